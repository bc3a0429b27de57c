"""Session, table access and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "tracemill", master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables: a Parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def delivered_once(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table without the rows that were delivered again under the same key; wide columns are not shuffled for it.

    Rows are told apart by file and place. Only keys and places are grouped; the places to
    leave out are few, and their join with the table is a broadcast where their size, as
    measured at run time, allows it.
    """
    t = spark.read.parquet(f"{sf_dir}/{name}.parquet").select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("__at"))
    first = t.groupBy(key).agg(F.min("__at").alias("__first"), F.count("*").alias("__n")).filter("__n > 1").select(F.col(key).alias("__key"), "__first")
    again = t.select(key, "__at").join(first, F.col(key).eqNullSafe(F.col("__key"))).filter(F.col("__at") != F.col("__first")).select("__at")
    return t.join(again, "__at", "left_anti").drop("__at")


#: Bytes of input per core below which rows are dealt out by hand.
SMALL_INPUT = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out over all cores where the input is too small for file splits to do so.

    A file of one row group is one task however many cores wait. Only inputs of less than
    SMALL_INPUT bytes per core are shuffled, larger ones pass as they are; the rows are the same.
    With ``tracemill.spread`` set to false in the session none are.
    """
    if df.sparkSession.conf.get("tracemill.spread", "true") == "false":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(2 * cores) if int(str(size)) < cores * SMALL_INPUT else df


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor reaches, from ``spark.checkpoint.dir``.

    Only a purely local master without that setting gets a temporary folder; a
    cluster without it is an error, as a machine-local folder dies with its host.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        wanted = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not wanted:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            wanted = "file://" + tempfile.mkdtemp(prefix="tracemill-")
        sc.setCheckpointDir(wanted)
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def materialize(df: DataFrame, codec: str | None = None, tidy: bool = False) -> DataFrame:
    """Cut the lineage by a written table in the shared folder, computed once.

    ``DataFrame.checkpoint`` runs the plan twice (once to count, once to write); a
    Parquet table is written once, is compressed (by ``codec``, else as the session says),
    and is there for every executor. Spark drops the shuffle files of a plan when the
    driver collects its garbage; ``tidy`` asks for that now, so that the files of one
    large step are gone before the next.
    """
    path = f"{shared_folder(df.sparkSession)}/t-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec) if codec else df.write
    writer.parquet(path)
    if tidy:
        df.sparkSession.range(1).count()  # Spark's event queues hold the last plan until another one has run
        df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_materialized(spark: SparkSession) -> None:
    """Delete the tables that ``materialize`` wrote for this session; results that still read them are lost."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(folder):
        for f in fs.listStatus(folder):
            if f.getPath().getName().startswith("t-"):
                fs.delete(f.getPath(), True)
