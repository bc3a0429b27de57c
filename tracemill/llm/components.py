"""Connected components by random-mate contraction, in SQL joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.session import materialize


def _folders(df: DataFrame) -> set[str]:
    return {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}


def _drop(df: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    spark = df.sparkSession
    for path in _folders(df):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def components(edges: DataFrame, u: str = "u", v: str = "v", seed: int = 17, max_rounds: int = 400) -> DataFrame:
    """(vertex, label) of every vertex with an edge to another; label is one vertex of its component.

    Each round every vertex draws a coin from its own name and the round; a tail with a
    head among its neighbours is collapsed into the smallest such head, edges are renamed,
    loops and doubles dropped. A vertex with an edge collapses with a chance of a quarter
    at least, so the rounds grow with the logarithm of the vertices. The contractions are
    unwound from the last round to the first. Edges with a null end and loops are ignored;
    repeated edges and both directions are the same edge. An empty table gives no rows.

    Neighbour minima are aggregated before the shuffle; the collapse maps are unique by
    vertex, so a hub is a skewed side of a join that adaptive execution splits. Each round
    is a written table: a lost executor costs one round at most. The round's number is a
    column and not a literal, so all rounds run the same compiled code.
    """
    spark = edges.sparkSession
    kind = edges.schema[u].dataType
    e = edges.select(F.col(u).cast(kind).alias("u"), F.col(v).cast(kind).alias("v")).filter("u is not null and v is not null and u <> v")
    e = materialize(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.lit(seed).alias("k")).distinct())
    head = lambda c: F.xxhash64(F.col(c), F.col("k")).bitwiseAND(1) == 1
    collapsed: list[DataFrame] = []
    while not e.isEmpty():
        if len(collapsed) == max_rounds:
            raise RuntimeError(f"edges are left after {max_rounds} rounds")
        mixed = e.filter(head("u") != head("v")).select(F.when(head("u"), F.col("v")).otherwise(F.col("u")).alias("tail"), F.when(head("u"), F.col("u")).otherwise(F.col("v")).alias("to"))
        step = materialize(mixed.groupBy("tail").agg(F.min("to").alias("to")))
        left = step.select(F.col("tail").alias("u"), F.col("to").alias("u2"))
        right = step.select(F.col("tail").alias("v"), F.col("to").alias("v2"))
        renamed = e.join(left, "u", "left").join(right, "v", "left").select(F.coalesce("u2", "u").alias("u"), F.coalesce("v2", "v").alias("v"), (F.col("k") + 1).alias("k")).filter("u <> v")
        nxt = materialize(renamed.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "k").distinct())
        _drop(e)
        collapsed.append(step)
        e = nxt
    _drop(e)
    if not collapsed:
        return spark.createDataFrame([], f"vertex {kind.simpleString()}, label {kind.simpleString()}")
    # From the last round to the first; each writes the labels of its own tails, and reads those of all later ones.
    written: list[DataFrame] = []
    for step in reversed(collapsed):
        here = step.select(F.col("tail").alias("vertex"), F.col("to").alias("label"))
        if written:
            later = _together(spark, written).select(F.col("vertex").alias("to"), F.col("label").alias("__label"))
            here = step.join(later, "to", "left").select(F.col("tail").alias("vertex"), F.coalesce("__label", "to").alias("label"))
        written.append(materialize(here))
        _drop(step)
    labels = _together(spark, written)
    return labels.unionByName(labels.select(F.col("label").alias("vertex")).distinct().withColumn("label", F.col("vertex")))


def _together(spark: SparkSession, tables: list[DataFrame]) -> DataFrame:
    """Written tables of one schema as one scan; empty ones have no files."""
    paths = [p for t in tables for p in _folders(t)]
    return spark.read.schema(tables[0].schema).parquet(*paths)
