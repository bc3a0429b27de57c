"""Writers of what pipelines hand on: annotations, rollouts, shards, evaluations, training sets, summaries, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import fixed, text
from tracemill.operators.traces import KEYS, unique

#: Most rows of a report or summary, which the driver renders.
REPORT_ROWS = 10_000


def annotations(p: DataFrame) -> DataFrame:
    """Metrics of parsed traces with dead-step ratios by type as a map, without texts."""
    n = F.size("steps")
    verif = F.filter("steps", lambda s: s["step_type"] == "verification")
    live_v = F.size(F.filter(verif, lambda s: F.array_contains("live", s["id"])))
    of = lambda t: F.filter("steps", lambda s: s["step_type"] == t)
    dead = lambda t: F.size(F.filter(of(t), lambda s: ~F.array_contains("live", s["id"])))
    entries = F.filter(F.transform(F.array(*[F.lit(t) for t in fixed.STEP_TYPES]), lambda t: F.struct(t.alias("key"), F.when(F.size(of(t)) > 0, dead(t) / F.size(of(t))).alias("value"))), lambda e: e["value"].isNotNull())
    return unique(
        p.select(
            *KEYS,
            "is_correct",
            n.cast("bigint").alias("num_steps"),
            F.when(n > 0, (n - F.size("live")) / n).otherwise(0.0).alias("dsr"),
            F.map_from_entries(entries).alias("typed_dsr"),
            F.when(n > 0, F.size(verif) / n).otherwise(0.0).alias("verification_density"),
            F.when(n == 0, 0.0).when(F.size(verif) > 0, live_v / F.size(verif)).otherwise(1.0).alias("live_verification_rate"),
            F.when(n > 0, F.length("solution")).otherwise(0).cast("bigint").alias("trace_length"),
        )
    )


def write_json(df: DataFrame, path: str, order: str | None = None) -> None:
    """JSON lines; sorted over all parts where ``order`` is given, by ranges and not in one task."""
    (df.orderBy(order) if order else df).write.mode("overwrite").json(path)


def write_evaluation(results: DataFrame, metrics: DataFrame, path: str) -> None:
    """An evaluation as two tables: results and metrics."""
    write_json(results, f"{path}/results")
    write_json(metrics, f"{path}/metrics")


def write_training_sets(variants: DataFrame, questions: DataFrame, stats: DataFrame, path: str) -> None:
    """Cleaned variants as training records, a folder each, with dataset_stats and dataset_info beside them.

    ``variants`` has problem_id, variant and cleaned; ``questions`` problem_id and question; ``stats`` is one row.
    """
    records = variants.join(questions, "problem_id").select("variant", text.sft_record(F.col("question"), F.col("cleaned")).alias("r")).select("variant", "r.*")
    records.write.mode("overwrite").partitionBy("variant").json(f"{path}/cleaned")
    write_summary(stats, f"{path}/dataset_stats.json")
    info = {k: {"file_name": f"cleaned/variant={k}", "formatting": "sharegpt", "columns": {"messages": "conversations", "system": "system"}} for k in fixed.POLICIES}
    put(stats.sparkSession, f"{path}/dataset_info.json", json.dumps(info, indent=2))


def put(spark: SparkSession, path: str, content: str) -> None:
    """A small file written by the driver, on any file system that Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def _few(df: DataFrame) -> list:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"more than {REPORT_ROWS} rows: write it with write_json")
    return rows


def write_summary(df: DataFrame, path: str) -> None:
    """A small result as one JSON document: an object for one row, else a list."""
    rows = [json.loads(r.j) for r in _few(df.select(F.to_json(F.struct("*")).alias("j")))]
    put(df.sparkSession, path, json.dumps(rows[0] if len(rows) == 1 else rows, indent=2, ensure_ascii=False))


def markdown(df: DataFrame, title: str) -> str:
    """A small result as a table under a title."""
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else f"{v:g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in _few(df))]) + "\n"


def comparison(deltas: DataFrame, base: str, new: str) -> str:
    """The report of two evaluations: accuracies, tokens and their signed differences by benchmark, subject and level."""
    p = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    name = F.when(F.col("dim") == "all", F.concat(F.lit("**"), "benchmark", F.lit("** accuracy"))).otherwise(F.concat_ws(" ", "benchmark", "dim", "key"))
    shown = deltas.orderBy("dim", "benchmark", "key").select(name.alias(" "), p("base_accuracy").alias(f"{base} (baseline)"), p("new_accuracy").alias(new), text.delta_label(F.col("base_accuracy"), F.col("new_accuracy")).alias("Δ"), text.delta_label(F.lit(0.0), F.col("tokens_delta"), percent=False).alias("Δ tokens"))
    return markdown(shown, "Comparison report")


def write_report(spark: SparkSession, path: str, *parts: str) -> None:
    put(spark, path, "\n".join(parts))


def write_sample(df: DataFrame, order: list, path: str, n: int = 50) -> None:
    """The first ``n`` rows in order, as one JSON document: a sample for reading."""
    write_summary(df.orderBy(*order).limit(n), path)
