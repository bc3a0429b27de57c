"""Traces, their steps, dependency graphs and liveness: the spine of the engine.

One row per trace, steps in an array: everything here is narrow. Edges look back at most
ten steps, so liveness is one reverse fold per trace and needs no join and no iteration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import fixed, text
from tracemill.session import delivered_once, spread, table

KEYS = ["problem_id", "rollout_id", "trace_id"]


def flatten(rollouts: DataFrame) -> DataFrame:
    """One row per sampled trace, missing fields with their defaults.

    ``trace_id`` is the trace's place in its rollout. Null and empty ``traces`` give no row.
    Twice delivered rollouts are still there twice: to tell them apart here would shuffle
    all texts. ``unique`` drops them from the narrow rows that come of the texts.
    """
    t = rollouts.select("problem_id", "rollout_id", F.coalesce("problem_text", F.lit("")).alias("problem_text"), F.coalesce("ground_truth", F.lit("")).alias("ground_truth"), "shard", F.posexplode("traces").alias("trace_id", "t"))
    solution = F.coalesce("t.solution", F.lit(""))
    return t.select(*KEYS, "problem_text", "ground_truth", "shard", solution.alias("solution"), F.coalesce("t.answer", F.lit("")).alias("answer"), F.coalesce("t.is_correct", F.lit(False)).alias("is_correct"), F.coalesce("t.num_tokens", text.word_count(solution)).cast("bigint").alias("num_tokens"))


def unique(df: DataFrame, *more: str) -> DataFrame:
    """Rows of one trace (and of one further key) once; what came of a twice delivered rollout is equal."""
    return df.dropDuplicates([*KEYS, *more])


def traces(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "rollouts").select("rollout_id", "problem_id", "problem_text", "ground_truth", "shard", "traces")
    return flatten(spread(rows))


def single(spark: SparkSession, d: str) -> DataFrame:
    """Every trace once, for what carries texts on: rollouts that were delivered again are left out before their texts are read."""
    return flatten(spread(delivered_once(spark, d, "rollouts", "rollout_id").select("rollout_id", "problem_id", "problem_text", "ground_truth", "shard", "traces")))


def once(c: Column) -> Column:
    """The same values, evaluated once per row.

    The optimiser copies a column's expression into what uses it, and splits structs into
    fields it copies one by one; inside a loop over steps that repeats the whole text
    analysis per element. An expression that is not deterministic by its kind (this one's
    result is) is never copied.
    """
    return F.when(F.monotonically_increasing_id() >= 0, c)


def _step(x: Column, i: Column) -> Column:
    return F.struct(i.alias("id"), text.step_type(x["p"], x["low"]).alias("step_type"), x["p"].alias("content"), F.length(x["p"]).alias("char_length"), text.symbols(x["p"]).alias("sym"))


def step_array(solution: Column) -> Column:
    """array<struct<id, step_type, content, char_length, sym>> of a text."""
    return F.transform(F.transform(text.segments(solution), lambda p: F.struct(p.alias("p"), F.lower(p).alias("low"))), _step)


def edge_array(steps: Column) -> Column:
    """For every step the earlier steps it builds on: the neighbour in a chain, those that share a symbol within ten steps, and for a lone conclusion the step before."""
    chain = F.array(*[F.lit(t) for t in fixed.CHAIN_TYPES])

    def inputs(s: Column, i: Column) -> Column:
        prior = F.try_element_at(steps, i)  # element_at counts from 1: the step before
        linked = (i > 0) & F.array_contains(chain, s["step_type"]) & F.array_contains(chain, prior["step_type"])
        first = F.when(linked, F.array(i - 1)).otherwise(F.array().cast("array<int>"))
        back = F.when(i > 0, F.sequence(F.greatest(F.lit(0), i - fixed.LOOKBACK), i - 1)).otherwise(F.array().cast("array<int>"))
        shared = F.filter(back, lambda j: F.arrays_overlap(F.element_at(steps, j + 1)["sym"], s["sym"]) & ~(linked & (j == i - 1)))
        both = F.concat(first, shared)
        return F.when((s["step_type"] == "conclusion") & (F.size(both) == 0) & (i > 0), F.array(i - 1)).otherwise(both)

    return F.transform(steps, inputs)


def conclusion_ids(steps: Column) -> Column:
    """Steps typed as conclusions, else the last step; empty for no steps."""
    own = F.transform(F.filter(steps, lambda s: s["step_type"] == "conclusion"), lambda s: s["id"])
    return F.when(F.size(own) > 0, own).when(F.size(steps) > 0, F.array(F.size(steps) - 1)).otherwise(F.array().cast("array<int>"))


def live_ids(edges: Column, seeds: Column) -> Column:
    """Steps from which a conclusion is reached, by one fold from the last step to the first."""
    back = F.when(F.size(edges) > 0, F.reverse(F.sequence(F.lit(0), F.size(edges) - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.aggregate(back, seeds, lambda acc, i: F.when(F.array_contains(acc, i), F.array_union(acc, F.element_at(edges, i + 1))).otherwise(acc)))


def parse(df: DataFrame, solution: str = "solution") -> DataFrame:
    """Adds steps, edges, conclusions and live: arrays of one row per trace, no shuffle.

    Null and blank texts have empty arrays.
    """
    df = df.withColumn("steps", once(step_array(F.col(solution))))
    df = df.withColumn("edges", once(edge_array(F.col("steps")))).withColumn("conclusions", conclusion_ids(F.col("steps")))
    return df.withColumn("live", once(live_ids(F.col("edges"), F.col("conclusions"))))


def parsed(spark: SparkSession, d: str) -> DataFrame:
    return parse(traces(spark, d))


def exploded(p: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row per step: id, type, length, symbols, inputs, is_live."""
    rows = F.transform("steps", lambda s, i: F.struct(i.alias("step_id"), s["step_type"].alias("step_type"), s["char_length"].alias("char_length"), s["sym"].alias("sym"), F.element_at(F.col("edges"), i + 1).alias("inputs"), F.array_contains("live", i).alias("is_live")))
    return unique(p.select(*KEYS, *(extra or []), rows.alias("__rows"))).select(*KEYS, *(extra or []), F.explode("__rows").alias("__s")).select(*KEYS, *(extra or []), "__s.*")


def annotate(p: DataFrame) -> DataFrame:
    """Metrics of every trace: steps, dead-step ratio, verification density, live verification rate, length. Traces without steps have zeros."""
    n = F.size("steps")
    dead = n - F.size("live")
    verif = F.filter("steps", lambda s: s["step_type"] == "verification")
    n_v = F.size(verif)
    live_v = F.size(F.filter(verif, lambda s: F.array_contains("live", s["id"])))
    some = n > 0
    metrics = p.select(
        *KEYS,
        "is_correct",
        "num_tokens",
        n.cast("bigint").alias("num_steps"),
        dead.cast("bigint").alias("num_dead"),
        F.when(some, dead / n).otherwise(0.0).alias("dsr"),
        F.when(some, n_v / n).otherwise(0.0).alias("verification_density"),
        F.when(~some, 0.0).when(n_v > 0, live_v / n_v).otherwise(1.0).alias("live_verification_rate"),
        F.when(some, F.length("solution")).otherwise(0).cast("bigint").alias("trace_length"),
    )
    return unique(metrics)


def typed_dsr(p: DataFrame) -> DataFrame:
    """Per trace and step type present: total, dead, ratio."""
    rows = F.transform(F.array(*[F.lit(t) for t in fixed.STEP_TYPES]), lambda t: F.struct(t.alias("step_type"), F.size(F.filter("steps", lambda s: s["step_type"] == t)).cast("bigint").alias("total"), F.size(F.filter("steps", lambda s: (s["step_type"] == t) & ~F.array_contains("live", s["id"]))).cast("bigint").alias("dead")))
    return unique(p.select(*KEYS, F.filter(rows, lambda r: r["total"] > 0).alias("rows"))).select(*KEYS, F.explode("rows").alias("r")).select(*KEYS, "r.*").withColumn("ratio", F.col("dead") / F.col("total"))
