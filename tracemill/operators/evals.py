"""Evaluation of runs: metrics by benchmark, subject and level, and comparisons of two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def metrics(runs: DataFrame, *by: str) -> DataFrame:
    """(*by, benchmark, dim, key, total, correct, accuracy, avg_tokens) in one aggregation over grouping sets.

    Rows with an empty subject or level 0 count in their benchmark, but have no row of their own.
    """
    sets = [[*by, "benchmark"], [*by, "benchmark", "subject"], [*by, "benchmark", "level"]]
    g = runs.groupingSets(sets, *by, "benchmark", "subject", "level").agg(
        F.grouping_id().alias("g"), F.count("*").alias("total"), F.count_if("is_correct").alias("correct"), F.round(F.count_if("is_correct") / F.count("*"), 6).alias("accuracy"), F.round(F.avg("num_tokens"), 6).alias("avg_tokens")
    )
    dim = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "subject").otherwise("level")
    key = F.when(F.col("g") == 3, "").when(F.col("g") == 1, F.col("subject")).otherwise(F.col("level").cast("string"))
    return g.select(*by, "benchmark", dim.alias("dim"), key.alias("key"), "total", "correct", "accuracy", "avg_tokens").filter("dim = 'all' or (dim = 'subject' and key <> '') or (dim = 'level' and key <> '0')")


def compare(base: DataFrame, new: DataFrame, *by: str) -> DataFrame:
    """Differences of the metrics both runs have; ``by`` names the new run where there are several."""
    b = new.select(*by, "benchmark", "dim", "key", F.col("accuracy").alias("new_accuracy"), F.col("avg_tokens").alias("new_tokens"))
    j = base.join(b, ["benchmark", "dim", "key"])
    return j.select(*by, "benchmark", "dim", "key", F.col("accuracy").alias("base_accuracy"), "new_accuracy", F.round(F.col("new_accuracy") - F.col("accuracy"), 6).alias("accuracy_delta"), F.round(F.col("new_tokens") - F.col("avg_tokens"), 6).alias("tokens_delta"))


def _against_first(runs: DataFrame) -> DataFrame:
    """One row per problem and later run, beside the problem's run 0."""
    base = runs.filter("model = 0").select("id", F.col("is_correct").alias("ca"), F.col("num_tokens").alias("ta"))
    return base.join(runs.filter("model > 0").select("id", "model", F.col("is_correct").alias("cb"), F.col("num_tokens").alias("tb")), "id")


def disagreement(runs: DataFrame) -> DataFrame:
    """Who solved the problem, run 0 or each later one, by ``model``."""
    pairs = _against_first(runs)
    outcome = F.when(F.col("ca") & F.col("cb"), "both").when(F.col("ca"), "base_only").when(F.col("cb"), "new_only").otherwise("neither")
    return pairs.groupBy("model", outcome.alias("outcome")).agg(F.count("*").alias("n"), F.round(F.avg("ta"), 6).alias("base_tokens"), F.round(F.avg("tb"), 6).alias("new_tokens"))


def impact(runs: DataFrame) -> DataFrame:
    """Change of accuracy by how much shorter each later run is than run 0, by ``model``."""
    pairs = _against_first(runs)
    left = F.col("tb") / F.col("ta")
    bucket = F.when(left > 0.95, "under_5").when(left > 0.8, "under_20").when(left > 0.6, "under_40").otherwise("rest")
    return pairs.filter("ta > 0").groupBy("model", bucket.alias("reduction")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("cb").cast("double")) - F.avg(F.col("ca").cast("double")), 6).alias("accuracy_delta"))


def numbered(scored: DataFrame) -> DataFrame:
    """``trace_id`` counted on over all rollouts of a problem, in order of rollout_id, as annotations are numbered.

    Offsets come from one row per rollout, so a problem with very many traces is not gathered in a window.
    """
    sizes = scored.groupBy("problem_id", "rollout_id").agg((F.max("trace_id") + 1).alias("n"))
    before = Window.partitionBy("problem_id").orderBy("rollout_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("problem_id", "rollout_id", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int").alias("__before"))
    return scored.join(offsets, ["problem_id", "rollout_id"]).withColumn("trace_id", F.col("trace_id") + F.col("__before")).drop("__before")


def levels(scored: DataFrame, annotated: DataFrame) -> DataFrame:
    """Scores of all rollouts beside the latest delivered ones of the same trace; NaN counts as absent."""
    w = Window.partitionBy("problem_id", "trace_id").orderBy(F.col("annotated_at").desc_nulls_last(), F.col("quality_reward").desc_nulls_last(), F.col("dsr").asc_nulls_last())
    l2 = annotated.select("problem_id", "trace_id", "dsr", "quality_reward", "annotated_at").withColumn("k", F.row_number().over(w)).filter("k = 1")
    l2 = l2.select("problem_id", "trace_id", F.col("dsr").alias("l2_dsr"), F.when(~F.isnan("quality_reward"), F.col("quality_reward")).alias("l2_quality"))
    return numbered(scored).join(l2, ["problem_id", "trace_id"], "left")
