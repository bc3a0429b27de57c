"""Best-of-N: one trace per problem by a selector, and what it brings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIE = ["rollout_id", "trace_id"]


def selectors() -> dict[str, list[Column]]:
    right = F.col("is_correct").desc()
    return {
        "shortest": [right, F.col("num_tokens").asc()],
        "longest": [right, F.col("num_tokens").desc()],
        "anchor": [right, F.col("post_answer_len").asc()],
        "dsr": [right, F.col("dsr").asc()],
        "quality": [right, F.col("quality_reward").desc()],
        "quality_any": [F.col("quality_reward").desc()],
    }


def best_of_n(a: DataFrame, selector: str) -> DataFrame:
    """The selected trace of every problem; ties go to the first. A row_number filter, so hot problems are pruned before the shuffle."""
    w = Window.partitionBy("problem_id").orderBy(*selectors()[selector], *TIE)
    return a.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def summary(chosen: DataFrame, name: str) -> DataFrame:
    return chosen.agg(F.lit(name).alias("selector"), F.count("*").alias("problems"), F.round(F.avg(F.col("is_correct").cast("double")), 6).alias("accuracy"), F.round(F.avg("num_tokens"), 6).alias("avg_tokens"), F.round(F.avg("dsr"), 6).alias("avg_dsr"), F.round(F.avg("quality_reward"), 6).alias("avg_quality"), F.round(F.avg("num_steps"), 6).alias("avg_steps")).select("selector", "problems", "accuracy", "avg_tokens", "avg_dsr", "avg_quality", "avg_steps")


def table_of_selectors(a: DataFrame) -> DataFrame:
    """A row per selector, and 'random' as the exact expectation of a uniform choice."""
    out = None
    for s in selectors():
        one = summary(best_of_n(a, s), s)
        out = one if out is None else out.unionByName(one)
    means = a.groupBy("problem_id").agg(F.avg(F.col("is_correct").cast("double")).alias("is_correct"), F.avg("num_tokens").alias("num_tokens"), F.avg("dsr").alias("dsr"), F.avg("quality_reward").alias("quality_reward"), F.avg("num_steps").alias("num_steps"))
    return out.unionByName(summary(means, "random"))


def majority(a: DataFrame) -> DataFrame:
    """Per problem the answer given most often (then the smallest), and of its traces the one with the best reward."""
    votes = a.filter("norm_answer <> ''").groupBy("problem_id", "norm_answer").agg(F.count("*").alias("votes"))
    w = Window.partitionBy("problem_id").orderBy(F.desc("votes"), "norm_answer")
    top = votes.withColumn("__k", F.row_number().over(w)).filter("__k = 1").select("problem_id", "norm_answer", "votes")
    mine = a.join(top, ["problem_id", "norm_answer"])
    v = Window.partitionBy("problem_id").orderBy(F.desc("quality_reward"), *TIE)
    return mine.withColumn("__k", F.row_number().over(v)).filter("__k = 1").select("problem_id", "norm_answer", "votes", *TIE, "is_correct", "quality_reward")
