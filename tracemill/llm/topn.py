"""The N best rows of every group, with one rule for ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], at: str, tie: list[Column]) -> DataFrame:
    """The row of each key with the greatest ``at`` (null before all), ties by ``tie``.

    The rank filter becomes a group limit before and after the shuffle, so of a key
    that came a million times a map task sends one row.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last(), *tie)
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank <= 1").drop("__rank")


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int = 3, rank: str = "rank") -> DataFrame:
    """The first n rows of each group by ``order``, with their ``rank`` (from 1).

    ``order`` should end in a column that is unique in the group; rows equal in all
    order columns are ranked in an arbitrary but single order. Null groups form a group.
    A group of any size is pruned to n rows by every map task before the shuffle
    (the optimiser's group limit), so no task holds a hot group. Groups with fewer than
    n rows give all of them; an empty table gives none; n < 1 gives none.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def best_traces(annotated: DataFrame, n: int = 3) -> DataFrame:
    """Per problem the n traces with the highest quality_reward (then lowest dsr, nulls last, then trace_id).

    Of several rows of a trace the one annotated last counts; a trace whose counting row
    has a null or NaN reward is left out. Rows of a null problem or trace stay a group of
    their own. Equal rows count once.
    """
    rows = annotated.select("problem_id", "trace_id", "quality_reward", "dsr", "annotated_at")
    last = latest(rows, ["problem_id", "trace_id"], "annotated_at", [F.col("quality_reward").desc_nulls_last(), F.col("dsr").asc_nulls_last()])
    scored = last.filter(F.col("quality_reward").isNotNull() & ~F.isnan("quality_reward"))
    return top_n(scored, ["problem_id"], [F.col("quality_reward").desc(), F.col("dsr").asc_nulls_last(), F.col("trace_id").asc()], n)
