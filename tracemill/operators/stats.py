"""Grouped statistics of problems and traces, rank tests, histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.session import materialize


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson's r of the rows that have both values; null where either does not vary."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    both = lambda x: F.when(a.isNotNull() & b.isNotNull(), x)
    spread = F.stddev_pop(both(a)) * F.stddev_pop(both(b))
    return F.when(spread > 0, F.covar_pop(a, b) / spread)


def categories(a: DataFrame) -> DataFrame:
    """Per problem: traces, correct ones, and saturated / partial / all_incorrect."""
    g = a.groupBy("problem_id").agg(F.count("*").alias("n"), F.count_if("is_correct").alias("n_correct"))
    return g.withColumn("category", F.when(F.col("n_correct") == F.col("n"), "saturated").when(F.col("n_correct") > 0, "partial").otherwise("all_incorrect"))


def variance_by_category(a: DataFrame) -> DataFrame:
    """For problems with two correct traces or more: variances of outcome and of structural reward, by category."""
    right = F.col("is_correct")
    g = a.groupBy("problem_id").agg(
        F.count("*").alias("n"),
        F.count_if("is_correct").alias("n_correct"),
        F.var_pop(right.cast("double")).alias("outcome_var"),
        F.var_pop(F.when(right, 1 - F.col("dsr"))).alias("struct_var"),
        (F.max(F.when(right, F.col("dsr"))) - F.min(F.when(right, F.col("dsr")))).alias("dsr_range"),
        F.var_pop(F.when(right, F.col("live_verification_rate"))).alias("lvr_var"),
    ).filter("n_correct >= 2")
    g = materialize(g.withColumn("category", F.when(F.col("n_correct") == F.col("n"), "saturated").otherwise("partial")))
    middle = medians(g, "struct_var", "category", ["saturated", "partial"]).select("category", r6("median").alias("median_struct_var"))
    means = g.groupBy("category").agg(F.count("*").alias("problems"), r6(F.avg("outcome_var")).alias("mean_outcome_var"), r6(F.avg("struct_var")).alias("mean_struct_var"), r6(F.avg("dsr_range")).alias("mean_dsr_range"), r6(F.avg("lvr_var")).alias("mean_lvr_var"), r6(F.avg((F.col("struct_var") > 0.001).cast("double"))).alias("share_nonzero"))
    return means.join(F.broadcast(middle), "category", "left")  # a row for each category


def signal_preservation(a: DataFrame) -> DataFrame:
    """Structural variance of saturated problems against that of partial ones, with its label."""
    v = variance_by_category(a)
    one = v.agg(F.max(F.when(F.col("category") == "saturated", F.col("mean_struct_var"))).alias("saturated_var"), F.max(F.when(F.col("category") == "partial", F.col("mean_struct_var"))).alias("partial_var"))
    ratio = F.when(F.col("partial_var") > 0, F.col("saturated_var") / F.col("partial_var"))
    return one.select("saturated_var", "partial_var", r6(ratio).alias("preservation"), F.when(ratio > 0.5, "strong").when(ratio > 0.1, "moderate").otherwise("weak").alias("label"))


def buckets(value: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the half-open bucket a value is in; the last bucket is open above."""
    out = F.when(value < edges[0], labels[0])
    for e, lab in zip(edges[1:], labels[1:]):
        out = out.when(value < e, lab)
    return out.otherwise(labels[-1])


def filled(df: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """Counts by label with a zero row for absent labels."""
    every = df.sparkSession.createDataFrame([(x,) for x in labels], f"{column} string")
    return every.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def medians(df: DataFrame, value: str, group: str, groups: list) -> DataFrame:
    """(group, median) of the groups that have values: the mean of the two middle ones, from prefix sums of counts, so no task holds a group."""
    t = rank_table(df, value, F.col(group), groups, cumulate=True)
    sides = [F.struct(F.lit(g).alias(group), F.col(f"n{i}").alias("n"), F.col(f"upto{i}").alias("upto")) for i, g in enumerate(groups)]
    rows = t.select("value", F.explode(F.array(*sides)).alias("x")).select("value", "x.*").filter("n > 0")
    total = rows.groupBy(group).agg(F.sum("n").alias("total"))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    hit = lambda at: F.max(F.when((F.col("upto") >= at) & (F.col("upto") - F.col("n") < at), F.col("value")))
    return rows.join(F.broadcast(total), group).groupBy(group).agg(((hit(low) + hit(high)) / 2).alias("median"))


def rank_table(df: DataFrame, value: str, group: Column, groups: list, parts: int | None = None, cumulate: bool = False) -> DataFrame:
    """(value, size of every group, average rank): ranks over the whole table without one task that sorts it.

    Values are counted first, then range-partitioned; a prefix sum over the partitions
    gives each its offset. The partitioned counts are a written table, so both passes see
    the same partitions. With ``cumulate`` ``upto0``, ``upto1``... count each group's
    values up to here.
    """
    counts = [F.count_if(group == g).alias(f"n{i}") for i, g in enumerate(groups)]
    by_value = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(*counts)
    n = reduce(lambda x, y: x + y, [F.col(f"n{i}") for i in range(len(groups))])
    own = by_value.withColumn("n", n)
    split = own.repartitionByRange(parts, "value") if parts else own.repartitionByRange("value")
    split = materialize(split.withColumn("part", F.spark_partition_id()))
    if cumulate:
        own = [f"n{i}" for i in range(len(groups))]
        sums = split.groupBy("part").agg(*[F.sum(c).alias(f"s_{c}") for c in own])
        first = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
        before = sums.select("part", *[F.coalesce(F.sum(f"s_{c}").over(first), F.lit(0)).alias(f"b_{c}") for c in own])
        here = Window.partitionBy("part").orderBy("value")
        return split.withColumns({f"w_{c}": F.sum(c).over(here) for c in own}).join(before, "part").select("value", *own, *[(F.col(f"w_{c}") + F.col(f"b_{c}")).alias(f"upto{i}") for i, c in enumerate(own)])
    sums = split.groupBy("part").agg(F.sum("n").alias("s"))
    before = sums.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = split.withColumn("below", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(before, "part")
    return ranked.withColumn("rank", F.col("offset") + F.col("below") + (F.col("n") + 1) / 2).drop("part", "offset", "below")


def mann_whitney(df: DataFrame, value: str, flag: str) -> DataFrame:
    """One row: U of the flagged rows, its z with tie and continuity correction."""
    t = rank_table(df, value, F.col(flag), [True, False])
    s = t.agg(F.sum("n0").alias("a"), F.sum("n1").alias("b"), F.sum(F.col("n0") * F.col("rank")).alias("ranks"), F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("ties"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    n = a + b
    u = F.col("ranks") - a * (a + 1) / 2
    var = a * b / 12.0 * (n + 1 - F.col("ties") / (n * (n - 1)))
    gap = F.abs(u - a * b / 2) - 0.5
    return s.select(u.alias("u"), F.when(var > 0, F.greatest(gap, F.lit(0.0)) / F.sqrt(var)).otherwise(0.0).alias("z"))


def kruskal_wallis(df: DataFrame, value: str, group: str, groups: list) -> DataFrame:
    """One row: H with tie correction over the given groups, and its degrees of freedom; a group without rows counts for neither."""
    t = rank_table(df, value, F.col(group), groups)
    sums = t.agg(*[F.sum(f"n{i}").cast("double").alias(f"n{i}") for i in range(len(groups))], *[F.sum(F.col(f"n{i}") * F.col("rank")).alias(f"r{i}") for i in range(len(groups))], F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("ties"))
    n = reduce(lambda x, y: x + y, [F.col(f"n{i}") for i in range(len(groups))])
    part = reduce(lambda x, y: x + y, [F.when(F.col(f"n{i}") > 0, F.col(f"r{i}") * F.col(f"r{i}") / F.col(f"n{i}")).otherwise(0.0) for i in range(len(groups))])
    h = (12.0 / (n * (n + 1)) * part - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    there = reduce(lambda x, y: x + y, [(F.col(f"n{i}") > 0).cast("int") for i in range(len(groups))])
    return sums.select(r6(h).alias("h"), (there - 1).alias("df"))


def cohens_d(df: DataFrame, value: str, flag: str) -> DataFrame:
    """One row: means of flagged and other rows, their difference, and Cohen's d with the mean of both variances."""
    on, off = F.when(F.col(flag), F.col(value)), F.when(~F.col(flag), F.col(value))
    s = df.agg(F.avg(on).alias("mean_1"), F.avg(off).alias("mean_0"), F.var_pop(on).alias("v1"), F.var_pop(off).alias("v0"))
    pooled = F.sqrt((F.col("v1") + F.col("v0")) / 2)
    return s.select(r6("mean_1").alias("mean_1"), r6("mean_0").alias("mean_0"), r6(F.col("mean_1") - F.col("mean_0")).alias("diff"), r6(F.when(pooled > 0, (F.col("mean_1") - F.col("mean_0")) / pooled).otherwise(0.0)).alias("cohens_d"))
