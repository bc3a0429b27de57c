"""Train, validation and test splits that keep tied records together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.components import components
from tracemill.session import materialize

#: Fixed value: what says, in any letter case and with outer blanks, that a value is not known.
NOT_KNOWN = ("", "-", "--", "?", ".", "unknown", "not known", "unk", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "anonymous", "anon", "anon.", "missing", "unspecified", "not specified", "undefined", "not available", "not given", "no author", "no source", "tbd", "other", "various", "x", "0")
PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def known(column: str) -> Column:
    """The value without outer blanks and letter case; null where it is absent or says nothing."""
    value = F.lower(F.regexp_replace(F.col(column), r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", ""))
    return F.when(~value.isin(*NOT_KNOWN), value)


def problem_number(column: str = "problem_id") -> Column:
    """The number written in a problem's name, however it is spelled; null without one."""
    digits = F.regexp_extract(F.col(column), r"(\d+)", 1)
    return F.when(digits != "", F.expr("try_cast(" + f"regexp_extract(`{column}`, '([0-9]+)', 1)" + " as bigint)"))


def tied_groups(df: DataFrame, key: str, ties: dict[str, Column], number: Column | None = None) -> DataFrame:
    """(key, component, number): the component of every record tied to others by equal values of any tie.

    Vertices are the ties' values, not the records: each record ties its values in a
    chain, equal chains are one, so a value that a third of the rows share is one vertex
    and its edges are as many as it has distinct neighbours. A record without any value
    has a null component. Rows with the same key count once; a null key is kept as such.
    """
    names = list(ties)
    rows = df.select(F.col(key).alias("__key"), *[F.when(c.isNotNull(), F.concat(F.lit(f"{n}:"), c.cast("string"))).alias(f"__{n}") for n, c in ties.items()], (number if number is not None else F.lit(None).cast("bigint")).alias("__number")).distinct()
    values = F.filter(F.array(*[F.col(f"__{n}") for n in names]), lambda x: x.isNotNull())
    rows = materialize(rows.withColumn("__values", values))
    chain = F.transform(F.sequence(F.lit(1), F.size("__values") - 1), lambda i: F.struct(F.element_at("__values", i).alias("u"), F.element_at("__values", i + 1).alias("v")))
    edges = rows.filter(F.size("__values") > 1).select(F.explode(chain).alias("__e")).select("__e.u", "__e.v").distinct()
    label = components(edges)
    own = rows.select("__key", "__number", F.try_element_at("__values", F.lit(1)).alias("vertex"))
    return own.join(label, "vertex", "left").select(F.col("__key").alias(key), F.coalesce("label", "vertex").alias("component"), F.col("__number").alias("number"))


def pair_groups(pairs: DataFrame) -> DataFrame:
    """(pair_id, component, number) of preference pairs tied by problem number, origin_id or author_id."""
    number = problem_number()
    return tied_groups(pairs, "pair_id", {"p": number, "o": known("origin_id"), "a": known("author_id")}, number)


def named_groups(pairs: DataFrame) -> DataFrame:
    """(pair_id, group_id): the smallest problem number written in the group; pairs of groups without one are left out."""
    g = materialize(pair_groups(pairs))
    least = g.filter("component is not null and number is not null").groupBy("component").agg(F.min("number").alias("group_id"))
    return g.join(least, "component").select("pair_id", "group_id").distinct()


def assign(groups: DataFrame, key: str, proportions: dict[str, float] | None = None, bucket_rows: int = 50_000, seed: int = 17) -> DataFrame:
    """(key, component, split): components laid end to end by falling weight, each in the split where it begins.

    A component's weight is its number of keys; a key without a component is one of its
    own. Large components come first and fall into the first split; the many small ones
    fill the others to their proportions. Positions are prefix sums in two steps, over
    (weight, bucket) and inside a bucket of about ``bucket_rows`` components, so no task
    sees all components: distinct weights are at most the root of twice the rows.
    """
    p = proportions or PROPORTIONS
    total = sum(p.values())
    one = groups.withColumn("__c", F.coalesce("component", F.concat(F.lit("k:"), F.col(key).cast("string")), F.lit("k:")))
    weight = one.groupBy("__c").agg(F.countDistinct(key).alias("__w")).withColumn("__w", F.greatest("__w", F.lit(1)))
    weight = materialize(weight)
    buckets = 1 + weight.count() // bucket_rows
    weight = weight.withColumn("__b", F.pmod(F.xxhash64("__c", F.lit(seed)), F.lit(buckets)))
    cells = weight.groupBy("__w", "__b").agg(F.sum("__w").alias("__sum"))
    by_weight = cells.groupBy("__w").agg(F.sum("__sum").alias("__all"))
    run = Window.orderBy(F.desc("__w")).rowsBetween(Window.unboundedPreceding, -1)
    before_w = by_weight.select("__w", F.coalesce(F.sum("__all").over(run), F.lit(0)).alias("__before"), F.sum("__all").over(Window.partitionBy()).alias("__total"))
    in_w = Window.partitionBy("__w").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before_b = cells.select("__w", "__b", F.coalesce(F.sum("__sum").over(in_w), F.lit(0)).alias("__before_b"))
    rank = F.row_number().over(Window.partitionBy("__w", "__b").orderBy("__c")) - 1
    place = weight.withColumn("__r", rank).join(before_w, "__w").join(before_b, ["__w", "__b"])
    at = (F.col("__before") + F.col("__before_b") + F.col("__r") * F.col("__w")) / F.col("__total")
    bound, split = 0.0, None
    names = list(p)
    for name in names[:-1]:
        bound += p[name] / total
        split = F.when(at < bound, name) if split is None else split.when(at < bound, name)
    split = F.lit(names[-1]) if split is None else split.otherwise(names[-1])
    return one.join(place.select("__c", split.alias("split")), "__c").select(key, F.col("__c").alias("component"), "split").distinct()
