"""Waste motifs: runs of dead steps found inside each trace's arrays, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.traces import KEYS, once, unique

TYPES = ["dead_cascade", "verification_theater", "abandoned_branch", "circular_revisit"]
MIN_CASCADE, REVISIT_SHARE = 3, 0.6


def _ints(c: Column) -> Column:
    return c.cast("array<int>")


def _places() -> Column:
    return F.when(F.size("steps") > 0, F.sequence(F.lit(0), F.size("steps") - 1)).otherwise(_ints(F.array()))


def _islands(members: Column) -> Column:
    """(first, length) of the runs of neighbouring numbers in a sorted array."""
    heads = F.filter(members, lambda i: ~F.array_contains(members, i - 1))
    tails = F.filter(members, lambda i: ~F.array_contains(members, i + 1))
    return F.zip_with(heads, tails, lambda a, b: F.struct(a.alias("first"), (b - a + 1).alias("length")))


def _motif(kind: str, first: Column, length: Column, severity: Column) -> Column:
    return F.struct(first.cast("int").alias("first_id"), F.lit(TYPES.index(kind)).alias("type_rank"), F.lit(kind).alias("motif_type"), length.cast("int").alias("length"), severity.cast("double").alias("severity"))


def with_motifs(p: DataFrame) -> DataFrame:
    """Adds ``motifs`` to parsed traces, by first step, then kind; an empty array where there is none.

    Each stage is a column of its own, done once a trace.
    """
    at = lambda i: F.element_at(F.col("steps"), i + 1)
    inputs = lambda i: F.element_at(F.col("edges"), i + 1)
    p = p.withColumn("__dead", once(F.filter(_places(), lambda i: ~F.array_contains("live", i))))
    p = p.withColumn("__theater", F.filter("__dead", lambda i: (at(i)["step_type"] == "verification") & ~F.arrays_overlap(inputs(i), F.col("live"))))
    p = p.withColumn("__stops", F.filter(_places(), lambda i: F.array_contains("live", i) | (at(i)["step_type"] == "exploration")))
    p = p.withColumn("__runs", _islands(F.col("__dead"))).withColumn("__theaters", _islands(F.col("__theater")))
    reach = F.transform(F.filter("__dead", lambda i: at(i)["step_type"] == "exploration"), lambda i: F.struct(i.alias("first"), (F.coalesce(F.try_element_at(F.filter("__stops", lambda j: j > i), F.lit(1)), F.size("steps")) - i).alias("length")))
    p = p.withColumn("__reach", reach)

    def revisits(i: Column) -> Column:
        own = at(i)["sym"]
        again = F.exists(F.col("live"), lambda j: (j < i) & (F.size(F.array_intersect(own, at(j)["sym"])) / F.size(own) >= REVISIT_SHARE))
        return at(i)["step_type"].isin("derivation", "computation") & (F.size(own) >= 2) & again

    p = p.withColumn("__again", F.filter("__dead", revisits))
    cascades = F.transform(F.filter("__runs", lambda r: r["length"] >= MIN_CASCADE), lambda r: _motif("dead_cascade", r["first"], r["length"], F.least(F.lit(1.0), r["length"] / 10)))
    theaters = F.transform("__theaters", lambda r: _motif("verification_theater", r["first"], r["length"], F.lit(0.8)))
    branches = F.transform(F.filter("__reach", lambda r: r["length"] >= 2), lambda r: _motif("abandoned_branch", r["first"], r["length"], F.least(F.lit(1.0), r["length"] / 8)))
    circular = F.transform("__again", lambda i: _motif("circular_revisit", i, F.lit(1), F.lit(0.6)))
    return p.withColumn("motifs", once(F.array_sort(F.concat(cascades, theaters, branches, circular)))).drop("__dead", "__theater", "__stops", "__runs", "__theaters", "__reach", "__again")


def motifs(p: DataFrame) -> DataFrame:
    """A row per motif with its neighbours: context_before is -1 at the start, context_after -1 at the end."""
    def row(m: Column, i: Column) -> Column:
        after = m["first_id"] + m["length"]
        return F.struct(i.alias("motif_seq"), m["motif_type"].alias("motif_type"), m["first_id"].alias("first_id"), m["length"].alias("length"), m["severity"].alias("severity"), (m["first_id"] - 1).alias("context_before_id"), F.when(after < F.size("steps"), after).otherwise(-1).alias("context_after_id"))

    return unique(with_motifs(p).select(*KEYS, F.transform("motifs", row).alias("__rows"))).select(*KEYS, F.explode("__rows").alias("__m")).select(*KEYS, "__m.*")


def count_of(kind: str) -> Column:
    return F.size(F.filter("motifs", lambda x: x["motif_type"] == kind))


def motif_summary(p: DataFrame) -> DataFrame:
    """Per trace: motifs, wasted steps, mean severity and counts by kind."""
    m = with_motifs(p)
    n = F.size("motifs")
    total = F.aggregate("motifs", F.lit(0), lambda a, x: a + x["length"])
    severity = F.aggregate("motifs", F.lit(0.0), lambda a, x: a + x["severity"])
    kinds = [count_of(t).cast("bigint").alias(t) for t in TYPES]
    summary = m.select(*KEYS, n.cast("bigint").alias("num_motifs"), total.cast("bigint").alias("wasted_steps"), F.when(n > 0, F.round(severity / n, 6)).otherwise(0.0).alias("mean_severity"), *kinds)
    return unique(summary)
