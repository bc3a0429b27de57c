"""Kinds of dead steps, and rewards that weigh them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import fixed
from tracemill.operators.traces import KEYS, once, unique

REVISIT_JACCARD, SHARED_SYMBOLS = 0.6, 2


def _kind(i: Column) -> Column:
    """The kind of dead step i; null for a live one. The first rule that holds decides."""
    at = lambda k: F.element_at(F.col("steps"), k + 1)
    kind, own = at(i)["step_type"], at(i)["sym"]
    inputs = F.element_at(F.col("edges"), i + 1)
    live = lambda k: F.array_contains("live", k)
    theater = F.when(F.size(inputs) > 0, ~F.arrays_overlap(inputs, F.col("live"))).when(i > 0, ~live(i - 1)).otherwise(False)
    shared = lambda k: F.size(F.array_intersect(own, at(k)["sym"]))
    some = F.size(own) > 0
    jaccard = lambda k: shared(k) / (F.size(own) + F.size(at(k)["sym"]) - shared(k))
    revisit = some & F.exists(F.col("live"), lambda k: (F.size(at(k)["sym"]) > 0) & (jaccard(k) >= REVISIT_JACCARD))
    useful = some & F.exists(F.col("live"), lambda k: (k > i) & (shared(k) >= SHARED_SYMBOLS))
    return (
        F.when(live(i), None)
        .when(kind == "verification", F.when(theater, "verification_theater").otherwise("redundant_verification"))
        .when(kind.isin("computation", "derivation") & revisit, "circular_revisit")
        .when(kind.isin("exploration", "derivation", "computation") & useful, "productive_dead_end")
        .when(kind == "exploration", "wasteful_exploration")
        .when(kind == "correction", "failed_correction")
        .when(kind == "computation", "abandoned_computation")
        .otherwise("generic_dead")
    )


def with_quality(p: DataFrame) -> DataFrame:
    """Adds ``quality``: for each step its kind of deadness, null where live."""
    places = F.when(F.size("steps") > 0, F.sequence(F.lit(0), F.size("steps") - 1)).otherwise(F.array().cast("array<int>"))
    return p.withColumn("quality", once(F.transform(places, _kind)))


def dead_steps(p: DataFrame) -> DataFrame:
    """A row per dead step with its kind and penalty."""
    rows = F.transform("quality", lambda k, i: F.struct(i.alias("step_id"), F.element_at(F.col("steps"), i + 1)["step_type"].alias("step_type"), k.alias("quality")))
    d = unique(with_quality(p).select(*KEYS, F.filter(rows, lambda r: r["quality"].isNotNull()).alias("rows"))).select(*KEYS, F.explode("rows").alias("r")).select(*KEYS, "r.*")
    return d.withColumn("penalty", penalty(F.col("quality")))


def penalty(kind: Column) -> Column:
    table = F.create_map(*[x for k, v in fixed.PENALTY.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(table[kind], F.lit(0.3))


def count_of(kind: str) -> Column:
    return F.size(F.filter("quality", lambda x: x == kind))


def rewards(p: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Per trace: the reward 1 - penalties / steps within [0, 1] (1 without steps) and dead steps by kind."""
    w = with_quality(p)
    kinds = {k: count_of(k) for k in fixed.PENALTY}
    # Sums by kind in a fixed order, so that every engine adds the same numbers.
    cost = sum((n * F.lit(fixed.PENALTY[k]) for k, n in kinds.items()), F.lit(0.0))
    n = F.size("steps")
    reward = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - cost / n))).otherwise(1.0)
    return unique(w.select(*KEYS, *(extra or []), F.round(reward, 9).alias("quality_reward"), *[c.cast("bigint").alias(k) for k, c in kinds.items()]))
