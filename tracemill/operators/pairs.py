"""Preference pairs: capped joins of traces inside a problem.

Where pairs come in (chosen, rejected) order and only the first k count, no more than the
first k of each side can take part; both sides are cut to k by a group limit before the
join, so a problem with millions of traces joins k with k rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.motifs import with_motifs
from tracemill.operators.traces import once, unique
from tracemill.session import materialize

ORDER = ["rollout_id", "trace_id"]
CONTRASTED = ["dead_cascade", "verification_theater", "abandoned_branch"]


def _first(df: DataFrame, k: int, order: list | None = None, by: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*(by or ["problem_id"])).orderBy(*(order or ORDER))
    return df.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= k).drop("__k")


def _side(df: DataFrame, name: str) -> DataFrame:
    return df.select("problem_id", F.col("rollout_id").alias(f"{name}_rollout_id"), F.col("trace_id").alias(f"{name}_trace_id"), F.col("dsr").alias(f"{name}_dsr"), F.col("is_correct").alias(f"{name}_correct"))


def _capped(chosen: DataFrame, rejected: DataFrame, kind: str, k: int) -> DataFrame:
    both = _side(_first(chosen, k), "chosen").join(_side(_first(rejected, k), "rejected"), "problem_id")
    order = ["chosen_rollout_id", "chosen_trace_id", "rejected_rollout_id", "rejected_trace_id"]
    return _first(both, k, order).withColumn("pair_type", F.lit(kind))


def efficiency_pairs(a: DataFrame, low: float = 0.15, high: float = 0.35, k: int = 3) -> DataFrame:
    """Correct traces with few dead steps over correct ones with many."""
    return _capped(a.filter(F.col("is_correct") & (F.col("dsr") < low)), a.filter(F.col("is_correct") & (F.col("dsr") > high)), "efficiency", k)


def productive_pairs(a: DataFrame, high: float = 0.8, low: float = 0.3, k: int = 3) -> DataFrame:
    """Correct traces whose verification is live over those whose verification is dead."""
    v = a.filter(F.col("is_correct") & (F.col("verification_density") > 0))
    return _capped(v.filter(F.col("live_verification_rate") >= high), v.filter(F.col("live_verification_rate") <= low), "productive_exploration", k)


def direction_pairs(a: DataFrame, bound: float = 0.3, k: int = 3) -> DataFrame:
    """Correct, lean traces over wrong, wasteful ones."""
    return _capped(a.filter(F.col("is_correct") & (F.col("dsr") < bound)), a.filter(~F.col("is_correct") & (F.col("dsr") > bound)), "direction", k)


def _has(kind: str) -> Column:
    return F.exists("motifs", lambda x: x["motif_type"] == kind)


def _kept(x: Column) -> Column:
    return F.filter("steps", lambda s: (s["id"] < x["first_id"]) | (s["id"] >= x["first_id"] + x["length"]))


def _cuts(severity: float, steps: int, k: int) -> Column:
    """The k worst severe motifs of several steps that can be cut out of a correct trace, by falling severity, without text.

    The text without the motif must be under 0.95 of the solution's length and of 50
    characters at least; its length is that of the steps left and the blank lines between.
    """
    severe = F.filter("motifs", lambda x: (x["severity"] >= severity) & (x["length"] >= steps))

    def cut(x: Column, i: Column) -> Column:
        kept = _kept(x)
        chars = F.aggregate(kept, F.lit(0), lambda a, s: a + s["char_length"]) + F.greatest(F.size(kept) - 1, F.lit(0)) * 2
        return F.struct((-x["severity"]).alias("order"), i.alias("seq"), x["motif_type"].alias("motif_type"), x["first_id"].alias("first_id"), x["length"].alias("length"), chars.alias("n_chars"))

    fits = F.filter(F.transform(severe, cut), lambda c: (c["n_chars"] < F.length("solution") * F.lit(0.95)) & (c["n_chars"] >= 50))
    return F.when(F.col("is_correct"), F.slice(F.array_sort(fits), 1, k))


def prepare(p: DataFrame, severity: float = 0.5, steps: int = 3, k: int = 2) -> DataFrame:
    """What pairs are built from, one narrow row per parsed trace: metrics, motif flags, and ``cuts``, the places of the k worst severe motifs of correct traces.

    Written once to the shared folder, so that the joins of traces with traces read a few
    columns; no text is in it.
    """
    m = with_motifs(p)
    n = F.size("steps")
    verif = F.filter("steps", lambda s: s["step_type"] == "verification")
    live_v = F.size(F.filter(verif, lambda s: F.array_contains("live", s["id"])))
    worst = F.array_max(F.transform("motifs", lambda x: x["severity"]))
    return materialize(
        unique(m.select(
            "problem_id",
            *ORDER,
            "is_correct",
            F.when(n > 0, (n - F.size("live")) / n).otherwise(0.0).alias("dsr"),
            F.when(n > 0, F.size(verif) / n).otherwise(0.0).alias("verification_density"),
            F.when(n == 0, 0.0).when(F.size(verif) > 0, live_v / F.size(verif)).otherwise(1.0).alias("live_verification_rate"),
            F.coalesce(worst, F.lit(0.0)).alias("worst"),
            *[_has(t).alias(f"has_{t}") for t in CONTRASTED],
            _cuts(severity, steps, k).alias("cuts"),
        ))
    )


def excision_pairs(a: DataFrame) -> DataFrame:
    """Correct traces over themselves without one severe motif of several steps, by keys and places; ``chosen_dsr`` is 0 by definition."""
    best = a.filter("is_correct and size(cuts) > 0").select("problem_id", *ORDER, "dsr", F.explode("cuts").alias("__m"))
    return best.select("problem_id", *ORDER, "__m.motif_type", "__m.first_id", F.lit(0.0).alias("chosen_dsr"), F.col("dsr").alias("rejected_dsr"))


def excision_texts(p: DataFrame, severity: float = 0.5, steps: int = 3, k: int = 2) -> DataFrame:
    """The same with the text that is left, made for the chosen motifs only, inside each trace's row: no shuffle."""
    n = F.size("steps")
    m = with_motifs(p).withColumn("__cuts", once(_cuts(severity, steps, k))).filter("size(__cuts) > 0")
    left = F.transform("__cuts", lambda c: F.struct(c["motif_type"].alias("motif_type"), c["first_id"].alias("first_id"), F.array_join(F.transform(_kept(c), lambda s: s["content"]), "\n\n").alias("chosen_solution")))
    rows = m.select("problem_id", *ORDER, F.when(n > 0, (n - F.size("live")) / n).otherwise(0.0).alias("rejected_dsr"), F.explode(left).alias("__m"))
    return rows.select("problem_id", *ORDER, "__m.*", F.lit(0.0).alias("chosen_dsr"), "rejected_dsr")


def replacement_pairs(a: DataFrame, severity: float = 0.5, k: int = 3) -> DataFrame:
    """Per problem the correct trace with fewest dead steps and no motif of 0.3 or more over the first k correct ones with a severe motif."""
    f = a.filter("is_correct")
    clean = _first(f.filter("worst < 0.3"), 1, ["dsr", *ORDER])
    dirty = _first(f.filter(F.col("worst") >= severity), k)
    return _side(clean, "chosen").join(_side(dirty, "rejected"), "problem_id").withColumn("pair_type", F.lit("contrastive_replacement"))


def contrast_pairs(a: DataFrame, gap: float = 0.05, k: int = 3) -> DataFrame:
    """Per problem and kind of motif, correct traces without it over correct ones with it, widest first.

    Rejected come by falling dead-step ratio, chosen by rising; pairs closer than ``gap``
    drop out. As both orders are by ratio, the pairs left of each rejected trace are the
    first ones, so the first k rejected and the first k chosen hold the first k pairs.
    """
    f = a.filter("is_correct")
    out: DataFrame | None = None
    for t in CONTRASTED:
        rejected = _first(f.filter(F.col(f"has_{t}")), k, [F.desc("dsr"), *ORDER])
        chosen = _first(f.filter(~F.col(f"has_{t}")), k, ["dsr", *ORDER])
        both = _side(chosen, "chosen").join(_side(rejected, "rejected"), "problem_id").filter(F.col("rejected_dsr") - F.col("chosen_dsr") >= gap)
        best = _first(both, k, [F.desc("rejected_dsr"), "rejected_rollout_id", "rejected_trace_id", "chosen_dsr", "chosen_rollout_id", "chosen_trace_id"]).withColumn("pair_type", F.lit(f"contrastive_{t}"))
        out = best if out is None else out.unionByName(best)
    return out


def all_pairs(a: DataFrame) -> DataFrame:
    """All kinds together, with the traces' keys; excision pairs name the same trace on both sides."""
    ex = excision_pairs(a).select("problem_id", *[F.col(c).alias(f"{s}_{c}") for s in ("chosen", "rejected") for c in ORDER], "chosen_dsr", "rejected_dsr", F.lit(True).alias("chosen_correct"), F.lit(True).alias("rejected_correct"), F.lit("contrastive_excision").alias("pair_type"))
    parts = [efficiency_pairs(a), productive_pairs(a), direction_pairs(a), ex, replacement_pairs(a), contrast_pairs(a)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def shuffled(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """Pairs in an order drawn from their keys alone, with ``place``, what they are ordered by: a range-partitioned sort, no single task."""
    keys = ["pair_type", "problem_id", "chosen_rollout_id", "chosen_trace_id", "rejected_rollout_id", "rejected_trace_id"]
    return pairs.withColumn("place", F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))).cast("binary"))).orderBy("place")


def with_texts(pairs: DataFrame, excised: DataFrame, traces: DataFrame) -> DataFrame:
    """Pairs by their texts: (pair_type, problem_id, keys, problem_text, chosen_solution, rejected_solution).

    ``excised`` has the texts of excision pairs. Texts are read for traces that are in a
    pair only: those are picked by their keys before any text moves.
    """
    other = pairs.filter("pair_type <> 'contrastive_excision'").drop("chosen_dsr", "rejected_dsr", "chosen_correct", "rejected_correct")
    used = other.select(F.explode(F.array(*[F.struct(*[F.col(f"{s}_{c}").alias(c) for c in ORDER]) for s in ("chosen", "rejected")])).alias("k")).select("k.*").distinct()
    named = traces.select(*ORDER, "problem_text", "solution")
    text = materialize(named.join(used, ORDER, "left_semi"))
    side = lambda s, more: text.select(*[F.col(c).alias(f"{s}_{c}") for c in ORDER], F.col("solution").alias(f"{s}_solution"), *more)
    whole = other.join(side("chosen", ["problem_text"]), [f"chosen_{c}" for c in ORDER]).join(side("rejected", []), [f"rejected_{c}" for c in ORDER])
    columns = ["pair_type", "problem_id", *[f"{s}_{c}" for s in ("chosen", "rejected") for c in ORDER], "problem_text", "chosen_solution", "rejected_solution"]
    cut = excised.join(named, ORDER).select(F.lit("contrastive_excision").alias("pair_type"), "problem_id", *[F.col(c).alias(f"{s}_{c}") for s in ("chosen", "rejected") for c in ORDER], "problem_text", "chosen_solution", F.col("solution").alias("rejected_solution"))
    return whole.select(*columns).unionByName(cut.select(*columns))


def sharegpt(question: Column, chosen: Column, rejected: Column) -> Column:
    """A pair as a conversation record."""
    turn = lambda who, what: F.struct(F.lit(who).alias("from"), what.alias("value"))
    return F.struct(F.array(turn("human", question)).alias("conversations"), turn("gpt", chosen).alias("chosen"), turn("gpt", rejected).alias("rejected"))
