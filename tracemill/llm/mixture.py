"""Mixing sources to target shares of tokens: iterative proportional fitting and calibrated draws."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.bpe import TOKENIZERS, VOCABULARY, count_tokens
from tracemill.session import materialize

#: Most cells (source, language, topic) that the driver rakes; a guard, as cells are counted by names and not by rows.
MAX_CELLS = 1_000_000
#: Parts that the documents of one problem are dealt into where topics are joined; a problem may hold a third of all.
SALT = 16
#: Steps of the histogram that calibrates each source's draw.
STEPS = 4096


def plain_name(column: str) -> Column:
    """A name without outer blanks, letter case and kinds of separators; null for blank."""
    name = F.lower(F.regexp_replace(F.col(column), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    name = F.regexp_replace(name, r"[\s\-_.]+", "_")
    return F.when(name != "", name)


def plain_language(column: str) -> Column:
    """The language of a tag without its region; 'none' where absent."""
    return F.coalesce(F.when(plain_name(column) != "", F.regexp_extract(plain_name(column), r"^([a-z]+)", 1)), F.lit("none"))


def rake(tokens: np.ndarray, source: np.ndarray, cap: np.ndarray, share: np.ndarray, others: list[np.ndarray], rounds: int = 200, tolerance: float = 1e-9) -> tuple[np.ndarray, float]:
    """How often to use each cell, and the total of tokens, so that sources have their shares.

    The total is the largest that no source's cap stands against. Weights are raked to the
    other marginals (as they are in the data) and then to the sources, over and over; a
    cell above its cap is set to it and its source's rest is spread over the others.
    """
    n_sources = len(share)
    have = np.bincount(source, tokens, n_sources)
    most = np.bincount(source, tokens * cap, n_sources)
    wanted = (share > 0) & (have > 0)
    if not wanted.any():
        return np.zeros(len(tokens)), 0.0
    part = np.where(wanted, share, 0.0)
    part = part / part.sum()
    total = float((most[wanted] / part[wanted]).min())
    use = np.where(wanted[source], 1.0, 0.0)
    use *= (total * part / np.maximum(have, 1e-300))[source]
    use = np.minimum(use, cap)
    natural = tokens * wanted[source]
    for _ in range(rounds):
        before = use.copy()
        for label in others:
            now = np.bincount(label, tokens * use)
            want = np.bincount(label, natural) / natural.sum() * total
            use = use * (want / np.where(now > 0, now, 1.0))[label]
        for _ in range(50):  # to the sources, within the caps
            use = np.minimum(use, cap)
            now = np.bincount(source, tokens * use, n_sources)
            free = (use < cap) & wanted[source]
            loose = np.bincount(source[free], (tokens * use)[free], n_sources)
            gap = total * part - now
            if (np.abs(gap) <= tolerance * total).all() or not free.any():
                break
            use = np.where(free, use * (1 + gap / np.where(loose > 0, loose, 1.0))[source], use)
            use = np.maximum(use, 0.0)
        if np.abs(use - before).max() <= tolerance:
            break
    return np.minimum(use, cap), total


def mixture(documents: DataFrame, targets: DataFrame, topics: DataFrame | None = None, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, seed: int = 29) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chosen, report, marginals): documents with the times each is used, and the shares reached.

    ``chosen`` is (doc_id, source, n_tokens, copies) with copies of 1 up to the source's
    ``max_repeats``; ``report`` has a row for each source of ``targets``; ``marginals`` is
    (dimension, name, natural_share, raked_share, reached_share) of every language and
    topic: as it is in the sources used, after raking, and in the mixture. The sources'
    shares and caps hold exactly, so the other two marginals are kept as far as these
    leave room. Names of sources
    are matched without letter case, outer blanks and kinds of separators; documents of
    other or null sources are not used. A listed source without tokens gets nothing, and
    its share goes to the others in proportion. Empty and null texts have no tokens and
    are not used. ``topics`` (problem_id, category) gives the third marginal.

    Tokens are counted once per document; cells (source, language, topic) are summed before
    the shuffle and raked on the driver (their number goes by names, not rows). A document
    is used floor(w) times and once more if its hash draw is below the rest of w; per
    source one histogram of draws, weighted by tokens, sets the bound at which the share comes out.
    """
    spark = documents.sparkSession
    counted = count_tokens(documents, "text", ["doc_id", "source", "lang", "problem_id"], folder, vocabulary).filter("n_tokens > 0")
    goal = targets.select(plain_name("source").alias("name"), "target_share", "max_repeats").filter("name is not null").groupBy("name").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    goal_rows = sorted(goal.collect(), key=lambda r: r.name)  # one row for each listed source
    names = [r.name for r in goal_rows]
    base = counted.select("doc_id", plain_name("source").alias("name"), plain_language("lang").alias("lang"), "problem_id", "n_tokens").filter(F.col("name").isin(names))
    if topics is not None:
        # Documents without a problem get keys of their own, those of one problem SALT keys; topics may be many, so they are not broadcast.
        topic = topics.filter("problem_id is not null").groupBy("problem_id").agg(F.min(F.when(F.trim("category") != "", F.lower(F.trim("category")))).alias("topic")).filter("topic is not null")
        topic = topic.select("problem_id", "topic", F.explode(F.expr(f"sequence(0L, {SALT - 1}L)")).alias("__salt")).hint("shuffle_hash")
        draw = F.xxhash64("doc_id", F.lit(seed + 1))
        base = base.withColumn("__salt", F.when(F.col("problem_id").isNull(), draw.bitwiseOR(F.lit(1 << 20))).otherwise(F.pmod(draw, F.lit(SALT))))
        base = base.withColumn("problem_id", F.coalesce("problem_id", F.lit(""))).join(topic, ["problem_id", "__salt"], "left")
    else:
        base = base.withColumn("topic", F.lit(None).cast("string"))
    base = materialize(base.select("doc_id", "name", "lang", F.coalesce("topic", F.lit("none")).alias("topic"), "n_tokens"))
    cells = base.groupBy("name", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"))
    rows = cells.limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells of source, language and topic: give coarser topics, or none")
    rows.sort(key=lambda r: (r.name, r.lang, r.topic))
    number = {n: i for i, n in enumerate(names)}
    share = np.array([r.share or 0.0 for r in goal_rows])
    caps = np.array([max(r.cap or 0, 0) for r in goal_rows], float)
    source = np.array([number[r.name] for r in rows], np.int64)
    tokens = np.array([r.tokens for r in rows], float)
    kinds = [np.unique([r[k] for r in rows], return_inverse=True) if rows else (np.empty(0, str), np.empty(0, np.int64)) for k in (1, 2)]
    labels = [x for _, x in kinds]
    use, total = rake(tokens, source, caps[source] if len(rows) else np.empty(0), share, labels)
    plan = spark.createDataFrame([(r.name, r.lang, r.topic, float(w), float(caps[s])) for r, w, s in zip(rows, use, source)], "name string, lang string, topic string, use double, cap double")
    drawn = base.join(F.broadcast(plan), ["name", "lang", "topic"])
    chance = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    rest = F.col("use") - F.floor("use")
    drawn = drawn.withColumn("draw", F.when(rest > 0, chance / rest).otherwise(F.lit(float("inf"))))
    step = F.when(F.col("draw") < 2.0, F.floor(F.col("draw") / 2.0 * STEPS)).otherwise(STEPS)
    histogram = drawn.groupBy("name", step.alias("step")).agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.floor("use")).alias("sure")).collect()  # sources times steps
    part = np.where((share > 0) & (np.bincount(source, tokens, len(names)) > 0), share, 0.0)
    part = part / part.sum() if part.sum() else part
    bounds = []
    for i, n in enumerate(names):
        own = np.zeros(STEPS + 1)
        sure = 0.0
        for r in histogram:
            if r.name == n:
                own[r.step] += r.tokens
                sure += r.sure
        reach = sure + np.concatenate([[0.0], np.cumsum(own[:STEPS])])
        bounds.append((n, float(np.abs(reach - total * part[i]).argmin()) / STEPS * 2.0))
    bound = spark.createDataFrame(bounds, "name string, bound double")
    copies = F.least(F.col("cap"), F.floor("use") + F.when(F.col("draw") < F.col("bound"), 1).otherwise(0)).cast("int")
    every = drawn.join(F.broadcast(bound), "name").select("doc_id", F.col("name").alias("source"), "lang", "topic", "n_tokens", copies.alias("copies")).filter("copies > 0")
    chosen = every.select("doc_id", "source", "n_tokens", "copies")
    reached = chosen.groupBy(F.col("source").alias("name")).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    have = base.groupBy("name").agg(F.sum("n_tokens").alias("source_tokens"))
    joined = goal.join(have, "name", "left").join(reached, "name", "left").na.fill(0, ["source_tokens", "mix_tokens", "documents", "most_copies"])
    whole = joined.agg(F.sum("mix_tokens").alias("all_tokens"))
    report = joined.join(F.broadcast(whole)).select(F.col("name").alias("source"), F.col("share").alias("target_share"), (F.col("mix_tokens") / F.when(F.col("all_tokens") > 0, F.col("all_tokens"))).alias("reached_share"), "source_tokens", "mix_tokens", "documents", "most_copies", F.col("cap").alias("max_repeats"))
    listed = tokens * (share > 0)[source] if len(rows) else tokens
    known = [(d, str(n), float(a), float(b)) for d, (names_, x) in zip(("language", "topic"), kinds) for n, a, b in zip(names_, _shares(x, listed, len(names_)), _shares(x, tokens * use, len(names_)))]
    used = every.select("n_tokens", "copies", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("name")) for d, c in (("language", "lang"), ("topic", "topic"))])).alias("k"))
    used = used.groupBy("k.dimension", "k.name").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t"))
    in_all = used.filter("dimension = 'language'").agg(F.sum("t").alias("all_tokens"))
    told = spark.createDataFrame(known, "dimension string, name string, natural_share double, raked_share double").join(used, ["dimension", "name"], "left").join(F.broadcast(in_all))
    marginals = told.select("dimension", "name", "natural_share", "raked_share", (F.coalesce("t", F.lit(0)) / F.when(F.col("all_tokens") > 0, F.col("all_tokens"))).alias("reached_share"))
    return chosen, report, marginals


def _shares(label: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    sums = np.bincount(label, weight, n)
    return sums / sums.sum() if sums.sum() > 0 else sums
