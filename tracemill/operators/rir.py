"""Reasoning records with explicit inputs: dead-step elimination, its statistics, cleaned variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import fixed, text
from tracemill.operators.traces import once, unique

#: Step types of records by the types of paragraphs.
RECORD_TYPE = {"exploration": "assumption", "correction": "derivation"}


def reach(steps: Column) -> Column:
    """Sorted ids of the live steps: conclusions (else the last step) and all they use, for any graph.

    Ids need not be dense or ordered, inputs may name unknown steps (ignored) and form
    cycles. One fold from the last step to the first follows all inputs that point back;
    what is left (inputs that point forward) is carried as a frontier and only its steps
    are looked at, so rounds after it is empty cost nothing.
    """
    none = F.array().cast("array<int>")
    ids = F.transform(steps, lambda s: s["id"])
    seeds = F.transform(F.filter(steps, lambda s: s["type"] == "conclusion"), lambda s: s["id"])
    last = F.try_element_at(ids, F.lit(-1))
    start = F.array_distinct(F.when(F.size(seeds) > 0, seeds).when(F.size(ids) > 0, F.array(last)).otherwise(none))
    used = lambda s: F.coalesce(s["inputs"], none)
    back = F.aggregate(F.reverse(steps), start, lambda acc, s: F.when(F.array_contains(acc, s["id"]), F.array_union(acc, used(s))).otherwise(acc))

    def beyond(live: Column, front: Column) -> Column:
        """Known steps that the steps of the frontier use and that are not live yet."""
        more = F.flatten(F.transform(F.filter(steps, lambda s: F.array_contains(front, s["id"])), used))
        return F.array_except(F.array_intersect(more, ids), live)

    def state(live: Column, front: Column) -> Column:
        return F.struct(live.alias("live"), front.alias("front"))

    def grow(acc: Column, _: Column) -> Column:
        live = F.concat(acc["live"], acc["front"])
        return F.when(F.size(acc["front"]) > 0, state(live, beyond(live, acc["front"]))).otherwise(acc)

    rounds = F.when(F.size(ids) > 0, F.sequence(F.lit(1), F.size(ids))).otherwise(none)
    first = F.transform(F.array(F.array_intersect(back, ids)), lambda live: state(live, beyond(live, live)))
    whole = F.transform(first, lambda x: F.when(F.size(x["front"]) > 0, F.aggregate(rounds, x, grow, lambda acc: acc["live"])).otherwise(x["live"]))
    return F.array_sort(F.coalesce(F.try_element_at(whole, F.lit(1)), none))


def eliminate(df: DataFrame, steps: str = "steps") -> DataFrame:
    """Adds live_ids, dead_ids, total, dead_count and dead_ratio (0 without steps)."""
    df = df.withColumn("live_ids", once(reach(F.col(steps))))
    dead = F.array_sort(F.array_except(F.transform(steps, lambda s: s["id"]), F.col("live_ids")))
    df = df.withColumn("dead_ids", once(dead))
    n = F.size(steps)
    return df.select("*", n.alias("total"), F.size("dead_ids").alias("dead_count"), F.when(n > 0, F.size("dead_ids") / n).otherwise(0.0).alias("dead_ratio"))


def records(parsed: DataFrame) -> DataFrame:
    """Reasoning records of parsed traces: a step per paragraph with its inputs, length in words and paragraph."""
    kind = F.create_map(*[x for k, v in RECORD_TYPE.items() for x in (F.lit(k), F.lit(v))])
    rows = F.transform("steps", lambda s, i: F.struct(s["id"].alias("id"), F.coalesce(kind[s["step_type"]], s["step_type"]).alias("type"), F.element_at(F.col("edges"), i + 1).alias("inputs"), text.word_count(s["content"]).alias("original_tokens"), F.array(s["id"]).alias("paragraphs")))
    paragraphs = F.transform("steps", lambda s: s["content"])
    return parsed.select("problem_id", "rollout_id", "trace_id", "is_correct", "answer", "ground_truth", "solution", once(rows).alias("rsteps"), once(paragraphs).alias("paragraph_texts"))


def features(r: DataFrame) -> DataFrame:
    """One narrow row per record: counts, tokens, and shares of dead verification."""
    e = eliminate(r.withColumnRenamed("rsteps", "steps"))
    dead = lambda s: F.array_contains("dead_ids", s["id"])
    tokens = lambda xs: F.aggregate(xs, F.lit(0), lambda a, s: a + s["original_tokens"])
    verif = F.filter("steps", lambda s: s["type"] == "verification")
    dead_v = F.filter("steps", lambda s: (s["type"] == "verification") & dead(s))
    out = e.select(
        "problem_id",
        "rollout_id",
        "trace_id",
        "is_correct",
        F.col("total").cast("bigint").alias("total"),
        F.col("dead_count").cast("bigint").alias("dead"),
        F.size(F.filter("steps", lambda s: s["type"] == "conclusion")).cast("bigint").alias("concluded"),
        F.size(verif).cast("bigint").alias("verif"),
        F.size(dead_v).cast("bigint").alias("dead_verif"),
        tokens(F.col("steps")).cast("bigint").alias("tokens"),
        tokens(F.filter("steps", dead)).cast("bigint").alias("dead_tokens"),
        tokens(dead_v).cast("bigint").alias("dead_verif_tokens"),
    ).filter("total > 0")
    out = unique(out)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.select("*", share("dead", "total").alias("dsr"), share("dead_verif", "verif").alias("vii"), share("dead_tokens", "tokens").alias("dead_token_ratio"))


def random_removal(f: DataFrame) -> DataFrame:
    """For records with dead steps: the chance that removing as many random steps keeps all that is needed, in closed form."""
    m = F.col("total") - F.greatest(F.col("concluded"), F.lit(1))
    p = F.aggregate(F.sequence(F.lit(1), F.col("dead").cast("int")), F.lit(1.0), lambda acc, i: acc * i / (m - F.col("dead") + i))
    return f.filter("dead > 0").withColumn("random_apr", p)


def without(paragraphs: Column, removed: Column) -> Column:
    """Paragraphs joined without those whose place is removed; one that holds "boxed" always stays."""
    kept = F.filter(paragraphs, lambda x, i: F.contains(x, F.lit("boxed")) | ~F.array_contains(removed, i))
    return text.trim_all(F.regexp_replace(F.array_join(kept, "\n\n"), r"\n{3,}", "\n\n"))


def _variant_texts(r: DataFrame) -> tuple[DataFrame, dict[str, tuple[Column, Column]]]:
    e = eliminate(r.withColumnRenamed("rsteps", "steps"))
    ids = lambda f: F.transform(F.filter("steps", f), lambda s: s["id"])
    verif = lambda s: s["type"] == "verification"
    e = e.withColumn("__verif", ids(verif)).withColumn("__dead_verif", ids(lambda s: verif(s) & F.array_contains("dead_ids", s["id"])))
    return e, {
        "original": (F.col("solution"), F.lit(0)),
        "dse": (without(F.col("paragraph_texts"), F.col("dead_ids")), F.size("dead_ids")),
        "noverif": (without(F.col("paragraph_texts"), F.col("__verif")), F.size("__verif")),
        "liveverif": (without(F.col("paragraph_texts"), F.col("__dead_verif")), F.size("__dead_verif")),
        "keywordclean": (text.keyword_clean(F.col("solution")), F.lit(0)),
    }


def variants(r: DataFrame) -> DataFrame:
    """A row per record and cleaned variant: original, dse, noverif, liveverif, keywordclean; twice delivered records are there twice (see ``unique``)."""
    e, texts = _variant_texts(r)
    rows = F.array(*[F.struct(F.lit(k).alias("variant"), t.alias("cleaned"), n.cast("bigint").alias("removed_steps")) for k, (t, n) in texts.items()])
    return e.select("problem_id", "rollout_id", "trace_id", F.explode(rows).alias("v")).select("problem_id", "rollout_id", "trace_id", "v.*")


def variant_lengths(r: DataFrame) -> DataFrame:
    """One narrow row per record: steps, the length of every variant, the steps each removes, and whether elimination changes the text."""
    e, texts = _variant_texts(r)
    e = e.withColumn("__dse", once(texts["dse"][0]))
    texts["dse"] = (F.col("__dse"), texts["dse"][1])
    lengths = [F.length(t).cast("bigint").alias(f"len_{k}") for k, (t, _) in texts.items()]
    removed = [n.cast("bigint").alias(f"removed_{k}") for k, (_, n) in texts.items()]
    return unique(e.select("problem_id", "rollout_id", "trace_id", F.col("total").cast("bigint").alias("steps"), *lengths, *removed, (F.col("__dse") != F.col("solution")).alias("changed")))


def entities(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"[A-Za-z]\w*|\d+"), F.lit(0)))


def fragile(r: DataFrame) -> DataFrame:
    """A row per removed paragraph: fragile if close to a kept one in words or place, or of a kind that only looks dead; else robust.

    A paragraph's place is that of its first equal one.
    """
    e = eliminate(r.withColumnRenamed("rsteps", "steps"))
    e = e.withColumn("__kept", F.filter("paragraph_texts", lambda x, i: ~F.array_contains("dead_ids", i)))
    e = e.withColumn("__kept_entities", F.transform("__kept", entities))
    n = F.size("paragraph_texts")

    def row(x: Column, i: Column) -> Column:
        own = entities(x)
        first = F.array_position("paragraph_texts", x).cast("int") - 1
        near = lambda k: F.coalesce(F.array_contains("__kept", F.try_element_at("paragraph_texts", k + 1)), F.lit(False))
        close = F.exists("__kept_entities", lambda k: (F.size(k) > 0) & (F.size(own) > 0) & (F.size(F.array_intersect(own, k)) / F.least(F.size(own), F.size(k)) > 0.5))
        kind = text.step_type(x, F.lower(x))
        beside = ((first > 0) & near(F.greatest(first - 1, F.lit(0)))) | ((first < n - 1) & near(F.least(first + 1, n - 1)))
        return F.struct(i.alias("step_id"), kind.alias("kind"), F.length(x).alias("n_chars"), (close | kind.isin("verification", "exploration", "correction") | beside).alias("fragile"), F.array_contains("__kept", x).alias("kept"))

    rows = F.filter(F.transform("paragraph_texts", row), lambda s: ~s["kept"])
    return unique(e.select("problem_id", "rollout_id", "trace_id", rows.alias("rows"))).select("problem_id", "rollout_id", "trace_id", F.explode("rows").alias("s")).select("problem_id", "rollout_id", "trace_id", "s.step_id", "s.kind", "s.n_chars", "s.fragile")


def theta_policy(p: DataFrame, theta: float = 0.5) -> DataFrame:
    """Parsed traces without their robustly dead steps: (keys, kept_steps, cleaned).

    Live steps and conclusions stay. Dead computations and derivations go. Other dead steps
    stay beside a live step, or where they share more than ``theta`` of the smaller set of
    words and numbers with one.
    """
    live = lambda i: F.array_contains("live", i)
    p = p.withColumn("__e", once(F.transform("steps", lambda s: entities(s["content"]))))
    of = lambda i: F.element_at(F.col("__e"), i + 1)
    shared = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)) > theta)
    scaffold = lambda s: s["step_type"].isin("verification", "exploration", "correction") & (live(s["id"] - 1) | live(s["id"] + 1) | F.exists("live", lambda k: shared(of(s["id"]), of(k))))
    kept = F.filter("steps", lambda s: live(s["id"]) | (s["step_type"] == "conclusion") | scaffold(s))
    p = p.withColumn("__kept", once(kept))
    return p.select("problem_id", "rollout_id", "trace_id", F.size("__kept").cast("bigint").alias("kept_steps"), F.array_join(F.transform("__kept", lambda s: s["content"]), "\n\n").alias("cleaned"))


def difficulty(problem: Column) -> Column:
    """The difficulty that a problem's name starts with."""
    starts = lambda *xs: F.regexp_like(problem, F.lit("^(" + "|".join(xs) + ")"))
    return F.when(starts("aime", "hard"), "hard").when(starts("s2_", "scale_"), "medium").when(starts("algebra", "intermediate"), "easy").when(starts("geometry", "combinatorics", "numtheory"), "medium").when(starts("gsm8k"), "easy").otherwise("unknown")


assert set(RECORD_TYPE) < set(fixed.STEP_TYPES)
