"""The text operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import itertools
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import bpe, components, defects, language, leaks, mixture, neardup, repetition, sentences, splits, topn, truncation
from tracemill.llm import common as C

WORDS = ["alpha", "beta", "gamma", "delta", "root", "sum", "line", "seven", "12", "35", "so", "the", "of", "we", "get", "value"]


def sentence(rng, n=8):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


# 1 repetition


def brute_cover(text, n):
    w = re.findall(rf"\d+|[{C.HAN}]|[^\W\d_{C.HAN}]+", re.sub(r"\d+", "0", (text or "").casefold()))
    seen, hit = set(), [False] * len(w)
    for i in range(len(w) - n + 1):
        g = tuple(w[i : i + n])
        if g in seen:
            hit[i : i + n] = [True] * n
        seen.add(g)
    return len(w), sum(hit) / max(1, len(w))


def test_repetition_is_brute_force():
    rng = random.Random(1)
    texts = [None, "", " ", "一二三四五一二三四五一二三四五", "a" * 5000, "1 2 3 4 5 6 7 8 9 10 11"]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    out = repetition.measure(texts, (3, 5))
    for i, t in enumerate(texts):
        for k, n in enumerate((3, 5)):
            words, share = brute_cover(t, n)
            assert out[0][i] == words
            assert out[1 + 2 * k][i] == pytest.approx(share)
    assert repetition.measure(["x y\nx y\nz"], (3,))[-1] == [pytest.approx(3 / 7)]


def test_repetition_frame(spark):
    loop = "we now add the two values again " * 20
    df = spark.createDataFrame([(1, loop, "x"), (1, loop, "y"), (2, "short", None), (3, None, None)], "id int, body string, n_words string")
    assert [r.id for r in repetition.repetitive(df, "body", ["id"]).collect()] == [1]
    assert repetition.repetition_coverage(df, "body", ["id"]).count() == 4
    assert repetition.repetitive(df.limit(0), "body", ["id"]).count() == 0


# 2 splits


def union_find(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    return {x: find(x) for x in list(up)}


def test_components_random(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(70)] + [(500, rng.randint(501, 560)) for _ in range(60)] + [(i, i + 1) for i in range(700, 740)] + [(3, 3)]
    df = spark.createDataFrame([*edges, (None, 4)], "u int, v int")
    got = {r.vertex: r.label for r in components.components(df).collect()}
    want = union_find([e for e in edges if e[0] != e[1]])
    assert set(got) == set(want)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups(got) == groups(want)
    assert components.components(df.limit(0)).count() == 0


PAIRS = "pair_id bigint, problem_id string, origin_id string, author_id string"


def test_groups_and_splits(spark):
    rows = [(1, "prob_7", None, " A1 "), (2, " PROB-007", None, "n/a"), (3, None, "S1", "a1"), (4, None, "s1 ", "unknown"), (5, "prob_9", "Unknown", None), (6, None, None, None), (6, None, None, None), (7, "problem 12", "-", "b"), (8, "prob_3", "", "B")]
    df = spark.createDataFrame(rows, PAIRS)
    got = {r.pair_id: r.group_id for r in splits.named_groups(df).collect()}
    assert got == {1: 7, 2: 7, 3: 7, 4: 7, 5: 9, 7: 3, 8: 3}
    s = splits.assign(splits.pair_groups(df), "pair_id").collect()
    assert sorted(r.pair_id for r in s) == [1, 2, 3, 4, 5, 6, 7, 8]
    parts = defaultdict(set)
    for r in s:
        parts[r.component].add(r.split)
    assert all(len(v) == 1 for v in parts.values())
    assert splits.named_groups(df.limit(0)).count() == 0


def test_split_proportions(spark):
    df = spark.createDataFrame([(i, f"prob_{i // 2}", None, None) for i in range(1000)], PAIRS)
    n = Counter(r.split for r in splits.assign(splits.pair_groups(df), "pair_id").collect())
    assert n["train"] == pytest.approx(800, abs=4)
    assert n["test"] == pytest.approx(100, abs=4)


# 3 cut texts


def make_texts(rng, n):
    ends = ["Hence x = {}", "Answer: {}", "So we are done.", "QED", "The value is {}."]
    return ["\n\n".join(sentence(rng, rng.randint(6, 12)) for _ in range(rng.randint(2, 6))) + "\n\n" + rng.choice(ends).format(rng.randint(1, 99)) for _ in range(n)]


def test_cut_texts_held_out():
    rng = random.Random(3)
    model = truncation.EndModel().fit(make_texts(rng, 1500))
    whole = make_texts(rng, 300)
    cut = []
    for t in make_texts(rng, 300):
        k = rng.randint(20, len(t) - 15)
        while not (t[k - 1].isalpha() and t[k].isalpha()):
            k = rng.randint(20, len(t) - 15)
        cut.append(t[:k] + rng.choice(["", "...", " [truncated]", "�", "…"]))
    wrong = sum(truncation.cut_off(model, whole, ["s"] * 300))
    found = sum(truncation.cut_off(model, cut, ["s"] * 300))
    assert wrong <= 6
    assert found >= 285
    assert truncation.cut_off(model, [None, "", "  ", "..."], ["s"] * 4) == [False] * 4


def test_cut_texts_frame(spark):
    rng = random.Random(4)
    rows = [(i, t, "s") for i, t in enumerate(make_texts(rng, 200))] + [(900, "Alpha beta gam", "s"), (901, None, "s")]
    df = spark.createDataFrame(rows, "id int, t string, c string")
    got = {r.id: r.cut for r in truncation.truncated_texts(df, "t", "c", ["id"]).collect()}
    assert got[900]
    assert not got[901]
    assert truncation.truncated_texts(df.limit(0), "t", "c", ["id"]).count() == 0


# 4 defects

PROMPT = "From a box with 31 large and 49 plain tokens a clerk draws 53 pieces one after another without looking. Determine all integers k below 31 for which this is possible."


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, "empty"),
        (" \n​", "empty"),
        ("<think>\n\n</think>", "empty"),
        ("N/A", "empty"),
        ("\\boxed{}", "empty"),
        ("I'm sorry, but I can't help with this problem.", "refusal"),
        ("Lo siento, pero no puedo ayudar con este ejercicio.", "refusal"),
        ("对不起，我不能提供这道题的解答。", "refusal"),
        (PROMPT.upper(), "copy"),
        ("Problem: " + PROMPT, "copy"),
        ("> " + PROMPT.replace(". ", ".\n> "), "copy"),
        (PROMPT + "\n\n" + PROMPT, "copy"),
        ("The problem says: From a box with 31 large and 49 plain tokens, and so on. Let us set up a table with 5 rows and fill in 18. The first root is negative, hence only y = 2 survives. Hence k = 4", None),
        ("Die Antwort folgt aus der Gleichung. Beide Gleichungen zusammen ergeben 3 und das ist nicht mit der Schranke von oben zu vereinbaren. Also gilt k = 3", "language"),
        ("We start here. Si sustituimos el valor de la suma por la que queda, resulta que los dos lados son iguales y esto es todo. La respuesta es 3.", "language"),
        ("I cannot simplify 31/36 any more, so I keep the exact value for k. The answer is 3.", None),
    ],
)
def test_defects(text, want):
    assert defects.defect_of(PROMPT, text) == want


def test_suffix_automaton_random():
    rng = random.Random(6)
    for _ in range(60):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 25))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 30))]
        runs = {tuple(a[i : i + 3]) for i in range(len(a) - 2)}
        hit = [any(0 <= s and tuple(b[s : s + 3]) in runs for s in range(i - 2, i + 1)) for i in range(len(b))]
        assert defects.SuffixAutomaton(a).covered(b, 3) == sum(hit)


def test_defects_frame(spark):
    df = spark.createDataFrame([(1, PROMPT, None, "s", "z"), (2, None, "fine text here.", "s", "z"), (2, None, "fine text here.", "s", "z")], "id int, q string, a string, c string, defect string")
    got = [(r.id, r.defect) for r in defects.defects(df, "q", "a", "c", ["id"]).collect()]
    assert sorted(got, key=str) == [(1, "empty"), (2, None), (2, None)]


def test_languages():
    assert [language.vote(t) for t in ("the sum of the two is even", "das ist nicht die Summe der beiden", "la suma de los dos es par", "Это не так, как мы думали", "这是平方根", "これは平方根である", None, "")] == ["en", "de", "es", "ru", "zh", "ja", "", ""]


# 5 leaks


def test_leaks_brute_force():
    rng = random.Random(8)
    close = "Give your answer in lowest terms and do not use mixed numbers or decimals at all."
    items = [(f"t{i}", " ".join(rng.choice(WORDS) for _ in range(rng.randint(10, 40))).capitalize() + ". " + (close if i % 2 else "Find it.")) for i in range(20)]
    bodies = leaks.item_bodies(items)
    assert all(b[-1] != "all" for b in bodies.values())
    m = leaks.WuManber(bodies)
    own = defaultdict(set)
    for k, w in bodies.items():
        for i in range(len(w) - 11):
            own[tuple(w[i : i + 12])].add(k)
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(1, 3)):
            w = bodies[rng.choice(list(bodies))]
            a = rng.randint(0, len(w) - 1)
            parts += w[a : a + rng.randint(5, 20)] + [rng.choice(WORDS) for _ in range(rng.randint(0, 6))]
        got = {k for k, _, _ in leaks._own(m.runs(parts))}
        want = {k for i in range(len(parts) - 11) for k in own.get(tuple(parts[i : i + 12]), ()) if len(own[tuple(parts[i : i + 12])]) == 1}
        assert want <= got
        for k, a, b in m.runs(parts):
            assert b - a >= 12
            assert " ".join(parts[a:b]) in " ".join(bodies[k])


@pytest.mark.parametrize("chars", [8_000_000, 60])
def test_leaks_over_passes(spark, monkeypatch, chars):
    """Items that share a closing sentence and a passage, whole and in one pass each: shared runs are no item's own in either case."""
    monkeypatch.setattr(leaks, "PASS_CHARS", chars)
    rng = random.Random(31)
    word = lambda: rng.choice(WORDS) + str(rng.randint(0, 999))
    close = "Give your answer in lowest terms and do not use mixed numbers or decimals anywhere in it."
    shared = " ".join(word() for _ in range(14))
    own = [" ".join(word() for _ in range(16)) for _ in range(5)]
    texts = [f"{own[i]} {shared if i in (1, 3) else 'and so on'}. {close}" for i in range(5)]
    items = spark.createDataFrame([(f"i{i}", t) for i, t in enumerate(texts)], "unique_id string, problem string")
    rows = [("close", "Before. " + close), ("shared", "x " + shared + " y"), *[(f"own{i}", f"see {own[i]} there") for i in range(5)], ("two", own[0] + " then " + own[4]), ("part", " ".join(own[2].split()[2:14])), ("short", " ".join(own[2].split()[:11]))]
    got = {(r.id, r.unique_id) for r in leaks.leaked_passages(spark.createDataFrame(rows, "id string, body string"), "body", ["id"], items).collect()}
    assert got == {*((f"own{i}", f"i{i}") for i in range(5)), ("two", "i0"), ("two", "i4"), ("part", "i2")}


def test_leaks_frame(spark):
    item = "A tank near the boat yard fills at 36 liters per minute but leaks 4.25 liters per minute once it holds 785 liters of water"
    items = spark.createDataFrame([("i1", item), ("i2", None), ("i3", "")], "unique_id string, problem string")
    marked = "So **A tank near** the <b>boat yard</b> fi­lls at $36$ LITERS per minute but leaks 4.25 liters, ok"
    rec = spark.createDataFrame([("r1", marked), ("r1", marked), ("r2", "A tank near the boat yard fills"), ("r3", None)], "id string, body string")
    got = {(r.id, r.unique_id) for r in leaks.leaked_passages(rec, "body", ["id"], items).collect()}
    assert got == {("r1", "i1")}
    leaks.PASS_CHARS, kept = 40, leaks.PASS_CHARS
    try:
        assert {(r.id, r.unique_id) for r in leaks.leaked_passages(rec, "body", ["id"], items).collect()} == got
    finally:
        leaks.PASS_CHARS = kept
    assert leaks.leaked_passages(rec, "body", ["id"], items.limit(0)).count() == 0


# 6 near-duplicates


def edited(rng, w):
    w = list(w)
    for _ in range(rng.randint(0, 5)):
        i = rng.randrange(len(w))
        w[i : i + rng.randint(0, 1)] = [rng.choice(WORDS)] * rng.randint(0, 2)
    return w


@pytest.mark.parametrize("bucket", [48, 3])
def test_near_duplicates_brute_force(spark, bucket):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(35, 80))]
        for k in range(rng.randint(1, 6)):
            rows.append((len(rows), " ".join(edited(rng, base) if k else base)))
    rows += [(900 + i, rows[0][1]) for i in range(30)] + [(0, rows[0][1]), (990, None), (991, ""), (992, "short")]
    df = spark.createDataFrame(rows, "id int, body string").withColumn("__id", F.lit(1))
    links, members = neardup.similar(df, "body", ["id"], 3, 0.6, 30, bucket=bucket)
    name = {r["__id"]: r.id for r in members.groupBy("__id").agg(F.min("id").alias("id")).collect()}
    got = {tuple(sorted((name[r["__a"]], name[r["__b"]]))) for r in links.collect()}
    texts = {}
    for i, t in sorted((r for r in rows if r[1]), key=lambda r: r[0]):
        texts.setdefault(t, i)
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for t, i in texts.items() if len(t.split()) >= 30}
    want = {tuple(sorted(p)) for p in itertools.combinations(sets, 2) if len(sets[p[0]] & sets[p[1]]) >= 0.6 * len(sets[p[0]] | sets[p[1]])}
    assert len(want) > 20
    assert len(want - got) <= 0.02 * len(want)
    assert got <= want
    assert members.filter("id >= 900 and id < 990").count() == 30


def test_matching_solutions_by_all_names(spark):
    """Against all pairs of names: links between different texts for every name, copies once each with the least name."""
    rng = random.Random(19)
    base = [rng.choice(WORDS) + str(i) for i in range(60)]
    a, b, c, d = " ".join(base), " ".join(base[:50]), " ".join(base[:40]), " ".join(f"z{i}" for i in range(40))
    rows = [(1, a, b), (2, a, a), (3, c, d), (4, d, None), (5, b, "short"), (5, b, "short"), (6, "", d), (None, a, None)]
    pairs = spark.createDataFrame(rows, "pair_id long, chosen_solution string, rejected_solution string").withColumn("name", F.lit("x"))
    got = [tuple(r) for r in neardup.similar_solutions(pairs).collect()]
    assert len(got) == len(set(got))
    names = {}
    for k, x, y in rows:
        for side, t in (("chosen", x), ("rejected", y)):
            if t and len(t.split()) >= 30:
                names.setdefault(t, set()).add((k, side))
    order = lambda n: (n[0] is not None, n[0] or 0, n[1])
    want = set()
    shingles = {t: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for t in names}
    for s, t in itertools.combinations(names, 2):
        if len(shingles[s] & shingles[t]) >= 0.6 * len(shingles[s] | shingles[t]):
            want |= {tuple(sorted((x, y), key=order)) for x in names[s] for y in names[t]}
    for own in names.values():
        first = min(own, key=order)
        want |= {(first, x) for x in own if x != first}
    assert {((w, x), (y, z)) for w, x, y, z in got} == want
    assert any(x[0] is None for x, _ in want) and len(want) > 15


def test_hot_shingles_are_dealt_out(spark, monkeypatch):
    """A crowd of templated texts in one bucket: with any split of its shingles the same links as brute force."""
    rng = random.Random(23)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(w if rng.random() > 0.06 else f"e{rng.randint(0, 30)}" for w in base[: rng.choice([40, 50, 60])]) for _ in range(60)]
    texts = list(dict.fromkeys(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    sets = [{tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for t in texts]
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}
    assert len(want) > 50
    for meet in (2000, 3):
        monkeypatch.setattr(neardup, "MEET", meet)
        links, members = neardup.similar(df, "body", ["id"], 3, 0.6, 30, bucket=2)
        name = {r["__id"]: r.id for r in members.collect()}
        assert {tuple(sorted((name[r["__a"]], name[r["__b"]]))) for r in links.collect()} == want


def test_near_duplicates_empty(spark):
    links, members = neardup.similar(spark.createDataFrame([], "id int, body string"), "body", ["id"])
    assert links.count() == members.count() == 0


def test_sketch_estimates():
    rng = random.Random(10)
    a = [f"w{rng.randint(0, 5000)}" for _ in range(200)]
    b = a[:150] + [f"x{i}" for i in range(50)]
    doc, h, _ = neardup.shingle_sets([" ".join(a), " ".join(b)], 1)
    s = neardup.one_permutation(doc, h, 2, 4096, 1)
    assert np.mean(s[0] == s[1]) == pytest.approx(len(set(a) & set(b)) / len(set(a) | set(b)), abs=0.12)


# 7 top N


def test_top_n(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(600):
        rows.append((f"p{rng.choice([1, 1, 1, 2, 3])}", rng.randint(0, 30), rng.choice([None, float("nan"), 0.5, 0.7, 0.9]), rng.choice([None, 0.1, 0.2]), rng.randint(0, 9)))
    rows += rows[:50]
    df = spark.createDataFrame([(a, b, c, d, e, "x") for a, b, c, d, e in rows], "problem_id string, trace_id int, quality_reward double, dsr double, at int, rank string").withColumn("annotated_at", F.timestamp_seconds("at"))
    # Rows of one moment are told apart by their scores.
    key = lambda r: (-r[4], r[2] is None, 0 if r[2] is None else -9e9 if r[2] != r[2] else -r[2], r[3] is None, r[3] or 0)
    want = set()
    for p in ("p1", "p2", "p3"):
        last = {}
        for r in sorted((r for r in rows if r[0] == p), key=key):
            last.setdefault(r[1], r)
        good = [r for r in last.values() if r[2] is not None and r[2] == r[2]]
        want |= {(p, r[1]) for r in sorted(good, key=lambda r: (-r[2], r[3] is None, r[3] or 0, r[1]))[:3]}
    assert {(r.problem_id, r.trace_id) for r in topn.best_traces(df).collect()} == want
    assert topn.best_traces(df.limit(0)).count() == 0
    plan = topn.best_traces(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4


# 8 encoding


def test_encoding_is_that_of_the_public_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = os.path.join(bpe.TOKENIZERS, bpe.VOCABULARY)
    tokens = bpe.read_ranks(path)
    e = bpe.BacktrackingEncoder(tokens)
    theirs = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rng = random.Random(12)
    texts = ["<|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaaa" * 40, " \n\t  x", "naïve café 日本語 👩‍🏫"]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0x400, 0x4FF), rng.randint(0x4E00, 0x9FFF), 10, 0x200B, 0x1F600])) for _ in range(rng.randint(1, 60))) for _ in range(500)]
    texts += ["".join(rng.choice("aeioust ") for _ in range(50)) for _ in range(300)]
    for t in texts:
        assert e.encode(t) == theirs.encode_ordinary(t)
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate([*texts, "", None])], "id int, body string, ids string")
    ids = bpe.encode(df, "body", ["id"])
    got = {r.id: list(r.ids) for r in ids.collect()}
    assert got[len(texts)] == got[len(texts) + 1] == []
    assert got[3] == theirs.encode_ordinary(texts[3])
    back = {r.id: r.decoded for r in bpe.decode(ids, "ids", ["id"]).collect()}
    assert all(back[i] == t for i, t in enumerate(texts))
    assert bpe.encode(df.limit(0), "body", ["id"]).count() == 0


# 9 mixture


def test_rake_holds_shares_and_caps():
    tokens = np.array([100.0, 50.0, 30.0, 20.0, 10.0, 5.0])
    source = np.array([0, 0, 1, 1, 2, 2])
    lang = np.array([0, 1, 0, 1, 0, 1])
    cap = np.array([1.0, 1.0, 2.0, 2.0, 4.0, 4.0])
    use, total = mixture.rake(tokens, source, cap, np.array([0.5, 0.3, 0.2]), [lang])
    got = np.bincount(source, tokens * use)
    assert (use <= cap + 1e-9).all()
    assert got / got.sum() == pytest.approx([0.5, 0.3, 0.2], abs=1e-6)
    assert total == pytest.approx(min(150 / 0.5, 100 / 0.3, 60 / 0.2))


def test_mixture(spark):
    rng = random.Random(13)
    docs = [(i, sentence(rng, rng.randint(5, 30)), rng.choice(["a", "A ", "a", "b", "c", None]), rng.choice(["en", "DE", None]), None) for i in range(3000)] + [(9001, None, "a", "en", None), (9002, "", "b", "en", None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string, problem_id string")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("gone", 0.1, 1), ("c", 0.1, 3)], "source string, target_share double, max_repeats int")
    chosen, report, marginals = mixture.mixture(d, t)
    got = {r.source: r for r in report.collect()}
    assert set(got) == {"a", "b", "c", "gone"}
    assert got["gone"].mix_tokens == 0
    for s, want in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert got[s].reached_share == pytest.approx(want / 0.9, abs=0.005)
        assert got[s].most_copies <= got[s].max_repeats
    assert chosen.filter("copies < 1").count() == 0
    shares = {(r.dimension, r.name): r for r in marginals.collect()}
    assert {n for k, n in shares if k == "language"} == {"en", "de", "none"}
    for k in ("language", "topic"):
        for c in ("natural_share", "raked_share", "reached_share"):
            assert sum(r[c] for (x, _), r in shares.items() if x == k) == pytest.approx(1)
    assert all(r.reached_share == pytest.approx(r.raked_share, abs=0.02) == pytest.approx(r.natural_share, abs=0.02) for r in shares.values())
    none, empty, nothing = mixture.mixture(d.limit(0), t)
    assert none.count() == nothing.count() == 0
    assert empty.count() == 4


def test_topics_of_a_hot_problem_and_of_none(spark):
    """A third of the documents has one problem, a third none, and a problem's name may be blank: every document has its topic once."""
    docs = [(i, f"text number {i} of them", "a", "en", "hot" if i % 3 == 0 else None if i % 3 == 1 else f"p{i}") for i in range(600)] + [(601, "more text", "a", "en", "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string, problem_id string").withColumn("topic", F.lit("clash"))
    topics = spark.createDataFrame([("hot", "Algebra "), ("hot", "algebra"), ("p2", "geometry"), ("p5", ""), (None, "x")], "problem_id string, category string")
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    chosen, _, marginals = mixture.mixture(d, t, topics)
    assert chosen.count() == 601 and chosen.select("doc_id").distinct().count() == 601
    n = {r.doc_id: r.n_tokens for r in chosen.collect()}
    total = sum(n.values())
    got = {r.name: r.reached_share for r in marginals.filter("dimension = 'topic'").collect()}
    assert got == pytest.approx({"algebra": sum(n[i] for i in range(0, 600, 3)) / total, "geometry": n[2] / total, "none": (total - n[2] - sum(n[i] for i in range(0, 600, 3))) / total})


# 10 sentences


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("One is 3.5 here. Two follows!", ["One is 3.5 here.", "Two follows!"]),
        ("See Fig. 3 for it (see Sec. 2.1 for more). No. 5 is next.", ["See Fig. 3 for it (see Sec. 2.1 for more).", "No. 5 is next."]),
        ('Reviewers wrote "keep it." in 9 cases. "Is it used?" asked one.', ['Reviewers wrote "keep it." in 9 cases.', '"Is it used?" asked one.']),
        ("Der Lauf Nr. 90 lieferte 31, d. h. 2 mehr als am 3. Mai. Ab dem 12. Schritt steigt er usw. bis zum Ende.", ["Der Lauf Nr. 90 lieferte 31, d. h. 2 mehr als am 3. Mai.", "Ab dem 12. Schritt steigt er usw. bis zum Ende."]),
        ("„Wird er benutzt?“ fragte sie. Ja.", ["„Wird er benutzt?“ fragte sie.", "Ja."]),
        ("第一步。第二步！（见图3。）然后", ["第一步。", "第二步！", "（见图3。）", "然后"]),
        ("「3個で足りる。」と書いてある。次", ["「3個で足りる。」と書いてある。", "次"]),
        ("हल है। क्या यह सम है? हाँ", ["हल है।", "क्या यह सम है?", "हाँ"]),
        ("ข้อความแรก ข้อความที่สอง 12 ชิ้น", ["ข้อความแรก", "ข้อความที่สอง 12 ชิ้น"]),
        ("# Title\r\n\r\n- one\n- two\n1. three\n\nEnd", ["# Title", "- one", "- two", "1. three", "End"]),
        ("A line that\ngoes on. Next", ["A line that\ngoes on.", "Next"]),
        ("It was 12.The next one", ["It was 12.", "The next one"]),
        ("branches, etc. Drawing it. 3 p.m. and later", ["branches, etc.", "Drawing it.", "3 p.m. and later"]),
        ("stops at 1, 2, 3, ... so it ends... Now", ["stops at 1, 2, 3, ... so it ends...", "Now"]),
        ("Really?! Yes.", ["Really?!", "Yes."]),
    ],
)
def test_sentences(text, want):
    ends = list(sentences.unit_ends([text])[0])
    got, at = [], 0
    for e in ends:
        got.append(text[at:e].strip())
        at = e
    assert got == want


def test_sentences_do_not_depend_on_chunks_or_company(spark):
    rng = random.Random(14)
    texts = [" ".join(sentence(rng) for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, "", " \n ", "x. " * 4000]
    alone = [list(sentences.unit_ends([t])[0]) for t in texts]
    assert [list(x) for x in sentences.unit_ends(texts)] == alone
    kept = sentences.CHUNK
    try:
        sentences.CHUNK = 7
        assert [list(x) for x in sentences.unit_ends(texts)] == alone
    finally:
        sentences.CHUNK = kept
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, body string")
    assert sentences.sentence_units(df, "body", ["id"]).count() == sum(map(len, alone))
    assert sentences.sentence_units(df.limit(0), "body", ["id"]).count() == 0


def test_registered_queries_have_sql_of_the_same_names():
    from tracemill.llm import queries

    assert set(queries.ORACLE) <= set(queries.QUERIES)
    assert {f"p{i}" for i in range(1, 11)} == {k.split("_")[0] for k in queries.QUERIES}
