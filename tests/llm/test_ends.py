"""Bounds of the end model's sample, and ends and refusals of any length."""

import random

from pyspark.sql import functions as F

from tracemill.llm import defects, fillers, truncation

LINES = ["We read the numbers from the table and add them up.", "The result is {} and it holds for the next row.", "Then comes the last part with {} steps.", "Hence the value is {} after all."]


def make(rng, n):
    return ["\n\n".join(rng.choice(LINES).format(rng.randrange(99)) for _ in range(5)) for _ in range(n)]


def test_sample_is_bounded_by_a_hot_text(spark, monkeypatch):
    """Half the rows are one text with the least hash: it is drawn once, and both bounds hold."""
    rng = random.Random(5)
    texts = list(dict.fromkeys(make(rng, 400)))
    hot = spark.createDataFrame([(t,) for t in texts], "t string").orderBy(F.xxhash64("t", F.lit(5))).first().t
    df = spark.createDataFrame([(t, "c") for t in texts] + [(hot, "c")] * 4000 + [("x" * 200_000, "c"), (None, "c"), ("", "c")], "t string, c string")
    fitted = []
    monkeypatch.setattr(truncation.EndModel, "fit", lambda self, given: fitted.append(given) or self)
    truncation.sample_model(df, "t", max_texts=50)
    truncation.sample_model(df, "t", max_chars=5000)
    truncation.sample_model(df.limit(0), "t")
    assert len(fitted[0]) == len(set(fitted[0])) == 50 and hot in fitted[0]
    assert 1 < len(fitted[1]) and sum(map(len, fitted[1])) <= 5000
    assert fitted[2] == []


def test_refusals_of_any_length():
    long = "I'm sorry, but I can't help with this request. " + "My reasons are of a general kind and I hope that they meet with some understanding on your side. " * 20
    assert defects.refuses(long) and defects.defect_of("What is 5 + 3?", long) == "refusal"
    assert defects.refuses("Some words come before the point is reached, and they are many. " * 12 + "I must decline to answer.")
    worked = "We are not allowed to divide by 0 here. " + "Hence x = 5 + 3 and the next row has 8 of them. " * 9
    assert not defects.refuses(worked) and defects.defect_of("What is 5 + 3?", worked) is None


def test_fillers():
    for t in (None, "", " \n", "N/A", "n/a\n\nTODO\n", "the answer\nis", "<think></think>" * 90, "." * 3000, "\\boxed{}\n" * 70):
        assert fillers.holds_nothing(t)
    for t in ("x = 5", "a" * 500, "none of these holds", "N/A\n5", "." * 600 + " and then 5"):
        assert not fillers.holds_nothing(t)


def test_last_codes_and_words_are_those_of_the_whole_text():
    rng = random.Random(7)
    model = truncation.EndModel().fit(make(rng, 300))
    for _ in range(200):
        t = "".join(rng.choice(["a", "word ", "7" * 150, " " * 200, "\n" * 90, ". ", "12", "Hence "]) for _ in range(rng.randint(1, 40)))
        tail = truncation._last_codes(t)
        assert t.endswith(tail)
        whole = truncation._codes([t])[0][:-1][-24:]
        short = truncation._codes([tail])[0][:-1][-24:]
        assert list(short) == list(whole) or len(tail) == len(t)
        if t.strip():
            assert truncation._last_words(t) == fillers.units(t)[-truncation.ASKED_WORDS:]
    far = "Hence the value is 5 and it" + " " * 2000
    assert model.score([far.rstrip()])[0] == model.score(["Hence the value is 5 and it"])[0]


def test_cut_traces_by_their_own_operator(spark):
    """A cut text stays a cut text whatever else is wrong with it; the question given back is whole; counts of tokens alone decide nothing."""
    rng = random.Random(11)
    question = "How many of the tokens in the box are large if the clerk draws them all one after another"
    whole = make(rng, 300)
    cut = [t[: next(k for k in range(len(t) // 2 + i, len(t)) if t[k - 2 : k + 1].isalpha())] for i, t in enumerate(make(rng, 30))]
    rows = [(i, "s", question, [(t, len(t.split())) for t in whole[i::30]]) for i in range(30)]
    rows += [(100 + i, "s", question, [(t, None if i % 3 else len(t.split()) + 9)]) for i, t in enumerate(cut)]
    rows += [(200, "s", question, [(question, 50), ("N/A", 1), (None, None), ("...", 4), (whole[0], 9999)]), (201, None, None, []), (202, None, None, None), (200, "s", question, [(question, 50), ("N/A", 1), (None, None), ("...", 4), (whole[0], 9999)])]
    df = spark.createDataFrame(rows, "rollout_id long, shard string, problem_text string, traces array<struct<solution string, num_tokens int>>").withColumn("cut", F.lit(1))
    got = {(r.rollout_id, r.trace_id) for r in defects.cut_traces(df).collect()}
    assert {r for r, _ in got} == {100 + i for i in range(30)}
    rates = {r.shard: (r.traces, r.with_text, r.cut) for r in defects.cut_rates(df).collect()}
    assert rates == {"s": (335, 332, 30)}
