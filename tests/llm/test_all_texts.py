"""Contexts are counted over every different text, also over those that no sample would hold."""

import random

import pytest

from tracemill.llm import defects, truncation

LINES = ["We read the numbers from the table and add them up.", "The result is {} and it holds for the next row.", "Then comes the last part with {} steps.", "Hence the value is {} after all."]


@pytest.fixture(scope="module")
def rows():
    """Forty texts end where only a text of 200,000 characters goes on."""
    rng = random.Random(31)
    texts = ["\n\n".join(rng.choice(LINES).format(rng.randrange(99)) for _ in range(5)) for _ in range(400)]
    texts += [t + f"\n\nFor {i} we take the amber quotient" for i, t in enumerate(texts[:40])]
    texts.append("Here we take the amber quotient and go on, as " * 4_500 + "it is.")
    return [(i, t, "c", "What is it?") for i, t in enumerate([*texts, *texts[:30], None, "", "N/A"])]


def _model(rows):
    return truncation.EndModel().fit(sorted({r[1] for r in rows if r[1]}))


def test_scores_are_those_of_a_model_of_all_texts(spark, rows):
    df = spark.createDataFrame(rows, "id int, t string, c string, q string").repartition(5)
    features = truncation.materialize(truncation.map_texts(truncation._named(df, "t", "c", ["id"], None), truncation.end_features, ["id", "__field"], ["__t", "__q"], truncation.FEATURES))
    got = {r.id: r for r in truncation.scored_by_all(df, "t", features).collect()}
    want = {r.id: r for r in truncation.scored_ends(df, "t", "c", ["id"], _model(rows)).collect()}
    assert set(got) == set(want) and len(got) == len(rows)
    for i, w in want.items():
        assert got[i]["__score"] == (w["__score"] if w["__score"] is None else pytest.approx(w["__score"], abs=1e-4))
        assert got[i]["__shift"] == pytest.approx(w["__shift"], abs=1e-9)
        assert (got[i]["__language"], got[i]["__words"], got[i]["__field"]) == (w["__language"], w["__words"], w["__field"])


def test_cut_texts_by_the_counts_of_all_texts(spark, rows):
    df = spark.createDataFrame(rows, "id int, t string, c string, q string")
    got = {r.id for r in truncation.truncated_texts(df, "t", "c", ["id"]).filter("cut").collect()}
    assert got == {r.id for r in truncation.truncated_texts(df, "t", "c", ["id"], model=_model(rows)).filter("cut").collect()}
    assert got >= set(range(400, 440))


def test_nothing_to_count(spark):
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, " \n", "c")], "id int, t string, c string")
    assert {(r.id, r.has_text, r.cut) for r in truncation.truncated_texts(df, "t", "c", ["id"]).collect()} == {(i, False, False) for i in (1, 2, 3)}


def test_defects_by_the_counts_of_all_texts(spark, rows):
    df = spark.createDataFrame(rows, "id int, t string, c string, q string")
    got = {(r.id, r.defect) for r in defects.defects(df, "q", "t", "c", ["id"]).filter("defect is not null").collect()}
    assert got == {(r.id, r.defect) for r in defects.defects(df, "q", "t", "c", ["id"], model=_model(rows)).filter("defect is not null").collect()}
    assert {(i, "truncated") for i in range(400, 440)} | {(471, "empty"), (472, "empty"), (473, "empty")} <= got
