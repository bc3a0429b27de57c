"""Report queries against their SQL, and the statistics under them against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from test_catalogue import duck  # noqa: F401
from test_every_trace import _equals_sql
from tracemill.functions import text
from tracemill.operators import rir, stats
from tracemill.operators import traces as T
from tracemill.plans import catalogue, exchange, reports  # noqa: F401

SOME = ["lenient_correctness", "segments_raw", "pair_texts", "parser_path", "graph_records", "quality_variance_stats", "best_of_n_levels", "rir_difficulty_within", "verdict_checks", "typed_dse_totals", "theta_policy", "observation_summary", "condition_deltas", "disagreement_groups", "hint_summary", "annotations_written", "reflection_prompts"]


@pytest.mark.parametrize("name", SOME)
def test_report_equals_sql(spark, duck, name):  # noqa: F811
    _equals_sql(spark, duck, name)


def test_names():
    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES)
    assert len(catalogue.QUERIES) >= 150


def test_medians(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.choice([None, round(rng.random(), 2)])) for _ in range(501)] + [("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r["median"] for r in stats.medians(df, "v", "g", list("abcde")).collect()}
    assert got == pytest.approx({g: statistics.median([v for k, v in rows if k == g and v is not None]) for g in "abc"})
    assert stats.medians(df.limit(0), "v", "g", ["a"]).count() == 0


def test_correlation_of_what_does_not_vary(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "a double, b double")
    assert df.agg(stats.correlation("a", "b").alias("r")).first().r is None
    rng = random.Random(4)
    x = [(rng.random(), rng.random()) for _ in range(50)]
    r = spark.createDataFrame([*x, (None, 9.0)], "a double, b double").agg(stats.correlation("a", "b").alias("r")).first().r
    assert r == pytest.approx(statistics.correlation(*zip(*x)))


@pytest.mark.parametrize(
    ("predicted", "truth", "want"),
    [("(A)", "A", True), ("A", "[A]", True), ("(A]", "A", False), ("3+2", "3\\pm2", True), ("3-2", "3\\pm2", True), ("3+2or3-2", "3\\pm2", True), ("3*2", "3\\pm2", False), ("", "", False), (None, "1", False), ("(", "", False), ("1\\pm2", "1\\pm2", True)],
)
def test_lenient(spark, predicted, truth, want):
    df = spark.createDataFrame([(predicted, truth)], "p string, t string")
    assert df.select(text.lenient_correct(F.col("p"), F.col("t")).alias("c")).first().c is want


def test_boxes_letters_and_labels(spark):
    rows = [("\\boxed{1} and \\boxed{a{b}c} x", "a{b}c"), ("\\boxed{1} and \\boxed{2", None), ("none", None), (None, None), ("\\boxed{}", "")]
    df = spark.createDataFrame(rows, "s string, want string")
    assert all(r.got == r.want for r in df.select(text.last_boxed(F.col("s")).alias("got"), "want").collect())
    letters = spark.createDataFrame([("It is B or C",), ("\\boxed{D} A",), ("A " + "x" * 300,), ("ABCD",), (None,)], "s string").select(text.letter_answer(F.col("s")).alias("a"))
    assert [r.a for r in letters.collect()][:4] == ["B", "D", "", ""]
    d = spark.createDataFrame([(0.5, 0.25), (1.0, 3.5)], "a double, b double")
    assert [r.x for r in d.select(text.delta_label(F.col("a"), F.col("b")).alias("x")).collect()] == ["-25.0%", "+250.0%"]
    assert [r.x for r in d.select(text.delta_label(F.col("a"), F.col("b"), percent=False).alias("x")).collect()] == ["-0.25", "+2.50"]


def test_policy_keeps_scaffolding_that_is_near(spark):
    t = "Let x_1 = 12 be given.\n\nLet me verify: nothing of it matters, sanity check.\n\nThe answer is \\boxed{12}.\n\nZebra compute 77 + 1 = 78 here and 78 * 2 = 156."
    p = T.parse(spark.createDataFrame([("p", 1, 0, t), ("p", 1, 1, ""), ("p", 1, 2, None)], "problem_id string, rollout_id long, trace_id int, solution string"))
    got = {r.trace_id: (r.kept_steps, r.cleaned) for r in rir.theta_policy(p).collect()}
    assert got[1] == got[2] == (0, "")
    assert "sanity check" in got[0][1] and "boxed" in got[0][1] and "Zebra" not in got[0][1]


def test_no_text_is_shuffled_for_repeated_deliveries(spark):
    """The exchanges of queries that carry texts on hold keys and places, not texts."""
    from test_catalogue import DATA

    if not DATA.exists():
        pytest.skip("no test tables")
    for name in ("think_texts", "keyword_clean", "clean_variants", "sft_records"):
        plan = catalogue.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(rollout_id" in plan or "hashpartitioning(__at" in plan or "Exchange" in plan
        assert "solution" not in "".join(line for line in plan.split("\n") if "hashpartitioning" in line)
