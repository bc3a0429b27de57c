"""Column functions against golden cases and plain-Python versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracemill.functions import fixed, text
from tracemill.operators import traces as T


def run(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[1] for r in df.select("i", fn(F.col("s")).alias("v")).orderBy("i").collect()]


GOLDEN = [
    ("Let me verify this by substituting back.", "verification"),
    ("2 + 3 = 5, and 5 * 4 = 20", "computation"),
    ("What if we try a different approach? Alternatively...", "exploration"),
    ("Wait, actually that is wrong. Let me reconsider.", "correction"),
    ("Therefore the answer is \\boxed{42}.", "conclusion"),
    ("By the triangle inequality, we have a + b > c.", "derivation"),
    ("2+3=5.", "derivation"),
]


def test_step_types(spark):
    assert run(spark, [g for g, _ in GOLDEN], lambda c: text.step_type(c, F.lower(c))) == [t for _, t in GOLDEN]


def plain_type(t):
    if "\\boxed{" in t or "\\boxed " in t:
        return "conclusion"
    low = t.lower()
    n = lambda ps, x: sum(bool(re.search(p, x)) for p in ps)
    scores = {"verification": 2 * n(fixed.VERIFICATION, low), "exploration": 1.5 * n(fixed.EXPLORATION, low), "correction": 1.5 * n(fixed.CORRECTION, low), "computation": n(fixed.COMPUTATION, t)}
    best = max(scores, key=scores.get)
    return best if scores[best] >= 2 else "derivation"


def test_step_types_random(spark):
    rng = random.Random(3)
    bits = ["let me ", "check", "verify", "what if ", "perhaps ", "suppose ", "wait", " wait,", "actually,", "actually ", "i made an error", "going back", "\\frac{1}{2}", "= 12", "3 + 4 = 7", "\\cdot", "indeed,", "as expected", "maybe we should", "no, that", "no wait", "double-check", "Alternatively", "That's wrong", "\\sqrt{x}", " ", "\n", "the", "re", "consider", "to confirm our", "let's see", "let's make sure", "\\sum"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    assert run(spark, texts, lambda c: text.step_type(c, F.lower(c))) == [plain_type(t) for t in texts]


def test_segments(spark):
    got = run(spark, ["Step 1.\n\nStep 2.\n\nStep 3.", None, " \n\n ", "a\n \nb", "a\n\n\n\n b "], text.segments)
    assert got == [["Step 1.", "Step 2.", "Step 3."], [], [], ["a\n \nb"], ["a", "b"]]


def test_symbols(spark):
    got = run(spark, ["x^2 + 2x + 1 = 49", "Consider a_1, x_{12}, and n_k", "123a a123 1.25a \\pi \\pitchfork"], text.symbols)
    assert got[0] == ["49", "x"]
    assert {"a_1", "x_12", "n_k"} <= set(got[1])
    assert {"12", "23", "1.2", "\\pi"} <= set(got[2])


def test_boxed(spark):
    cases = ["\\boxed{\\frac{1}{2}} then \\boxed{3", "no box", None, "\\boxed{1} and \\boxed{ 2 }", "\\boxed{a\\boxed{b}c}"]
    assert run(spark, cases, text.boxed_answer) == ["\\frac{1}{2}", "", "", "2", "a\\boxed{b}c"]


@pytest.mark.parametrize(("raw", "want"), [("\\dfrac 59", "\\frac{5}{9}"), ("145^\\circ", "145"), (".5", "0.5"), ("58,500", "58500"), ("x=5", "5"), ("4210_{5}", "4210"), ("\\text{ab}", "ab"), ("\\sqrt2.", "\\sqrt{2}")])
def test_normalize(spark, raw, want):
    assert run(spark, [raw], text.normalize_answer) == [want]


def test_correct(spark):
    df = spark.createDataFrame([("1/2", "1/2"), ("", ""), (None, "1"), ("x=3", "3")], "a string, b string")
    assert [r[0] for r in df.select(text.correct(F.col("a"), F.col("b"))).collect()] == [True, False, False, True]


TRACE = "\n\n".join(["Let x = 5 be given.", "By substitution we see it.", "Since q holds, consider it.", "What if we try a different approach? Alternatively we stop.", "The answer is \\boxed{}."])


def test_graph_and_liveness(spark):
    rows = [("p", 1, 0, s, True, None) for s in [TRACE]] + [("p", 2, 0, "", True, None), ("p", 3, 0, None, False, None)]
    df = spark.createDataFrame(rows, "problem_id string, rollout_id int, trace_id int, solution string, is_correct boolean, num_tokens bigint")
    got = {r.rollout_id: r for r in T.annotate(T.parse(df)).collect()}
    assert got[1].num_steps == 5
    assert got[1].dsr == pytest.approx(0.6)
    for k in (2, 3):
        assert (got[k].num_steps, got[k].dsr, got[k].live_verification_rate, got[k].trace_length) == (0, 0.0, 0.0, 0)
    steps = T.exploded(T.parse(df)).collect()
    assert all(0 <= j < r.step_id and r.step_id - j <= 10 for r in steps for j in r.inputs)
    assert all(r.is_live for r in steps if r.step_type == "conclusion")


def test_live_fold_random(spark):
    rng = random.Random(5)
    rows, want = [], []
    for i in range(80):
        n = rng.randint(1, 40)
        edges = [sorted(rng.sample(range(max(0, k - 10), k), min(k, rng.randint(0, 2)))) for k in range(n)]
        seeds = sorted(rng.sample(range(n), rng.randint(1, min(3, n))))
        live, stack = set(seeds), list(seeds)
        while stack:
            for j in edges[stack.pop()]:
                if j not in live:
                    live.add(j)
                    stack.append(j)
        rows.append((i, edges, seeds))
        want.append(sorted(live))
    df = spark.createDataFrame(rows, "i int, e array<array<int>>, s array<int>")
    assert [r[1] for r in df.select("i", T.live_ids(F.col("e"), F.col("s"))).orderBy("i").collect()] == want


def test_sql_names(spark):
    from tracemill.functions.register import plain_step_type, register

    assert [plain_step_type(g) for g, _ in GOLDEN] == [t for _, t in GOLDEN]
    rows = [(1, "p", "q", "7", "s", [("Let x = 12.\n\nSo \\boxed{12}.", "12", True, 5)])]
    schema = "rollout_id bigint, problem_id string, problem_text string, ground_truth string, shard string, traces array<struct<solution:string,answer:string,is_correct:boolean,num_tokens:int>>"
    register(spark, spark.createDataFrame(rows, schema))
    assert [r.step_type for r in spark.sql("select * from trace_steps('Let x = 12.\n\nSo \\\\boxed{12}.')").collect()] == ["derivation", "conclusion"]
    assert spark.sql("select count(*) as n from trace_rows where is_live").first().n == 2
    assert spark.sql("select num_steps from trace_metrics").first().num_steps == 2
