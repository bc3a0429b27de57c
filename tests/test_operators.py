"""Joins, R-IR kernels, statistics, files and streams on small inputs."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import evals, pairs, rir, select, stats
from tracemill.operators import prefixes as N
from tracemill.operators import traces as T
from tracemill.sources import files

ANN = "problem_id string, rollout_id int, trace_id int, is_correct boolean, dsr double, verification_density double, live_verification_rate double"


@pytest.fixture(scope="module")
def annotated(spark):
    return spark.createDataFrame([("p1", 1, 0, True, 0.05, 0.1, 0.9), ("p1", 1, 1, True, 0.50, 0.3, 0.2), ("p1", 1, 2, False, 0.45, 0.2, 0.1)], ANN)


def test_pairs(annotated):
    one = lambda df: [(r.chosen_trace_id, r.rejected_trace_id) for r in df.collect()]
    assert one(pairs.efficiency_pairs(annotated)) == [(0, 1)]
    assert one(pairs.productive_pairs(annotated)) == [(0, 1)]
    assert one(pairs.direction_pairs(annotated)) == [(0, 2)]
    assert pairs.efficiency_pairs(annotated.limit(0)).count() == 0


def test_pair_cap_is_that_of_the_whole_join(spark):
    rng = random.Random(1)
    rows = [(f"p{rng.randint(0, 3)}", i, 0, rng.random() < 0.7, rng.choice([0.0, 0.1, 0.2, 0.4, 0.6]), 0.0, 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, ANN)
    got = {(r.problem_id, r.chosen_rollout_id, r.rejected_rollout_id) for r in pairs.efficiency_pairs(df).collect()}
    want = set()
    for p in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == p and r[3])
        every = [(p, a[1], b[1]) for a in sorted(mine, key=lambda r: r[1]) if a[4] < 0.15 for b in sorted(mine, key=lambda r: r[1]) if b[4] > 0.35]
        want |= set(every[:3])
    assert got == want


def test_reach_any_graph(spark):
    rng = random.Random(2)
    rows, want = [], []
    for i in range(60):
        n = rng.randint(0, 12)
        ids = rng.sample(range(1, 40), n)
        steps = [(k, rng.choice(["derivation", "verification", "conclusion"]) if rng.random() < 0.4 else "derivation", [rng.choice([*ids, 99]) for _ in range(rng.randint(0, 2))]) for k in ids]
        seeds = [s[0] for s in steps if s[1] == "conclusion"] or ([steps[-1][0]] if steps else [])
        by = {s[0]: s[2] for s in steps}
        live, stack = set(seeds), list(seeds)
        while stack:
            for j in by[stack.pop()]:
                if j in by and j not in live:
                    live.add(j)
                    stack.append(j)
        rows.append((i, steps))
        want.append(sorted(live))
    df = spark.createDataFrame(rows, "i int, steps array<struct<id:int,type:string,inputs:array<int>>>")
    got = rir.eliminate(df).orderBy("i").collect()
    assert [r.live_ids for r in got] == want
    assert all(len(r.live_ids) + r.dead_count == r.total for r in got)


def test_rank_tests(spark):
    rng = random.Random(4)
    rows = [(rng.random() < 0.5, float(rng.randint(0, 6))) for _ in range(150)]
    df = spark.createDataFrame(rows, "flag boolean, v double")
    r = stats.mann_whitney(df, "v", "flag").first()
    a, b = [v for f, v in rows if f], [v for f, v in rows if not f]
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert r.u == pytest.approx(u)
    n = len(rows)
    ties = sum(t**3 - t for t in (sum(v == k for _, v in rows) for k in range(7)))
    sigma = math.sqrt(len(a) * len(b) / 12 * (n + 1 - ties / (n * (n - 1))))
    assert r.z == pytest.approx(max(0.0, abs(u - len(a) * len(b) / 2) - 0.5) / sigma)


def test_categories_and_selection(spark):
    rows = [("p", 1, i, i != 1, 10 * i, float(i), 0.1 * i, 1.0 - 0.1 * i, 3) for i in range(3)] + [("q", 2, 0, False, 5, 0.0, 0.5, 0.5, 2)]
    df = spark.createDataFrame(rows, "problem_id string, rollout_id int, trace_id int, is_correct boolean, num_tokens int, post_answer_len double, dsr double, quality_reward double, num_steps int")
    assert {r.problem_id: r.trace_id for r in select.best_of_n(df, "longest").collect()} == {"p": 2, "q": 0}
    assert {r.problem_id: r.trace_id for r in select.best_of_n(df, "dsr").collect()} == {"p": 0, "q": 0}
    assert {r.problem_id: r.category for r in stats.categories(df).collect()} == {"p": "partial", "q": "all_incorrect"}


def test_metrics_leave_out_empty_subjects(spark):
    df = spark.createDataFrame([("b", "", 0, True, 10), ("b", "s", 2, False, 20)], "benchmark string, subject string, level int, is_correct boolean, num_tokens int")
    got = {(r.dim, r.key): r.total for r in evals.metrics(df).collect()}
    assert got == {("all", ""): 2, ("subject", "s"): 1, ("level", "2"): 1}


def test_files(spark, tmp_path):
    one = [{"problem_id": "prob_10", "problem_text": "q", "traces": [{"solution": "a b", "answer": "1", "is_correct": True}]}, {"problem_id": "prob_2", "traces": []}]
    (tmp_path / "a.json").write_text(json.dumps(one))
    (tmp_path / "b.json").write_text(json.dumps(one[:1]))
    rows, twice = files.merge_shards(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json"))
    assert [r.problem_id for r in rows.collect()] == ["prob_10", "prob_10", "prob_2"]
    assert [r.problem_id for r in twice.collect()] == ["prob_10"]
    (tmp_path / "c.json").write_text(json.dumps([{"conversations": [{"from": "human", "value": "q0"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "so \\boxed{7}"}]}]))
    assert [tuple(r) for r in files.read_problems(spark, str(tmp_path / "c.json")).collect()] == [("prob_0", "q", "7")]
    d = tmp_path / "records"
    d.mkdir()
    (d / "rec_3.json").write_text(json.dumps({"steps": [{"id": 1, "type": "conclusion", "inputs": []}]}))
    (d / "x_summary.json").write_text("{}")
    assert [r.problem_id for r in files.read_records(spark, str(d)).collect()] == ["rec_3"]
    p = spark.createDataFrame([("p", "c", "r"), ("q", "c", "r")], "problem_id string, chosen_solution string, rejected_solution string")
    t = spark.createDataFrame([("p", "what?"), ("q", "")], "problem_id string, problem_text string")
    files.write_pairs(p, t, str(tmp_path / "out"))
    back = files.read_pairs(spark, str(tmp_path / "out")).collect()
    assert len(back) == 1
    assert back[0].chosen.value == "c"


def test_choices(spark):
    df = spark.createDataFrame([("q", ["x", "", "y"], "y"), ("q", ["x"], "z")], "q string, o array<string>, r string")
    rows = df.select(files.choices(F.col("q"), F.col("o")).alias("t"), files.choice_letter(F.col("q"), F.col("o"), F.col("r")).alias("a")).collect()
    assert f"{rows[0].a}) y" in rows[0].t
    assert rows[1].a == "A"


@pytest.mark.parametrize("motifs", [False, True])
def test_stream_equals_batch(spark, tmp_path, motifs):
    from tracemill.streaming import online

    rng = random.Random(7)
    bits = ["Let me check that k = 12 holds.", "So k = 12 and then 40.", "What if we try another way?", "Then m = 77 follows.", "Nothing here.", "The answer is \\boxed{40}.", "Let me verify m = 77."]
    traces = [("p", i, 0, "\n\n".join(rng.choice(bits) + rng.choice(["", "\t", "\u3000"]) for _ in range(rng.randint(1, 24)))) for i in range(25)]
    df = spark.createDataFrame(traces, "problem_id string, rollout_id bigint, trace_id int, solution string")
    want = {(r.rollout_id, r.step_id): (r.num_dead, r.intervention, r.num_motifs if motifs else 0) for r in N.timeline(T.parse(df)).collect()}
    rows = online.paragraphs(df).withColumn("paragraph", F.concat(F.lit("\t"), "paragraph")).withColumn("ts", F.lit("2026-01-01").cast("timestamp"))
    rows.filter("paragraph_idx % 2 = 1").coalesce(1).write.parquet(str(tmp_path / "in"))  # odd ones come first
    rows.filter("paragraph_idx % 2 = 0").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = online.watch(stream, motifs=motifs).writeStream.format("memory").queryName(f"watched{motifs}").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.rollout_id, r.step_id): (r.num_dead, r.intervention, r.num_motifs if motifs else 0) for r in spark.table(f"watched{motifs}").collect()}
    assert got == want


def test_stream_state_is_bounded_and_gaps_close():
    from tracemill.streaming.online import TraceState

    s = TraceState()
    for i in range(100):
        list(s.arrive(i, "derivation", [f"s{i}"]))
    assert len(s.symbols) == 10 and len(TraceState(s.saved()).types) == 100
    assert list(s.arrive(105, "conclusion", [])) == list(s.arrive(103, "derivation", [])) == []
    assert [x[:2] for x in s.rest()] == [(100, 101), (101, 102)] and not s.early
