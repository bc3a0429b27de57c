"""Files that pipelines exchange: what is written is read back, sources are joined, models are hooked in."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracemill.operators import rir
from tracemill.operators import traces as T
from tracemill.sources import files, models, sinks

SOLUTION = "Let x = 12.\n\nLet me verify: substituting back, 12 = 12.\n\nSo x = 12 + y_1 and y_1 = 30.\n\nThe answer is \\boxed{42}"


@pytest.fixture(scope="module")
def traces(spark):
    rows = [("p1", 1, [(SOLUTION, "42", True, 9), ("", "", False, None)]), ("p2", 2, [("No box, the choice is B", "B", False, 3)]), ("p1", 1, [(SOLUTION, "42", True, 9), ("", "", False, None)])]
    r = spark.createDataFrame(rows, "problem_id string, rollout_id long, traces array<struct<solution string, answer string, is_correct boolean, num_tokens int>>")
    return r.select("*", F.lit("q").alias("problem_text"), F.lit("42").alias("ground_truth"), F.lit("s").alias("shard"))


def test_annotations_round_trip(spark, traces, tmp_path):
    a = sinks.annotations(T.parse(T.flatten(traces)))
    sinks.write_json(a, str(tmp_path / "a"), "problem_id")
    back = files.read_annotations(spark, str(tmp_path / "a"))
    assert sorted(map(str, back.collect())) == sorted(map(str, a.select(*back.columns).collect()))
    assert back.count() == 3
    assert set(back.filter("num_steps > 0 and rollout_id = 1").first().typed_dsr) >= {"conclusion", "verification"}


def test_rollouts_and_shards_round_trip(spark, traces, tmp_path):
    one = traces.dropDuplicates(["rollout_id"])
    sinks.write_json(one, str(tmp_path / "r"), "problem_id")
    back = spark.read.schema(files.ROLLOUT).json(str(tmp_path / "r"))
    assert [(r.problem_id, len(r.traces)) for r in back.orderBy("problem_id").collect()] == [("p1", 2), ("p2", 1)]


def test_evaluation_and_reports(spark, tmp_path):
    results = spark.createDataFrame([("a", True), ("b", False)], "id string, is_correct boolean")
    sinks.write_evaluation(results, results.agg(F.count("*").alias("n")), str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e" / "results")).count() == 2
    assert spark.read.json(str(tmp_path / "e" / "metrics")).first().n == 2
    deltas = spark.createDataFrame([("m", "all", "", 0.5, 0.625, -12.5), ("m", "level", "3", 0.5, 0.4, 3.0)], "benchmark string, dim string, key string, base_accuracy double, new_accuracy double, tokens_delta double")
    report = sinks.comparison(deltas, "one", "two")
    assert "| **m** accuracy | 50.0% | 62.5% | +12.5% | -12.50 |" in report
    assert "| m level 3 | 50.0% | 40.0% | -10.0% | +3.00 |" in report
    sinks.write_report(spark, str(tmp_path / "r.md"), report, "end")
    assert (tmp_path / "r.md").read_text().endswith("end")
    sinks.write_sample(spark.range(200), ["id"], str(tmp_path / "s.json"))
    assert [r["id"] for r in json.loads((tmp_path / "s.json").read_text())] == list(range(50))
    with pytest.raises(ValueError, match="rows"):
        sinks.write_summary(spark.range(sinks.REPORT_ROWS + 1), str(tmp_path / "x.json"))


def test_training_sets(spark, traces, tmp_path):
    r = rir.records(T.parse(T.flatten(traces.dropDuplicates(["rollout_id"])))).filter("size(rsteps) > 0")
    stats = rir.variant_lengths(r).agg(F.count("*").alias("total"), F.sum("len_original").alias("total_chars"))
    sinks.write_training_sets(rir.variants(r), traces.select("problem_id", F.col("problem_text").alias("question")).distinct(), stats, str(tmp_path / "d"))
    got = spark.read.json(str(tmp_path / "d" / "cleaned"))
    assert {r.variant for r in got.select("variant").distinct().collect()} == {"original", "dse", "noverif", "liveverif", "keywordclean"}
    assert got.filter("variant = 'original'").count() == 2 and got.first().system.startswith("Please reason")
    assert json.loads((tmp_path / "d" / "dataset_stats.json").read_text())["total"] == 2
    assert set(json.loads((tmp_path / "d" / "dataset_info.json").read_text())) == {"original", "dse", "noverif", "liveverif", "keywordclean"}


def test_three_sources(spark, tmp_path):
    for d in ("rir", "dse"):
        (tmp_path / d).mkdir()
    (tmp_path / "raw.json").write_text(json.dumps([{"id": i, "question": f"q{i}", "solution": f"s{i}", "answer": "1"} for i in range(4)]))
    step = {"id": 0, "content": "x", "type": "conclusion", "inputs": [], "original_tokens": 1}
    for name, metadata in (("a_0", {"limo_id": "0"}), ("a_1", {}), ("a_7", {"limo_id": "2"})):
        (tmp_path / "rir" / f"{name}.json").write_text(json.dumps({"steps": [step], "metadata": metadata, "paragraph_texts": {"10": "c", "2": "b", "0": "a"}, "original_answer": "so\n7", "ground_truth": "7.0"}))
    (tmp_path / "rir" / "a_9.json").write_text(json.dumps({"steps": [], "metadata": {}}))
    for name, body in (("r_0", {"limo_id": 0, "dead_ids": [1]}), ("r_1", {"dead_ids": []}), ("r_3", {"dead_ids": []})):
        (tmp_path / "dse" / f"{name}.json").write_text(json.dumps(body))
    paths = [str(tmp_path / x) for x in ("raw.json", "rir", "dse")]
    assert {(r.limo_id, r.question, tuple(r.dead_ids)) for r in files.read_three_way(spark, *paths).collect()} == {(0, "q0", (1,)), (1, "q1", ())}
    with pytest.raises(ValueError, match="needed"):
        files.read_three_way(spark, *paths, min_parsed=3)
    s = files.structured(files.read_records(spark, str(tmp_path / "rir")))
    assert [r.paragraph_texts for r in s.collect()] == [["a", "b", "c"]] * 3
    assert rir.features(s).filter("is_correct and total = 1").count() == 3


def test_items_lookups_and_pairs_of_files(spark, tmp_path):
    m = spark.createDataFrame([("u1", "p", "3", None, None), ("u2", "p", "4", "algebra", 5)], "unique_id string, problem string, answer string, subject string, level int")
    assert [(r.subject, r.level, r.benchmark) for r in files.items(m).orderBy("id").collect()] == [("", 0, "math500"), ("algebra", 5, "math500")]
    c = spark.createDataFrame([("Which?", "right", "a", "", None, None), (None, "x", "y", "z", "w", "s")], "question string, correct string, incorrect_1 string, incorrect_2 string, incorrect_3 string, subdomain string")
    r = files.choice_items(c).collect()
    assert len(r) == 1 and r[0].id == "gpqa_0" and r[0].answer in "AB" and f"{r[0].answer}) right" in r[0].problem and r[0].problem.endswith("in \\boxed{}.")
    assert files.first_that_reads(spark, str(tmp_path / "none")) is None
    m.write.parquet(str(tmp_path / "second"))
    assert files.first_that_reads(spark, str(tmp_path / "none"), str(tmp_path / "second")).count() == 2
    (tmp_path / "l2.json").write_text(json.dumps({"p1": {"0": {"dsr": 0.5, "quality_reward": 0.7}, "1": {"dsr": 0.1}}, "p2": {}}))
    assert {(r.problem_id, r.trace_id, r.dsr) for r in files.read_lookup(spark, str(tmp_path / "l2.json")).collect()} == {("p1", 0, 0.5), ("p1", 1, 0.1)}
    for n, right in (("a", [True, False, True]), ("b", [False, False])):
        (tmp_path / f"{n}.json").write_text(json.dumps([{"id": f"x{i}", "is_correct": v} for i, v in enumerate(right)]))
    got = files.read_paired(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json"))
    assert [(r.place, r.base.is_correct, r.new.is_correct) for r in got.orderBy("place").collect()] == [(0, True, False), (1, False, False)]
    (tmp_path / "map.json").write_text(json.dumps({"p1": "What?", "p2": ""}))
    assert {tuple(r) for r in files.read_problem_map(spark, str(tmp_path / "map.json")).collect()} == {("p1", "What?"), ("p2", "")}


def test_problems_numbered_over_many_files(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"part{k}.json").write_text(json.dumps([{"conversations": [{"from": "human", "value": f"q{k}-{i}"}, {"from": "gpt", "value": f"\\boxed{{{i}}}"}][: 2 if i != 1 else 1]} for i in range(4)]))
    got = {r.problem_id: (r.problem_text, r.ground_truth) for r in files.read_problems(spark, str(tmp_path)).collect()}
    assert set(got) == {f"prob_{i}" for i in range(15)} and len(set(got.values())) == 15


def test_models(spark):
    def stub(frames):
        for f in frames:
            out = f[["problem_id", "condition"]].copy()
            out["sample"] = f["sample"].astype("int32") if "sample" in f else 0
            out["solution"] = ["\\boxed{" + ("42" if s % 2 == 0 else "0") + "}" if p != "c" else "The choice is B, I think" for p, s in zip(f["problem_id"], out["sample"])]
            out["num_tokens"] = 3
            yield out

    p = spark.createDataFrame([("a", "What?", "42"), ("b", "Why?", "7")], "problem_id string, problem_text string, ground_truth string")
    m = {(r.problem_id, r.condition): [(t.role, t.content) for t in r.messages] for r in models.messages(p).collect()}
    assert len(m) == 6 and m["a", "baseline"] == [("user", "What?")]
    assert [x for x, _ in m["a", "structural_hint_v2"]] == ["system", "user"] and m["b", "structural_hint"][0][1].endswith("\n\nWhy?")
    r = {x.problem_id: [t.is_correct for t in x.traces] for x in models.sampled(p, stub, 4).collect()}
    assert r == {"a": [True, False, True, False], "b": [False] * 4}
    items = spark.createDataFrame([("a", "What?", "42", "", 0, "math500"), ("c", "Which?", "B", "", 0, "gpqa")], "id string, problem string, answer string, subject string, level int, benchmark string")
    assert {x.id: (x.predicted, x.is_correct) for x in models.evaluated(items, stub).collect()} == {"a": ("42", True), "c": ("B", True)}
    rollouts = models.sampled(p, stub, 4)
    asked = {x.problem_id: x.prompt for x in models.reflection_requests(rollouts).collect()}
    assert set(asked) == {"b"} and "0, 42" in asked["b"]
    assert models.hint_requests(p).filter("problem_id = 'b'").first().prompt.endswith("Problem: Why?")
    hints = spark.createDataFrame([("a", " " + "h" * 250)], "problem_id string, hint string")
    assert models.hinted(p, hints).first().prompt == models.fixed.HINT_GIVEN + "h" * 200 + "...\n\nNow solve this problem:\nWhat?"
    assert models.fixed.HINT_REFLECTED + "h" * 250 + "\n\nNow solve:\nWhat?" == models.hinted(p, hints, reflected=True).first().prompt


def test_parser_model(spark):
    t = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d"), (1, 4, "e")], "rollout_id long, trace_id int, solution string")
    replies = {
        "a": 'Sure: {"steps": [{"id": 5, "type": "derivation", "inputs": [9, 5, 77]}, {"id": 9, "type": "computation", "content": "x"}, {"id": 2, "type": "conclusion", "inputs": [5]}, {"id": 3, "type": "verification", "inputs": [2]}]} done',
        "b": '{"steps": [{"inputs": [1]}, {"inputs": [0]}, {}]}',
        "c": "no structure {broken",
        "d": '{"steps": []}',
        "e": None,
    }

    def model(frames):
        for f in frames:
            yield pd.DataFrame({"rollout_id": f["rollout_id"], "trace_id": f["trace_id"], "reply": [replies[x] for x in f["prompt"]]})

    got = {r.solution: (r.parse_success, [list(e) for e in r.edges], list(r.live)) for r in models.parsed_by(t, model).collect()}
    assert got["a"] == (True, [[1], [], [0], [2]], [0, 1, 2])
    assert got["b"] == (True, [[1], [0], []], [2])
    assert got["c"] == got["d"] == got["e"] == (False, [], [])
