"""Hooks for outside models: prompts that go in, and what is made of the replies.

A model is any function from an iterator of pandas frames to an iterator of frames, run
once per partition by ``mapInPandas``; everything around it is columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import fixed, text
from tracemill.operators.parser import parse_replies

REPLIES = "problem_id string, condition string, sample int, solution string, num_tokens int"
#: Conditions of guided generation: (system prompt or None, what stands before the question).
CONDITIONS = {"baseline": (None, ""), "structural_hint": (None, fixed.STRUCTURAL_PREFIX), "structural_hint_v2": (fixed.STRUCTURAL_SYSTEM, "")}


def messages(problems: DataFrame, conditions: dict[str, tuple[str | None, str]] | None = None) -> DataFrame:
    """(problem_id, condition, messages): every problem under every condition, as role and content turns; the conditions are a handful of rows."""
    rows = [(k, s, p) for k, (s, p) in (conditions or CONDITIONS).items()]
    c = problems.sparkSession.createDataFrame(rows, "condition string, system string, prefix string")
    turn = lambda who, what: F.struct(F.lit(who).alias("role"), what.alias("content"))
    turns = F.array(turn("system", F.col("system")), turn("user", F.concat("prefix", "problem_text")))
    return problems.join(F.broadcast(c)).select("problem_id", "condition", F.filter(turns, lambda t: t["content"].isNotNull()).alias("messages"))


def generate(prompts: DataFrame, model, schema: str = REPLIES) -> DataFrame:
    """Rows made by an outside model, once per partition."""
    return prompts.mapInPandas(model, schema)


def sampled(problems: DataFrame, model, k: int) -> DataFrame:
    """Rollouts of ``k`` samples a problem: (problem_id, problem_text, ground_truth, traces), answers extracted and checked.

    ``model`` gets (problem_id, condition, messages, sample), a row per sample, and returns
    REPLIES. Samples of one problem are a bounded group of ``k`` rows.
    """
    asked = messages(problems, {"baseline": (None, "")}).select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("sample"))
    got = generate(asked, model).join(problems.select("problem_id", "ground_truth", "problem_text"), "problem_id")
    answer = text.boxed_answer(F.col("solution"))
    trace = F.struct("sample", F.struct("solution", answer.alias("answer"), text.correct(answer, F.col("ground_truth")).alias("is_correct"), "num_tokens").alias("t"))
    g = got.groupBy("problem_id").agg(F.any_value("problem_text").alias("problem_text"), F.any_value("ground_truth").alias("ground_truth"), F.array_sort(F.collect_list(trace)).alias("s"))
    return g.select("problem_id", "problem_text", "ground_truth", F.transform("s", lambda x: x["t"]).alias("traces"))


def evaluated(items: DataFrame, model) -> DataFrame:
    """One reply for every item (id, problem, answer, subject, level, benchmark), with the predicted answer and whether it is right.

    Multiple-choice items fall back to the first letter that stands alone in the last 200
    characters where nothing is boxed.
    """
    asked = messages(items.select(F.col("id").alias("problem_id"), F.col("problem").alias("problem_text")), {"baseline": (None, "")}).withColumn("sample", F.lit(0))
    got = generate(asked, model).select(F.col("problem_id").alias("id"), "solution", "num_tokens")
    said = F.when(F.col("benchmark") == "gpqa", text.letter_answer(F.col("solution"))).otherwise(text.boxed_answer(F.col("solution")))
    j = items.join(got, "id").withColumn("predicted", said)
    return j.select("id", "benchmark", "subject", "level", F.col("answer").alias("ground_truth"), "predicted", text.correct(F.col("predicted"), F.col("answer")).alias("is_correct"), "solution", "num_tokens")


def parsed_by(traces: DataFrame, model, limit: int = 8000) -> DataFrame:
    """Traces with the structure that a parser model gives: its prompt holds the first ``limit`` characters, as its context does.

    ``model`` gets (rollout_id, trace_id, prompt) and returns (rollout_id, trace_id, reply).
    """
    got = traces.select("rollout_id", "trace_id", F.substring("solution", 1, limit).alias("prompt")).mapInPandas(model, "rollout_id bigint, trace_id int, reply string")
    return parse_replies(traces.join(got, ["rollout_id", "trace_id"]), "reply")


def hint_requests(problems: DataFrame) -> DataFrame:
    """What asks a model for a hint to a problem that it fails."""
    return problems.select("problem_id", F.concat(F.lit(fixed.HINT_REQUEST), "problem_text").alias("prompt"))


def reflection_requests(rollouts: DataFrame) -> DataFrame:
    """What shows a model up to three distinct wrong answers of its own (the smallest ones) and asks what it misses; problems solved once have none.

    Distinct answers are aggregated by problem before three are kept.
    """
    t = rollouts.select("problem_id", "problem_text", F.explode("traces").alias("t")).select("problem_id", "problem_text", "t.is_correct", text.boxed_answer(F.col("t.solution")).alias("a"))
    solved = t.filter("is_correct").select("problem_id").distinct()
    wrong = t.filter("a <> ''").select("problem_id", "a").distinct()
    first = wrong.withColumn("k", F.row_number().over(Window.partitionBy("problem_id").orderBy("a"))).filter("k <= 3")
    named = first.groupBy("problem_id").agg(F.array_join(F.array_sort(F.collect_list("a")), ", ").alias("answers"))
    p = t.select("problem_id", "problem_text").groupBy("problem_id").agg(F.min("problem_text").alias("problem_text")).join(solved, "problem_id", "left_anti").join(named, "problem_id", "left")
    return p.select("problem_id", F.concat(F.lit(fixed.REFLECTION_START), F.coalesce("answers", F.lit("")), F.lit("\n\nProblem: "), "problem_text", F.lit(fixed.REFLECTION_END)).alias("prompt"))


def hinted(problems: DataFrame, hints: DataFrame, reflected: bool = False) -> DataFrame:
    """Problems with a hint before them: at most 200 characters, marked where cut, or 300 of a reflection."""
    shown = F.substring(text.trim_all(F.col("hint")), 1, 300) if reflected else text.excerpt(text.trim_all(F.col("hint")), 200)
    start, then = (fixed.HINT_REFLECTED, "\n\nNow solve:\n") if reflected else (fixed.HINT_GIVEN, "\n\nNow solve this problem:\n")
    return problems.join(hints, "problem_id").select("problem_id", F.concat(F.lit(start), shown, F.lit(then), "problem_text").alias("prompt"))
