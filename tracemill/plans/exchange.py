"""Queries over what is written to the shared folder and read back, and over prompts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracemill.functions import fixed
from tracemill.operators import evals as E
from tracemill.operators import rir as R
from tracemill.operators import traces as T
from tracemill.plans import catalogue as C
from tracemill.plans import reports as P
from tracemill.plans import sqltext as S
from tracemill.plans.catalogue import query
from tracemill.session import delivered_once, shared_folder, table
from tracemill.sources import files, models, sinks


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"


@query(S.RECURSIVE + ", ty as (select rollout_id, trace_id, step_type, round(count(*) filter (not is_live)::double / count(*), 6) as ratio from ls group by all), ts as (select rollout_id, trace_id, string_agg(step_type || '=' || ratio, ';' order by step_type) as typed from ty group by all) select ann.problem_id, ann.rollout_id, ann.trace_id, is_correct, num_steps, round(dsr, 9) as dsr, coalesce(typed, '') as typed, trace_length from ann left join ts using (rollout_id, trace_id)")
def annotations_written(spark, d):
    """Annotations as files: written without texts, read back with their schema."""
    path = _folder(spark)
    sinks.write_json(sinks.annotations(T.parsed(spark, d)), path)
    a = files.read_annotations(spark, path)
    typed = F.array_join(F.array_sort(F.transform(F.map_entries("typed_dsr"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 6).cast("string")))), ";")
    return a.select(*T.KEYS, "is_correct", "num_steps", F.round("dsr", 9).alias("dsr"), typed.alias("typed"), "trace_length")


@query(S.ROWS + " select problem_id, count(distinct rollout_id) as rollouts, count(*) as traces, sum(length(solution))::bigint as chars, count(*) filter (is_correct) as correct from t group by 1")
def rollouts_written(spark, d):
    """Rollouts as files in order of their problems, read back and flattened."""
    path = _folder(spark)
    sinks.write_json(delivered_once(spark, d, "rollouts", "rollout_id").select("rollout_id", *[f.name for f in files.ROLLOUT.fields]), path, "problem_id")
    r = spark.read.schema(StructType([StructField("rollout_id", LongType()), *files.ROLLOUT.fields])).json(path)
    t = T.flatten(r.withColumn("shard", F.lit(None).cast("string")))
    return t.groupBy("problem_id").agg(F.countDistinct("rollout_id").alias("rollouts"), F.count("*").alias("traces"), F.sum(F.length("solution")).alias("chars"), F.count_if("is_correct").alias("correct"))


@query(C.ORACLE["eval_metrics"])
def evaluation_written(spark, d):
    """An evaluation as files, results and metrics, and the metrics read back."""
    path = _folder(spark)
    runs = C._runs(spark, d)
    sinks.write_evaluation(runs, E.metrics(runs), path)
    return spark.read.schema("benchmark string, dim string, key string, total bigint, correct bigint, accuracy double, avg_tokens double").json(f"{path}/metrics")


@query(C._r(P._VL + " union all ".join(f"select '{k}' as variant, count(*) as n, sum(len_{k})::bigint as chars, {S.q(fixed.SYSTEM_PROMPT)} as system from vl" for k in fixed.POLICIES)))
def training_sets_written(spark, d):
    """Cleaned variants as training records, a folder each, read back."""
    path = _folder(spark)
    v = R.variants(R.records(T.parse(T.single(spark, d))).filter("size(rsteps) > 0"))
    question = delivered_once(spark, d, "rollouts", "rollout_id").groupBy("problem_id").agg(F.min(F.coalesce("problem_text", F.lit(""))).alias("question"))
    sinks.write_training_sets(v, question, P.dataset_stats(spark, d), path)
    r = spark.read.schema("conversations array<struct<`from`: string, value: string>>, system string, variant string").json(f"{path}/cleaned")
    return r.groupBy("variant").agg(F.count("*").alias("n"), F.sum(F.length(F.element_at("conversations", 2)["value"])).alias("chars"), F.min("system").alias("system"))


@query("select unique_id as id, problem, answer, coalesce(subject, '') as subject, coalesce(level, 0) as level, 'math500' as benchmark from math500")
def held_out_items(spark, d):
    """The held-out items in the form of problems."""
    return files.items(table(spark, d, "math500"))


@query("with qs as (select problem_id, min(question) as question from problems where question is not null group by 1) " + " union all ".join(f"select problem_id, '{k}' as condition, {S.q(s or '')} as system, {S.q(p)} || question as prompt from qs" for k, (s, p) in models.CONDITIONS.items()))
def guided_prompts(spark, d):
    """Every problem under every condition of guided generation."""
    p = table(spark, d, "problems").filter("question is not null").groupBy("problem_id").agg(F.min("question").alias("problem_text"))
    said = lambda who: F.try_element_at(F.filter("messages", lambda t: t["role"] == who), F.lit(1))["content"]
    return models.messages(p).select("problem_id", "condition", F.coalesce(said("system"), F.lit("")).alias("system"), said("user").alias("prompt"))


@query(S.ROWS + f", bx as (select problem_id, problem_text, is_correct, {C._boxed_sql('solution')} as a from t), w as (select distinct problem_id, a from bx where a <> ''), k as (select *, row_number() over (partition by problem_id order by a) as k from w), g as (select problem_id, string_agg(a, ', ' order by a) as answers from k where k <= 3 group by 1), pt as (select problem_id, min(problem_text) as problem_text from bx group by 1 having not bool_or(is_correct)) select problem_id, {S.q(fixed.REFLECTION_START)} || coalesce(answers, '') || E'\\n\\nProblem: ' || problem_text || {S.q(fixed.REFLECTION_END)} as prompt from pt left join g using (problem_id)")
def reflection_prompts(spark, d):
    """What asks a model to reflect on its wrong answers, for problems that no trace solves."""
    r = delivered_once(spark, d, "rollouts", "rollout_id").select("problem_id", F.coalesce("problem_text", F.lit("")).alias("problem_text"), "traces")
    return models.reflection_requests(r)
