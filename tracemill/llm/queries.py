"""The queries of the text operators, each over its whole tables, and SQL for those that SQL can check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import bpe, defects, leaks, mixture, neardup, repetition, sentences, splits, topn
from tracemill.llm.common import answers
from tracemill.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Repetitive solutions of rollouts and rejected solutions."""
    return repetition.repetitive(answers(table(spark, d, "rollouts"), table(spark, d, "preference_pairs"), ("rejected",)), "solution", ["record_table", "record_id", "slot"])


def p1_repetition(spark: SparkSession, d: str) -> DataFrame:
    """The shares of repeated content of every such text."""
    return repetition.repetition_coverage(answers(table(spark, d, "rollouts"), table(spark, d, "preference_pairs"), ("rejected",)), "solution", ["record_table", "record_id", "slot"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.named_groups(table(spark, d, "preference_pairs"))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every pair's component and split."""
    return splits.assign(splits.pair_groups(table(spark, d, "preference_pairs")), "pair_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.cut_traces(table(spark, d, "rollouts"))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each shard's texts break off."""
    return defects.cut_rates(table(spark, d, "rollouts"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.defective_answers(table(spark, d, "rollouts"), table(spark, d, "preference_pairs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_records(table(spark, d, "problems"), table(spark, d, "documents"), table(spark, d, "math500"))


def p5_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked, and into how many records of each table."""
    found = leaks.leaked_records(table(spark, d, "problems"), table(spark, d, "documents"), table(spark, d, "math500"))
    return found.groupBy("unique_id").agg(F.count_if(F.col("record_table") == "problems").alias("problems"), F.count_if(F.col("record_table") == "documents").alias("documents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_solutions(table(spark, d, "preference_pairs"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every solution's text, links and group."""
    return neardup.solution_groups(table(spark, d, "preference_pairs"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.best_traces(table(spark, d, "annotated")).select("problem_id", "trace_id")


def p7_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The three best traces with rank and scores."""
    return topn.best_traces(table(spark, d, "annotated")).select("problem_id", "trace_id", "quality_reward", "dsr", F.col("rank").cast("bigint").alias("rank"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"), "text", ["doc_id"])


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every document and whether decoding gives its text back."""
    docs = table(spark, d, "documents")
    ids = bpe.encode(docs, "text", ["doc_id", "text"])
    back = bpe.decode(ids, "ids", ["doc_id", "text", "ids"])
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"))


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), table(spark, d, "problems").select("problem_id", "category"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[1]


def p9_marginals(spark: SparkSession, d: str) -> DataFrame:
    """Shares of languages and topics: natural, raked and reached."""
    return _mixture(spark, d)[2]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents"), "text", ["doc_id"])


QUERIES = {f.__name__: f for f in (p1_found, p1_repetition, p2_found, p2_splits, p3_found, p3_rates, p4_found, p5_found, p5_items, p6_found, p6_groups, p7_found, p7_ranked, p8_ids, p8_roundtrip, p9_mixture, p9_shares, p9_marginals, p10_found)}

_BEST = """
with latest as (
  select problem_id, trace_id, quality_reward, dsr,
         row_number() over (partition by problem_id, trace_id order by annotated_at desc nulls last, quality_reward desc nulls last, dsr asc nulls last) as k
  from annotated),
ranked as (
  select *, row_number() over (partition by problem_id order by quality_reward desc, dsr asc nulls last, trace_id asc) as rank
  from latest where k = 1 and quality_reward is not null and not isnan(quality_reward))
"""

_GROUPS = """
with recursive named as (
  select distinct pair_id,
         try_cast(nullif(regexp_extract(problem_id, '([0-9]+)', 1), '') as bigint) as number,
         case when lower(trim(origin_id)) not in ({absent}) then 'o:' || lower(trim(origin_id)) end as origin,
         case when lower(trim(author_id)) not in ({absent}) then 'a:' || lower(trim(author_id)) end as author
  from preference_pairs),
ties as (
  select pair_id, 'p:' || number as tie from named where number is not null
  union select pair_id, origin from named where origin is not null
  union select pair_id, author from named where author is not null),
reach(start, tie) as (
  select distinct tie, tie from ties
  union
  select r.start, b.tie from reach r join ties a on a.tie = r.tie join ties b on b.pair_id = a.pair_id),
least as (
  select r.start as tie, min(n.number) as group_id
  from reach r join ties t on t.tie = r.tie join named n on n.pair_id = t.pair_id where n.number is not null group by 1)
select distinct t.pair_id, l.group_id from ties t join least l on l.tie = t.tie
"""

ORACLE = {
    "p7_found": _BEST + "select problem_id, trace_id from ranked where rank <= 3",
    "p7_ranked": _BEST + "select problem_id, trace_id, quality_reward, dsr, rank from ranked where rank <= 3",
    "p2_found": _GROUPS.format(absent=", ".join(f"'{x}'" for x in splits.NOT_KNOWN)),
}
