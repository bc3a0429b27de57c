"""Queries that take every trace in, against their SQL, and against how many traces there are."""

import pytest

from test_catalogue import DATA, duck, plain  # noqa: F401
from tracemill.plans.catalogue import ORACLE, QUERIES

EVALS = ["eval_metrics", "eval_structural", "compare_models", "disagreement", "impact_buckets", "condition_metrics", "scaffold_diff"]


def _equals_sql(spark, duck, name):  # noqa: F811
    df = QUERIES[name](spark, str(DATA))
    cur = duck.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    rows = df.collect()
    assert sorted(tuple(plain(r[c]) for c in cols) for r in rows) == sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    return rows


@pytest.mark.parametrize("name", EVALS)
def test_evaluation_of_every_trace(spark, duck, name):  # noqa: F811
    rows = _equals_sql(spark, duck, name)
    every, first = duck.execute("select count(*), count(*) filter (i = 0) from (select unnest(range(len(traces))) as i from (select distinct on (rollout_id) * from rollouts))").fetchone()
    if name == "eval_metrics":
        assert sum(r.total for r in rows if r.dim == "all") == every
    elif name == "condition_metrics":
        assert sum(r.n for r in rows) == every
    elif name in ("disagreement", "scaffold_diff"):
        assert sum(r.n for r in rows) == every - first
    else:
        assert max(r.model for r in rows) > 1


@pytest.mark.parametrize("name", ["full_coverage", "parser_level_corr"])
def test_levels_of_every_trace(spark, duck, name):  # noqa: F811
    rows = _equals_sql(spark, duck, name)
    if name == "parser_level_corr":
        every = duck.execute("select sum(len(traces)) from (select distinct on (rollout_id) * from rollouts)").fetchone()[0]
        assert rows[0].n == every


def test_trace_of_a_later_rollout_without_annotation(spark):
    from tracemill.operators import evals as E

    scored = spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("a", 5, 0), ("b", 2, 0), ("b", 3, 0)], "problem_id string, rollout_id long, trace_id int")
    when = "2024-01-01 00:00:00"
    second = spark.createDataFrame([("a", 0, 0.1, 1.0, when), ("a", 1, 0.2, 1.0, when), ("b", 0, 0.3, 1.0, when), ("b", 1, 0.4, 1.0, when)], "problem_id string, trace_id int, dsr double, quality_reward double, annotated_at string")
    got = {(r.problem_id, r.rollout_id, r.trace_id, r.l2_dsr) for r in E.levels(scored, second).collect()}
    assert got == {("a", 1, 0, 0.1), ("a", 1, 1, 0.2), ("a", 5, 2, None), ("b", 2, 0, 0.3), ("b", 3, 1, 0.4)}
