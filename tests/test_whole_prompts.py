"""Prompts with the same opening are different problems."""

import pytest

from test_catalogue import duck  # noqa: F401
from test_every_trace import _equals_sql
from tracemill.plans import catalogue


def test_prompts_with_a_shared_opening(spark, monkeypatch):
    opening = "Read the following carefully. " * 5
    rows = [(1, "x", opening + "one"), (2, "x", opening + "two"), (3, "y", opening + "two"), (4, "y", "three")]
    df = spark.createDataFrame(rows, "pair_id long, pair_type string, problem_text string")
    monkeypatch.setattr(catalogue, "table", lambda *_: df)
    assert {r.pair_type: r.prompts for r in catalogue.pair_coverage(spark, "").collect()} == {"x": 2, "y": 2, "all": 3}
    assert [tuple(r) for r in catalogue.problems_in_several_kinds(spark, "").collect()] == [(opening + "two", 2, 2)]


@pytest.mark.parametrize("name", ["pair_coverage", "problems_in_several_kinds"])
def test_whole_prompts_equal_sql(spark, duck, name):  # noqa: F811
    _equals_sql(spark, duck, name)
