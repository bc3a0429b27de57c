"""The rank test over difficulties takes every stratum in, also one that the test tables lack."""

from pathlib import Path

import pytest

from tracemill.plans import catalogue

H_ROWS = [("easy", v) for v in (0.1, 0.2, 0.2, 0.3)] + [("medium", v) for v in (0.2, 0.4, 0.5)] + [("hard", v) for v in (0.6, 0.7, 0.7, 0.9, 0.1)] + [("unknown", v) for v in (0.3, 0.3, 0.8)]


def _h(rows):
    """H by its definition."""
    v = sorted(x for _, x in rows)
    n = len(v)
    rank = {x: sum(i + 1 for i, y in enumerate(v) if y == x) / v.count(x) for x in v}
    groups = {g: [rank[x] for k, x in rows if k == g] for g, _ in rows}
    ties = sum(v.count(x) ** 3 - v.count(x) for x in set(v))
    return (12 / (n * (n + 1)) * sum(sum(r) ** 2 / len(r) for r in groups.values()) - 3 * (n + 1)) / (1 - ties / (n**3 - n)), len(groups) - 1


@pytest.mark.parametrize("left_out", ["", "hard", "unknown"])
def test_difficulty_test_takes_all_strata(spark, monkeypatch, left_out):
    rows = [r for r in H_ROWS if r[0] != left_out]
    df = spark.createDataFrame(rows, "difficulty string, dsr double")
    monkeypatch.setattr(catalogue, "_by_difficulty", lambda s, d: df)
    got = catalogue.QUERIES["rir_difficulty_test"](spark, "").first()
    h, free = _h(rows)
    assert got.h == pytest.approx(h, abs=1e-6)
    assert got.df == free


def test_difficulty_test_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in data.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    got = catalogue.QUERIES["rir_difficulty_test"](spark, str(data)).first()
    assert con.execute(catalogue.ORACLE["rir_difficulty_test"]).fetchall() == [(got.h, got.df)]
