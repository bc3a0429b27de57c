"""Queries against their SQL in DuckDB on the smallest test tables, where those are there."""

import math
from pathlib import Path

import pytest

from tracemill.plans.catalogue import ORACLE, QUERIES

DATA = Path("/root/testdata/sf0.001")
SOME = ["trace_annotation", "step_symbols", "dag_edges", "motifs_all", "dead_step_quality", "all_pairs", "best_of_n_table", "variance_by_category", "dsr_histogram", "boxed_answers", "normalized_answers", "key_step_hints", "pair_length_stats", "rir_live_dead", "rir_correctness_independence", "clean_variants", "fragile_robust", "prefix_timeline", "compare_models", "weighted_liveness", "full_coverage"]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    cur = duck.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want


def test_names():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 60


def test_every_step_and_motif_type_occurs(spark):
    if not DATA.exists():
        pytest.skip("no test tables")
    kinds = {r[0] for r in QUERIES["step_types"](spark, str(DATA)).select("step_type").distinct().collect()}
    assert {"conclusion", "derivation", "verification", "computation"} <= kinds
    assert {r[0] for r in QUERIES["motifs_all"](spark, str(DATA)).select("motif_type").distinct().collect()} >= {"dead_cascade", "verification_theater"}
