"""Driver contract and DuckDB oracle agreement at sf0.001, plus the
stand-in expected counts of FIXTURES §3."""

import duckdb
import pytest

import __spark_entry__ as entry
from graded.session import TABLES
from tests.conftest import SF001, SF01

SLOW = {"m1_m2_fit_evaluate", "m3_strategy_sweep", "m4_save_reload"}


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 4
    assert df.columns[0] == "lang" and "f1_macro" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    sdf = entry.queries()[name](spark, SF001)
    cols = sorted(sdf.columns)
    srows = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    res = duck.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    drows = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=repr)
    assert srows == drows


# TP, FP, FN, TN over valid rows, invalid among label 1 / label 0.
EXPECTED = {
    (SF01, "lenient"): (32, 73, 9, 190, 10, 85),
    (SF01, "strict"): (13, 31, 3, 110, 35, 207),
    (SF01, "last_word"): (12, 32, 6, 96, 33, 220),
    (SF001, "lenient"): (6, 16, 2, 42, 3, 18),
    (SF001, "strict"): (4, 4, 0, 21, 7, 51),
    (SF001, "last_word"): (2, 6, 1, 28, 8, 42),
}


@pytest.mark.parametrize("sf,parser", sorted(EXPECTED))
def test_standin_expected_counts(spark, sf, parser):
    q = entry.queries()[f"a1_confusion_{parser}"](spark, sf)
    n = {(r.label, r.pred): r.n for r in q.collect()}
    got = (n.get((1, 1), 0), n.get((0, 1), 0), n.get((1, 0), 0), n.get((0, 0), 0), n.get((1, -1), 0), n.get((0, -1), 0))
    assert got == EXPECTED[(sf, parser)]


def test_a_failed_sweep_cell_is_a_row(spark):
    from graded.operators import training as ML
    from graded.sources.corpus import load_corpus

    c = load_corpus(spark, SF001)
    train, test = c.filter("split = 'train'"), c.filter("split = 'test'")
    rows = {r.strategy: r for r in ML.sweep(train, test, ("undersample", "no such strategy")).collect()}
    assert rows["undersample"].status == "ok" and rows["undersample"].total_samples == test.count()
    assert rows["no such strategy"].status.startswith("failed: ") and rows["no such strategy"].total_samples is None


def test_queries_leave_no_caches_behind(spark):
    for name in ("r1_undersample", "r3_balanced", "w1_early_stop", "v1_encode", "m3_strategy_sweep"):
        entry.queries()[name](spark, SF001).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
