import importlib

import duckdb
import pytest

entry = importlib.import_module("__spark_entry__")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "lineitem", "documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 2


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 95


@pytest.mark.parametrize("key", ["coverage_by_hospital", "lab_delta", "auroc", "alert_hours", "alert_metrics", "splits",
                                 "feature_drift", "patients", "prior_looks"])
def test_query_equals_sql(spark, con, key):
    got = entry.queries()[key](spark, SF)
    names = sorted(got.columns)
    want = con.execute(entry.oracle_sql()[key])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == names
    order = [columns.index(n) for n in names]
    a = sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr)
    b = sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, abs=1e-9, nan_ok=True) if all(isinstance(v, float) for v in x) else x == y
