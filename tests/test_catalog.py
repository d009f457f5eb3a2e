"""Every registered query of the engine against its SQL, on whole small tables."""

import glob
import os

import duckdb
import pyarrow as pa
import pytest

from vecspark.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return c


def canon(t: pa.Table) -> list[tuple]:
    """Rows with whole numbers as such, whatever else their columns hold."""
    names = sorted(t.column_names)
    return sorted((tuple(r[c] for c in names) for r in t.to_pylist()), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, duck, name):
    got = catalog.queries()[name](spark, sf).toArrow()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got.num_rows
        return
    want = duck.sql(sql).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert canon(got) == canon(want)


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.queries()) <= set(e.queries())


def test_recall(spark, sf):
    assert catalog.queries()["ann_recall"](spark, sf).agg({"recall": "avg"}).first()[0] >= 0.9
