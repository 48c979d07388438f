"""Every catalogued query against its SQL, and independence of partitioning."""

import glob
import os
from pathlib import Path

import duckdb
import pytest

from listloom.plans import catalogue
from listloom.plans.catalogue import QUERIES
from listloom.plans.oracles import ORACLES

from .conftest import SMALL, TEST


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{TEST}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def _sorted(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, TEST)
    columns = sorted(df.columns)
    rows = _sorted(tuple(r[c] for c in columns) for r in df.collect())
    if name in ORACLES:
        found = con.sql(ORACLES[name])
        assert sorted(found.columns) == columns
        places = [found.columns.index(c) for c in columns]
        assert rows == _sorted(tuple(r[i] for i in places) for r in found.fetchall())
    else:
        assert rows


@pytest.mark.parametrize("name", ["dedup_priority", "display_threads"])
def test_partitioning_changes_nothing(spark, name):
    def rows(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return _sorted(tuple(r) for r in QUERIES[name](spark, TEST).collect())

    try:
        assert rows("1") == rows("7")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_pages_of_the_stream_are_written_by_many_tasks(spark, monkeypatch):
    """A file for each page is slow to write; the table of suppliers is one task."""
    tasks, add = [], catalogue.stream_of_pages
    monkeypatch.setattr(catalogue, "stream_of_pages", lambda spark, folder: tasks.append({n.split("-")[1] for n in _names(folder)}) or add(spark, folder))
    catalogue.page_stream(spark, SMALL)
    assert len(tasks[-1]) > 1


def _names(folder):
    return [p.name for p in Path(folder).rglob("part-*")]
