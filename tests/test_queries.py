"""Registered queries against their oracles at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__
from gridwright.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    cell = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)


def test_queries_without_oracle_are_tested_by_themselves():
    """Each against plain Python in ``test_models``."""
    with open(f"{os.path.dirname(__file__)}/test_models.py", encoding="utf-8") as f:
        text = f.read()
    assert all(f'"{name}"' in text for name in set(catalog.QUERIES) - set(catalog.ORACLE_SQL))


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["bid", "subs", "critical"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
