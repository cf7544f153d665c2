"""The driver contract: every query runs, and equals its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from chronofact.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, list | tuple):
        return [canonical(x) for x in v]
    return str(v)


@pytest.fixture(scope="session")
def duck(tables):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    return con


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.schema == entry.entry(spark).schema


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.isdir(os.path.join(os.path.dirname(registry.__file__), "..", "llm")) == ("op5_exact_dedup" in entry.queries())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, tables, name):
    df = registry.queries()[name](spark, tables)
    rows = df.select(*sorted(df.columns)).collect()
    sql = registry.oracle_sql().get(name)
    if sql is not None:
        out = duck.sql(sql)
        assert sorted(out.columns) == sorted(df.columns)
        other = out.project(", ".join(f'"{c}"' for c in sorted(out.columns))).fetchall()
        assert sorted(map(str, map(canonical, map(tuple, rows)))) == sorted(map(str, map(canonical, other)))
