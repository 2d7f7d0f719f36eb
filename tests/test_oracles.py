"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import math
import os

import duckdb
import pytest

from lexmill.plans import all_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REGISTRY = all_queries()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool) or isinstance(v, str):
        return str(v)
    if isinstance(v, (list, tuple)):
        return str([canonical(x) for x in v])
    try:
        return f"{float(v):.6f}"
    except (TypeError, ValueError):
        return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(REGISTRY.ORACLE_SQL))
def test_rows_equal(spark, duck, name):
    df = REGISTRY.QUERIES[name](spark, SF)
    cursor = duck.execute(REGISTRY.ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(REGISTRY.QUERIES) - set(REGISTRY.ORACLE_SQL)))
def test_runs(spark, name):
    REGISTRY.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
