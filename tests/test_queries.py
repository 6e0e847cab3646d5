"""Every registered query over the smallest tables against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from millrace.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return round(float(x), 6)
    return [plain(y) for y in x] if isinstance(x, (list, tuple)) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    told = duck.sql(registry.ORACLE[name])
    assert sorted(df.columns) == sorted(told.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(told.columns, told.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_is_stable(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["chunk_key", "chunk_id", "query_no", "similarity", "boosted"]
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
