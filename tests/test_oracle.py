"""Every registered query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from lodestone import registry

registry.load()
FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The driver checks the same queries over larger tables.
NAMES = sorted(registry.ORACLE_SQL)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(rows):
    def value(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else float(f"{x:.9g}")
        return float(x) if hasattr(x, "as_tuple") else x

    return sorted((tuple(value(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = duck.execute(registry.ORACLE_SQL[name])
    heads = [d[0] for d in found.description]
    assert sorted(heads) == columns
    rows = [tuple(r[heads.index(c)] for c in columns) for r in found.fetchall()]
    assert plain(df.select(*columns).collect()) == plain(rows)
