"""Every registered query against its SQL text on the smallest data."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from kdframe.plans import all_queries, all_sql

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double"}

pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{ROOT}/{name}.parquet')")
    return con


def test_registry_is_complete():
    names = set(all_queries())
    assert names == set(all_sql())
    assert names <= set(entry.queries())
    wanted = {"s": 11, "d": 16, "c": 14, "t": 9, "p": 7, "l": 17, "h": 16, "e": 22, "x": 7, "u": 4}
    for family, count in wanted.items():
        for i in range(1, count + 1):
            assert any(n.startswith(f"{family}{i}_") for n in names), f"{family}{i}"


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1.5e-6)
    return a == b


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(type(v)), v if not isinstance(v, float) else round(v, 4)) for v in r])


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    df = all_queries()[name](spark, ROOT)
    columns = sorted(df.columns)
    got = ordered([tuple(r[c] for c in columns) for r in df.collect()])
    cursor = duck.execute(all_sql()[name])
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert {c: t for c, t in df.dtypes} == {c: KINDS[k] for c, k in kinds.items()}
    place = [names.index(c) for c in columns]
    want = ordered([tuple(r[i] for i in place) for r in cursor.fetchall()])
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(close(x, y) for x, y in zip(a, b)), (a, b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
