"""Every registered query against its SQL at the smallest scale."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
import pytest

from lodestrata.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return repr(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = Counter(norm([r[c] for c in columns]) for r in df.collect())
    if name in registry.oracle_sql():
        cur = db.execute(registry.oracle_sql()[name])
        named = [x[0] for x in cur.description]
        assert sorted(named) == columns
        assert got == Counter(norm([r[named.index(c)] for c in columns]) for r in cur.fetchall())


def test_entry_without_llm():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
