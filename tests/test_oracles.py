"""Every registered query against its SQL on the same tables; queries without SQL must run and keep their schema."""

import math
import os

import duckdb
import pytest

from tessera.plans import registry

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    if hasattr(v, "tzinfo") and v.tzinfo:
        return str(v.replace(tzinfo=None))
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    if name not in SQL:
        assert df.schema and got is not None
        return
    cur = duck.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == names
    want = sorted((tuple(plain(r[cols.index(c)]) for c in names) for r in cur.fetchall()), key=repr)
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, bad[:3]
