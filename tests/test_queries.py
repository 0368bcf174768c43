import math

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = sorted(set(entry.reference.ORACLES) & set(entry.reference.QUERIES))


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else float(f"{v:.6g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_its_sql(spark, db, name):
    out = entry.reference.QUERIES[name](spark, DATA)
    rows = db.execute(entry.reference.ORACLES[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == sorted(out.columns)
    want = sorted((tuple(map(plain, r)) for r in rows.fetchall()), key=repr)
    got = sorted((tuple(plain(r[n]) for n in names) for r in out.collect()), key=repr)
    assert got == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 3
