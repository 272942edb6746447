"""Each registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from parlance.plans.catalogue import FLAGSHIP, QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_flagship_is_one_to_one(spark, sf):
    rows = FLAGSHIP(spark, sf).collect()
    assert rows
    for side in ("i", "j"):
        assert len({(r["conv_id"], r[side]) for r in rows}) == len(rows)


def test_partitions_do_not_matter(spark, sf):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return sorted(map(tuple, FLAGSHIP(spark, sf).collect())), sorted(map(tuple, QUERIES["vocab_ids"](spark, sf).collect()))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert run(1) == run(7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
