"""Every query of the catalogue against its SQL, over whole tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from quern.plans import catalogue


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def compare(spark, name, queries, oracles, sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = queries[name](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    result = con.execute(oracles[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, tiny, name):
    compare(spark, name, catalogue.QUERIES, catalogue.ORACLE_SQL, tiny)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_hits_grow_with_k(spark, tiny):
    r = catalogue.QUERIES["retrieval_metrics"](spark, tiny).first()
    assert r["hit_at_1"] <= r["hit_at_3"] <= r["hit_at_5"] and r["hit_at_1"] <= r["mrr"]
