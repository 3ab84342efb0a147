"""Dead documents are told by bits, without a shuffle of the rows that hold the postings, which are read few at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.operators import lexical_index, retrieval
from quern.session import drop, long_rows


def some(spark, n, word):
    return spark.range(n).select(F.col("id").alias("k"), F.concat(F.lit(word), (F.col("id") % 7).cast("string"), F.lit(" b")).alias("text"))


def test_postings_are_not_shuffled_for_dead_documents(spark, tmp_path, monkeypatch):
    docs, path = some(spark, 300, "a"), str(tmp_path / "i")
    lexical_index.write_lexical_index(some(spark, 400, "c").unionByName(docs.where("k >= 400")), "k", path)
    index = lexical_index.update_lexical_index(docs.unionByName(some(spark, 400, "c").where("k > 350")), "k", path)
    plans, kept = {}, lexical_index._kept
    monkeypatch.setattr(lexical_index, "_kept", lambda rows, label, held: plans.setdefault(label, rows._jdf.queryExecution().executedPlan().toString()) and kept(rows, label, held))
    queries = spark.createDataFrame([(1, "a1 b"), (2, "c3 c4"), (3, "b")], "q long, text string")
    found = lexical_index.search_lexical_index(queries, index, "q", "k", 9)
    plain = retrieval.bm25_search(queries, docs.unionByName(some(spark, 400, "c").where("k > 350")), "q", "k", 9)
    rows = lambda x: sorted(map(repr, x.select("q", "k", "score", "rank").collect()))
    assert rows(found) == rows(plain) and index.snapshot.parts["dead"]
    assert "Exchange" not in plans["blocks"] and "Join" not in plans["blocks"]


def test_dead_bits_are_those_of_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical_index, "RUN_BITS", 5)
    docs, path = some(spark, 200, "a"), str(tmp_path / "i")
    lexical_index.write_lexical_index(docs, "k", path)
    index = lexical_index.update_lexical_index(docs.where("k % 3 > 0"), "k", path)
    listed = {(r.segment, r.doc) for r in index.table("dead").select("segment", F.explode("docs").alias("doc")).collect()}
    every = sorted((r.segment, r.doc) for r in index.table("documents").select("segment", "doc").collect())
    segment, doc = (np.array(x) for x in zip(*every))
    dead = lexical_index._dead(lexical_index._gone(index), segment, doc)
    assert len(listed) == 67 and [x for x, d in zip(every, dead) if d] == sorted(listed)
    assert not lexical_index._dead({}, segment, doc).any()


def test_batches_of_long_rows_are_small(spark):
    """With lists of 1.6 kB a row, the default of 64 MB and 10,000 rows is one batch."""
    rows = spark.range(0, 12_000, 1, 1).select(F.array_repeat("id", 200).alias("a"))
    seen = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"]) for b in batches)
    held: list[str] = []
    found = [r.n for r in lexical_index._kept(rows.mapInArrow(seen, "n long"), "sizes", held).collect()]
    assert sum(found) > 12_000 * 1600 and max(found) < 9_000_000
    drop(spark, held[0])
    names = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(n) for n in names]
    with pytest.raises(KeyError), long_rows(spark):
        assert [spark.conf.get(n) for n in names] == ["8m", "256"]
        raise KeyError
    assert [spark.conf.get(n) for n in names] == before


def test_only_the_promising_blocks_are_sent(spark, tmp_path, monkeypatch):
    """The blocks, long rows, stay where they are, whatever Spark thinks of the sizes."""
    docs = some(spark, 300, "a")
    index = lexical_index.write_lexical_index(docs, "k", str(tmp_path / "i"))
    plans, kept, limit = {}, lexical_index._kept, "spark.sql.autoBroadcastJoinThreshold"
    monkeypatch.setattr(lexical_index, "_kept", lambda rows, label, held: plans.setdefault(label, rows._jdf.queryExecution().executedPlan().toString()) and kept(rows, label, held))
    queries, before = spark.createDataFrame([(1, "a1 b"), (2, "a3 a4")], "q long, text string"), spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        found = lexical_index.search_lexical_index(queries, index, "q", "k", 9)
    finally:
        spark.conf.set(limit, before)
    rows = lambda x: sorted(map(repr, x.select("q", "k", "score", "rank").collect()))
    assert rows(found) == rows(retrieval.bm25_search(queries, docs, "q", "k", 9))
    assert "BroadcastHashJoin" in plans["promising"] and "SortMergeJoin" not in plans["promising"]
