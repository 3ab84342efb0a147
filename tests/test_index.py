"""Snapshots, and the stored lexical index: versions, changes, merges and searches that skip blocks."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import lexical_index, retrieval
from quern.session import clear
from quern.sources import snapshots

DOCS = "k long, path string, text string"
WORDS = ["the"] * 30 + ["and"] * 10 + [f"w{i}" for i in range(80)] + ["foo_bar", "fooBar", "缓存在"]


def some_docs(rng, n, first=0):
    rows = [(first + i, f"f{(first + i) // 3}", " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 40)))) for i in range(n)]
    return rows + [(None, "f1", "w1 w2 null key"), (None, "f2", "w1"), (first + 5, "f1", "w3 w4 twice"), (first + 5, "f1", "w3 w4 twice"), (900 + first, None, "w5 no file"), (901 + first, "f3", None), (902 + first, "f3", "")]


def asked(spark, rng):
    rows = [(f"q{i}", " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 9)))) for i in range(25)]
    return spark.createDataFrame(rows + [("none", None), ("new", "zzz"), (None, "w1 w2"), ("q1", "w3 the")], "q string, text string")


def hits(rows):
    return sorted(map(repr, rows.select("q", "k", "score", "rank").collect()))


def same(spark, docs, queries, index, k=7):
    plain = hits(retrieval.bm25_search(queries, spark.createDataFrame(docs, DOCS), "q", "k", k))
    assert hits(lexical_index.search_lexical_index(queries, index, "q", "k", k)) == plain
    return plain


def test_search_of_rows_with_null_and_repeated_keys(spark, tmp_path):
    rows = [(None, "a", "x"), (5, "a", "x y"), (5, "a", "x y"), (6, "b", "z")]
    queries = spark.createDataFrame([("q", "x")], "q string, text string")
    index = lexical_index.write_lexical_index(spark.createDataFrame(rows, DOCS), "k", str(tmp_path / "i"))
    plain = same(spark, rows, queries, index)
    assert len(plain) == 2 and index.n == 4 and "k=5" in plain[0] and "k=5" in plain[1]


@pytest.mark.parametrize("file", ["path", None])
def test_changes_equal_a_rebuild(spark, tmp_path, monkeypatch, file):
    monkeypatch.setattr(lexical_index, "BLOCK_DOCS", 8)
    monkeypatch.setattr(lexical_index, "FIRST_BLOCKS", 2)
    rng, path = random.Random(9), str(tmp_path / "i")
    queries, docs = asked(spark, rng), some_docs(rng, 120)
    index = lexical_index.write_lexical_index(spark.createDataFrame(docs, DOCS), "k", path, file=file)
    assert index.tokenised == len(docs)
    first, plain = index, same(spark, docs, queries, index)
    for turn in range(2 if file else 1):
        gone = {f"f{rng.randrange(40)}" for _ in range(4)}
        changed = {f"f{rng.randrange(40)}" for _ in range(3)} - gone
        kept = [d for d in docs if d[1] not in gone]
        now = [(k, p, f"{t} changed{turn} w1 w7") if p in changed and t else (k, p, t) for k, p, t in kept] + [(2000 + 10 * turn + i, f"new{turn}", f"w{i} the new") for i in range(5)]
        rng.shuffle(now)
        index = lexical_index.update_lexical_index(spark.createDataFrame(now, DOCS), "k", path, file=file)
        if file:  # files that say something else now, whole, and new ones
            touched = {p for p in {d[1] for d in now} if sorted(map(repr, (d for d in now if d[1] == p))) != sorted(map(repr, (d for d in docs if d[1] == p)))}
            assert index.tokenised == sum(d[1] in touched for d in now)
        assert 0 < index.tokenised < len(now) / 2 and index.n == len(now)
        docs = now
        same(spark, docs, queries, index)
    again = lexical_index.update_lexical_index(spark.createDataFrame(docs, DOCS), "k", path, file=file)
    assert again.tokenised == 0
    merged = lexical_index.merge_lexical_index(again)
    assert len(merged.snapshot.parts["documents"]) == 1 and not merged.snapshot.parts["dead"]
    same(spark, docs, queries, merged)
    df = lambda i: {r["term"]: r["n"] for r in i.table("terms").groupBy("term").agg(F.sum("df").alias("n")).where("n <> 0").collect()}
    assert df(merged) == df(again) and (merged.n, merged.tokens) == (again.n, again.tokens)
    # Who opened the first version still reads it, by its number too.
    assert hits(lexical_index.search_lexical_index(queries, first, "q", "k", 7)) == plain
    assert hits(lexical_index.search_lexical_index(queries, lexical_index.read_lexical_index(spark, path, 1), "q", "k", 7)) == plain
    # All of it gone, and come again.
    none = lexical_index.update_lexical_index(spark.createDataFrame([], DOCS), "k", path, file=file)
    assert none.n == 0 and lexical_index.search_lexical_index(queries, none, "q", "k", 7).count() == 0
    same(spark, docs, queries, lexical_index.update_lexical_index(spark.createDataFrame(docs, DOCS), "k", path, file=file))
    clear(spark)


def test_small_sets_and_wide_queries(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    queries, docs = asked(spark, rng), some_docs(rng, 60)
    index = lexical_index.write_lexical_index(spark.createDataFrame(docs, DOCS).repartition(5), "k", str(tmp_path / "i"))
    monkeypatch.setattr(retrieval, "QUERY_SET", 8)
    monkeypatch.setattr(lexical_index, "CELLS", 20)
    for k in (1, 200):
        same(spark, docs, queries, index, k)
    assert lexical_index.search_lexical_index(queries.limit(0), index, "q", "k").count() == 0
    for bad in (0, -1):
        with pytest.raises(ValueError):
            lexical_index.search_lexical_index(queries, index, "q", "k", bad)


def test_parameters_belong_to_the_index(spark, tmp_path):
    path, docs = str(tmp_path / "i"), spark.createDataFrame(some_docs(random.Random(1), 20), DOCS)
    index = lexical_index.write_lexical_index(docs, "k", path, k1=1.1, b=0.4)
    assert (lexical_index.update_lexical_index(docs, "k", path).k1, index.b) == (1.1, 0.4)
    with pytest.raises(ValueError):
        lexical_index.update_lexical_index(docs, "k", path, k1=1.2)
    with pytest.raises(ValueError):
        lexical_index.update_lexical_index(docs.withColumn("k", F.col("k").cast("string")), "k", path)
    with pytest.raises(FileExistsError):
        lexical_index.write_lexical_index(docs, "k", path)
    assert lexical_index.write_lexical_index(docs, "k", path, k1=1.2, overwrite=True).k1 == 1.2
    with pytest.raises(FileNotFoundError):
        lexical_index.read_lexical_index(spark, str(tmp_path / "none"))


def test_a_build_killed_between_two_writes_leaves_the_old_version(spark, tmp_path, monkeypatch):
    rng, path = random.Random(4), str(tmp_path / "i")
    queries, docs = asked(spark, rng), some_docs(rng, 40)
    other = [(k, p, "w1 w2 the other text") for k, p, t in docs[10:]]
    index = lexical_index.write_lexical_index(spark.createDataFrame(docs, DOCS), "k", path)
    plain, part, small = hits(lexical_index.search_lexical_index(queries, index, "q", "k", 5)), snapshots.write_part, snapshots.write_new
    killed = 0
    for at in range(20):
        left = [at]

        def killing(write, left=left):
            def run(*args):
                if left[0] == 0:
                    raise KeyboardInterrupt
                left[0] -= 1
                return write(*args)

            return run

        monkeypatch.setattr(snapshots, "write_part", killing(part))
        monkeypatch.setattr(snapshots, "write_new", killing(small))
        try:
            lexical_index.update_lexical_index(spark.createDataFrame(other, DOCS), "k", path)
        except KeyboardInterrupt:
            killed += 1
            monkeypatch.setattr(snapshots, "write_part", part)
            monkeypatch.setattr(snapshots, "write_new", small)
            assert snapshots.versions(spark, path) == [1]
            assert hits(lexical_index.search_lexical_index(queries, lexical_index.read_lexical_index(spark, path), "q", "k", 5)) == plain
        else:
            break
    monkeypatch.setattr(snapshots, "write_part", part)
    monkeypatch.setattr(snapshots, "write_new", small)
    assert killed == 6  # files, dead, documents, postings, terms, manifest
    same(spark, other, queries, lexical_index.read_lexical_index(spark, path), 5)
    assert hits(lexical_index.search_lexical_index(queries, index, "q", "k", 5)) == plain
    # What the killed builds left goes, what the kept versions read stays.
    assert snapshots.vacuum(spark, path, keep=2) == []
    orphans = snapshots.vacuum(spark, path, keep=2, grace=0)
    assert len(orphans) >= 1 + 2 + 3 + 4 + 5
    assert hits(lexical_index.search_lexical_index(queries, index, "q", "k", 5)) == plain
    snapshots.vacuum(spark, path, keep=1, grace=0)
    same(spark, other, queries, lexical_index.read_lexical_index(spark, path), 5)
    with pytest.raises(FileNotFoundError):
        lexical_index.read_lexical_index(spark, path, 1)


def test_of_two_writers_the_second_fails(spark, tmp_path, monkeypatch):
    path, docs = str(tmp_path / "i"), some_docs(random.Random(1), 10)
    lexical_index.write_lexical_index(spark.createDataFrame(docs, DOCS), "k", path)
    commit, once = snapshots.commit, []

    def later(*args):
        if not once:
            once.append(1)
            lexical_index.update_lexical_index(spark.createDataFrame(docs[:5], DOCS), "k", path)
        return commit(*args)

    monkeypatch.setattr(snapshots, "commit", later)
    with pytest.raises(snapshots.ConflictError):
        lexical_index.update_lexical_index(spark.createDataFrame(docs[:7], DOCS), "k", path)
    assert lexical_index.read_lexical_index(spark, path).n == 5 and snapshots.versions(spark, path) == [1, 2]
    with pytest.raises(FileExistsError):
        snapshots.write_new(spark, f"{path}/versions/0000000002.json", "{}")
    assert not [n for n in os.listdir(f"{path}/versions") if n.startswith(".") and not n.endswith(".crc")]


def test_blocks_that_cannot_matter_are_not_read(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(4)
    queries = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")
    index, told = lexical_index.write_lexical_index(docs, "doc_id", str(tmp_path / "i")), {}
    found = lexical_index.search_lexical_index(queries, index, "item_id", "doc_id", 5, told=told)
    plain = retrieval.bm25_search(queries, docs, "item_id", "doc_id", 5)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    assert told["made"] * 2 <= told["gains"] and told["read"] <= told["postings"]
