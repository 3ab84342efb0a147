"""A stored index of trigrams: which files can hold a text at all, so that substring search reads few of them.

``grams`` (gram, block, files) holds for every three code points of the lower-cased texts the files that hold them, numbered, a row a gram
and run of files of a block of BLOCK_FILES (a task begins a new row where its texts reach RUN_CHARS), so that no (gram, file) row is shuffled; ``files`` (file, path) the numbers; ``counts`` (gram, n). Of an asked text the RAREST grams by these
counts are looked up, and a file that has them all is a candidate; the operators that search decide. Texts shorter than three have every file as candidate.

Defined results: null texts hold nothing and null asked texts have no candidates; case is folded as Spark's ``lower`` folds it on both
sides; rows that share a path are files of their own and each a candidate by its path.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import corpus, diagnosis
from quern.session import sliced
from quern.sources import snapshots

BLOCK_FILES, RAREST, RUN_CHARS = 1024, 4, 4_000_000


def grams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


@dataclass
class GramIndex:
    spark: SparkSession
    snapshot: snapshots.Snapshot

    def table(self, name: str) -> DataFrame:
        return self.snapshot.table(self.spark, name)


def _exploded(rows: DataFrame, kind: str) -> DataFrame:
    """id, gram of rows (id, t)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                of, found = [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    own = grams(t)
                    of += [i] * len(own)
                    found += own
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of, pa.int64())), pa.array(found, pa.string())], names=["id", "gram"])

    return rows.select("id", "t").mapInArrow(run, f"id {kind}, gram string")


def _listed(rows: DataFrame) -> DataFrame:
    """gram, block, files of rows (file, t): each task lists the files of its runs, in their order."""
    shift = BLOCK_FILES.bit_length() - 1

    def told(block: int, lists: dict[str, list[int]]) -> Iterator[pa.RecordBatch]:
        keys = sorted(lists)
        for start in range(0, len(keys), 20_000):
            part = keys[start : start + 20_000]
            files = pa.array([lists[g] for g in part], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([block] * len(part), pa.int64()), files], names=["gram", "block", "files"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, chars, lists = -1, 0, {}
        for batch in sliced(batches, 64):
            for file, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lists and (file >> shift != block or chars + len(t) > RUN_CHARS):
                    yield from told(block, lists)
                    chars, lists = 0, {}
                block, chars = file >> shift, chars + len(t)
                for g in grams(t):
                    if (own := lists.get(g)) is None:
                        lists[g] = [file]
                    else:
                        own.append(file)
        if lists:
            yield from told(block, lists)

    return rows.select("file", "t").mapInArrow(run, "gram string, block long, files array<long>")


def write_gram_index(files: DataFrame, folder: str, path: str = "path", text: str = "text") -> GramIndex:
    """A version of the index below ``folder``."""
    spark = files.sparkSession
    numbered = files.where(F.col(text).isNotNull()).select(F.monotonically_increasing_id().alias("file"), F.col(path).alias("path"), F.lower(text).alias("t"))
    held = snapshots.write_part(numbered, folder, "lowered")  # numbers must not change between the tables
    own = snapshots.part_table(spark, folder, held, numbered.schema)
    lists = _listed(own)
    part = snapshots.write_part(lists, folder, "grams")
    written = snapshots.part_table(spark, folder, part, lists.schema)
    counts = written.groupBy("gram").agg(F.sum(F.size("files").cast("long")).alias("n"))
    named = own.select("file", "path")
    parts = {"grams": [part], "counts": [snapshots.write_part(counts, folder, "counts")], "files": [snapshots.write_part(named, folder, "files")]}
    done = snapshots.commit(spark, snapshots.opened(spark, folder), folder, parts, {"grams": lists.schema, "counts": counts.schema, "files": named.schema}, {})
    return GramIndex(spark, done)


def read_gram_index(spark: SparkSession, folder: str, version: int | None = None) -> GramIndex:
    found = snapshots.opened(spark, folder, version)
    if found is None:
        raise FileNotFoundError(folder)
    return GramIndex(spark, found)


def candidates(index: GramIndex, asked: DataFrame, key: str, text: str) -> DataFrame:
    """key, path of the files that can hold each asked text, each once."""
    kind = asked.schema[key].dataType.simpleString()
    own = asked.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.lower(text).alias("t"))
    numbered = own.select(F.struct("id", "t").alias("q"), "t").distinct()
    counts = index.table("counts")
    wanted = _exploded(numbered.select(F.col("q").alias("id"), "t"), f"struct<id: {kind}, t: string>")
    known = wanted.join(counts, "gram", "left").select("id", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram").alias("g"))
    rarest = known.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("g")), 1, RAREST).alias("g"))  # grams of one asked text
    picked = rarest.select("id", F.size("g").alias("asked"), F.explode("g.gram").alias("gram"))
    hits = picked.join(index.table("grams"), "gram").select("id", "asked", F.explode("files").alias("file"))
    long_ = hits.groupBy("id", "file").agg(F.count(F.lit(1)).alias("n"), F.first("asked").alias("asked")).where("n = asked").select("id.id", "file")
    # A text too short for a gram: every file.
    short = own.where(F.length("t") < 3).select("id").distinct().withColumn("one", F.lit(1)).join(index.table("files").select("file", F.lit(1).alias("one")), "one").select("id", "file")
    found = long_.unionByName(short).join(index.table("files"), "file").select(F.col("id").alias(key), "path")
    return found.distinct()


def grep(files: DataFrame, index: GramIndex, query: str, context: int = 2, limit: int | None = 20, path: str = "path", text: str = "text") -> DataFrame:
    """What ``corpus.grep`` gives, of the files that can hold the query alone."""
    asked = index.spark.createDataFrame([(0, query)], "id int, t string")
    held = candidates(index, asked, "id", "t").select(F.col("path").alias(path))
    return corpus.grep(files.join(held, path, "left_semi"), path, query, context, limit, text)


def identifier_exists(names: DataFrame, files: DataFrame, index: GramIndex, name: str = "name", path: str = "path", text: str = "text") -> DataFrame:
    """What ``diagnosis.identifier_exists`` gives, with only the texts of files that can hold one of the names."""
    held = candidates(index, names.select(F.col(name).alias("id"), F.col(name).alias("t")), "id", "t").select(F.col("path").alias(path)).distinct()
    return diagnosis.identifier_exists(names, files.join(held, path, "left_semi"), files, name, path, text)
