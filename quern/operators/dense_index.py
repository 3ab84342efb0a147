"""A stored index of vectors with exact search: pivots, distances from them, and the triangle inequality.

Pivots are chosen farthest first among a bounded sample. Every vector belongs to its nearest pivot and to a ring, by its distance from
it; ``blocks`` holds for each pivot and ring, PIVOTS * RINGS rows at most, the least and the greatest of these distances, the greatest norm
and the number of vectors. A query's distance from a pivot then bounds its distance from all vectors of a ring, and so their
scores. A search scores the rings that promise most until they hold k vectors, and then those alone that can reach the k-th best score
found. Nothing is approximate: where the bounds say little, as among vectors without clusters, all vectors are scored.

Defined results: rows without a key or vector aren't indexed; vectors of any norm are taken (the score is the inner product); null or
non-finite components raise; rows that share a key are returned each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.operators.retrieval import QUERY_BLOCK, ranked
from quern.session import drop, materialise
from quern.sources import snapshots

PIVOTS, RINGS, WIDTH, SAMPLE = 64, 128, 1 / 32, 4096
SLACK = 2e-6  # scores are rounded to six decimals
ROWS = 1024


@dataclass
class DenseIndex:
    """An opened version; ``pivots`` and ``blocks`` are small and held."""

    spark: SparkSession
    snapshot: snapshots.Snapshot
    pivots: np.ndarray
    blocks: list


def _matrix(column: pa.Array, what: str) -> np.ndarray:
    out = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
    if not np.isfinite(out).all():
        raise ValueError(f"{what} holds null or non-finite components")
    return out


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T), 0))


def farthest_first(sample: np.ndarray, most: int) -> np.ndarray:
    """Rows of the sample, each as far as can be from those before it."""
    chosen, far = [0], _apart(sample, sample[:1])[:, 0]
    while len(chosen) < min(most, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _apart(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def write_dense_index(items: DataFrame, key: str, path: str, vector: str = "embedding", **properties: str | float | int | bool) -> DenseIndex:
    """A version of the index at ``path``; ``properties`` (a model's name, say) are checked when it is read."""
    spark = items.sparkSession
    rows = items.select(F.col(key).alias("key"), F.col(vector).alias("v")).where("key is not null and v is not null and size(v) > 0")
    sample = rows.orderBy(F.xxhash64("key")).limit(SAMPLE).collect()
    pivots = farthest_first(np.array([r.v for r in sample], dtype=np.float64), PIVOTS) if sample else np.zeros((0, 0))
    key_type, vector_type = (f.dataType.simpleString() for f in rows.schema.fields)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                x = _matrix(part.column(1), "a vector")
                if x.shape[1] != pivots.shape[1]:
                    raise ValueError("the vectors have several sizes")
                far = _apart(x, pivots)
                near = far.argmin(axis=1)
                far = far[np.arange(len(x)), near]
                ring = np.minimum(far / WIDTH, RINGS - 1).astype(np.int64)
                columns = [pa.array((near * RINGS + ring).astype(np.int32)), pa.array(far), pa.array(np.sqrt((x * x).sum(axis=1)))]
                yield pa.RecordBatch.from_arrays([*columns, *part.columns], names=["block", "far", "norm", "key", "v"])

    placed = rows.mapInArrow(place, f"block int, far double, norm double, key {key_type}, v {vector_type}")
    part = snapshots.write_part(placed.sortWithinPartitions("block"), path, "vectors")
    held = snapshots.part_table(spark, path, part, placed.schema)
    blocks = held.groupBy("block").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.max("norm").alias("norm"), F.count(F.lit(1)).alias("n"))
    parts = {"vectors": [part], "blocks": [snapshots.write_part(blocks, path, "blocks")]}
    told = {"user": properties, "pivots": pivots.tolist()}
    snapshots.commit(spark, snapshots.opened(spark, path), path, parts, {"vectors": placed.schema, "blocks": blocks.schema}, told)
    return read_dense_index(spark, path, **properties)


def read_dense_index(spark: SparkSession, path: str, version: int | None = None, **properties: str | float | int | bool) -> DenseIndex:
    found = snapshots.opened(spark, path, version)
    if found is None:
        raise FileNotFoundError(path)
    wrong = sorted(k for k, v in properties.items() if found.properties["user"].get(k) != v)
    if wrong:
        raise ValueError(f"the index was built with other properties: {', '.join(wrong)}")
    blocks = found.table(spark, "blocks").orderBy("block").collect()  # PIVOTS * RINGS at most
    return DenseIndex(spark, found, np.array(found.properties["pivots"], dtype=np.float64), blocks)


def _bounds(queries: np.ndarray, index: DenseIndex) -> np.ndarray:
    """queries x blocks: the most that a vector of the block can score."""
    near = _apart(queries, index.pivots)[:, [b.block // RINGS for b in index.blocks]]
    low, high, norm = (np.array([b[c] for b in index.blocks]) for c in ("low", "high", "norm"))
    least = np.maximum(np.maximum(near - high, low - near) - 1e-9, 0)
    size = np.sqrt((queries * queries).sum(axis=1))[:, None]
    return np.minimum((size**2 + norm**2 - least**2) / 2, size * norm) + SLACK


def _scored(index: DenseIndex, queries: np.ndarray, need: np.ndarray, k: int) -> DataFrame:
    """q (place of the query), d (key), score: of each query the k best a task of the blocks that it needs (queries x blocks)."""
    spark = index.spark
    numbers = [b.block for b in index.blocks]
    wanted = [(n,) for n, some in zip(numbers, need.any(axis=0)) if some]
    rows = index.snapshot.table(spark, "vectors").join(F.broadcast(spark.createDataFrame(wanted, "block int")), "block", "left_semi").select("block", "key", "v")
    schema = index.snapshot.schema("vectors")
    at = {n: i for i, n in enumerate(numbers)}
    shared = spark.sparkContext.broadcast((queries, np.packbits(need, axis=0), at))
    key_kind = to_arrow_type(schema["key"].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, packed, at = shared.value
        best: dict[int, list] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                block, keys = part.column(0).to_numpy(), part.column(1).to_pylist()
                x = _matrix(part.column(2), "a vector")
                for b in np.unique(block):
                    asked = np.flatnonzero(np.unpackbits(packed[:, at[int(b)]], count=len(matrix)))
                    own = np.flatnonzero(block == b)
                    score = np.round(matrix[asked] @ x[own].T, 6) + 0.0
                    if len(own) > k:
                        least = np.partition(score, len(own) - k, axis=1)[:, len(own) - k]
                        q, d = np.nonzero(score >= least[:, None])
                    else:
                        q, d = np.nonzero(np.ones_like(score, dtype=bool))
                    for i, j in zip(q.tolist(), d.tolist()):
                        best.setdefault(int(asked[i]), []).append((-score[i, j], keys[own[j]]))
                    for i in set(asked[q].tolist()):
                        if len(best[i]) > 4 * k:
                            best[i] = sorted(best[i])[:k]
        columns = list(zip(*((q, d, -float(s)) for q, found in best.items() for s, d in sorted(found)[:k]))) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), key_kind, pa.float64()))], names=["q", "d", "score"])

    return rows.mapInArrow(run, f"q int, d {schema['key'].dataType.simpleString()}, score double")


def search_dense_index(queries: DataFrame, index: DenseIndex, query: str, key: str, k: int = 5, vector: str = "embedding", told: dict | None = None) -> DataFrame:
    """query, key, score, rank, the same as ``dense_search`` gives. Runs the search; ``quern.session.clear`` removes its result.

    ``told`` gets ``pairs`` (queries times vectors) and ``scored``, those of them that the second step scored.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark = index.spark
    query_type, key_type = queries.schema[query].dataType.simpleString(), index.snapshot.schema("vectors")["key"].dataType.simpleString()
    asked = queries.select(query, vector).where(F.col(vector).isNotNull())
    sets = max(1, -(-asked.count() // QUERY_BLOCK))
    out = spark.createDataFrame([], f"`{query}` {query_type}, `{key}` {key_type}, score double")
    sizes = np.array([b.n for b in index.blocks])
    for number in range(sets):
        rows = (asked if sets == 1 else asked.where(F.pmod(F.xxhash64(query, vector), F.lit(sets)) == number)).collect()
        if not rows or not len(sizes):
            continue
        matrix = np.array([r[1] for r in rows], dtype=np.float64)
        bounds = _bounds(matrix, index)
        order = np.argsort(-bounds, axis=1, kind="stable")
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        need = np.zeros(bounds.shape, dtype=bool)
        np.put_along_axis(need, order, before < k, axis=1)
        first = ranked(_scored(index, matrix, need, k), "q", [F.desc("score"), F.asc("d")], k)
        least = np.full(len(rows), -np.inf)
        for r in first.where(F.col("rank") == k).collect():  # a row a query
            least[r["q"]] = r["score"]
        need = bounds >= least[:, None]
        if told is not None:
            told["pairs"] = told.get("pairs", 0) + len(rows) * int(sizes.sum())
            told["scored"] = told.get("scored", 0) + int((need * sizes).sum())
        found, path = materialise(_scored(index, matrix, need, k), "dense")
        named = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"q int, id {query_type}")
        best = ranked(found, "q", [F.desc("score"), F.asc("d")], k).join(named, "q").select(F.col("id").alias(query), F.col("d").alias(key), "score")
        out = out.unionByName(materialise(best, "dense-hits")[0])
        drop(spark, path)
    return ranked(out, query, [F.desc("score"), F.asc(key)], k)
