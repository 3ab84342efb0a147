"""Centroid clustering by ball k-means in whole numbers, so that every run and every order of rows gives the same clusters.

A cluster is a ball: its centroid and the radius that its members reach. Centroid j is a neighbour of ball i only if half of its
distance from centroid i is within the radius. Members nearer to their centroid than half the way to the nearest
neighbour are the stable core and stay without a comparison; the rest lie in annuli, the k-th of which is beyond half the way to
k neighbours, and are compared with these k alone. A ball whose centroid and neighbours didn't move keeps its members. All of this
is exact, ties included: a distance of just twice the own one is compared, and the smaller number wins.

A task sees parts of balls. A part is a ball about the same centroid, with a radius of its own that is never larger, so each part finds
its own neighbours and no pass over the data for radii is needed. A round is one pass that assigns and writes vectors with
their clusters, and one aggregation of sums (a row a cluster and task reaches the shuffle). Only centroids pass through the driver.

Defined results: vectors that are null, of another size, or hold null or non-finite components are left out; rows that share an id
or a vector each count and are each returned; a row without an id is clustered but never a first centroid; with fewer than k
candidates there are as many clusters as candidates (rows that tie by id are taken in the order of their components), and without any,
or without rows, the result is empty; other columns are ignored. A scaled component so large (2 ** 26
of 64) that a long can't be sure to hold four times a squared distance raises.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, parts, table

K, ROUNDS, SIZE, SCALE, SEED = 40, 5, 64, 256, 2


def scaled(rows: DataFrame, size: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, q) of the vectors that count, each component as the floor of its scaled value."""
    kept = rows.select(F.col(id_col).alias("vec_id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    kept = kept.where((F.size("v") == size) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return kept.select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("q"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the smallest digests, in their order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = vectors.where("vec_id is not null").select(digest.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    return np.array([r.q for r in chosen], dtype=np.int64)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` and ``y``, both of int64."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    if 16 * x.shape[1] * most * most >= 1 << 63:
        raise ArithmeticError(f"a scaled component of {most} among {x.shape[1]}: four times a squared distance may not fit a long")
    if 4 * x.shape[1] * most * most < 1 << 53:  # whole numbers that doubles hold exactly
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in y], axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest centroid (the smallest of ``numbers`` on a tie) and the squared distance; ``numbers`` ascend."""
    found = squares(x, centroids[numbers])
    at = found.argmin(axis=1)
    return numbers[at], found[np.arange(len(x)), at]


def reassign(x: np.ndarray, was: np.ndarray, centroids: np.ndarray, apart: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The clusters and squared distances of rows whose clusters were ``was`` before centroids moved; ``apart``: squared distances of centroids."""
    now, far = was.copy(), np.empty(len(x), dtype=np.int64)
    for i in np.unique(was):
        rows = np.flatnonzero(was == i)
        own = squares(x[rows], centroids[i : i + 1])[:, 0]
        far[rows] = own
        near = np.flatnonzero(apart[i] <= 4 * own.max())
        near = near[near != i]
        if not len(near) or not (moved[i] or moved[near].any()):
            continue
        near = near[np.argsort(apart[i][near], kind="stable")]
        annulus = np.searchsorted(apart[i][near], 4 * own, side="right")  # how many neighbours can be as near; 0: the core
        for k in np.unique(annulus[annulus > 0]):
            out = rows[annulus == k]
            now[out], far[out] = nearest(x[out], centroids, np.sort(np.append(near[:k], i)))
    return now, far


def assign(rows: DataFrame, centroids: np.ndarray, moved: np.ndarray | None, keep_vectors: bool) -> DataFrame:
    """Rows (vec_id, q, cluster, distance), without q if it isn't kept; ``rows`` have their clusters unless ``moved`` is None."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = squares(centroids, centroids)
        for batch in parts(batches, 8192):
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if moved is None:
                cluster, far = nearest(x, centroids, np.arange(len(centroids)))
            else:
                cluster, far = reassign(x, batch.column(2).to_numpy().astype(np.int64), centroids, apart, moved)
            held = [batch.column(0)] + [batch.column(1)] * keep_vectors + [pa.array(cluster.astype(np.int32)), pa.array(far)]
            yield pa.RecordBatch.from_arrays(held, names=["vec_id", *["q"] * keep_vectors, "cluster", "distance"])

    read = rows.select("vec_id", "q", *["cluster"] * (moved is not None))
    return read.mapInArrow(run, f"vec_id {kind}, {'q array<long>, ' * keep_vectors}cluster int, distance long")


def updated(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means of the clusters; a cluster without vectors keeps its centroid."""
    sums = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(F.col("q")[i]) for i in range(centroids.shape[1]))).alias("s"))
    out = centroids.copy()
    for r in sums.collect():  # k rows
        out[r.cluster] = [s // r.n for s in r.s]
    return out


def cluster(
    rows: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that counts. See the module."""
    spark = rows.sparkSession
    vectors = scaled(rows, size, scale, id_col, vector_col)
    out = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], out)
    with Tables(spark) as tables:
        moved = None
        for _ in range(rounds):
            before, vectors = vectors, tables.write(assign(vectors, centroids, moved, keep_vectors=True), "assigned")
            if moved is not None:
                tables.drop(before)
            following = updated(vectors, centroids)
            moved = (following != centroids).any(axis=1)
            centroids = following
        last = tables.write(assign(vectors, centroids, moved, keep_vectors=False), "clusters", keep=True)
        inertia = {r.cluster: r.d for r in last.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
        digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
        told = [(i, d, sum(inertia.values()), digests[i]) for i, d in inertia.items()]
        told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        return last.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty clusters of ``embeddings`` after five rounds."""
    return cluster(table(spark, sf_dir, "embeddings"))


def oracle() -> str:
    """SQL of the same clusters: every round compares all vectors with all centroids."""
    steps = [f"""
with v as materialized (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as q from embeddings
  where len(embedding) = {SIZE} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {SIZE}
), x as materialized (select rid, unnest(range({SIZE})) as p, unnest(q) as x from v),
c0 as materialized (
  select c, unnest(range({SIZE})) as p, unnest(q) as y from (select q, row_number() over (order by sha256('{SEED}:' || vec_id::varchar), q) - 1 as c from v where vec_id is not null qualify c < {K})
)"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""
a{i} as materialized (select rid, arg_min(c, (d, c)) as c, min(d) as d from (select rid, c, sum((x - y) * (x - y))::bigint as d from x join c{i} using (p) group by rid, c) group by rid)""")
        if i < ROUNDS:
            steps.append(f"""
c{i + 1} as materialized (
  select c, p, coalesce(m, y) as y from c{i} left join (select c, p, ((s - ((s % n) + n) % n) // n)::bigint as m from (select c, p, sum(x)::bigint as s, count(*) as n from x join a{i} using (rid) group by c, p)) using (c, p)
)""")
    last = ROUNDS
    return ",".join(steps) + f"""
select vec_id, c::int as cluster, d as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, h as centroid_sha256
from a{last} join v using (rid) join (select c, sha256(string_agg(y::varchar, ',' order by p)) as h from c{last} group by c) using (c)
"""


ORACLE = oracle()
