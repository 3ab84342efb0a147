"""Near duplicates among embeddings by a pigeonhole join over subspaces.

Unit vectors are rotated by a fixed random orthogonal matrix and split into blocks of few dimensions. Two vectors at squared distance
2 - 2 * threshold or less are, in one block at least, at most that block's share of it apart (its share of the dimensions), so a
range join a block under that budget finds every link.

1. Equal vectors of a label collapse to one class with a count, on the map side first.
2. In every block the space is cut into cells, by quantiles that a bounded sample gives; the more vectors a label has, the
   more cells. A vector goes to its own cell and to those with greater numbers that the budget's ball around it reaches, so that each
   pair within the budget meets in one cell exactly.
3. A cell's vectors are compared in memory, first in the block, then by cosine; cells of more than TILE vectors are dealt to tasks by
   pairs of tiles. A pair that several blocks find counts in the first of them. A task returns a count a vector and the links that join
   what it hasn't seen joined, never the pairs: a group of near copies costs comparisons, not rows.
4. Components of these links.

The cosine is of the values as doubles; where the rotated one is within 1e-9 of the threshold, the values decide.

Defined results: rows whose label or vector is null, or whose vector is empty, zero or holds a null or non-finite component, link
with nothing; vectors of different sizes don't link; equal vectors of a label are links, also under a shared id, and every row is
returned; a row without an id is a vector like the others, has the least id reachable as its component (null if there is none) and
is kept only in that last case; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, parts, table
from .near_dup import components

BLOCKS = 8
CELL_ROWS = 2048  # vectors that a cell of an evenly filled label holds, about
TILE = 8192  # vectors of one cell on one side of a task
SAMPLE = 4096  # vectors that the cells' borders are fitted on
BUCKETS, SPOTS = 1 << 12, 1 << 16  # rows at most of the two broadcast tables: cuts of labels, tiles of large cells
CUTS = 6  # of a dimension at most, each a doubling of its intervals
CHUNK, PADDED, SLACK = 1024, 256, 1e-9


class Space:
    """Rotation and blocks of vectors of one size."""

    def __init__(self, size: int, threshold: float, borders: np.ndarray | None = None):
        self.size, self.threshold = size, threshold
        q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
        self.turn = q * np.sign(np.diag(r))
        self.blocks = [b for b in np.array_split(np.arange(size), min(BLOCKS, size))]
        self.budgets = [(2 - 2 * threshold) * len(b) / size for b in self.blocks]
        if borders is None:  # a coordinate of a rotated unit vector is 1 / sqrt(size) large, about
            borders = np.quantile(np.random.default_rng(1).standard_normal(SAMPLE), quantiles())[:, None] * np.full(size, size**-0.5)
        self.borders = borders

    def rotated(self, raw: np.ndarray) -> np.ndarray:
        """Unit vectors of the rows, rotated. Always so many rows at a time, so that a row's result doesn't depend on its neighbours."""
        _, power = np.frexp(np.abs(raw).max(axis=1))
        unit = np.ldexp(raw, -power[:, None])
        unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
        out = np.empty_like(unit)
        held = np.zeros((PADDED, self.size))
        for a in range(0, len(unit), PADDED):
            part = unit[a : a + PADDED]
            held[: len(part)] = part
            out[a : a + PADDED] = (held @ self.turn)[: len(part)]
        return out

    def cells(self, u: np.ndarray, block: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, own) of the cells that rows go to: their own, and those after it within the budget."""
        dims = self.blocks[block]
        reach = self.budgets[block] * (1 + 3 * SLACK) + 1e-12
        row, cell, gap = np.arange(len(u)), np.zeros(len(u), dtype=np.int64), np.zeros(len(u))
        home = np.zeros(len(u), dtype=np.int64)
        for i, dim in enumerate(dims):
            cuts = min(CUTS, (depth + len(dims) - 1 - i) // len(dims))
            if not cuts:
                break
            border = self.borders[(1 << CUTS - cuts) - 1 :: 1 << CUTS - cuts, dim]
            low, high = np.append(-np.inf, border), np.append(border, np.inf)
            x = u[row, dim][:, None]
            far = gap[:, None] + np.maximum(np.maximum(low - x, x - high), 0) ** 2
            at, interval = np.nonzero(far <= reach)
            row, cell, gap = row[at], cell[at] * len(low) + interval, far[at, interval]
            home = home * len(low) + np.searchsorted(border, u[:, dim], side="right")
        keep = cell >= home[row]
        return row[keep], cell[keep], cell[keep] == home[row[keep]]

    def near(self, x: np.ndarray, y: np.ndarray, block: int) -> np.ndarray:
        """Which pairs are within the block's budget; the answer for a pair doesn't depend on the others or on its order."""
        a, b = x[:, self.blocks[block]], y[:, self.blocks[block]]
        far = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
        most = self.budgets[block] * (1 + SLACK) + 1e-13
        out = far <= most
        i, j = np.nonzero(np.abs(far - most) < SLACK)
        if len(i):
            out[i, j] = ((a[i] - b[j]) ** 2).sum(axis=1) <= most
        return out


def quantiles() -> np.ndarray:
    return np.arange(1, 1 << CUTS) / (1 << CUTS)


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows, from the values; scaled by powers of two, which is exact."""
    x, y = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None]) for v in (x, y))
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


class Forest:
    """Which rows of a task are known to be joined."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def top(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, good: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
        """Join what the matrix links; each round joins every row to one column that it isn't joined with yet."""
        while True:
            a, b = (np.array([self.top(i) for i in at]) for at in (rows.tolist(), columns.tolist()))
            open_ = good & (a[:, None] != b[None, :])
            left = np.flatnonzero(open_.any(axis=1))
            if not len(left):
                return
            for i, j in zip(rows[left].tolist(), columns[open_[left].argmax(axis=1)].tolist()):
                p, q = self.top(i), self.top(j)
                if p != q:
                    self.parent[max(p, q)] = min(p, q)
                    self.edges.append((i, j))


def compared(space: Space, block: int, raw: np.ndarray, weight: np.ndarray, right: np.ndarray, inner: bool) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """A number of links of every row of a task and the links that join: left rows with right ones, and with each other if ``inner``."""
    u = space.rotated(raw)
    found, forest = np.zeros(len(raw), dtype=np.int64), Forest(len(raw))
    one, other = np.flatnonzero(~right), np.flatnonzero(right)

    def chunks(at: np.ndarray) -> list[np.ndarray]:
        return [at[a : a + CHUNK] for a in range(0, len(at), CHUNK)]

    pairs = [(a, b, False) for a in chunks(one) for b in chunks(other)]
    if inner:
        each = chunks(one)
        pairs += [(a, b, i == j) for i, a in enumerate(each) for j, b in enumerate(each) if i <= j]
    for a, b, same in pairs:
        good = space.near(u[a], u[b], block)
        if same:
            good = np.triu(good, 1)
        x, y = np.flatnonzero(good.any(axis=1)), np.flatnonzero(good.any(axis=0))
        if not len(x):
            continue
        a, b, good = a[x], b[y], good[np.ix_(x, y)]
        cos = u[a] @ u[b].T
        good &= cos >= space.threshold - SLACK
        i, j = np.nonzero(good & (cos < space.threshold + SLACK))
        if len(i):
            good[i, j] = cosine(raw[a[i]], raw[b[j]]) >= space.threshold
        for earlier in range(block):
            if not good.any():
                break
            good &= ~space.near(u[a], u[b], earlier)
        if good.any():
            found[a] += good @ weight[b]
            found[b] += good.T @ weight[a]
            forest.join(good, a, b)
    return found, forest.edges


def _raw(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _spaces(threshold: float, borders: dict[int, np.ndarray]):
    held: dict[int, Space] = {}

    def of(size: int) -> Space:
        if size not in held:
            held[size] = Space(size, threshold, borders.get(size))
        return held[size]

    return of


def _sized(batch: pa.RecordBatch, sizes: np.ndarray, extra: np.ndarray) -> Iterator[tuple[pa.RecordBatch, int, int]]:
    """The batch in parts of one size of vector and one value of ``extra``."""
    for size, value in sorted(set(zip(sizes.tolist(), extra.tolist()))):
        yield batch.filter(pa.array((sizes == size) & (extra == value))), size, value


def dealt(classes: DataFrame, threshold: float, borders: dict[int, np.ndarray], whole: bool) -> DataFrame:
    """Rows (g, h, block, cell, own, cid, n, v) of every cell that a vector goes to; without ``whole``, (spot, held): how many vectors
    of the input part go to cells of the spot. ``classes``: g, h (of the label and size), depth, cid, n, v."""
    vector = classes.schema["v"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = _spaces(threshold, borders)
        for big in batches:
            for batch in parts([big]):
                if not batch.num_rows:
                    continue
                for part, size, depth in _sized(batch, np.diff(batch.column(5).offsets.to_numpy()), batch.column(2).to_numpy()):
                    s = space(size)
                    u = s.rotated(_raw(part.column(5)))
                    for block in range(len(s.blocks)):
                        row, cell, own = s.cells(u, block, depth)
                        g, h = (part.column(i).take(pa.array(row)) for i in (0, 1))
                        at = [g, h, pa.array(np.full(len(row), block, dtype=np.int32)), pa.array(cell)]
                        if whole:
                            rest = [part.column(i).take(pa.array(row)) for i in (3, 4, 5)]
                            yield pa.RecordBatch.from_arrays([*at, pa.array(own), *rest], names=["g", "h", "block", "cell", "own", "cid", "n", "v"])
                        else:
                            key, held = np.unique(np.stack([g.to_numpy(), h.to_numpy(), np.full(len(row), block), cell]), axis=1, return_counts=True)
                            yield pa.RecordBatch.from_arrays([*(pa.array(k) for k in key), pa.array(held)], names=["g", "h", "block", "cell", "held"])

    read = classes.select("g", "h", "depth", "cid", "n", "v")
    if whole:
        return read.mapInArrow(run, f"g long, h long, block int, cell long, own boolean, cid long, n long, v {vector}")
    return read.mapInArrow(run, "g long, h long, block long, cell long, held long")


def _spot() -> Column:
    return F.pmod(F.xxhash64("g", "h", F.col("block").cast("long"), "cell"), F.lit(SPOTS))


def cell_links(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b, n): links that join (n null), and numbers of links of single vectors (b null)."""
    rows = rows.withColumn("task", F.xxhash64("g", "h", "block", "cell", "i", "j")).repartition("task")
    rows = rows.sortWithinPartitions("task", "g", "h", "block", "cell", "i", "j")
    rows = rows.select("g", "h", F.col("block").cast("long").alias("block"), "cell", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "right", "cid", "n", "v")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, held, now = _spaces(threshold, {}), [], None

        def finish() -> Iterator[pa.RecordBatch]:
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            if batch.num_rows < 2:
                return
            cid, raw = batch.column(7).to_numpy(), _raw(batch.column(9))
            right = batch.column(6).to_numpy(zero_copy_only=False).astype(bool)
            found, edges = compared(space(raw.shape[1]), now[2], raw, batch.column(8).to_numpy(), right, now[4] == now[5])
            some = np.flatnonzero(found)
            if len(some):
                a = np.concatenate([cid[some], cid[[e[0] for e in edges]]])
                b = pa.array([None] * len(some) + cid[[e[1] for e in edges]].tolist(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(found[some].tolist() + [None] * len(edges), pa.int64())], names=["a", "b", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(6)], axis=1)
            begins = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(begins, begins[1:]):
                key = tuple(keys[a].tolist())
                if key != now:
                    if held:
                        yield from finish()
                    held, now = [], key
                held.append(batch.slice(a, b - a))
        if held:
            yield from finish()

    return rows.mapInArrow(run, "a long, b long, n long")


def fitted(classes: DataFrame, threshold: float) -> dict[int, np.ndarray]:
    """Borders of cells a size of vectors: quantiles of the rotated coordinates of SAMPLE vectors, those whose numbers hash least."""
    found: dict[int, list] = {}
    for r in classes.select("v", F.xxhash64("h", "cid").alias("o")).orderBy("o").limit(SAMPLE).collect():
        found.setdefault(len(r.v), []).append(r.v)
    return {size: np.quantile(Space(size, threshold).rotated(np.array(v, dtype=np.float64)), quantiles(), axis=0) for size, v in found.items() if len(v) >= 64}


def linked_vectors(rows: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) of every row: cosines of ``threshold`` or more within a label. See the module."""
    with Tables(rows.sparkSession) as tables:
        return _linked_vectors(tables, rows, threshold, id_col, vector_col, label_col)


def _linked_vectors(tables: Tables, rows: DataFrame, threshold: float, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    element = rows.schema[vector_col].dataType.elementType
    v = F.transform(F.col(vector_col), lambda x: x + F.lit(0).cast(element))  # no negative zeros
    own = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"))
    counts = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    own = own.select("vec_id", F.when(counts & F.col("label").isNotNull(), F.struct("label", "v")).alias("s"))
    whole = own.where("s is not null").groupBy("s.label", "s.v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))

    digests = [F.xxhash64("label", F.size("v")).alias("g"), F.xxhash64(F.lit(3), "label").alias("h"), F.xxhash64("v").alias("x"), F.xxhash64(F.lit(7), "v").alias("y")]
    classes = tables.write(whole.select(F.monotonically_increasing_id().alias("cid"), "least", "n", "v", *digests), "classes")
    bucket = F.pmod("g", F.lit(BUCKETS))
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / CELL_ROWS))).cast("int")
    cuts = tables.write(classes.groupBy(bucket.alias("bucket")).agg(depth.alias("depth")), "cuts")  # BUCKETS rows at most
    deep = classes.withColumn("bucket", bucket).join(F.broadcast(cuts), "bucket").select("g", "h", "depth", "cid", "n", "v")

    borders = fitted(classes, threshold)
    cells = dealt(deep, threshold, borders, whole=False).groupBy("g", "h", "block", "cell").agg(F.sum("held").alias("held")).where(f"held > {TILE}")
    tiles = tables.write(cells.groupBy(_spot().alias("spot")).agg(F.ceil(F.max("held") / TILE).cast("int").alias("tiles")), "tiles")  # SPOTS rows at most
    placed = dealt(deep, threshold, borders, whole=True).withColumn("spot", _spot()).join(F.broadcast(tiles), "spot", "left")
    placed = placed.withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("tile", F.pmod(F.xxhash64("cid", F.lit(5)), F.col("tiles")).cast("int"))
    # A tile of a cell's own vectors meets every tile as the left side, and those before it as the right one.
    every = F.expr("sequence(0, tiles - 1)")
    left = F.transform(every, lambda t: F.struct(F.col("tile").alias("i"), t.alias("j"), F.lit(False).alias("right")))
    right = F.transform(F.when(F.col("own"), F.filter(every, lambda t: t < F.col("tile"))).otherwise(every), lambda t: F.struct(t.alias("i"), F.col("tile").alias("j"), F.lit(True).alias("right")))
    placed = placed.select("*", F.explode(F.when(F.col("own"), F.concat(left, right)).otherwise(right)).alias("t"))
    placed = placed.select("g", "h", "block", "cell", "t.i", "t.j", "t.right", "cid", "n", "v")
    found = tables.write(cell_links(placed, threshold), "found")

    roots = components(found.where("b is not null").select("a", "b"), tables)
    roots = tables.write(roots.select(F.col("rid").alias("cid"), "root"), "roots")
    links = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
    known = classes.select("cid", "least", "n", "g", "h", "x", "y")
    held = known.join(links, "cid", "left").join(roots, "cid", "left")
    first = held.where("root is not null").groupBy("root").agg(F.min("least").alias("first"))
    held = held.where("n > 1 or root is not null").join(first, "root", "left")
    held = held.select("g", "h", "x", "y", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("first", "least").alias("first"), F.lit(True).alias("linked"))
    held = tables.write(held, "linked", keep=True)

    told = own.select("vec_id", "s.label", "s.v").select("vec_id", *(F.when(F.col("v").isNotNull(), d).alias(n) for d, n in zip(digests, "ghxy")))
    told = told.join(held, list("ghxy"), "left")
    component = F.when(F.col("linked"), F.col("first")).otherwise(F.col("vec_id"))
    kept = F.when(F.col("vec_id").isNull(), F.col("c").isNull()).otherwise(F.col("vec_id") == F.col("c"))
    told = told.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("c"))
    return told.select("vec_id", "n_links", F.col("c").alias("component_id"), kept.alias("kept"))


def op13_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of ``embeddings`` at a cosine of 0.98 or more within a label."""
    return linked_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
with recursive v as materialized (
  select row_number() over () as rid, vec_id, label, embedding::double[] as e, label is not null and len(embedding) > 0 and coalesce(len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding), false)
    and coalesce(len(list_filter(embedding, lambda x: x <> 0)) > 0, false) as fit from embeddings
), f as materialized (select rid, label, e, len(e) as size from v where fit),
l as materialized (
  select a, b from (select a.rid as a, b.rid as b, case when a.size = b.size then list_cosine_similarity(a.e, b.e) end as cos from f a join f b on a.label = b.label and a.size = b.size and a.rid <> b.rid) where cos >= 0.98
), n as (select a, count(*) as n from l group by a),
r as (select rid, vec_id as root from v union select l.b, r.root from r join l on l.a = r.rid),
c as (select rid, min(root) as root from r group by rid)
select vec_id, coalesce(n, 0) as n_links, root as component_id, coalesce(vec_id = root, root is null) as kept from v join c using (rid) left join n on n.a = v.rid
"""
