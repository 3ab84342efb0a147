"""Near duplicates by fast similarity sketching, banding and exact verification on whole shingle sets.

1. Every text becomes its set of hashed word shingles, a sketch of 150 bins and 30 band keys (five bins each): a pair at
   similarity 0.8 shares no band with probability 7e-6. Equal sets fall together by fingerprint, so that copies cost one
   representative, the least document id.
2. Band keys held by one representative only go. In every other bucket the representative that shares most buckets
   (the likely centre of its group) is the leader, and all members are verified against it: links grow with
   memberships, not with pairs. Pairs whose sketches put them six deviations below the threshold aren't verified.
3. Components of these links (large-star and small-star joins). Buckets that lie inside one component are done.
4. What is left are buckets with members in several components. Small ones give their pairs across components; larger ones
   are cut into blocks of bounded size, and tasks compare block with block in memory, returning only links that join
   components they haven't seen joined. So every pair of a bucket is either verified or known to be connected.
5. Components of all links; the result carries every document, copies included.

Verification is exact on full sets: 100 * intersection >= threshold * union, in whole numbers.

Defined results: null, empty and blank texts have an empty set and are linked with nothing; rows that share a document id
count as one document (of several texts of one id, the one of least fingerprint stands for its links, and all of them get its
component); rows with a null id get the component of their copies (null if none has an id) and are kept only
where no copy has one; texts of any length are taken whole; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sketch as sk
from .common import Tables, let_go, parts, table

SMALL = 16  # members of a bucket whose pairs are listed
BLOCK_ROWS, BLOCK_ITEMS = 1024, 400_000  # representatives and set elements of a block, about
BITS = 26  # of the bitmap that picks rows before a join: at most 2 ** (BITS - 6) rows are broadcast


def sketched(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, n, fp, brief, bands); fp and what follows are null where the set is empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        shingler = sk.Shingler(size)
        for batch in parts(batches):
            n, fp, brief, bands = [], [], [], []
            for text in batch.column(1):
                items = shingler.of(text.as_py())
                n.append(len(items))
                if not len(items):
                    fp.append(None), brief.append(None), bands.append(None)
                    continue
                values = sk.sketch(items)
                fp.append(sk.fingerprint(items)), brief.append(sk.brief(values)), bands.append(sk.band_keys(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(brief, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n", "fp", "brief", "bands"],
            )

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, f"doc_id {kind}, n long, fp binary, brief binary, bands array<long>")


def bitmap_of(ids: DataFrame, column: str) -> DataFrame:
    """Rows (word, mask) of a bitmap of hashed ids: at most 2 ** (BITS - 6) rows, whatever the number of ids."""
    spot = F.pmod(F.xxhash64(column), F.lit(1 << BITS))
    return ids.select(spot.alias("s")).groupBy(F.shiftright("s", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("mask")
    )


def maybe_in(rows: DataFrame, bitmap: DataFrame, column: str, into: str) -> DataFrame:
    """``rows`` with a boolean: false only for ids that the bitmap's ids don't hold. The bitmap is broadcast, being bounded."""
    spotted = rows.select(F.struct("*").alias("row"), F.pmod(F.xxhash64(column), F.lit(1 << BITS)).alias("spot"))
    spotted = spotted.withColumn("word", F.shiftright("spot", 6))  # the row's own columns are inside it, so no name clashes
    joined = spotted.join(F.broadcast(bitmap), "word", "left")
    hit = F.expr("(shiftright(mask, cast(spot & 63 as int)) & 1L) = 1")
    return joined.select("row.*", F.coalesce(hit, F.lit(False)).alias(into))


def sets_of(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (rid, items) with the sets, as bytes, of the documents whose ids and fingerprints are in ``wanted`` (rid, fp).

    The bitmap lets few texts that aren't needed into the join's shuffle. A repeated row gives its set again.
    """
    read = docs.select(F.col(id_col).alias("rid"), F.col(text_col).alias("text"))
    read = maybe_in(read, bitmap_of(wanted, "rid"), "rid", "hit").where("hit").select("rid", "text").join(wanted, "rid")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        shingler = sk.Shingler(size)
        for batch in parts(batches):
            items = [shingler.of(t.as_py()) for t in batch.column(1)]
            own = [len(i) > 0 and sk.fingerprint(i) == fp for i, fp in zip(items, batch.column(2).to_pylist())]
            held = pa.array([i.tobytes() if keep else None for i, keep in zip(items, own)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), held], names=["rid", "items"]).filter(pa.array(own, pa.bool_()))

    return read.select("rid", "text", "fp").mapInArrow(run, f"rid {kind}, items binary")


def likely(pairs: DataFrame, reps: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches don't rule out the threshold."""
    own = reps.select("rid", "n", "brief")
    both = pairs.join(own.toDF("a", "na", "sa"), "a").join(own.toDF("b", "nb", "sb"), "b")
    both = both.where(f"100 * least(na, nb) >= {threshold} * greatest(na, nb)").select("a", "b", "sa", "sb")
    share = threshold / 100
    least = sk.BINS * share - 6 * (sk.BINS * share * (1 - share)) ** 0.5
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, sk.BINS) for i in (2, 3))
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    return both.mapInArrow(run, f"a {kind}, b {kind}")


def linked(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= threshold * (len(x) + len(y) - both)


def verify(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that are links."""
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            good = [
                linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), threshold)
                for x, y in zip(batch.column(2), batch.column(3))
            ]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, f"a {kind}, b {kind}")


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """Rows (rid, root) of every end of a link; root is the least id of the component."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = tables.write(edges, "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = tables.write(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = tables.write(large, "large")
        low = tables.write(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        small = small.select("e.u", "e.v").where("u <> v").distinct()
        following = tables.write(small, "edges")
        tables.drop(edges, least, large, low)
        edges = following
        seen = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == before or seen[0] == 0:
            break
        before = seen
    return edges.select(F.col("u").alias("rid"), F.col("v").alias("root")).unionByName(edges.select("v", "v").toDF("rid", "root").distinct())


def _block_links(ids: list, roots: list, sides: np.ndarray, sets: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """Links across roots among rows of side 0, or between the sides; once two roots are joined, no more of theirs."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    value, index, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(sets)), sizes)
    keep = shared[index]
    owner, column = owner[keep], column[index[keep]]
    width, inter = int(shared.sum()), None
    left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    if not len(right):
        right = left
    inter = np.zeros((len(left), len(right)), dtype=np.float32)
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    step = max(1, 16_000_000 // max(1, len(sets)))
    for first in range(0, width, step):  # a dense slice of the shared elements at a time
        a, b = np.searchsorted(column, (first, first + step))
        dense = np.zeros((len(sets), min(step, width - first)), dtype=np.float32)
        dense[owner[a:b], column[a:b] - first] = 1
        inter += dense[left] @ dense[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - inter
    good = 100 * inter.astype(np.float64) >= threshold * union
    names = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    root = np.array([names[r] for r in roots])
    good &= root[left][:, None] != root[right][None, :]
    parent = list(range(len(names)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(*np.nonzero(good)):
        a, b = int(left[i]), int(right[j])
        p, q = top(root[a]), top(root[b])
        if p != q:
            parent[p] = q
            out.append((ids[a], ids[b]))
    return out


def block_links(rows: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links of large buckets. rows: bucket, rid, root, blocks (of its bucket)."""
    block = F.pmod(F.xxhash64("rid", F.lit(5)), F.col("blocks")).cast("int")
    dealt = rows.withColumn("block", block).select(
        "bucket", "rid", "root", "block", F.explode(F.expr("sequence(0, cast(blocks - 1 as int))")).alias("other")
    )
    dealt = dealt.select(
        "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), "rid", "root",
    )
    key = F.xxhash64("bucket", "i", "j")
    dealt = dealt.join(sets, "rid").withColumn("task", key).repartition("task").sortWithinPartitions("task", "bucket", "i", "j")
    dealt = dealt.select("task", "bucket", "i", "j", "side", "rid", "root", "items")
    kind = rows.schema["rid"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        arrow = None
        held: list[tuple] = []
        now = None

        def finish() -> list[tuple[int, int]]:
            if len({h[2] for h in held}) < 2:
                return []
            sets_ = [np.frombuffer(h[3], np.uint64) for h in held]
            return _block_links([h[1] for h in held], [h[2] for h in held], np.array([h[0] for h in held]), sets_, threshold)

        found: list[tuple[int, int]] = []
        for batch in batches:
            arrow = batch.schema.field(5).type
            columns = [batch.column(i).to_pylist() for i in range(1, 8)]
            for bucket, i, j, side, rid, root, items in zip(*columns):
                if (bucket, i, j) != now:
                    if held:
                        found += finish()
                    held, now = [], (bucket, i, j)
                held.append((side, rid, root, items))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], arrow) for k in (0, 1)], names=["a", "b"])
                found = []
        if held:
            found += finish()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], arrow) for k in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, size: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept) of every row of ``docs``. See the module."""
    with Tables(docs.sparkSession) as tables:
        return _near_duplicates(tables, docs, size, threshold, id_col, text_col)


def _near_duplicates(tables: Tables, docs: DataFrame, size: int, threshold: int, id_col: str, text_col: str) -> DataFrame:
    all_ = tables.write(sketched(docs, size, id_col, text_col), "sketched", keep=True)
    copies = tables.write(all_.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rid")), "copies")
    owner = all_.where("fp is not null and doc_id is not null").select("doc_id", "fp", "n", "brief", "bands")
    first = copies.where("rid is not null").groupBy("rid").agg(F.min("fp").alias("fp"))  # of several texts of one id
    reps = owner.join(first, (owner.doc_id == first.rid) & (owner.fp == first.fp), "left_semi")
    reps = tables.write(reps.select(F.col("doc_id").alias("rid"), "fp", "n", "brief", "bands").dropDuplicates(["rid"]), "reps")
    members = reps.select("rid", F.explode("bands").alias("bucket"))
    counts = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    counts = tables.write(counts, "buckets")
    members = tables.write(members.join(counts, "bucket"), "members")
    wanted = tables.write(members.groupBy("rid").agg(F.sum("held").alias("weight")), "wanted")
    named = reps.select("rid", "fp").join(wanted.select("rid"), "rid", "left_semi")
    sets = tables.write(sets_of(docs, named, size, id_col, text_col), "sets")
    if not sets.groupBy("rid").count().where("count > 1").isEmpty():  # rows of one id and text: one set each
        sets = tables.write(sets.groupBy("rid").agg(F.min("items").alias("items")), "sets")
    few = reps.join(wanted.select("rid"), "rid", "left_semi").select("rid", "n", "brief")
    few = tables.write(few, "few")

    lead = members.join(wanted, "rid").groupBy("bucket").agg(F.max(F.struct("weight", "rid")).alias("m"))
    lead = tables.write(lead.select("bucket", F.col("m.rid").alias("b")), "leaders")
    star = members.join(lead, "bucket").where("rid <> b").select(F.col("rid").alias("a"), "b").distinct()
    links = tables.write(verify(likely(star, few, threshold), sets, threshold), "links")
    roots = tables.write(components(links, tables), "roots")

    rooted = members.join(roots, "rid", "left").select("bucket", "held", "rid", F.coalesce("root", "rid").alias("root"))
    rooted = tables.write(rooted, "rooted")
    open_ = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    open_ = tables.write(open_.select("bucket"), "open")
    left = rooted.join(open_, "bucket")
    left = tables.write(left, "left")
    small = left.where(f"held <= {SMALL}")
    pairs = small.select("bucket", F.col("rid").alias("a"), F.col("root").alias("ra")).join(
        small.select("bucket", F.col("rid").alias("b"), F.col("root").alias("rb")), "bucket"
    )
    pairs = pairs.where("a < b and ra <> rb").select("a", "b").distinct()
    found = verify(likely(pairs, few, threshold), sets, threshold)
    large = left.where(f"held > {SMALL}").join(few.select("rid", "n"), "rid")
    cells = large.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK_ROWS), F.ceil(F.col("s") / BLOCK_ITEMS), F.lit(1)).alias("blocks")
    cells = tables.write(cells.select("bucket", blocks), "cells")
    found = found.unionByName(block_links(large.join(cells, "bucket").select("bucket", "rid", "root", "blocks"), sets, threshold))
    every = links.unionByName(found)
    roots = tables.write(components(every, tables), "roots")

    home = copies.join(roots, "rid", "left").select("fp", "rid", F.coalesce("root", "rid").alias("root"))
    home = tables.write(home, "home", keep=True)
    done = all_.select("doc_id", "n", "fp").join(home, "fp", "left")
    component = F.coalesce("root", "doc_id")
    return done.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.when(F.col("doc_id").isNull(), F.col("root").isNull()).otherwise(F.col("doc_id") == component).alias("kept"),
    )


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents at a similarity of 0.8 or more on four-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=4)
