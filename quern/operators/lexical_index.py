"""A stored BM25 index: versions, changes by file, and searches that read only the blocks that can matter.

Tables of a version (``sources.snapshots``): ``documents`` (segment, doc, key, file, length, terms, tfs), a row a document; ``postings``
(segment, block, docs, lengths, terms, tops, ns, at, tfs), a row for each block of BLOCK_DOCS documents (two, where a stored file is read
in two splits that part a block): its documents, and of each term the most that it can add to a score there, in how many of them it
stands, in which (places in ``docs``) and how often; ``terms`` (term, df), whose numbers add up over parts; ``dead`` (segment, block,
docs), documents that a later version replaced or removed; ``files`` (file, fingerprint). Documents are stored in the order of their
numbers, so that tasks make blocks of neighbouring rows: no posting is a row, and none is shuffled.

An update compares fingerprints of files, tokenises the documents of new and changed ones into a segment of their own, marks what it
replaces as dead, and adds to ``terms`` what came and takes off what went, from the stored counts. A merge writes the living
documents of all segments into one, without reading a text. Either is a commit: readers keep what they opened.

A search keeps of each block what is said of its terms; adds up, a query and block, the most that the query's terms can score
there; scores the few most promising blocks of each query, so that the k-th best score found bounds what matters; and then scores those
blocks alone whose sum reaches it, in the task that adds up. The result is exact.

Defined results: every row is a document, also one that shares its key with others or has no text; a row without a key counts in the
statistics and is never returned; documents without a file are one file; a query without tokens finds nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StructType

from quern.operators.retrieval import K1, B, check_bm25, python_tokens, query_sets, ranked
from quern.session import drop, long_rows, materialise, sliced
from quern.sources import snapshots

BLOCK_DOCS = 8  # documents of a block: the more, the fewer rows and the looser their bounds
FIRST_BLOCKS = 12  # blocks of each query that are scored to learn how good a score must be
CELLS = 4_000_000  # of a matrix of blocks by queries in a task
SLACK = 2e-6  # scores are rounded to six decimals
PARTS = 12  # a merge is due when there are more segments
RUN_BITS = 15  # of the numbers of documents whose dead are bits of one row
DEAD = StructType().add("segment", "integer").add("block", "long").add("docs", ArrayType(LongType()))


@dataclass
class LexicalIndex:
    """An opened version."""

    spark: SparkSession
    snapshot: snapshots.Snapshot

    def __getattr__(self, name: str):
        if name in ("n", "tokens", "k1", "b", "tokenised"):
            return self.snapshot.properties[name]
        raise AttributeError(name)

    @property
    def avgdl(self) -> float:
        return self.tokens / self.n if self.n else 0.0

    @property
    def version(self) -> int:
        return self.snapshot.version

    def table(self, name: str) -> DataFrame:
        return self.snapshot.table(self.spark, name)


def _lists(sizes: Iterable[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)


def _flat(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _sizes(column: pa.ListArray) -> np.ndarray:
    return pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _tokenised(docs: DataFrame) -> DataFrame:
    """key, file, length, terms, tfs of docs (key, file, text)."""
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            lengths, sizes, terms, tfs = [], [], [], []
            for text in part.column(2).to_pylist():
                tokens = python_tokens(text)
                found = Counter(tokens)
                lengths.append(len(tokens)), sizes.append(len(found)), terms.extend(found), tfs.extend(found.values())
            columns = [part.column(0), part.column(1), pa.array(lengths, pa.int64()), _lists(sizes, pa.array(terms, pa.string())), _lists(sizes, pa.array(tfs, pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "file", "length", "terms", "tfs"])

    return docs.select("key", "file", "text").mapInArrow(run, f"key {kind}, file string, length long, terms array<string>, tfs array<int>")


def _fingerprints(docs: DataFrame) -> DataFrame:
    """file, fingerprint: equal if the file's rows are the same in any order (128 bits of hashes and their number)."""
    return docs.groupBy("file").agg(
        F.concat_ws(
            "-", F.count(F.lit(1)).cast("string"), F.hex(F.bit_xor(F.xxhash64("key", "text"))), F.sum(F.xxhash64(F.lit(11), "key", "text").cast("decimal(38,0)")).cast("string")
        ).alias("fingerprint")
    )


def _block(doc: Column) -> Column:
    return F.shiftright(doc, BLOCK_DOCS.bit_length() - 1)


def _numbered(rows: DataFrame, segment: int) -> DataFrame:
    """Documents in the order of their keys, numbered so: ties of scores within a segment go by number."""
    ordered = rows.repartitionByRange(F.col("key").asc_nulls_last()).sortWithinPartitions(F.col("key").asc_nulls_last())
    return ordered.select(F.lit(segment).alias("segment"), F.monotonically_increasing_id().alias("doc"), "key", "file", "length", "terms", "tfs")


POSTINGS = "segment int, block long, docs array<long>, lengths array<long>, terms array<string>, tops array<double>, ns array<int>, at array<int>, tfs array<int>"


def _postings(documents: DataFrame, avgdl: float, k1: float, b: float) -> DataFrame:
    shift = BLOCK_DOCS.bit_length() - 1

    def blocks(part: pa.RecordBatch) -> pa.RecordBatch:
        """Of rows (segment, doc, length, terms, tfs) of whole blocks."""
        doc, length, sizes = part.column(1).to_numpy(), part.column(2).to_numpy(), _sizes(part.column(3))
        block = doc >> shift
        begins = np.append(0, np.flatnonzero(np.diff(block)) + 1)
        held = np.diff(np.append(begins, len(doc)))  # documents of each block
        row, number = np.repeat(np.arange(len(doc)), sizes), np.repeat(np.arange(len(begins)), held)
        said, tf = part.column(3).flatten().dictionary_encode(), _flat(part.column(4)).astype(np.int64)
        code, n_terms = said.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(said.dictionary))
        gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / avgdl))
        each = number[row] * n_terms + code
        by = np.argsort(each, kind="stable")
        first = np.flatnonzero(np.diff(each[by], prepend=-1))
        term = each[by][first]
        sizes_of = lambda of, n: np.bincount(of, minlength=n)
        terms, postings = sizes_of(term // n_terms, len(begins)), sizes_of(number[row], len(begins))
        columns = [
            pa.array(part.column(0).to_numpy()[begins].astype(np.int32)), pa.array(block[begins]), _lists(held, pa.array(doc)), _lists(held, pa.array(length)),
            _lists(terms, said.dictionary.take(pa.array(term % n_terms))), _lists(terms, pa.array(np.maximum.reduceat(gain[by], first) if len(first) else np.zeros(0))),
            _lists(terms, pa.array(np.diff(np.append(first, len(by))).astype(np.int32))), _lists(postings, pa.array((row - begins[number[row]])[by].astype(np.int32))), _lists(postings, pa.array(tf[by].astype(np.int32))),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in POSTINGS.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in sliced(batches, 1024):
            if left is not None:
                batch = pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            block = batch.column(1).to_numpy() >> shift
            last = int(np.append(0, np.flatnonzero(np.diff(block)) + 1)[-1])  # the last block may go on in the next batch
            if last:
                yield blocks(batch.slice(0, last))
            left = batch.slice(last)
        if left is not None:
            yield blocks(left)

    return documents.where("key is not null").select("segment", "doc", "length", "terms", "tfs").mapInArrow(run, POSTINGS)


def _said(documents: DataFrame) -> DataFrame:
    """term, df of documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pc.value_counts(batch.column(0).flatten())
            yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], names=["term", "df"])

    return documents.select("terms").mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _sums(documents: DataFrame) -> tuple[int, int]:
    return tuple(documents.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first())


def _segment(spark: SparkSession, path: str, rows: DataFrame, segment: int, k1: float, b: float) -> tuple[DataFrame, dict[str, str], tuple[int, int], dict]:
    """Writes documents and postings of a segment: its documents, parts, (n, tokens), schemas."""
    numbered = _numbered(rows, segment)
    with long_rows(spark):
        own = snapshots.write_part(numbered, path, "documents")
        documents = snapshots.part_table(spark, path, own, numbered.schema)
        n, tokens = _sums(documents)
        held = _postings(documents, max(tokens, 1) / max(n, 1), k1, b)
        parts = {"documents": own, "postings": snapshots.write_part(held, path, "postings")}
    return documents, parts, (n, tokens), {"documents": numbered.schema, "postings": held.schema}


def update_lexical_index(
    docs: DataFrame, key: str, path: str, k1: float | None = None, b: float | None = None, text: str = "text", file: str | None = None, overwrite: bool = False
) -> LexicalIndex:
    """The index at ``path`` made to hold ``docs``: all of them at first (or with ``overwrite``), then the files that have changed.

    ``file``: the column of a document's file; without it each key is a file of its own. k1 and b are those of the first build.
    ``tokenised`` of the result is how many documents were tokenised.
    """
    spark = docs.sparkSession
    base = snapshots.opened(spark, path)
    old = None if overwrite else base
    k1, b = (old.properties["k1"], old.properties["b"]) if old and k1 is None and b is None else (K1 if k1 is None else k1, B if b is None else b)
    check_bm25(1, k1, b)
    if old and (k1, b) != (old.properties["k1"], old.properties["b"]):
        raise ValueError("the index was built with other parameters")
    own_file = F.coalesce(F.col(file or key).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), own_file.alias("file"), F.col(text).alias("text"))
    if old and old.schema("documents")["key"].dataType != rows.schema["key"].dataType:
        raise ValueError("the index was built with keys of another type")
    segment = (base.version if base else 0) + 1
    prints = _fingerprints(rows)
    files = snapshots.write_part(prints, path, "files")
    now = snapshots.part_table(spark, path, files, prints.schema)
    parts: dict[str, list[str]] = {n: list(old.parts[n]) if old else [] for n in ("documents", "postings", "terms", "dead")}
    n = tokens = 0
    terms_gone = None
    held: list[str] = []
    if old:
        before = old.table(spark, "files")
        both = now.select("file", F.col("fingerprint").alias("new")).join(before.select("file", F.col("fingerprint").alias("old")), "file", "full").where("not (new <=> old)")
        both = _kept(both, "changes", held)
        rows = rows.join(both.where("new is not null").select("file"), "file", "left_semi")
        gone = _living(LexicalIndex(spark, old)).join(both.where("old is not null").select("file"), "file", "left_semi")
        gone = _kept(gone.select("segment", "doc", "length", "terms"), "gone", held)
        gone_n, gone_tokens = _sums(gone)
        n, tokens = old.properties["n"] - gone_n, old.properties["tokens"] - gone_tokens
        if gone_n:
            listed = gone.groupBy("segment", _block(F.col("doc")).alias("block")).agg(F.collect_list("doc").alias("docs"))  # BLOCK_DOCS at most
            parts["dead"].append(snapshots.write_part(listed, path, "dead"))
            terms_gone = _said(gone).select("term", (-F.col("df")).alias("df"))
    tokenised = _kept(_tokenised(rows), "tokenised", held)  # putting the keys in order reads its rows twice
    documents, made, (added, said), schemas = _segment(spark, path, tokenised, segment, k1, b)
    if added:
        parts["documents"].append(made["documents"]), parts["postings"].append(made["postings"])
    terms = _said(documents) if terms_gone is None else _said(documents).unionByName(terms_gone).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
    if added or terms_gone is not None:
        with long_rows(spark):
            parts["terms"].append(snapshots.write_part(terms, path, "terms"))
    avgdls = dict(old.properties["avgdls"]) if old else {}
    avgdls[str(segment)] = max(said, 1) / max(added, 1)
    schemas |= {"terms": terms.schema, "dead": DEAD, "files": prints.schema}
    properties = {"n": n + added, "tokens": tokens + said, "k1": k1, "b": b, "tokenised": added, "avgdls": avgdls}
    committed = snapshots.commit(spark, base, path, {**parts, "files": [files]}, schemas, properties)
    for p in held:
        drop(spark, p)
    return LexicalIndex(spark, committed)




def write_lexical_index(docs: DataFrame, key: str, path: str, k1: float = K1, b: float = B, text: str = "text", file: str | None = None, overwrite: bool = False) -> LexicalIndex:
    """A first version of the index at ``path``; where there is one already it is an error, or with ``overwrite`` a new version of all."""
    if not overwrite and snapshots.versions(docs.sparkSession, path):
        raise FileExistsError(path)
    return update_lexical_index(docs, key, path, k1, b, text, file, overwrite)


def read_lexical_index(spark: SparkSession, path: str, version: int | None = None) -> LexicalIndex:
    """The last version of the index at ``path``, or the one asked for, with the parameters that it was built with."""
    found = snapshots.opened(spark, path, version)
    if found is None:
        raise FileNotFoundError(path)
    return LexicalIndex(spark, found)


def merge_due(index: LexicalIndex) -> bool:
    return len(index.snapshot.parts["documents"]) > PARTS


def merge_lexical_index(index: LexicalIndex) -> LexicalIndex:
    """A version with the same documents in one segment and nothing dead, from stored counts alone."""
    spark, base, path = index.spark, index.snapshot, index.snapshot.path
    segment = base.version + 1
    documents, made, (n, tokens), schemas = _segment(spark, path, _living(index).select("key", "file", "length", "terms", "tfs"), segment, index.k1, index.b)
    terms = _said(documents)
    with long_rows(spark):
        told = snapshots.write_part(terms, path, "terms")
    parts = {"documents": [made["documents"]], "postings": [made["postings"]], "terms": [told], "dead": [], "files": base.parts["files"]}
    schemas |= {"terms": terms.schema, "dead": DEAD, "files": base.schema("files")}
    properties = {**base.properties, "n": n, "tokens": tokens, "tokenised": 0, "avgdls": {str(segment): max(tokens, 1) / max(n, 1)}}
    return LexicalIndex(spark, snapshots.commit(spark, base, path, parts, schemas, properties))


def _kept(rows: DataFrame, label: str, held: list[str]) -> DataFrame:
    with long_rows(rows.sparkSession):
        table, path = materialise(rows, label)
    held.append(path)
    return table


def _living(index: LexicalIndex) -> DataFrame:
    dead = index.table("dead").select("segment", F.explode("docs").alias("doc"))
    documents = index.table("documents")
    return documents.join(dead, ["segment", "doc"], "left_anti") if index.snapshot.parts["dead"] else documents


def _gone(index: LexicalIndex) -> dict[int, dict[int, np.ndarray]]:
    """Of each segment and run of 2^RUN_BITS numbers with dead documents, which are dead: a bit a document, so that the rows of
    ``postings``, long lists, are neither shuffled nor sorted for them."""
    if not index.snapshot.parts["dead"]:
        return {}
    doc = F.explode("docs").alias("doc")
    runs = index.table("dead").select("segment", doc).groupBy("segment", F.shiftright("doc", RUN_BITS).alias("run"))
    out: dict[int, dict[int, np.ndarray]] = {}
    for r in runs.agg(F.bitmap_construct_agg(F.col("doc").bitwiseAND((1 << RUN_BITS) - 1)).alias("bits")).collect():
        out.setdefault(r["segment"], {})[r["run"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _dead(gone: dict[int, dict[int, np.ndarray]], segment: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which of some documents are dead."""
    out = np.zeros(len(doc), dtype=bool)
    for s in np.unique(segment):
        runs = gone.get(int(s), {})
        own = np.flatnonzero(segment == s) if runs else np.zeros(0, dtype=np.int64)
        for run in np.unique(doc[own] >> RUN_BITS):
            if (bits := runs.get(int(run))) is not None:
                at = own[doc[own] >> RUN_BITS == run]
                place = doc[at] & ((1 << RUN_BITS) - 1)
                out[at] = bits[place >> 3] >> (place & 7) & 1
    return out


class _Asked:
    """Queries of a set as weights by term: who says term t, and how much it counts for each. Sparse, so as large as the queries."""

    def __init__(self, counts: list[Counter], terms: list[str], idf: dict[int, float]):
        place = {t: i for i, t in enumerate(terms)}
        rows = sorted((place[t], q, n * idf.get(place[t], 0.0)) for q, c in enumerate(counts) for t, n in c.items())
        self.n = len(counts)
        self.query = np.array([r[1] for r in rows], dtype=np.int64)
        self.weight = np.array([r[2] for r in rows])
        self.first = np.searchsorted(np.array([r[0] for r in rows], dtype=np.int64), np.arange(len(terms) + 1))

    def of(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.first[t], self.first[t + 1])
        return self.query[own], self.weight[own]


def _most(batch: pa.RecordBatch, asked: _Asked, grown: dict[int, float]) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, blocks x queries): what a query can score at most in the blocks of some rows (segment, block, ts, tops, ...) of a batch."""
    step = max(1, CELLS // max(1, asked.n))
    segment = batch.column(0).to_numpy()
    factor = np.array([grown[s] for s in segment.tolist()])
    for start in range(0, batch.num_rows, step):
        part = batch.slice(start, step)
        row = np.repeat(np.arange(part.num_rows), _sizes(part.column(2)))
        t, top = _flat(part.column(2)), _flat(part.column(3))
        top = top * factor[start + row]
        out = np.zeros((part.num_rows, asked.n))
        by = np.argsort(t, kind="stable")
        ends = np.flatnonzero(np.diff(t[by])) + 1
        for at in np.split(by, ends) if len(by) else []:
            q, w = asked.of(int(t[at[0]]))
            out[np.ix_(row[at], q)] += top[at][:, None] * w
        yield start, out


def _promising(bounds: DataFrame, shared, m: int) -> DataFrame:
    """q, segment, block, most: of each query the m blocks of a task where it can score most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, grown, *_ = shared.value
        best = np.zeros((asked.n, 0))
        where = np.zeros((asked.n, 0, 2), dtype=np.int64)
        for batch in sliced(batches):
            place = np.stack([batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()], axis=1)
            for start, most in _most(batch, asked, grown):
                best = np.concatenate([best, most.T], axis=1)
                where = np.concatenate([where, np.broadcast_to(place[start : start + len(most)], (asked.n, len(most), 2))], axis=1)
                if best.shape[1] > m:
                    at = np.argpartition(-best, m - 1, axis=1)[:, :m]
                    best, where = np.take_along_axis(best, at, axis=1), np.take_along_axis(where, at[:, :, None], axis=1)
        q, i = np.nonzero(best > 0)
        found = where[q, i]
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(found[:, 0].astype(np.int32)), pa.array(found[:, 1]), pa.array(best[q, i])], names=["q", "segment", "block", "most"])

    return bounds.mapInArrow(run, "q int, segment int, block long, most double")


def _told_of(postings: DataFrame, terms) -> DataFrame:
    """segment, block, ts, tops, ns, at, tfs, docs, lengths: of each block what is said of asked terms, by their places in ``terms``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(terms.value, pa.string())
        for batch in sliced(batches):
            of = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            t = pc.index_in(of["terms"].flatten(), value_set=asked)
            good = np.flatnonzero(pc.is_valid(t).to_numpy(zero_copy_only=False))
            ns, row = _flat(of["ns"]), np.repeat(np.arange(batch.num_rows), _sizes(of["terms"]))[good]
            first, size = (np.cumsum(ns) - ns)[good], ns[good].astype(np.int64)
            each = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())  # places of their postings
            terms_of, postings_of = np.bincount(row, minlength=batch.num_rows), np.bincount(np.repeat(row, size), minlength=batch.num_rows)
            flat = {"ts": t.take(pa.array(good)).cast(pa.int32()), "tops": of["tops"].flatten().take(pa.array(good)), "ns": pa.array(size.astype(np.int32))}
            columns = [of["segment"], of["block"], *(_lists(terms_of, x) for x in flat.values()), *(_lists(postings_of, pa.array(_flat(of[x])[each])) for x in ("at", "tfs")), of["docs"], of["lengths"]]
            some = pa.array(np.flatnonzero(terms_of))
            yield pa.RecordBatch.from_arrays([c.take(some) for c in columns], names=["segment", "block", *flat, "at", "tfs", "docs", "lengths"])

    schema = "segment int, block long, ts array<int>, tops array<double>, ns array<int>, at array<int>, tfs array<int>, docs array<long>, lengths array<long>"
    return postings.select("segment", "block", "docs", "lengths", "terms", "tops", "ns", "at", "tfs").mapInArrow(run, schema)


def _best(batch: pa.RecordBatch, qs: np.ndarray, asked: _Asked, least: np.ndarray, gone: dict, index: tuple[float, float, float], k: int) -> Iterator[pa.RecordBatch]:
    """q, segment, doc, score: of each query of ``qs`` the k best living documents, ties included, of some blocks (segment, block, ts, tops,
    ns, at, tfs, docs, lengths). A block scores queries of its neighbours too."""
    k1, b, avgdl = index
    if not batch.num_rows or not len(qs):
        return
    column = np.full(asked.n, -1, dtype=np.int64)
    column[qs] = np.arange(len(qs))
    doc, length, tf = _flat(batch.column(7)), _flat(batch.column(8)).astype(float), _flat(batch.column(6)).astype(float)
    sizes = _sizes(batch.column(7))
    row = _flat(batch.column(5)) + np.repeat(np.cumsum(sizes) - sizes, _sizes(batch.column(5)))
    said = np.repeat(_flat(batch.column(2)), _flat(batch.column(4)))
    gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / avgdl))
    score = np.zeros((len(doc), len(qs)))
    by = np.argsort(said, kind="stable")
    for at in np.split(by, np.flatnonzero(np.diff(said[by])) + 1) if len(by) else []:
        q, w = asked.of(int(said[at[0]]))
        q = column[q]
        if len(own := np.flatnonzero(q >= 0)):
            score[np.ix_(row[at], q[own])] += gain[at][:, None] * w[own]
    score = np.round(score, 6)
    segment = np.repeat(batch.column(0).to_numpy(), sizes)
    score[_dead(gone, segment, doc)] = 0
    good = (score > 0) & (score >= least[qs])
    for s in np.unique(segment):
        own = np.flatnonzero(segment == s)
        if len(own) > k:
            good[own] &= score[own] >= np.partition(score[own], len(own) - k, axis=0)[len(own) - k]  # ties of the k-th stay
    i, j = np.nonzero(good)
    yield pa.RecordBatch.from_arrays([pa.array(qs[j].astype(np.int32)), pa.array(segment[i].astype(np.int32)), pa.array(doc[i]), pa.array(score[i, j])], names=["q", "segment", "doc", "score"])


def _together(asked: _Asked) -> int:
    """Blocks that are scored at a time."""
    return max(1, CELLS // (BLOCK_DOCS * max(1, asked.n)))


def _scored(blocks: DataFrame, shared, index: LexicalIndex, k: int) -> DataFrame:
    """q, segment, doc, score: the k best documents of each query in blocks that name the queries to score (``qs``, the last column)."""
    told = index.k1, index.b, index.avgdl

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, _, least, gone = shared.value
        for part in sliced(batches, min(512, _together(asked))):
            yield from _best(part, np.unique(_flat(part.column(9))), asked, least, gone, told, k)

    return blocks.mapInArrow(run, "q int, segment int, doc long, score double")


def _reached(most: np.ndarray, least: np.ndarray) -> np.ndarray:
    return (most > 0) & (most * (1 + 1e-9) + SLACK >= least)


def _reaching(blocks: DataFrame, shared, index: LexicalIndex, k: int) -> DataFrame:
    """What ``_scored`` gives, of the blocks where a query can reach its threshold."""
    told = index.k1, index.b, index.avgdl

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, grown, least, gone = shared.value
        for batch in sliced(batches):
            for start, most in _most(batch, asked, grown):
                reach = _reached(most, least)
                rows = np.flatnonzero(reach.any(axis=1))
                for first in range(0, len(rows), _together(asked)):
                    own = rows[first : first + _together(asked)]
                    yield from _best(batch.take(pa.array(start + own)), np.flatnonzero(reach[own].any(axis=0)), asked, least, gone, told, k)

    return blocks.mapInArrow(run, "q int, segment int, doc long, score double")


def _tell(told: dict, blocks: DataFrame, shared) -> None:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, grown, least, _ = shared.value
        says = np.diff(asked.first)
        postings = read = gains = made = 0
        for batch in sliced(batches):
            for start, most in _most(batch, asked, grown):
                reach = _reached(most, least)
                part = batch.slice(start, len(most))
                for own, ts, ns in zip(reach, part.column(2), part.column(4)):
                    t, n = ts.values.to_numpy(), ns.values.to_numpy().astype(np.int64)
                    users = np.array([own[asked.of(x)[0]].sum() for x in t.tolist()])
                    postings, gains = postings + n.sum(), gains + (n * says[t]).sum()
                    read, made = read + n[users > 0].sum(), made + (n * users).sum()
        yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in (postings, read, gains, made)], names=["postings", "read", "gains", "made"])

    found = blocks.mapInArrow(run, "postings long, read long, gains long, made long")
    for name, value in found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in found.columns)).first().asDict().items():
        told[name] = told.get(name, 0) + value


def search_lexical_index(queries: DataFrame, index: LexicalIndex, query: str, key: str, k: int = 5, query_text: str = "text", told: dict | None = None) -> DataFrame:
    """query, key, score, rank, the same as ``bm25_search`` gives over the index's documents. See the module.

    Runs the search and returns its written result, which ``quern.session.clear`` removes. ``told`` gets sums over query sets:
    ``postings`` (of the queries' terms), ``read`` (of those, the scored ones), and, counting a posting once for each query that says its
    term, ``gains`` (all) and ``made`` (in blocks where that query can reach its threshold).
    """
    check_bm25(k, index.k1, index.b)
    spark, out = index.spark, None
    gone = _gone(index)
    key_type = index.snapshot.schema("documents")["key"].dataType.simpleString()
    query_type = queries.schema[query].dataType.simpleString()
    for ids, counts in query_sets(queries, query, query_text):
        held: list[str] = []
        terms = sorted({t for c in counts for t in c})
        asked = spark.createDataFrame(pa.table({"t": pa.array(range(len(terms)), pa.int32()), "term": pa.array(terms, pa.string())}), "t int, term string")  # of a query set at most
        df = index.table("terms").join(F.broadcast(asked), "term").groupBy("t").agg(F.sum("df").alias("df"))
        idf = {r["t"]: float(np.log(1 + (index.n - r["df"] + 0.5) / (r["df"] + 0.5))) for r in df.collect()}
        own = _Asked(counts, terms, idf)
        grown = {int(s): max(1.0, index.avgdl / a) for s, a in index.snapshot.properties["avgdls"].items()}  # tops are of the mean length at the build
        blocks = _kept(_told_of(index.table("postings"), spark.sparkContext.broadcast(terms)), "blocks", held)
        bounds = blocks.select("segment", "block", "ts", "tops")
        shared = spark.sparkContext.broadcast((own, grown, np.zeros(own.n), gone))
        first = ranked(_promising(bounds, shared, FIRST_BLOCKS), "q", [F.desc("most"), F.asc("segment"), F.asc("block")], FIRST_BLOCKS)
        first = first.groupBy("segment", "block").agg(F.array_sort(F.collect_set(F.col("q").cast("long"))).alias("qs"))  # a query set at most
        first = _kept(blocks.join(F.broadcast(first), ["segment", "block"]), "promising", held)  # FIRST_BLOCKS rows a query at most
        best = ranked(_scored(first, shared, index, k), "q", [F.desc("score"), F.asc("segment"), F.asc("doc")], k)
        least = np.zeros(own.n)
        with long_rows(spark):
            for r in best.where(F.col("rank") == k).select("q", "score").collect():  # a row a query
                least[r["q"]] = r["score"]
        limited = spark.sparkContext.broadcast((own, grown, least, gone))
        hits = _kept(ranked(_reaching(blocks, limited, index, k), ["q", "segment"], [F.desc("score"), F.asc("doc")], k).drop("rank"), "hits", held)
        if told is not None:
            with long_rows(spark):
                _tell(told, blocks, limited)
        keyed = hits.join(index.table("documents").select("segment", "doc", "key"), ["segment", "doc"])
        named = spark.createDataFrame(list(enumerate(ids)), f"q int, id {query_type}")
        part = keyed.join(named, "q").select(F.col("id").alias(query), F.col("key").alias(key), "score")
        part = materialise(part, "found")[0]
        for p in held:
            drop(spark, p)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"`{query}` {query_type}, `{key}` {key_type}, score double, rank long")
    return ranked(out, query, [F.desc("score"), F.asc(key)], k)
