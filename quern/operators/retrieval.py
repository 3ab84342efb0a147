"""Lexical and dense retrieval for many queries at once, fusion, gating and reranking."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.functions.text import token_bag
from quern.session import sliced, written

K1, B, RRF_K = 1.5, 0.75, 60
QUERY_BLOCK, LEXICAL_BLOCK = 4096, 1024  # query vectors, and query texts, scored at a time
DENSE_CELLS = 500_000  # scores of vectors that a task computes at a time
QUERY_SET, BLOCK_BYTES = 20_000, 64_000_000  # query texts that a scan serves; weights of a block of them in a task


def document_lengths(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return docs.select(key, F.size(token_bag(F.col(text))).cast("long").alias("length"))


def postings(docs: DataFrame, key: str, text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """term, key, tf, length. With ``terms`` (one column, term) only those terms are counted, and shuffled."""
    tokens = docs.select(key, token_bag(F.col(text)).alias("t"))
    rows = tokens.select(key, F.size("t").cast("long").alias("length"), F.explode("t").alias("term"))
    if terms is not None:
        rows = rows.join(terms, "term", "left_semi")
    return rows.groupBy("term", key, "length").agg(F.count(F.lit(1)).alias("tf"))


def collection_stats(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row: n documents and their average length."""
    return document_lengths(docs, key, text).agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def term_stats(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """term, total tf, document frequency, idf; a row per term.

    One shuffle of partial sums by term: a document adds its tokens and its distinct tokens, never (term, document) rows.
    """
    one = lambda x, tf, df: F.struct(x.alias("term"), F.lit(tf).alias("tf"), F.lit(df).alias("df"))
    counted = F.concat(F.transform("t", lambda x: one(x, 1, 0)), F.transform(F.array_distinct("t"), lambda x: one(x, 0, 1)))
    tokens = docs.select(token_bag(F.col(text)).alias("t"))
    sums = tokens.select(F.inline(counted)).groupBy("term").agg(F.sum("tf").alias("total_tf"), F.sum("df").alias("df"))
    return sums.crossJoin(F.broadcast(collection_stats(docs, key, text))).select(  # the other side is one row
        "term", "total_tf", "df", F.round(idf(F.col("n"), F.col("df")), 6).alias("idf"), "n", F.round("avgdl", 6).alias("avgdl")
    )


def ranked(rows: DataFrame, query: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each query; Spark keeps k of each on the map side."""
    w = Window.partitionBy(query).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= k)


def _lower(text: str) -> str:
    """A to Z lower-cased, nothing else."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


_IDENTIFIER, _PART = re.compile("[a-z][a-z0-9_]*|[0-9]+"), re.compile("[a-z]+|[0-9]+")
_HUMP, _IDEOGRAPHS = re.compile("([a-z0-9])([A-Z])"), re.compile("[\u4e00-\u9fff]+")


def python_tokens(text: str | None) -> list[str]:
    """The tokens of ``token_bag`` in Arrow batches."""
    if not text:
        return []
    out = _IDENTIFIER.findall(_lower(text))
    out += _PART.findall(_lower(_HUMP.sub(r"\1 \2", text.replace("_", " "))))
    if not text.isascii():
        for run in _IDEOGRAPHS.findall(text):
            out += run
            out += [run[i : i + 2] for i in range(len(run) - 1)]
    return out


_WORD, WORDS, WORD_CHARS = re.compile("[A-Za-z][A-Za-z0-9_]*|[0-9]+"), 100_000, 64  # words whose tokens a task remembers, and their length


class _Said(dict):
    """The tokens of words, and of runs of ideographs, joined by blanks."""

    def __missing__(self, word: str) -> str:
        tokens = " ".join(python_tokens(word))
        if len(word) <= WORD_CHARS:
            if len(self) >= WORDS:
                self.clear()
            self[word] = tokens
        return tokens


def token_texts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, tokens, n_tokens: the tokens of ``code_tokens`` in their order, joined by blanks. A word is split once while a task remembers it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = _Said()
        for batch in sliced(batches):
            words = ([] if not t else _WORD.findall(t) if t.isascii() else _WORD.findall(t) + _IDEOGRAPHS.findall(t) for t in batch.column(1).to_pylist())
            tokens = [" ".join([said[w] for w in own]) for own in words]
            counts = [t.count(" ") + 1 if t else 0 for t in tokens]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.string()), pa.array(counts, pa.int64())], names=["key", "tokens", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), text).mapInArrow(run, f"key {kind}, tokens string, n_tokens long").withColumnRenamed("key", key)


def query_sets(queries: DataFrame, query: str, query_text: str) -> Iterator[tuple[list, list[Counter]]]:
    """Ids and token counts of QUERY_SET queries at a time."""
    sets = max(1, -(-queries.count() // QUERY_SET))
    for number in range(sets):
        own = queries if sets == 1 else queries.where(F.pmod(F.xxhash64(query, query_text), F.lit(sets)) == number)
        rows = own.select(query, query_text).collect()
        yield [r[0] for r in rows], [Counter(python_tokens(r[1])) for r in rows]


def _blocks(counts: list[Counter]) -> Iterator[tuple[int, int, dict[str, int]]]:
    """(first, last + 1, places of its terms) of runs of queries whose weights take BLOCK_BYTES at most, or that are one query."""
    first, terms = 0, {}
    for i, c in enumerate(counts):
        new = {t for t in c if t not in terms}
        if i > first and ((len(terms) + len(new)) * (i + 1 - first) * 8 > BLOCK_BYTES or i - first == LEXICAL_BLOCK):
            yield first, i, terms
            first, terms, new = i, {}, set(c)
        for t in sorted(new):
            terms[t] = len(terms)
    if counts:
        yield first, len(counts), terms


def _sparse(ids: list, counts: list[Counter], terms: dict[str, int], idf_of: dict[str, float]) -> tuple:
    """Of a block of queries: ids, the terms that they say, and (place of a term, place of a query, weight) of each that a query says: how
    often, times the term's idf. As large as the queries."""
    own = np.array(sorted({terms[t] for c in counts for t in c}), dtype=np.int64)
    rows = [(terms[t], q, n * idf_of.get(t, 0.0)) for q, c in enumerate(counts) for t, n in c.items()]
    said, q, w = (np.array(x) for x in zip(*rows)) if rows else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
    return ids, own, np.searchsorted(own, said), q, w


def _keep_best(best: list[list[tuple]], score: np.ndarray, keys: list, k: int) -> None:
    """Adds rows (documents x queries) of positive scores to the k best (-score, key) of each query."""
    for q in range(score.shape[1]):
        column = score[:, q]
        least = -best[q][-1][0] if len(best[q]) == k else 0.0
        rows = np.flatnonzero((column >= least) & (column > 0))
        if len(rows) > 4 * k:
            rows = rows[column[rows] >= np.partition(column[rows], len(rows) - k)[len(rows) - k]]
        if len(rows):
            best[q] = sorted([*best[q], *((-column[d], keys[d]) for d in rows.tolist())])[:k]


def _best_rows(ids: list, best: list[list[tuple]], names: list[str], kinds: tuple[pa.DataType, pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*((ids[q], d, float(-s)) for q, found in enumerate(best) for s, d in found))) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*kinds, pa.float64()))], names=names)


def check_bm25(k: int, k1: float, b: float) -> None:
    if k < 1 or k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("k must be positive, k1 positive and b between 0 and 1")


def bm25_search(queries: DataFrame, docs: DataFrame, query: str, key: str, k: int = 5, k1: float = K1, b: float = B, query_text: str = "text", text: str = "text") -> DataFrame:
    """query, key, score, rank without an index. Every occurrence of a query token counts.

    The documents' texts are read once for QUERY_SET queries: what is kept of each is its length and how often it holds the
    queries' terms, in a written table that gives the statistics and is scored in blocks, as matrix products of which each
    task lets only its k best rows a query leave. So the shuffle doesn't grow with documents times queries.
    """
    check_bm25(k, k1, b)
    kinds = tuple(to_arrow_type(d.schema[c].dataType) for d, c in ((queries, query), (docs, key)))
    kind, query_kind = docs.schema[key].dataType.simpleString(), queries.schema[query].dataType.simpleString()
    spark, out = docs.sparkSession, None
    for ids, counts in query_sets(queries, query, query_text):
        terms = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
        sent = spark.sparkContext.broadcast(terms)

        def count(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in sliced(batches):
                lengths, at, tf = [], [], []
                for value in batch.column(1).to_pylist():
                    tokens = python_tokens(value)
                    found = [(i, n) for t, n in Counter(tokens).items() if (i := own.get(t)) is not None]
                    lengths.append(len(tokens)), at.append([i for i, _ in found]), tf.append([n for _, n in found])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(lengths, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))], names=["k", "length", "at", "tf"]
                )

        counted = docs.select(F.col(key).alias("k"), text).mapInArrow(count, f"k {kind}, length long, at array<int>, tf array<int>")
        counted = written(counted, "term-counts")
        n, avgdl = counted.agg(F.count(F.lit(1)), F.avg("length")).first()
        df = {r["i"]: r["n"] for r in counted.select(F.explode("at").alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}  # terms of the queries
        idf_of = {t: float(np.log(1 + (n - df.get(i, 0) + 0.5) / (df.get(i, 0) + 0.5))) for t, i in terms.items()}
        shared = spark.sparkContext.broadcast(([_sparse(ids[i:j], counts[i:j], terms, idf_of) for i, j, _ in _blocks(counts)], avgdl))

        def score(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            blocks, avgdl = shared.value
            best: list[list[list[tuple]]] = [[[] for _ in asked] for asked, *_ in blocks]
            for batch in batches:
                for start in range(0, batch.num_rows, 1024):
                    part = batch.slice(start, 1024)
                    sizes = np.array([len(x) for x in part.column(2)], dtype=np.int64)
                    at, tf = (part.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
                    row, keys = np.repeat(np.arange(part.num_rows), sizes), part.column(0).to_pylist()
                    norm = k1 * (1 - b + b * part.column(1).to_numpy().astype(float) / avgdl)
                    gain = tf * (k1 + 1) / (tf + norm[row])
                    for found, (asked, own, t, q, w) in zip(best, blocks):
                        place = np.minimum(np.searchsorted(own, at), len(own) - 1)
                        said = own[place] == at if len(own) else np.zeros(len(at), dtype=bool)
                        if not said.any():
                            continue
                        used, column = np.unique(place[said], return_inverse=True)
                        x = np.zeros((part.num_rows, len(used)))
                        x[row[said], column] = gain[said]
                        of = np.minimum(np.searchsorted(used, t), len(used) - 1)
                        held = used[of] == t
                        weight = np.zeros((len(used), len(asked)))  # BLOCK_BYTES at most
                        weight[of[held], q[held]] = w[held]
                        _keep_best(found, np.round(x @ weight, 6), keys, k)
            for found, (asked, *_) in zip(best, blocks):
                yield _best_rows(asked, found, [query, key, "score"], kinds)

        part = counted.where("k is not null and size(at) > 0").mapInArrow(score, f"`{query}` {query_kind}, `{key}` {kind}, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], f"`{query}` {query_kind}, `{key}` {kind}, score double")
    return ranked(out, query, [F.desc("score"), F.asc(key)], k)


def normalise(vector: Column) -> Column:
    double = F.transform(vector, lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(double, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(size > 0, F.transform(double, lambda x: x / size)).otherwise(double)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_search(queries: DataFrame, items: DataFrame, query: str, key: str, k: int = 5, vector: str = "embedding", exclude_same: bool = False) -> DataFrame:
    """query, key, score, rank by exact cosine similarity of unit vectors.

    Queries go out in blocks of bounded size; slices of the items of DENSE_CELLS scores at most are matrix products, and only a task's
    k best for each query leave the executor.
    """
    spark = items.sparkSession
    total = queries.count()
    kind = items.schema[key].dataType.simpleString()
    query_kind = queries.schema[query].dataType.simpleString()
    types = [to_arrow_type(queries.schema[query].dataType), to_arrow_type(items.schema[key].dataType), pa.float64()]
    out = None
    for block in range(max(1, -(-total // QUERY_BLOCK))):
        own = queries if total <= QUERY_BLOCK else queries.where(F.pmod(F.xxhash64(query), F.lit(-(-total // QUERY_BLOCK))) == block)
        rows = [(r[0], r[1]) for r in own.select(query, vector).where(F.col(vector).isNotNull()).collect()]
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64)))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            best = None  # keys and scores of each query's best so far, by score, then key
            step = max(1, DENSE_CELLS // max(1, len(ids)))
            for batch in batches:
                for part in sliced([batch], step) if len(ids) else ():
                    keys = np.array(part.column(0).to_pylist(), dtype=np.int64 if pa.types.is_integer(types[1]) else object)
                    vectors = np.array(part.column(1).to_pylist(), dtype=np.float64)
                    score = np.round(matrix @ vectors.T, 6) + 0.0
                    order = np.argsort(keys, kind="stable")
                    at = order[np.argsort(-score[:, order], axis=1, kind="stable")[:, : k + exclude_same]]
                    new = keys[at], np.take_along_axis(score, at, axis=1)
                    if best is not None:
                        names, scores = (np.concatenate(pair, axis=1) for pair in zip(best, new))
                        order = np.argsort(names, axis=1, kind="stable")
                        by = np.argsort(-np.take_along_axis(scores, order, axis=1), axis=1, kind="stable")[:, : k + exclude_same]
                        at = np.take_along_axis(order, by, axis=1)
                        new = np.take_along_axis(names, at, axis=1), np.take_along_axis(scores, at, axis=1)
                    best = new
            if best is not None:
                picked = [(q, d, s) for q, own, of in zip(ids, best[0].tolist(), best[1].tolist()) for d, s in zip(own, of) if not (exclude_same and q == d)]
                cols = list(zip(*picked)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[query, key, "score"])

        read = items.select(F.col(key), F.col(vector)).where(F.col(key).isNotNull() & F.col(vector).isNotNull())
        part = read.mapInArrow(run, f"`{query}` {query_kind}, `{key}` {kind}, score double")
        out = part if out is None else out.unionByName(part)
    return ranked(out, query, [F.desc("score"), F.asc(key)], k)


def fuse(dense: DataFrame, lexical: DataFrame, query: str, key: str, k: int = 5, rrf_k: int = RRF_K, dense_weight: float = 1.0, lexical_weight: float = 1.0, by_sources: bool = False) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query, key, score, rank): one full join, both sides dealt by query already.

    Ties: rows of the dense list first, then of the lexical list, each by rank; ``by_sources``: by number of lists.
    """
    of = lambda rows, name: rows.select(query, key, F.col("rank").alias(f"{name}_rank"), F.col("score").alias(f"{name}_score"))
    term = lambda weight, name: F.coalesce(weight / (rrf_k + F.col(f"{name}_rank")), F.lit(0.0))
    both = of(dense, "dense").join(of(lexical, "bm25"), [query, key], "full")
    score = F.round(term(F.lit(dense_weight), "dense") + term(F.lit(lexical_weight), "bm25"), 9)
    fused = both.select(query, key, score.alias("rrf_score"), "dense_rank", "dense_score", "bm25_rank", "bm25_score")
    matched = F.concat_ws(",", F.when(F.col("dense_rank").isNotNull(), "dense"), F.when(F.col("bm25_rank").isNotNull(), "bm25"))
    fused = fused.withColumn("matched_by", matched)
    has = [F.col("dense_rank").isNotNull(), F.col("bm25_rank").isNotNull()]
    first = [F.desc(F.size(F.split("matched_by", ",")))] if by_sources else [c.desc() for c in has]
    order = [F.desc("rrf_score"), *first, F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"), F.asc(key)]
    return ranked(fused, query, order, k)


def soft_gate(queries: DataFrame, dense: DataFrame, query: str, threshold: float | None) -> DataFrame:
    """query, top1 (best dense similarity), skipped. Without a threshold nothing is skipped."""
    top = dense.groupBy(query).agg(F.max("score").alias("top1"))
    skipped = F.coalesce(F.col("top1") < threshold, F.lit(True)) if threshold is not None else F.lit(False)
    return queries.select(query).distinct().join(top, query, "left").select(query, "top1", skipped.alias("skipped"))


def overlap_score(query_tokens: Column, tokens: Column) -> Column:
    """Share of the query's distinct tokens that the passage holds: the local stand-in for a cross-encoder."""
    asked = F.array_distinct(query_tokens)
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(asked, tokens)), F.size(asked)), F.lit(0.0)), 6)


def rerank(recalled: DataFrame, query: str, key: str, final_k: int = 5) -> DataFrame:
    """Recalled rows (query, key, rrf_score, rank, reranker_score) by reranker score; a null score falls back to recall order."""
    order = [F.desc_nulls_last("reranker_score"), F.desc("rrf_score"), F.asc("rank"), F.asc(key)]
    best = ranked(recalled.withColumnRenamed("rank", "pre_rerank_rank").withColumn("rank", F.col("pre_rerank_rank")), query, order, final_k, "reranker_rank")
    return best.select(
        query, key, "pre_rerank_rank", "reranker_rank", "reranker_score",
        (F.col("pre_rerank_rank") - F.col("reranker_rank")).alias("rank_change"),
        F.when(F.col("reranker_score").isNull(), "fallback").otherwise("scored").alias("reranker_status"),
    )
