"""One search call for many queries: rewriting, two gates, two retrievals, fusion, reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import token_bag
from quern.operators import lexical_index, providers, retrieval
from quern.session import written

# Hits that are shown, recalled for the reranker, and retrieved by each method, and the largest number shown.
TOP_K, RECALL_K, RETRIEVAL_K, MOST = 5, 20, 30, 10


def chained_ks(top_k: int = TOP_K, recall_k: int = RECALL_K, retrieval_k: int = RETRIEVAL_K) -> tuple[int, int, int]:
    """The three numbers, if each is at least the one before it and the first between 1 and MOST."""
    if isinstance(top_k, bool) or not isinstance(top_k, int) or not 1 <= top_k <= MOST:
        raise ValueError(f"top_k must be between 1 and {MOST}")
    if recall_k < top_k:
        raise ValueError("recall_k must be at least top_k")
    if retrieval_k < recall_k:
        raise ValueError("retrieval_k must be at least recall_k")
    return top_k, recall_k, retrieval_k


def adapted_ks(top_k: int, candidates: int = RECALL_K) -> tuple[int, int, int]:
    """Numbers for a caller that names what it shows and, maybe, its candidates."""
    if candidates < top_k:
        raise ValueError("candidates must be at least top_k")
    recall = max(4 * top_k, RECALL_K)
    return chained_ks(top_k, recall, max(candidates, recall, RETRIEVAL_K))


def search(
    queries: DataFrame,
    passages: DataFrame,
    vectors: DataFrame,
    query: str,
    key: str,
    ks: tuple[int, int, int] = (TOP_K, RECALL_K, RETRIEVAL_K),
    threshold: float | None = None,
    index: lexical_index.LexicalIndex | None = None,
    query_vectors: DataFrame | None = None,
    embedder: providers.Embedder | None = None,
    scorer: providers.Scorer | None = None,
    rewritten: DataFrame | None = None,
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(hits, told): the best passages of each query, and a row per query that says which way it went.

    queries: query, text; passages: key, text; vectors: key, embedding of passages; query_vectors: query, embedding (else the
    embedder makes them). ``rewritten`` has the columns that ``providers.rewrite`` gives; without it the rules rewrite. A query
    that needs no search, or whose best similarity is below ``threshold``, has no hits and a reason. ``index``: a stored
    lexical index of the passages (else their texts are read once). ``scorer`` scores pairs of texts (else the share of the
    query's tokens that a passage holds); a score that is missing keeps the recalled order.

    The corpus is searched while this runs, once by each method; what the two results read are written tables of at most
    retrieval_k rows a query, which ``quern.session.clear`` removes.

    hits: query, key, pre_rerank_rank, reranker_rank, reranker_score, rank_change, reranker_status, rrf_score, dense_rank,
    dense_score, bm25_rank, bm25_score, matched_by. told: query, intent, rewrite_source, top1, reason, hits.
    """
    top_k, recall_k, retrieval_k = chained_ks(*ks)
    asked = rewritten if rewritten is not None else providers.rewrite_by_rules(queries.select(query, text), text)
    wanted = asked.where("should_search")
    own = query_vectors
    if own is None:
        own = providers.embed(wanted.select(query, F.col("semantic_query").alias("t")), "t", embedder, prefix="query: ").select(query, "embedding")
    dense = retrieval.dense_search(own.join(wanted.select(query), query, "left_semi"), vectors, query, key, retrieval_k)
    dense = written(dense, "dense")  # retrieval_k rows a query, read by the gate and by the fusion
    gate = retrieval.soft_gate(wanted, dense, query, threshold)
    passed = gate.where("not skipped").select(query)
    said = wanted.join(passed, query, "left_semi").select(query, F.col("keyword_query").alias("t"))
    if index is not None:
        lexical = lexical_index.search_lexical_index(said, index, query, key, retrieval_k, query_text="t")
    else:
        lexical = retrieval.bm25_search(said, passages, query, key, retrieval_k, query_text="t", text=text)
    fused = retrieval.fuse(dense.join(passed, query, "left_semi"), lexical, query, key, recall_k)
    fused = written(fused, "fused")
    pairs = fused.join(asked.select(query, F.col("semantic_query").alias("_q")), query).join(passages.select(key, F.col(text).alias("_p")), key, "left")
    if scorer is not None:
        scored = providers.cross_score(pairs, "_q", "_p", scorer)
    else:
        share = retrieval.overlap_score(token_bag(F.col("_q")), token_bag(F.col("_p")))
        scored = pairs.withColumn("reranker_score", F.when(F.col("_p").isNotNull(), share))
    best = retrieval.rerank(scored.select(query, key, "rrf_score", "rank", "reranker_score"), query, key, top_k)
    hits = written(best.join(fused.drop("rank"), [query, key]), "hits")
    counts = hits.groupBy(query).agg(F.count(F.lit(1)).alias("hits"))
    reason = F.when(~F.col("should_search"), "no_search_needed").when(F.col("skipped"), "below_threshold").when(F.col("hits").isNull(), "no_hits")
    told = asked.join(gate, query, "left").join(counts, query, "left").select(
        query, "intent", "rewrite_source", "top1", reason.alias("reason"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits")
    )
    return hits, told
