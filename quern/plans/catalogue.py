"""Every query by name, with the SQL that should give the same rows. Each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import batches, corpus, curation, dense_index, diagnosis, evaluation, evidence, gram_index, lexical_index, matching, projections, providers, retrieval, search, sessions, static_analysis
from quern.plans import samples
from quern.session import scratch, spread
from quern.session import table as read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = read_table(spark, sf_dir, name)
    return spread(rows) if name == "documents" else rows  # its queries are heavy on expressions


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


LINES = "case when coalesce(text, '') = '' then [] else string_split(case when ends_with(text, chr(10)) then left(text, length(text) - 1) else text end, chr(10)) end"
COUNT = "coalesce(length(text) - length(replace(text, chr(10), '')) + case when length(text) > 0 and not ends_with(text, chr(10)) then 1 else 0 end, 0)"


@query(f"""
select source, lang, count(*) as files, cast(sum({COUNT}) as bigint) as total_lines,
  cast(sum(coalesce(length(text), 0)) as bigint) as total_chars
from documents group by grouping sets ((source), (source, lang))""")
def corpus_stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.repository_stats(table(spark, sf_dir, "documents"), "source", "lang")


def _windows(lines: int, overlap: int) -> str:
    return f"""
with d as (select doc_id, {LINES} as lines from documents),
s as (select doc_id, lines, unnest(range(0, greatest(len(lines) - {overlap} - 1, 0) + 1, {lines - overlap})) as s from d where len(lines) > 0)
select doc_id, s + 1 as start_line, least(s + {lines}, len(lines)) as end_line,
  length(array_to_string(lines[s + 1 : s + {lines}], chr(10))) as n_chars, md5(array_to_string(lines[s + 1 : s + {lines}], chr(10))) as content_md5
from s"""


def _windowed(spark: SparkSession, sf_dir: str, lines: int, overlap: int) -> DataFrame:
    rows = corpus.line_windows(table(spark, sf_dir, "documents"), "doc_id", chunk_lines=lines, overlap=overlap)
    return rows.select("doc_id", "start_line", "end_line", F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("content_md5"))


@query(_windows(20, 5))
def line_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windowed(spark, sf_dir, 20, 5)


@query(_windows(80, 10))
def line_window_chunks_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windowed(spark, sf_dir, 80, 10)


@query(f"""
with d as (select doc_id, {LINES} as lines from documents)
select doc_id, cast(case when len(lines) = 0 then 0 else 3 end as bigint) as start_line,
  cast(case when len(lines) = 0 then 0 else least(len(lines), 7) end as bigint) as end_line, cast(len(lines) as bigint) as total_lines,
  coalesce(array_to_string(lines[3:7], chr(10)), '') as content
from d""")
def file_slice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.file_slices(table(spark, sf_dir, "documents"), "doc_id", 3, 7)


@query(f"""
with d as (select doc_id, {LINES} as lines from documents where contains(lower(text), 'token =')),
h as (select doc_id, lines, unnest(range(len(lines))) as i from d),
k as (select *, greatest(i - 1, 0) as a, least(i + 1, len(lines) - 1) as b from h where contains(lower(lines[i + 1]), 'token ='))
select doc_id, i + 1 as line, a + 1 as start_line, b + 1 as end_line, cast(len(lines) as bigint) as total_lines,
  array_to_string(list_transform(range(a, b + 1), lambda j: case when j = i then '> ' else '  ' end || lines[j + 1]), chr(10)) as content
from k order by doc_id, line limit 50""")
def grep_with_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.grep(table(spark, sf_dir, "documents"), "doc_id", "TOKEN =", context=1, limit=50)


FILES_SQL = """
files as (select doc_id, case source when 'src0' then 'data' when 'src1' then 'Logs' when 'src2' then 'api/Training' else source end || '/' || doc_id ||
  case lang when 'en' then '.py' when 'de' then '.md' when 'fr' then '.txt' else '.JSON' end as file, text from documents)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.when(F.col("source") == "src0", "data").when(F.col("source") == "src1", "Logs").when(F.col("source") == "src2", "api/Training").otherwise(F.col("source"))
    kind = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "de", ".md").when(F.col("lang") == "fr", ".txt").otherwise(".JSON")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(place, F.lit("/"), F.col("doc_id").cast("string"), kind).alias("file"), "text")


IGNORED_SQL = "[" + ", ".join(f"'{d}'" for d in corpus.IGNORED_DIRECTORIES) + "]"


@query(f"""
with {FILES_SQL}, p as (
  select file, 'File: ' || file || chr(10) || 'Type: text' || chr(10) || 'Name: module' || chr(10) || 'Code:' || chr(10) || text as passage,
    'File: ' || file || chr(10) || 'Lines: 1-80' || chr(10) || 'Type: text' || chr(10) || 'Name: module' || chr(10) || 'Code:' || chr(10) ||
      case when length(text) > 8000 then left(text, 8000) || chr(10) || '...truncated...' else text end as reranked,
    case when length(text) > 12000 then left(text, 12000) || chr(10) || '...truncated...' else text end as cut
  from files where lower(regexp_extract(file, '(\\.[^./]+)$', 1)) in ('.py', '.md', '.json', '.yaml', '.yml', '.toml')
    and not list_has_any(list_transform(string_split(file, '/'), lambda x: lower(x)), {IGNORED_SQL}) and regexp_matches(text, '\\S'))
select file, md5(passage) as lexical_md5, md5('passage: ' || passage) as dense_md5, md5(reranked) as rerank_md5, length(reranked) as rerank_chars, length(cut) as cut_chars from p""")
def indexable_filter_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir).where(corpus.indexable(F.col("file"), F.col("text")))
    file, kind, name, content = F.col("file"), F.lit("text"), F.lit(""), F.col("text")
    reranked = corpus.rerank_passage(file, kind, name, F.lit(1), F.lit(80), content)
    return rows.select(
        "file", F.md5(corpus.lexical_passage(file, kind, name, content)).alias("lexical_md5"), F.md5(corpus.dense_passage(file, kind, name, content)).alias("dense_md5"),
        F.md5(reranked).alias("rerank_md5"), F.length(reranked).cast("long").alias("rerank_chars"),
        F.length(T.truncate(content, corpus.TOOL_CHARS, corpus.MARKER)).cast("long").alias("cut_chars"),
    )


@query(f"""
with {FILES_SQL}
select file, lower(regexp_extract(file, '(\\.[^./]+)$', 1)) as suffix from files
where lower(regexp_extract(file, '(\\.[^./]+)$', 1)) in ('.py', '.md', '.json', '.yaml', '.yml', '.txt', '.toml') and not list_has_any(string_split(file, '/'), {IGNORED_SQL})""")
def scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where(corpus.scannable(F.col("file"))).select("file", corpus.suffix(F.col("file")).alias("suffix"))


@query(f"""
with d as (select doc_id, {LINES} as lines from documents)
select doc_id, md5(array_to_string(list_transform(range(len(lines)), lambda i: lpad(cast(i + 1 as varchar), 4, ' ') || ' | ' || lines[i + 1]), chr(10))) as numbered_md5 from d""")
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(corpus.numbered(F.col("text"))).alias("numbered_md5"))


def _cjk_sql(text: str) -> str:
    return (
        f"flatten(list_transform(regexp_extract_all({text}, '[\\x{{4e00}}-\\x{{9fff}}]+'), lambda r: list_concat("
        "list_transform(range(1, length(r) + 1), lambda i: substring(r, i, 1)), list_transform(range(1, length(r)), lambda i: substring(r, i, 2)))))"
    )


def _tokens_sql(text: str) -> str:
    part = "list_transform(regexp_extract_all(regexp_replace(replace(w, '_', ' '), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z]+|[0-9]+'), lambda p: lower(p))"
    return f"list_concat(flatten(list_transform(regexp_extract_all({text}, '[A-Za-z][A-Za-z0-9_]*|[0-9]+'), lambda w: list_concat([lower(w)], {part}))), {_cjk_sql(text)})"


@query(f"""with t as (select doc_id, {_tokens_sql('text')} as t from documents)
select doc_id, cast(len(t) as bigint) as n_tokens, md5(array_to_string(t, ' ')) as tokens_md5 from t""")
def tokenize_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.token_texts(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "n_tokens", F.md5("tokens").alias("tokens_md5"))


IDEOGRAPHS = ("aeinorst", "的一是不了人我在")  # letters of every document turned into ideographs: runs of them, and letters between


@query(f"""with src as (select id, text from {samples.sql(samples.CODE)} union all select 'd' || doc_id, translate(text, '{IDEOGRAPHS[0]}', '{IDEOGRAPHS[1]}') from documents)
select id, md5(array_to_string({_tokens_sql('text')}, ' ')) as tokens_md5, len({_tokens_sql('text')})::bigint as n_tokens from src""")
def cjk_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "documents").select(_id("d", "doc_id"), F.translate("text", *IDEOGRAPHS).alias("text"))
    tokens = retrieval.token_texts(samples.frame(spark, samples.CODE).unionByName(made), "id")
    return tokens.select("id", F.md5("tokens").alias("tokens_md5"), "n_tokens")


STATS_SQL = f"""
tok as (select doc_id, {_tokens_sql('text')} as t from documents),
coll as (select count(*) as n, avg(len(t)) as avgdl from tok),
tf as (select term, doc_id, dl, count(*) as tf from (select doc_id, len(t) as dl, unnest(t) as term from tok) group by all)"""


@query(f"""with {STATS_SQL}
select term, cast(sum(tf) as bigint) as total_tf, count(*) as df, round(ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)), 6) as idf, n, round(avgdl, 6) as avgdl
from tf, coll group by term, n, avgdl""")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.term_stats(table(spark, sf_dir, "documents"), "doc_id")


def _bm25_sql(k: int, asked: str = "benchmark", text: str = "text") -> str:
    return f"""{STATS_SQL},
df as (select term, count(*) as df from tf group by term),
asked as (select item_id, term, count(*) as qtf from (select item_id, unnest({_tokens_sql(text)}) as term from {asked}) group by all),
scored as (select item_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) as score
  from asked join tf using (term) join df using (term), coll group by item_id, doc_id),
bm25 as (select * from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0) where rank <= {k})"""


def _bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return retrieval.bm25_search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id", k)


@query(f"with {_bm25_sql(5)} select item_id, doc_id, score, rank from bm25")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, 5).select("item_id", "doc_id", "score", "rank")


@query("""
with v as (select vec_id, cast(embedding as double[]) as e from embeddings),
s as (select q.vec_id as query_id, v.vec_id, round(list_dot_product(q.e, v.e), 6) as score from v q, v where q.vec_id % 100 = 0 and q.vec_id <> v.vec_id)
select query_id, vec_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.dense_search(asked, rows, "query_id", "vec_id", 5, exclude_same=True).select("query_id", "vec_id", "score", "rank")


@query("""
with v as (select vec_id, cast(embedding as double[]) as e from embeddings),
s as (select q.vec_id as query_id, v.vec_id, round(list_dot_product(q.e, v.e), 6) as score from v q, v where q.vec_id % 100 = 0)
select query_id, vec_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10""")
def dense_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index of vectors, searched by bounds from pivots."""
    rows = table(spark, sf_dir, "embeddings")
    index = dense_index.write_dense_index(rows, "vec_id", scratch(spark, "dense"), model="given")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return dense_index.search_dense_index(asked, index, "query_id", "vec_id", 10).select("query_id", "vec_id", "score", "rank")


@query("""with e as (select vec_id, label, cast(embedding as double[]) as e from embeddings), u as (select vec_id, label, e, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) as u from e)
select vec_id, label, round(sqrt(list_dot_product(e, e)), 6) as norm, round(list_dot_product(u, u), 6) as unit, round(u[1], 6) as first from u""")
def normalised_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = retrieval.normalise(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.round(F.sqrt(retrieval.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"), F.round(retrieval.dot(unit, unit), 6).alias("unit"), F.round(F.get(unit, F.lit(0)), 6).alias("first"),
    )


def _dense_sql(k: int) -> str:
    return f"""
vec as (select vec_id, cast(embedding as double[]) as e from embeddings),
dscored as (select b.item_id, v.vec_id as doc_id, round(list_dot_product(q.e, v.e), 6) as score from benchmark b join vec q on q.vec_id = b.item_id, vec v where v.vec_id <> b.item_id),
dense as (select * from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from dscored) where rank <= {k})"""


def _dense(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = table(spark, sf_dir, "benchmark").select("item_id").join(rows, F.col("item_id") == F.col("doc_id")).select("item_id", "embedding")
    return retrieval.dense_search(asked, rows, "item_id", "doc_id", k, exclude_same=True)


FUSED_SQL = """
fused as (select item_id, doc_id, round(sum(1.0 / (60 + rank)), 9) as rrf_score, max(case when s = 'dense' then rank end) as dense_rank, max(case when s = 'dense' then score end) as dense_score,
    max(case when s = 'bm25' then rank end) as bm25_rank, max(case when s = 'bm25' then score end) as bm25_score
  from (select item_id, doc_id, score, rank, 'dense' as s from dense union all select item_id, doc_id, score, rank, 'bm25' as s from bm25) group by item_id, doc_id)"""
MATCHED_SQL = "concat_ws(',', case when dense_rank is not null then 'dense' end, case when bm25_rank is not null then 'bm25' end)"


def _ranked_sql(first: str, k: int) -> str:
    return f"""ranked as (select *, {MATCHED_SQL} as matched_by, row_number() over (partition by item_id order by rrf_score desc, {first},
  dense_rank nulls last, bm25_rank nulls last, doc_id) as rank from fused), hybrid as (select * from ranked where rank <= {k})"""


BOTH_FIRST, COUNT_FIRST = "dense_rank is not null desc, bm25_rank is not null desc", "(dense_rank is not null)::int + (bm25_rank is not null)::int desc"


def _fused(spark: SparkSession, sf_dir: str, k: int, by_sources: bool = False) -> DataFrame:
    return retrieval.fuse(_dense(spark, sf_dir, 20), _bm25(spark, sf_dir, 20), "item_id", "doc_id", k, by_sources=by_sources)


@query(f"with {_bm25_sql(20)}, {_dense_sql(20)}, {FUSED_SQL}, {_ranked_sql(BOTH_FIRST, 5)} select * from hybrid")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, 5)


@query(f"with {_bm25_sql(20)}, {_dense_sql(20)}, {FUSED_SQL}, {_ranked_sql(COUNT_FIRST, 5)} select item_id, doc_id, rrf_score, matched_by, rank from hybrid")
def rrf_fusion_matched_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, 5, by_sources=True).select("item_id", "doc_id", "rrf_score", "matched_by", "rank")


@query(f"""with {_dense_sql(1)}
select b.item_id, d.score as top1, coalesce(d.score < 0.42, true) as skipped from (select distinct item_id from benchmark) b left join dense d using (item_id)""")
def soft_fuse_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.soft_gate(table(spark, sf_dir, "benchmark"), _dense(spark, sf_dir, 1), "item_id", 0.42)


def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    recalled = _fused(spark, sf_dir, 20).select("item_id", "doc_id", "rrf_score", "rank")
    asked = table(spark, sf_dir, "benchmark").select("item_id", T.token_bag(F.col("text")).alias("q"))
    found = recalled.join(asked, "item_id").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "left")
    scored = found.withColumn("reranker_score", F.when(F.col("text").isNotNull(), retrieval.overlap_score(F.col("q"), T.token_bag(F.col("text")))))
    return retrieval.rerank(scored.select("item_id", "doc_id", "rrf_score", "rank", "reranker_score"), "item_id", "doc_id")


RERANK_SQL = f"""with {_bm25_sql(20)}, {_dense_sql(20)}, {FUSED_SQL}, {_ranked_sql(BOTH_FIRST, 20)},
qt as (select item_id, list_distinct({_tokens_sql('text')}) as q from benchmark),
scored2 as (select h.item_id, h.doc_id, h.rrf_score, h.rank as pre_rerank_rank,
    case when t.t is not null then round(coalesce(len(list_intersect(q.q, t.t)) / nullif(len(q.q), 0), 0), 6) end as reranker_score
  from hybrid h join qt q using (item_id) left join tok t using (doc_id)),
final as (select *, row_number() over (partition by item_id order by reranker_score desc nulls last, rrf_score desc, pre_rerank_rank, doc_id) as reranker_rank from scored2)"""


@query(RERANK_SQL + " select item_id, doc_id, pre_rerank_rank, reranker_rank, reranker_score, case when reranker_score is null then 'fallback' else 'scored' end as reranker_status from final where reranker_rank <= 5")
def rerank_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir).drop("rank_change")


@query(RERANK_SQL + " select item_id, doc_id, pre_rerank_rank - reranker_rank as rank_change from final where reranker_rank <= 5")
def rank_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir).select("item_id", "doc_id", "rank_change")


LABELS_SQL = "labels2 as (select b.item_id, d.doc_id from benchmark b, documents d where contains(d.text, b.text))"
ASKED_SQL = "asked2 as (select item_id, exists (select 1 from labels2 l where l.item_id = b.item_id) as should_retrieve, case when contains(text, chr(10)) then 'multi_line' else 'single_line' end as query_type from benchmark b)"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, doc_id of documents that contain an item."""
    return matching.held_in(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


def _asked(spark: SparkSession, sf_dir: str, labels: DataFrame) -> DataFrame:
    wanted = labels.select("item_id").distinct().withColumn("should_retrieve", F.lit(True))
    rows = table(spark, sf_dir, "benchmark").join(wanted, "item_id", "left")
    kind = F.when(F.contains("text", F.lit("\n")), "multi_line").otherwise("single_line")
    return rows.select("item_id", F.coalesce("should_retrieve", F.lit(False)).alias("should_retrieve"), kind.alias("query_type"))


def _metrics_sql(results: str) -> str:
    return f"""select a.item_id, should_retrieve, query_type, min(case when l.doc_id is not null then r.rank end) as first_rank, count(r.doc_id) as retrieved
  from asked2 a left join {results} r using (item_id) left join labels2 l on l.item_id = r.item_id and l.doc_id = r.doc_id group by all"""


def _hit(k: int) -> str:
    return f"round(avg(case when should_retrieve then case when coalesce(first_rank <= {k}, false) then 1.0 else 0.0 end end), 6) as hit_at_{k}"


SUMMARY_SQL = f"""count(*) as queries, count(*) filter (where should_retrieve) as relevant, {_hit(1)}, {_hit(3)}, {_hit(5)},
  round(avg(case when should_retrieve then coalesce(1.0 / first_rank, 0) end), 6) as mrr,
  round(avg(case when not should_retrieve then case when retrieved > 0 then 1.0 else 0.0 end end), 6) as irrelevant_fp_rate"""


def _evaluated(spark: SparkSession, sf_dir: str, results: DataFrame) -> DataFrame:
    labels = _labels(spark, sf_dir)
    return evaluation.retrieval_rows(_asked(spark, sf_dir, labels), results, labels, "item_id", "doc_id")


@query(f"with {_bm25_sql(5)}, {LABELS_SQL}, {ASKED_SQL}, e as ({_metrics_sql('bm25')}) select {SUMMARY_SQL} from e")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.retrieval_metrics(_evaluated(spark, sf_dir, _bm25(spark, sf_dir, 5)))


@query(f"with {_bm25_sql(5)}, {LABELS_SQL}, {ASKED_SQL}, e as ({_metrics_sql('bm25')}) select query_type, {SUMMARY_SQL} from e group by grouping sets ((), (query_type))")
def retrieval_metrics_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.retrieval_metrics(_evaluated(spark, sf_dir, _bm25(spark, sf_dir, 5)), by="query_type")


@query(f"""with {_bm25_sql(20)}, {_dense_sql(20)}, {FUSED_SQL}, {_ranked_sql(BOTH_FIRST, 5)}, {LABELS_SQL}, {ASKED_SQL},
b5 as (select * from bm25 where rank <= 5), d5 as (select * from dense where rank <= 5),
s as (select 'bm25' as method, {SUMMARY_SQL} from ({_metrics_sql('b5')}) union all select 'dense', {SUMMARY_SQL} from ({_metrics_sql('d5')})
  union all select 'hybrid', {SUMMARY_SQL} from ({_metrics_sql('hybrid')}))
select method, hit_at_1, hit_at_3, hit_at_5, mrr, irrelevant_fp_rate, row_number() over (order by coalesce(hit_at_5, 0) desc, coalesce(mrr, 0) desc, coalesce(hit_at_3, 0) desc, coalesce(irrelevant_fp_rate, 1), method) as place from s""")
def method_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir)
    asked = _asked(spark, sf_dir, labels)
    dense, lexical = _dense(spark, sf_dir, 20), _bm25(spark, sf_dir, 20)
    methods = {"bm25": lexical.where("rank <= 5"), "dense": dense.where("rank <= 5"), "hybrid": retrieval.fuse(dense, lexical, "item_id", "doc_id", 5)}
    results = None
    for name, found in methods.items():
        one = found.select(F.lit(name).alias("method"), "item_id", "doc_id", "rank")
        results = one if results is None else results.unionByName(one)
    each = F.explode(F.array(*[F.lit(m) for m in methods])).alias("method")
    of_method = F.concat_ws(":", "method", "item_id").alias("asked")
    rows = evaluation.retrieval_rows(
        asked.select("*", each).withColumn("asked", of_method), results.select(of_method, "doc_id", "rank"),
        labels.select("*", each).select(of_method, "doc_id"), "asked", "doc_id",
    )
    out = evaluation.retrieval_metrics(rows, by="method").where("method is not null")
    ranked = evaluation.rank_methods(out.withColumn("latency_ms", F.lit(None).cast("double")))
    return ranked.select("method", "hit_at_1", "hit_at_3", "hit_at_5", "mrr", "irrelevant_fp_rate", "place")


SCORES_SQL = "scores as (select value as score, event_type in ('purchase', 'signup') as should_retrieve from events where value is not null)"
CANDIDATES_SQL = f"""{SCORES_SQL}, tot as (select count(*) filter (where should_retrieve) as p, count(*) filter (where not should_retrieve) as n, min(score) as lo, max(score) as hi from scores),
pts as (select score as threshold, sum(count(*) filter (where should_retrieve)) over (order by score desc) as tp, sum(count(*) filter (where not should_retrieve)) over (order by score desc) as fp from scores group by score
  union all select lo - 1e-6, p, n from tot union all select hi + 1e-6, 0, 0 from tot),
cand as (select threshold, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(n - fp as bigint) as tn, cast(p - tp as bigint) as fn, round(coalesce(tp / nullif(p, 0), 0), 9) as recall,
  round(coalesce(fp / nullif(n, 0), 0), 9) as fpr, round(coalesce((tp + n - fp) / nullif(p + n, 0), 0), 9) as accuracy from pts, tot)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("value").alias("score"), F.col("event_type").isin("purchase", "signup").alias("should_retrieve"))


@query(f"with {CANDIDATES_SQL} select * from cand where recall >= 0.95 order by fpr, recall desc, threshold limit 1")
def threshold_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.calibrate(_scores(spark, sf_dir), 0.95)


@query(f"with {CANDIDATES_SQL} select * from cand")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion_by_threshold(_scores(spark, sf_dir))


@query(f"""with {SCORES_SQL} select should_retrieve, min(score) as min, round(quantile_cont(score, 0.25), 6) as p25, round(quantile_cont(score, 0.5), 6) as median,
  round(quantile_cont(score, 0.75), 6) as p75, max(score) as max, round(avg(score), 6) as mean from scores group by should_retrieve""")
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.distribution(_scores(spark, sf_dir).where("score is not null"), "should_retrieve")


ROUTES_SQL = """routes as (select event_id, case event_type when 'error' then 'answer_directly' else 'call_tool' end as gold_decision,
    case event_type when 'click' then 'search_codebase' when 'view' then 'analyze_code' when 'purchase' then 'analyze_log' when 'signup' then 'complete_code' end as gold_tool,
    props as gold_args,
    case when event_id % 19 = 0 then null when event_id % 23 = 0 then 'maybe' when event_type = 'error' and event_id % 5 > 0 then 'answer_directly' else 'call_tool' end as pred_decision,
    case when event_id % 29 = 0 then 'invent_tool' when event_id % 7 = 0 then 'search_codebase' else
      case event_type when 'click' then 'search_codebase' when 'view' then 'analyze_code' when 'purchase' then 'analyze_log' when 'signup' then 'complete_code' end end as pred_tool,
    case when event_id % 13 = 0 then null else '{"' || case when event_id % 11 = 0 then 'x' else 'k' end || '":' || case event_id % 3 when 0 then '"' || json_extract_string(props, '$.k') || '"' else json_extract_string(props, '$.k') end || '}' end as pred_args,
    event_id % 19 <> 0 as json_valid, event_id % 19 <> 0 and event_id % 23 <> 0 and event_id % 29 <> 0 as schema_valid, case when event_id % 31 = 0 then 'timeout' end as api_error from events)"""


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.col("event_type")
    tool = F.when(kind == "click", "search_codebase").when(kind == "view", "analyze_code").when(kind == "purchase", "analyze_log").when(kind == "signup", "complete_code")
    k = F.get_json_object("props", "$.k")
    return e.select(
        "event_id",
        F.when(kind == "error", "answer_directly").otherwise("call_tool").alias("gold_decision"),
        tool.alias("gold_tool"),
        F.col("props").alias("gold_args"),
        F.when(i % 19 == 0, None).when(i % 23 == 0, "maybe").when((kind == "error") & (i % 5 > 0), "answer_directly").otherwise("call_tool").alias("pred_decision"),
        F.when(i % 29 == 0, "invent_tool").when(i % 7 == 0, "search_codebase").otherwise(tool).alias("pred_tool"),
        F.when(i % 13 != 0, F.concat(F.lit('{"'), F.when(i % 11 == 0, "x").otherwise("k"), F.lit('":'), F.when(i % 3 == 0, F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k), F.lit("}"))).alias("pred_args"),
        (i % 19 != 0).alias("json_valid"),
        ((i % 19 != 0) & (i % 23 != 0) & (i % 29 != 0)).alias("schema_valid"),
        F.when(i % 31 == 0, "timeout").alias("api_error"),
    )


TOOLS_SQL = ", ".join(f"'{t}'" for t in evaluation.TOOLS)


def _rate(name: str, a: str, b: str) -> str:
    return f"round(coalesce({a} / nullif({b}, 0), 0), 6) as {name}"


@query(f"""with {ROUTES_SQL}, c as (select count(*) as total_samples, count(*) filter (where api_error is null) as successful_requests, count(*) filter (where api_error is not null) as api_error_count,
  count(*) filter (where json_valid) as json_valid_count, count(*) filter (where schema_valid) as schema_valid_count, count(*) filter (where pred_decision = gold_decision) as decision_correct_count,
  count(*) filter (where gold_decision = 'call_tool') as gold_tool_call_count,
  count(*) filter (where gold_decision = 'call_tool' and pred_decision = 'call_tool' and pred_tool = gold_tool) as tool_name_correct_count,
  count(*) filter (where gold_decision = 'call_tool' and pred_decision = 'call_tool' and pred_tool = gold_tool and list_contains(json_keys(pred_args), 'k')) as argument_keys_covered_count,
  count(*) filter (where gold_decision = 'call_tool' and pred_decision = 'call_tool' and pred_tool = gold_tool and replace(gold_args, ' ', '') = pred_args) as arguments_exact_match_count,
  count(*) filter (where pred_decision = 'call_tool' and coalesce(pred_tool not in ({TOOLS_SQL}), true)) as hallucinated_tool_count from routes)
select *, {_rate('api_success_rate', 'successful_requests', 'total_samples')}, {_rate('json_valid_rate', 'json_valid_count', 'total_samples')}, {_rate('schema_valid_rate', 'schema_valid_count', 'total_samples')},
  {_rate('decision_accuracy', 'decision_correct_count', 'total_samples')}, {_rate('tool_name_accuracy', 'tool_name_correct_count', 'gold_tool_call_count')},
  {_rate('argument_key_coverage_rate', 'argument_keys_covered_count', 'gold_tool_call_count')}, {_rate('arguments_exact_match_rate', 'arguments_exact_match_count', 'gold_tool_call_count')},
  {_rate('tool_hallucination_rate', 'hallucinated_tool_count', 'total_samples')} from c""")
def routing_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.routing_metrics(_routes(spark, sf_dir))


@query(f"""with {ROUTES_SQL} select case when gold_decision = 'answer_directly' then 'answer_directly' else coalesce(gold_tool, '__invalid_tool__') end as gold,
  case when not json_valid then '__invalid_json__' when coalesce(pred_decision, '') = 'answer_directly' then 'answer_directly' when coalesce(pred_decision, '') <> 'call_tool' then '__invalid_decision__'
    when coalesce(pred_tool in ({TOOLS_SQL}), false) = false then '__invalid_tool__' else pred_tool end as predicted, count(*) as n from routes group by all""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion_matrix(_routes(spark, sf_dir))


@query("select round(avg(value), 6) as mean_latency, round(sum(user_id) / sum(value), 6) as tokens_per_second from events")
def generation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.generation_stats(table(spark, sf_dir, "events").select(F.col("value").alias("latency_seconds"), F.col("user_id").alias("generated_tokens")))


@query("select round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) as loss from lineitem")
def weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("loss"))


CASES_SQL = """cases as (select conv_id, max(turn) >= 1 as completed, conv_id % 6 <> 0 as should_call_tool, conv_id % 7 <> 0 as called_tool,
    case when conv_id % 6 <> 0 then 'search' else '' end as expected, case when conv_id % 7 <> 0 then 'search' else '' end as actual,
    case when bool_or(role = 'user') then bool_or(contains(lower(text), 'the') and contains(lower(text), 'of')) end as arguments_correct,
    case when conv_id % 5 > 0 then bool_or(contains(text, 'and')) end as evidence_hit, case when conv_id % 4 > 0 then bool_or(contains(text, 'is')) end as citation_valid, sum(length(text)) as latency_ms from conversations group by conv_id)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, tools = F.col("conv_id"), lambda c: F.when(c, F.array(F.lit("search"))).otherwise(F.array().cast("array<string>"))
    any_ = lambda c: F.max(c.cast("int")).cast("boolean")
    named = evaluation.contains_all(F.col("text"), F.array(F.lit("THE"), F.lit("of")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        (F.max("turn") >= 1).alias("completed"),
        F.when(any_(F.col("role") == "user"), any_(named)).alias("arguments_correct"),
        any_(F.contains("text", F.lit("and"))).alias("_and"), any_(F.contains("text", F.lit("is"))).alias("_is"),
        F.sum(F.length("text")).alias("latency_ms"),
    ).select(
        "conv_id", "completed", (i % 6 != 0).alias("should_call_tool"), (i % 7 != 0).alias("called_tool"), tools(i % 6 != 0).alias("expected_tools"), tools(i % 7 != 0).alias("actual_tools"),
        "arguments_correct", F.when(i % 5 > 0, F.col("_and")).alias("evidence_hit"), F.when(i % 4 > 0, F.col("_is")).alias("citation_valid"), "latency_ms",
    )


def _mean(condition: str, what: str) -> str:
    return f"round(avg(case when {condition} then case when {what} then 1.0 when not ({what}) then 0.0 end end), 6)"


@query(f"""with {CASES_SQL} select count(*) as cases, count(*) filter (where completed) as completed, {_mean('completed', 'should_call_tool = called_tool')} as decision_accuracy,
  {_mean('completed', 'expected = actual')} as selection_accuracy, {_mean('completed and should_call_tool', 'arguments_correct')} as argument_accuracy, {_mean('completed', 'evidence_hit')} as evidence_hit_rate,
  {_mean('completed', 'citation_valid')} as citation_accuracy, count(*) filter (where completed and not should_call_tool and called_tool) as false_positives,
  count(*) filter (where completed and should_call_tool and not called_tool) as false_negatives,
  {_rate('false_positive_rate', 'count(*) filter (where completed and not should_call_tool and called_tool)', 'count(*) filter (where completed and not should_call_tool)')},
  {_rate('false_negative_rate', 'count(*) filter (where completed and should_call_tool and not called_tool)', 'count(*) filter (where completed and should_call_tool)')},
  round(avg(case when completed then latency_ms end), 6) as mean_latency_ms from cases""")
def agent_eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.agent_summary(_cases(spark, sf_dir))


@query("""with j as (select case when doc_id % 13 = 0 then 'error' else 'ok' end as status, quality = 1 as s, toxic = 1 as h, 1 + doc_id % 5 as r, case when doc_id % 3 > 0 then 1 + doc_id % 4 end as e, case when doc_id % 2 > 0 then 1 + doc_id % 3 end as c, 1 + doc_id % 3 as a from labels)
select count(*) as items, count(*) filter (where status = 'ok') as judged, count(*) filter (where status <> 'ok') as failed, round(avg(case when status = 'ok' then s::int end), 6) as supported_rate,
  round(avg(case when status = 'ok' then h::int end), 6) as hallucination_rate, round(avg(case when status = 'ok' then r end), 6) as relevance, round(avg(case when status = 'ok' then e end), 6) as evidence_support,
  round(avg(case when status = 'ok' then c end), 6) as citation_support, cast(coalesce(sum(greatest(a - 1, 0)), 0) as bigint) as retries from j""")
def judge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").select(
        F.when(i % 13 == 0, "error").otherwise("ok").alias("status"), (F.col("quality") == 1).alias("answer_supported"), (F.col("toxic") == 1).alias("hallucination"),
        (1 + i % 5).alias("relevance_score"), F.when(i % 3 > 0, 1 + i % 4).alias("evidence_score"), F.when(i % 2 > 0, 1 + i % 3).alias("citation_score"), (1 + i % 3).alias("attempts"),
    )
    return evaluation.judge_summary(rows)


S = samples.sql

# Literal rows for the rare forms, and rows made of the tables, so that the plans meet whole tables.
MADE_LOG_SQL = """'Traceback (most recent call last):' || chr(10) || '  File "/srv/app/' || source || '/' || doc_id || '.txt", line ' || (doc_id % 9 + 1) || ', in step_' || lang || chr(10) ||
  '    ' || left(replace(coalesce(text, ''), chr(10), ' '), 40) || chr(10) || case doc_id % 3 when 0 then 'ValueError: ' when 1 then 'KeyError: ' else 'note ' end || coalesce(lang, 'none')"""
LOGS_SQL = f"(select id, text from {S(samples.LOGS)} union all select 'd' || doc_id, {MADE_LOG_SQL} from documents where lang is not null and source is not null) as logs_"
REPOSITORY_SQL = f"(select path, total_lines from {S(samples.REPOSITORY)} union all select source || '/' || doc_id || '.txt', 5 + doc_id % 7 from documents where source is not null) as repository_"
QUESTIONS_SQL = f"(select id, text from {S(samples.QUESTIONS)} union all select 'd' || doc_id, coalesce(text, '') from documents) as questions_"
ANSWERS_SQL = f"""(select id, text from {S(samples.ANSWERS)} union all select 'c' || conv_id || '-' || turn, coalesce(text, '') || ' [made/' || conv_id || '.py:' || (turn + 1) || '-' || (turn + conv_id % 9) || ']' from
  (select distinct on (conv_id, turn) * from conversations order by conv_id, turn, role, text)) as answers_"""
EVIDENCE_SQL = f"(select id, file, start_line, end_line from {S(samples.EVIDENCE)} union all select distinct 'c' || conv_id || '-' || turn, 'made/' || conv_id || '.py', 1, 6 from conversations) as evidence_"
CITED_FILES_SQL = f"(select path, total_lines from {S(samples.REPOSITORY)} union all select distinct 'made/' || conv_id || '.py', 4 + conv_id % 5 from conversations) as files_"
MODEL_JSON_SQL = f"""(select id, text from {S(samples.MODEL_JSON)} union all select 'e' || event_id, case event_id % 5 when 0 then props when 1 then '```json' || chr(10) || props || chr(10) || '```' when 2 then 'so ' || props || ' there'
  when 3 then left(props, 4) else '[' || props || '] {{' || event_type || ' ' || props || ' }}' end from events) as answers_"""


def _id(prefix: str, *columns: str) -> Column:
    return F.concat(F.lit(prefix), F.concat_ws("-", *columns)).alias("id")


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("lang is not null and source is not null")
    kind, at = F.col("doc_id") % 3, (F.col("doc_id") % 9 + 1).cast("string")
    made = F.concat(
        F.lit('Traceback (most recent call last):\n  File "/srv/app/'), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit('.txt", line '), at, F.lit(", in step_"), "lang", F.lit("\n    "),
        F.replace(F.substring(F.coalesce("text", F.lit("")), 1, 40), F.lit("\n"), F.lit(" ")), F.lit("\n"), F.when(kind == 0, "ValueError: ").when(kind == 1, "KeyError: ").otherwise("note "), F.coalesce("lang", F.lit("none")),
    )
    return samples.frame(spark, samples.LOGS).unionByName(docs.select(_id("d", "doc_id"), made.alias("text")))


def _repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("source is not null")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return samples.frame(spark, samples.REPOSITORY).unionByName(docs.select(path.alias("path"), (5 + F.col("doc_id") % 7).alias("total_lines")))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.frame(spark, samples.QUESTIONS).unionByName(table(spark, sf_dir, "documents").select(_id("d", "doc_id"), F.coalesce("text", F.lit("")).alias("text")))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min_by("text", F.struct("role", "text")).alias("text"))
    end = (F.col("turn") + F.col("conv_id") % 9).cast("string")
    mark = F.concat(F.lit(" [made/"), F.col("conv_id").cast("string"), F.lit(".py:"), (F.col("turn") + 1).cast("string"), F.lit("-"), end, F.lit("]"))
    return samples.frame(spark, samples.ANSWERS).unionByName(said.select(_id("c", "conv_id", "turn"), F.concat(F.coalesce("text", F.lit("")), mark).alias("text")))


def _made_files(spark: SparkSession, sf_dir: str) -> Column:
    return F.concat(F.lit("made/"), F.col("conv_id").cast("string"), F.lit(".py"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda n: F.lit(n).cast("long")
    made = table(spark, sf_dir, "conversations").select(_id("c", "conv_id", "turn"), _made_files(spark, sf_dir).alias("file"), one(1).alias("start_line"), one(6).alias("end_line")).distinct()
    return samples.frame(spark, samples.EVIDENCE).unionByName(made)


def _cited_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "conversations").select(_made_files(spark, sf_dir).alias("path"), (4 + F.col("conv_id") % 5).alias("total_lines")).distinct()
    return samples.frame(spark, samples.REPOSITORY).unionByName(made)


def _model_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, p = F.col("event_id") % 5, F.col("props")
    text = F.when(i == 0, p).when(i == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(i == 2, F.concat(F.lit("so "), p, F.lit(" there"))).when(i == 3, F.substring(p, 1, 4))
    text = text.otherwise(F.concat(F.lit("["), p, F.lit("] {"), "event_type", F.lit(" "), p, F.lit(" }")))
    return samples.frame(spark, samples.MODEL_JSON).unionByName(table(spark, sf_dir, "events").select(_id("e", "event_id"), text.alias("text")))


@query(f"""with w as (select id, coalesce(text, '') as text from {QUESTIONS_SQL}),
f as (select id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9_./\\\\-]+'), lambda r: regexp_extract(r, '^([A-Za-z0-9_./\\\\-]+\\.(?:[pP][yY]|[jJ][sS][oO][nN]|[yY][aA]?[mM][lL]|[tT][oO][mM][lL]|[mM][dD]|[tT][xX][tT]))(?:[^A-Za-z0-9_].*)?$', 1)), lambda x: x <> '') as a,
  list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: regexp_matches(x, '^[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+$')) as b,
  list_filter(regexp_extract_all(text, '[A-Za-z0-9_.]+'), lambda x: regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)+$')) as c,
  list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: regexp_matches(x, '^(?:[A-Z]{{2,}}[A-Za-z0-9]*|[A-Z][a-z0-9]+(?:[A-Z][A-Za-z0-9]*)+)$')) as d from w),
l as (select id, list_concat(a, b, c, d) as l from f)
select id, array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i), ',') as identifiers from l""")
def extract_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("id", F.array_join(T.identifiers(F.col("text")), ",").alias("identifiers"))


# The rules once more, written out for SQL by hand.
def _intent_sql(text: str) -> str:
    return f"""case when regexp_matches(lower({text}), 'traceback|runtimeerror|报错|异常|错误日志') then 'log_diagnosis'
  when regexp_matches(lower({text}), 'docker|容器') then 'dockerfile_generation'
  when regexp_matches(lower({text}), 'pytest|单元测试|生成测试|测试用例') then 'test_generation'
  when regexp_matches(lower({text}), '补全代码|修改代码|重构|实现代码|修复代码') then 'code_completion'
  when regexp_matches(lower({text}), '代码质量|圈复杂度|静态分析|分析文件') then 'code_analysis'
  when regexp_matches(lower({text}), '仓库|项目|代码|文件|函数|类|实现|定义|调用|模型|缓存|训练|推理|[.]py|_') then 'code_search' else 'general_question' end"""


def _error_sql(text: str) -> str:
    return f"""case when regexp_matches(lower({text}), '(missing|unexpected) key[(]s[)] in state_dict') then 'model_state_dict_mismatch'
  when regexp_matches(lower({text}), 'size mismatch|shapes cannot be multiplied|the size of tensor') then 'tensor_shape_mismatch'
  when regexp_matches(lower({text}), 'cuda (error: )?out of memory') then 'cuda_out_of_memory' when regexp_matches(lower({text}), 'modulenotfounderror|no module named') then 'missing_dependency'
  when regexp_matches(lower({text}), 'filenotfounderror|no such file or directory') then 'missing_file' when contains(lower({text}), 'syntaxerror') then 'python_syntax_error'
  when contains(lower({text}), 'attributeerror') then 'missing_attribute' when contains(lower({text}), 'keyerror') then 'missing_dictionary_key' when contains(lower({text}), 'indexerror') then 'index_out_of_range'
  when contains(lower({text}), 'typeerror') then 'invalid_type_or_call' when contains(lower({text}), 'valueerror') then 'invalid_value'
  when regexp_matches(lower({text}), 'connectionerror|timeout') then 'network_or_timeout' else 'unknown' end"""


def _grouped(rows: DataFrame, label: Column) -> DataFrame:
    return rows.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""select {_intent_sql('text')} as label, count(*) as n
from (select text from {QUESTIONS_SQL} union all select coalesce(text, '') from conversations) group by 1""")
def infer_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _questions(spark, sf_dir).select("text").unionByName(table(spark, sf_dir, "conversations").select("text"))
    return _grouped(rows, T.infer_intent(F.col("text")))


@query(f"""select {_error_sql("('  ' || text)")} as label, count(*) as n
from (select text from {LOGS_SQL} union all select coalesce(text, '') from documents) as every group by 1""")
def classify_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _logs(spark, sf_dir).select("text").unionByName(table(spark, sf_dir, "documents").select("text"))
    return _grouped(rows, T.classify_exception(F.lit(None), F.lit(None), F.col("text")))


SYMBOLS_SQL = """l as (select id, list_filter(list_transform(list_concat(regexp_extract_all(text, '"([^"\\n]{2,200})"', 1), regexp_extract_all(text, '''([^''\\n]{2,200})''', 1), regexp_extract_all(text, '`([^`\\n]{2,200})`', 1),
    list_filter(regexp_extract_all(text, '[A-Za-z0-9_.]+'), lambda w: regexp_matches(w, '^[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z0-9_]+)+$'))), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) between 3 and 200) as l from src),
sym as (select id, list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i)[1:20] as s from l)"""


@query(f"""with src as (select id, text from {LOGS_SQL} union all select cast(doc_id as varchar), coalesce(text, '') from documents), {SYMBOLS_SQL}
select id, array_to_string(s, '|') as symbols from sym where len(s) > 0""")
def extract_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _logs(spark, sf_dir).unionByName(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text")))
    return T.filled(rows, "id", F.array_join(T.symbols(F.col("text")), "|"), "symbols")


LOG_LINES_SQL = f"ln as (select id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from {LOGS_SQL})"
FRAME_SQL = r"""'^\s*File\s+"([^"]+)",\s+line\s+([0-9]+)(?:,\s+in\s+(.+))?\s*$'"""
EXC_SQL = r"'^([A-Za-z0-9_.]+(?:Error|Exception|Interrupt))(?::\s*(.*))?$'"
STRIPPED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
FRAMES_SQL = f"""nx as (select *, {STRIPPED.format("lead(line) over (partition by id order by pos)")} as below from ln),
fr as (select id, row_number() over (partition by id order by pos) as n, regexp_extract(line, {FRAME_SQL}, 1) as file, cast(regexp_extract(line, {FRAME_SQL}, 2) as bigint) as line,
  nullif({STRIPPED.format(f"regexp_extract(line, {FRAME_SQL}, 3)")}, '') as function,
  case when below <> '' and not starts_with(below, 'File "') and not starts_with(below, 'Traceback') and not contains(below, 'During handling') and not contains(below, 'direct cause') then below end as source_line
  from nx where regexp_matches(line, {FRAME_SQL})),
ex as (select id, pos, regexp_extract({STRIPPED.format('line')}, {EXC_SQL}, 1) as type, {STRIPPED.format(f"regexp_extract({STRIPPED.format('line')}, {EXC_SQL}, 2)")} as message from ln where regexp_matches({STRIPPED.format('line')}, {EXC_SQL})),
fin as (select id, arg_max(type, pos) as type, arg_max(message, pos) as message, count(*) as n from ex group by id),
lg as (select id, text, f.type, f.message, coalesce(f.n, 0) as n_exceptions from {LOGS_SQL} left join fin f using (id)),
cat as (select *, {_error_sql("(coalesce(type, '') || ' ' || coalesce(message, '') || ' ' || text)")} as category from lg)"""


@query(f"with {LOG_LINES_SQL}, {FRAMES_SQL} select id, (select count(*) from fr where fr.id = c.id) as frame_count, n_exceptions as exception_count, type as final_type, message as final_message, category from cat c")
def parse_traceback(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = diagnosis.parse_logs(_logs(spark, sf_dir), "id")
    return parsed.select(
        "id", F.size("frames").cast("long").alias("frame_count"), F.size("exception_chain").cast("long").alias("exception_count"),
        F.col("final_exception.type").alias("final_type"), F.col("final_exception.message").alias("final_message"), "category",
    )


@query(f"with {LOG_LINES_SQL}, {FRAMES_SQL} select * from fr")
def traceback_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _logs(spark, sf_dir).select("id", F.posexplode(diagnosis.frames(F.col("text"))).alias("n", "f"))
    return rows.select("id", (F.col("n") + 1).cast("long").alias("n"), "f.*")


LOOSE_SQL = r"""'File\s+"([^"]+)",\s+line\s+([0-9]+)(?:,\s+in\s+([^\n]+))?'"""


@query(f"""with g as (select id, regexp_extract_all(text, {LOOSE_SQL}, 1) as a, regexp_extract_all(text, {LOOSE_SQL}, 2) as b, regexp_extract_all(text, {LOOSE_SQL}, 3) as c,
  regexp_extract_all(text, '(?m)^([A-Za-z_][A-Za-z0-9_.]*(?:Error|Exception)):\\s*(.*)$', 1)[-1] as last_type from {LOGS_SQL})
select id, cast(len(a) as bigint) as frames, array_to_string(a, '|') as files, array_to_string(b, '|') as lines, array_to_string(list_transform(c, lambda x: coalesce(x, '')), '|') as functions, last_type from g""")
def loose_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _logs(spark, sf_dir).select("id", diagnosis.loose_frames(F.col("text")).alias("f"), diagnosis.loose_exception(F.col("text")).alias("e"))
    return rows.select(
        "id", F.size("f").cast("long").alias("frames"), F.array_join("f.file", "|").alias("files"), F.array_join(F.transform("f", lambda x: x["line"].cast("string")), "|").alias("lines"),
        F.array_join("f.function", "|").alias("functions"), F.col("e.type").alias("last_type"),
    )


@query(f"""with {LOG_LINES_SQL}, {FRAMES_SQL}, repo as (select path, lower(path) as low from {REPOSITORY_SQL}),
asked as (select id, n, file, lower(replace(file, chr(92), '/')) as low from fr)
select id, n, file, coalesce((select min(path) from repo r where a.low = r.low or ends_with(a.low, '/' || r.low)),
  (select case when count(*) = 1 then min(path) end from repo r where string_split(r.low, '/')[-1] = string_split(a.low, '/')[-1])) as repository_file from asked a""")
def resolve_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosis.resolve_frames(traceback_frames(spark, sf_dir).select("id", "n", "file"), _repository(spark, sf_dir))


@query(f"""with {LOG_LINES_SQL}, {FRAMES_SQL}, src as (select id, text from {LOGS_SQL}), {SYMBOLS_SQL},
parts as (select id, 0 as a, 0 as b, 0 as c, left({STRIPPED.format("concat_ws(' ', type, message)")}, 500) as q from cat where type is not null
  union all select id, 1, 0, 0, category from cat where category <> 'unknown'
  union all select id, 2, -n, 0, function from fr where function <> '<module>' union all select id, 2, -n, 1, left(source_line, 300) from fr
  union all select id, 3, i, 0, s[i] from (select id, s, unnest(range(1, len(s) + 1)) as i from sym)),
cl as (select id, a, b, c, {STRIPPED.format('q')} as q from parts where q is not null),
fi as (select *, row_number() over (partition by id, lower(q) order by a, b, c) as dup from cl where q <> ''),
rk as (select *, row_number() over (partition by id order by a, b, c) as n from fi where dup = 1)
select id, string_agg(q, '|' order by n) as queries from rk where n <= 5 group by id""")
def search_query_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diagnosis.search_queries(diagnosis.parse_logs(_logs(spark, sf_dir), "id"))
    return T.filled(found, "id", F.array_join("queries", "|"), "queries")


CITED_SQL = f"""pl as (select id, regexp_replace(text, '(?s)```.*?(?:```|\\z)', '', 'g') as t from {ANSWERS_SQL}),
ca as (select id, regexp_extract_all(t, '\\[([^\\[\\]:\\n]+):([0-9]+)-([0-9]+)\\]', 1) as f, regexp_extract_all(t, '\\[([^\\[\\]:\\n]+):([0-9]+)-([0-9]+)\\]', 2) as s, regexp_extract_all(t, '\\[([^\\[\\]:\\n]+):([0-9]+)-([0-9]+)\\]', 3) as e from pl),
cited as (select id, i - 1 as pos, trim(f[i]) as file, s[i]::bigint as start_line, e[i]::bigint as end_line from (select *, unnest(range(1, len(f) + 1)) as i from ca))"""


@query(f"with {CITED_SQL} select * from cited")
def extract_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.extract_citations(_answers(spark, sf_dir), "id")


CHECKED_SQL = f"""{CITED_SQL}, ev as (select distinct id, lower(replace(file, chr(92), '/')) as file, start_line, end_line from {EVIDENCE_SQL} where file <> '' and start_line >= 1 and end_line >= start_line),
repo as (select lower(path) as file, total_lines from {CITED_FILES_SQL}),
checked as (select c.id, c.pos, c.file, c.start_line, c.end_line, case when r.total_lines is null then 'file_not_found' when c.start_line < 1 then 'start_before_first_line' when c.end_line < c.start_line then 'end_before_start'
    when c.end_line > r.total_lines then 'end_after_last_line' when not exists (select 1 from ev where ev.id = c.id and ev.file = lower(replace(c.file, chr(92), '/')) and c.start_line >= ev.start_line and c.end_line <= ev.end_line) then 'unsupported' end as reason
  from cited c left join repo r on r.file = lower(replace(c.file, chr(92), '/')))"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _cited_files(spark, sf_dir).withColumnRenamed("path", "file")
    return evidence.check_citations(extract_citations(spark, sf_dir), _evidence(spark, sf_dir), files, "id")


@query(f"with {CHECKED_SQL} select * from checked")
def citation_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir)


@query(f"""with {CHECKED_SQL}, n as (select id, count(*) as c, count(*) filter (where reason is null) as v from checked group by id)
select a.id, coalesce(c, 0) as citation_count, coalesce(v, 0) as valid_count, coalesce(c - v, 0) as invalid_count, coalesce(c - v, 0) = 0 and coalesce(c, 0) > 0 as valid from {ANSWERS_SQL.replace(' as answers_', ' as a')} left join n on n.id = a.id""")
def citation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.citation_report(_answers(spark, sf_dir), _checked(spark, sf_dir), "id")


JSON_SQL = r"""inner_ as (select id, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '(?is)^```(?:json)?\s*(.*?)\s*```$', '\1') as t from {}),
both_ as (select id, regexp_replace(t, '^\s+|\s+$', '', 'g') as t, regexp_extract(t, '(?s)(\{{.*\}})', 1) as b from inner_)"""


@query(f"with {JSON_SQL.format(MODEL_JSON_SQL)} select id, case when json_valid(t) and json_type(t) = 'OBJECT' then t when b <> '' and json_valid(b) and json_type(b) = 'OBJECT' then b end as repaired from both_")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model_json(spark, sf_dir).select("id", T.repair_json_object(F.col("text")).alias("repaired"))


def _made_json(kind: str) -> str:
    """SQL of JSON texts made of events, a broken one for every rule."""
    return {
        "target": """case event_id % 12 when 0 then '{"decision": "answer_directly", "tool_name": null, "arguments": {}}' when 1 then '{"decision": "' || event_type || '", "tool_name": null, "arguments": ' || props || '}'
    when 2 then '{"decision": "call_tool", "tool_name": "' || event_type || '", "arguments": ' || props || '}' when 3 then '{"decision": "call_tool", "tool_name": "analyze_code", "arguments": ' || props || '}'
    when 4 then '{"decision": "answer_directly", "tool_name": null, "arguments": ' || props || '}' when 5 then '{"decision": "call_tool", "arguments": ' || props || '}' when 6 then props || ' tail'
    when 7 then '{"decision": "call_tool", "tool_name": "search_codebase", "arguments": {"query": "' || event_type || '", "top_k": ' || (event_id % 14) || '}}' when 8 then '{"decision": "call_tool", "tool_name": "complete_code", "arguments": {"relative_path": "a", "instruction": " ", "start_line": ' || (event_id % 3) || '}}'
    when 9 then '{"decision": "call_tool", "tool_name": "analyze_log", "arguments": {"log_text": "x", "context_lines": ' || (event_id % 40) || '}}' when 10 then '{"decision": "call_tool", "tool_name": "analyze_log", "arguments": {"log_text": ' || event_id || '}}'
    else '{"decision": "call_tool", "tool_name": ' || event_id || ', "arguments": [1]}' end""",
    }[kind]


# The rules of a target, written out for SQL by hand: (priority, code) of every rule that is broken, the least counts.
TARGET_RULES_SQL = """args(tool, name, kind, required, least, most) as (values ('search_codebase', 'query', 's', true, null, null), ('search_codebase', 'top_k', 'i', false, 1, 10), ('analyze_code', 'relative_path', 's', true, null, null),
  ('analyze_log', 'log_text', 's', true, null, null), ('analyze_log', 'context_lines', 'i', false, 1, 30), ('complete_code', 'relative_path', 's', true, null, null), ('complete_code', 'instruction', 's', true, null, null),
  ('complete_code', 'start_line', 'i', false, 1, null), ('complete_code', 'end_line', 'i', false, 1, null), ('generate_tests', 'relative_path', 's', true, null, null), ('generate_tests', 'target_name', 's', false, null, null),
  ('generate_dockerfile', 'entrypoint', 's', false, null, null), ('generate_dockerfile', 'python_version', 's', false, null, null)),
placed as (select *, row_number() over () as place from args),
j as (select id, case when json_valid(text) and json_type(text) = 'OBJECT' then text::json end as j from src),
p as (select id, j, json_keys(j) as keys, json_extract_string(j, '$.decision') as decision, json_type(j, '$.tool_name') as tool_kind, json_extract_string(j, '$.tool_name') as tool, json_type(j, '$.arguments') as args_kind,
  case when json_type(j, '$.arguments') = 'OBJECT' then json_extract(j, '$.arguments') end as a, case when json_type(j, '$.arguments') = 'OBJECT' then json_keys(j, '$.arguments') else [] end as given from j),
broken as (
  select id, 1 as priority, 'not_an_object' as code from p where j is null
  union all select id, 2, 'missing_fields:' || array_to_string(list_filter(['arguments', 'decision', 'tool_name'], lambda x: not list_contains(keys, x)), ',') from p where j is not null and len(list_filter(['arguments', 'decision', 'tool_name'], lambda x: not list_contains(keys, x))) > 0
  union all select id, 3, 'unknown_decision' from p where coalesce(decision not in ('call_tool', 'answer_directly'), true)
  union all select id, 4, 'arguments_not_an_object' from p where coalesce(args_kind <> 'OBJECT', true)
  union all select id, 5, 'direct_with_tool' from p where decision = 'answer_directly' and tool_kind <> 'NULL'
  union all select id, 6, 'direct_with_arguments' from p where decision = 'answer_directly' and len(given) > 0
  union all select id, 7, 'tool_name_not_a_string' from p where decision = 'call_tool' and coalesce(tool_kind <> 'VARCHAR', true)
  union all select id, 8, 'unknown_tool' from p where decision = 'call_tool' and tool not in ('search_codebase', 'analyze_code', 'analyze_log', 'complete_code', 'generate_tests', 'generate_dockerfile')
  union all select p.id, 9, 'missing_arguments:' || string_agg(r.name, ',' order by r.name) from p join args r on r.tool = p.tool and r.required and not list_contains(given, r.name) where decision = 'call_tool' group by p.id
  union all select p.id, 10, 'unknown_arguments' from p join (select tool, list(name) as names from args group by tool) r on r.tool = p.tool where decision = 'call_tool' and len(list_filter(given, lambda x: not list_contains(r.names, x))) > 0
  union all select p.id, 100 * r.place + 1, 'wrong_type:' || r.name from p join placed r on r.tool = p.tool and list_contains(given, r.name) where decision = 'call_tool' and json_type(a, '$.' || r.name) not in (case r.kind when 's' then 'VARCHAR' else 'UBIGINT' end, case r.kind when 's' then 'VARCHAR' else 'BIGINT' end)
  union all select p.id, 100 * r.place + 2, 'blank:' || r.name from p join placed r on r.tool = p.tool and list_contains(given, r.name) where decision = 'call_tool' and r.kind = 's' and not regexp_matches(json_extract_string(a, '$.' || r.name), '\\S')
  union all select p.id, 100 * r.place + 3, 'below_minimum:' || r.name from p join placed r on r.tool = p.tool and list_contains(given, r.name) where decision = 'call_tool' and r.kind = 'i' and try_cast(json_extract_string(a, '$.' || r.name) as bigint) < r.least
  union all select p.id, 100 * r.place + 4, 'above_maximum:' || r.name from p join placed r on r.tool = p.tool and list_contains(given, r.name) where decision = 'call_tool' and r.kind = 'i' and try_cast(json_extract_string(a, '$.' || r.name) as bigint) > r.most),
told as (select s.id, arg_min(b.code, b.priority) as error from src s left join broken b on b.id = s.id group by s.id)"""
TARGETS_SQL = f"(select id, text from {S(samples.TARGETS)} union all select 'e' || event_id, {_made_json('target')} from events)"


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "events").select(_id("e", "event_id"), F.expr(_made_json("target")).alias("text"))
    return samples.frame(spark, samples.TARGETS).unionByName(made)


@query(f"with src as (select * from {TARGETS_SQL}), {TARGET_RULES_SQL} select * from told")
def validate_route_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _targets(spark, sf_dir).select("id", curation.target_error(F.col("text")).alias("error"))


MADE_SAMPLE = """case event_id % 7 when 0 then '{"id": "s' || event_id || '", "user_query": "' || event_type || '", "target": ' || t || ', "metadata": ' || m || '}' when 1 then '{"id": " ", "user_query": "q", "target": ' || t || ', "metadata": ' || m || '}'
  when 2 then '{"id": "s", "user_query": 5, "target": ' || t || ', "metadata": ' || m || '}' when 3 then '{"id": "s", "target": ' || t || '}' when 4 then '[' || m || ']'
  else '{"metadata": ' || m || ', "target": ' || t || ', "user_query": "x", "id": "y"}' end"""
MADE_META = """case event_id % 8 when 0 then props when 1 then '{"difficulty": "easy", "group_id": "g", "source": "' || event_type || '"}' when 2 then '{"difficulty": "' || event_type || '", "group_id": "g", "source": "manual"}'
  when 3 then '{"difficulty": "hard", "group_id": "", "source": "manual"}' when 4 then '{"difficulty": "hard", "group_id": 4, "source": "manual"}' when 5 then '"text"' else '{"difficulty": "medium", "group_id": "g1", "source": "ai_assisted", "more": 1}' end"""


@query(f"""with raw as (select event_id, event_type, {_made_json('target')} as t, {MADE_META} as m from events), made as (select event_id, event_type, case when json_valid(t) then t else 'null' end as t, m from raw), src as (select 'e' || event_id as id, t as text from made), {TARGET_RULES_SQL},
samples as (select event_id, {MADE_SAMPLE} as text, m from made), o as (select *, case when json_type(text) = 'OBJECT' then json_keys(text) end as keys from samples),
meta as (select event_id, case when json_type(m) <> 'OBJECT' then 'metadata_not_an_object' when len(list_filter(['difficulty', 'group_id', 'source'], lambda x: not list_contains(json_keys(m), x))) > 0
    then 'missing_metadata:' || array_to_string(list_filter(['difficulty', 'group_id', 'source'], lambda x: not list_contains(json_keys(m), x)), ',')
  when json_type(m, '$.difficulty') <> 'VARCHAR' or json_extract_string(m, '$.difficulty') not in ('easy', 'medium', 'hard') then 'unknown_difficulty' when json_type(m, '$.group_id') <> 'VARCHAR' or trim(json_extract_string(m, '$.group_id')) = '' then 'blank_group_id'
  when json_type(m, '$.source') <> 'VARCHAR' or json_extract_string(m, '$.source') not in ('manual', 'ai_assisted') then 'unknown_source' end as error from made)
select o.event_id, case when keys is null then 'not_an_object' when len(list_filter(['id', 'metadata', 'target', 'user_query'], lambda x: not list_contains(keys, x))) > 0 then 'missing_fields:' || array_to_string(list_filter(['id', 'metadata', 'target', 'user_query'], lambda x: not list_contains(keys, x)), ',')
  when json_type(text, '$.id') <> 'VARCHAR' or trim(json_extract_string(text, '$.id')) = '' then 'blank_id' when json_type(text, '$.user_query') <> 'VARCHAR' or trim(json_extract_string(text, '$.user_query')) = '' then 'blank_user_query'
  else coalesce(told.error, meta.error) end as error
from o join told on told.id = 'e' || o.event_id join meta on meta.event_id = o.event_id""")
def sample_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "events").select("event_id", "event_type", F.expr(_made_json("target")).alias("t"), F.expr(MADE_META).alias("m"))
    made = made.withColumn("t", F.when(F.expr("event_id % 12") == 6, "null").otherwise(F.col("t")))
    return made.select("event_id", curation.sample_error(F.expr(MADE_SAMPLE)).alias("error"))


MADE_JUDGMENT = """case doc_id % 9 when 0 then '{"answer_supported": true, "hallucination": ' || case when toxic = 1 then 'true' else 'false' end || ', "relevance_score": ' || (doc_id % 7) || ', "unsupported_claims": [], "reason": "r"}'
  when 1 then '{"answer_supported": ' || quality || ', "hallucination": false}' when 2 then '{"answer_supported": true, "hallucination": false, "relevance_score": true, "unsupported_claims": [], "reason": "r"}'
  when 3 then '{"answer_supported": true, "hallucination": false, "relevance_score": null, "unsupported_claims": [], "reason": "r"}' when 4 then '{"answer_supported": true, "hallucination": false, "relevance_score": 3, "unsupported_claims": "none", "reason": "r"}'
  when 5 then '{"answer_supported": true, "hallucination": false, "relevance_score": 3, "unsupported_claims": [], "reason": ' || doc_id || '}' when 6 then '{"answer_supported": true, "hallucination": false, "relevance_score": 3, "unsupported_claims": [], "reason": "", "evidence_support_score": ' || (doc_id % 8) || '}'
  when 7 then '{"answer_supported": true, "hallucination": false, "relevance_score": 3, "unsupported_claims": [], "reason": "", "citation_support_score": "4", "evidence_support_score": null}' else 'no object' end"""


def _score_sql(name: str) -> str:
    kind = f"coalesce(json_type(j, '$.{name}'), 'NULL')"
    return f"when {kind} not in ('NULL', 'UBIGINT', 'BIGINT') then 'not_an_integer:{name}' when {kind} <> 'NULL' and cast(json_extract_string(j, '$.{name}') as bigint) not between 1 and 5 then 'out_of_range:{name}'"


@query(f"""with j as (select doc_id, case when json_valid(t) then t end as j from (select doc_id, {MADE_JUDGMENT} as t from labels))
select doc_id, case when j is null then 'not_an_object' when coalesce(json_type(j, '$.answer_supported') <> 'BOOLEAN', true) then 'not_a_flag:answer_supported' when coalesce(json_type(j, '$.hallucination') <> 'BOOLEAN', true) then 'not_a_flag:hallucination'
  {_score_sql('relevance_score')} when coalesce(json_type(j, '$.relevance_score'), 'NULL') = 'NULL' then 'missing:relevance_score' when coalesce(json_type(j, '$.unsupported_claims') <> 'ARRAY', true) then 'not_a_list:unsupported_claims'
  when coalesce(json_type(j, '$.reason') <> 'VARCHAR', true) then 'not_a_string:reason' {_score_sql('evidence_support_score')} {_score_sql('citation_support_score')} end as error from j""")
def judgment_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", curation.judgment_error(F.expr(MADE_JUDGMENT)).alias("error"))


@query("""with q as (select lang || doc_id % 400 as id, case when doc_id % 50 = 0 then null else source end as repository_id, case when doc_id % 11 = 0 then 'train' when doc_id % 2 = 0 then 'dev' else 'test' end as split,
    case doc_id % 8 when 0 then 'identifier' when 1 then 'natural_language' when 2 then 'colloquial_zh' when 3 then 'cross_file' when 4 then 'misleading_keyword' when 5 then 'irrelevant' when 6 then 'odd' else 'identifier' end as query_type,
    case when doc_id % 17 = 0 then '  ' else left(text, 30) end as query, doc_id % 3 > 0 as should_retrieve, case when doc_id % 5 = 0 then [] else ['src1/' || doc_id || '.txt'] end as files, doc_id % 13 as chunks from documents where text is not null and lang is not null),
w as (select *, lower(trim(query)) as q from q where repository_id is not null)
select id, 'missing_fields' as rule, 'repository_id' as detail from q where repository_id is null
union all select id, 'blank_query', '' from w where q = '' union all select id, 'unknown_query_type', query_type from w where query_type = 'odd' union all select id, 'unknown_split', split from w where split = 'train'
union all select id, 'no_answers', '' from w where should_retrieve and len(files) = 0 union all select id, 'unwanted_answers', '' from w where not should_retrieve and (len(files) > 0 or chunks = 0)
union all select id, 'repeated_id', cast(count(*) - 1 as varchar) from w group by id having count(*) > 1 union all select min(id), 'repeated_query', cast(count(*) - 1 as varchar) from w group by q having count(*) > 1
union all select id, 'unknown_repository', repository_id from w where repository_id not in ('src1', 'src2', 'src3')
union all select id, 'missing_file', unnest(files) from w where repository_id = 'src1' and (id is not null and len(files) > 0 and files[1] not in (select source || '/' || doc_id || '.txt' from documents where source is not null))""")
def retrieval_dataset_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    kinds = F.array(*[F.lit(k) for k in (*curation.QUERY_TYPES, "odd", "identifier")])
    queries = docs.where("text is not null and lang is not null").select(
        F.concat("lang", (i % 400).cast("string")).alias("id"), F.when(i % 50 != 0, F.col("source")).alias("repository_id"), F.when(i % 11 == 0, "train").when(i % 2 == 0, "dev").otherwise("test").alias("split"),
        F.get(kinds, (i % 8).cast("int")).alias("query_type"), F.when(i % 17 == 0, "  ").otherwise(F.substring("text", 1, 30)).alias("query"), (i % 3 > 0).alias("should_retrieve"),
        F.when(i % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("src1/"), i.cast("string"), F.lit(".txt")))).alias("relevant_files"),
        F.when(i % 13 == 0, F.array(F.lit("chunk"))).otherwise(F.array().cast("array<string>")).alias("relevant_chunks"),
    )
    known = spark.createDataFrame([("src1",), ("src2",), ("src3",)], "id string")
    files = docs.where("source is not null").select(F.concat("source", F.lit("/"), i.cast("string"), F.lit(".txt")).alias("path"))
    return curation.retrieval_dataset_errors(queries, known, files, "src1")


def _docker_sql() -> tuple[str, str]:
    """The container file rules once more, by hand: every line is looked at apart."""
    line = lambda p: f"len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(lower(x), '{p}'))) > 0"
    needs = {"FROM": r"^\s*from\s+\S", "WORKDIR": r"^\s*workdir\s+\S", "COPY": r"^\s*copy\s", "CMD_OR_ENTRYPOINT": r"^\s*(cmd|entrypoint)\s"}
    bad = {"api_key": "regexp_matches(text, 'sk-[A-Za-z0-9_-]{10,}')", "plain_secret": """regexp_matches(lower(text), '(password|api_key|token)\\s*=\\s*["''][^"'']+["'']')""",
           "chmod_777": line(r"\bchmod\s+777\b"), "remote_script": line(r"(curl|wget).*\|\s*(sh|bash)"), "sudo": line(r"\bsudo\b")}
    advised = {"pip_install": r"^\s*run\s+.*pip\s+install", "USER": r"^\s*user\s+\S"}
    errors = [f"case when not ({line(p)}) then 'missing:{n}' end" for n, p in needs.items()] + [f"case when {c} then 'forbidden:{n}' end" for n, c in bad.items()]
    return f"concat_ws(',', {', '.join(errors)})", f"concat_ws(',', {', '.join(f'case when not ({line(p)}) then {chr(39)}{n}{chr(39)} end' for n, p in advised.items())})"


# A container file of every document: its text as comments, and instructions by its number.
MADE_DOCKERFILE = """case when doc_id % 11 = 0 then '' else 'FROM python:3' || chr(10) end || case when doc_id % 3 = 0 then 'WORKDIR /srv' || chr(10) else '' end || case when doc_id % 5 = 0 then 'copy . .' || chr(10) else '' end ||
  case doc_id % 4 when 0 then 'RUN pip install x' || chr(10) when 1 then 'RUN sudo chmod 777 /' || chr(10) when 2 then 'RUN curl http://x | sh' || chr(10) else '' end || '# ' || replace(coalesce(text, ''), chr(10), chr(10) || '# ') || chr(10) || case when doc_id % 2 = 0 then 'CMD run' else 'USER me' end"""


@query(f"""with src as (select id, text from {S(samples.DOCKERFILES)} union all select 'd' || doc_id, {MADE_DOCKERFILE} from documents)
select id, case when trim(text) = '' then 'no_dockerfile' else {_docker_sql()[0]} end as errors, case when trim(text) = '' then '' else {_docker_sql()[1]} end as warnings from src""")
def dockerfile_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "documents").select(_id("d", "doc_id"), F.expr(MADE_DOCKERFILE).alias("text"))
    errors, warnings = curation.dockerfile_findings(F.col("text"))
    return samples.frame(spark, samples.DOCKERFILES).unionByName(made).select("id", errors.alias("errors"), warnings.alias("warnings"))


@query("""with n as (select doc_id, regexp_replace(lower(text), '[\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}，。！？、；：“”‘’（）,.!?;:"''()]', '', 'g') as q from documents)
select min(doc_id) as doc_id from n where q <> '' group by q""")
def query_normalise_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.first_keys(table(spark, sf_dir, "documents"), "doc_id", "text")


SPLIT_SQL = """g as (select c_custkey, min(c_mktsegment) as c_mktsegment from customer group by c_custkey),
z as (select *, count(*) over (partition by c_mktsegment) as n, row_number() over (partition by c_mktsegment order by md5('42:' || c_custkey), c_custkey) as i from g),
y as (select *, greatest(1, round_even(n * 0.2, 0))::bigint as v, greatest(1, round_even(n * 0.2, 0))::bigint as t from z),
x as (select *, greatest(n - v - t, 1) as r from y), assigned as (select c_custkey, c_mktsegment, case when i <= r then 'train' when i <= r + least(v, greatest(n - r - 1, 1)) then 'validation' else 'test' end as split from x)"""


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.group_split(table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment")


@query(f"with {SPLIT_SQL} select * from assigned")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir)


@query(f"with {SPLIT_SQL} select split, c_mktsegment, count(*) as samples, count(distinct c_custkey) as groups, md5(array_to_string(list_sort(list(distinct c_custkey)), ',')) as group_ids_md5 from orders join assigned on o_custkey = c_custkey group by all")
def group_split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    told = curation.split_manifest(orders, _assigned(spark, sf_dir), "c_custkey", "c_mktsegment", with_groups=True)
    return told.select("split", "c_mktsegment", "samples", "groups", F.md5(F.array_join(F.transform("group_ids", lambda x: x.cast("string")), ",")).alias("group_ids_md5"))


@query("select o_custkey, count(distinct o_orderpriority) as splits, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') as in_splits from orders group by o_custkey having count(distinct o_orderpriority) > 1")
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.leaks(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query("select c_nationkey, count(distinct c_mktsegment) as labels from customer group by 1 having count(distinct c_mktsegment) > 1")
def mixed_label_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.mixed_groups(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")


@query("select event_type, user_id % 3 as bucket, count(*) as n from events group by grouping sets ((event_type), (user_id % 3), (event_type, user_id % 3))")
def dataset_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 3).alias("bucket"))
    a, b = F.col("event_type"), F.col("bucket")
    return rows.groupingSets([[a], [b], [a, b]], a, b).agg(F.count(F.lit(1)).alias("n"))


@query("""with r as (select 'known_source' as rule, doc_id from documents where source is null or not regexp_matches(source, '^src[0-9]+$') union all select 'not_blank', doc_id from documents where text is null or not regexp_matches(text, '\\S')
  union all select 'length_matches', doc_id from documents where n_chars is distinct from length(text) union all select 'short', doc_id from documents where coalesce(length(text) > 5000, true)) select doc_id, rule from r""")
def dataset_rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {
        "known_source": F.rlike("source", F.lit("^src[0-9]+$")), "not_blank": F.rlike("text", F.lit(r"\S")),
        "length_matches": F.col("n_chars") == F.length("text"), "short": F.length("text") <= 5000,
    }
    return evaluation.violations(table(spark, sf_dir, "documents"), "doc_id", rules)


TURNS_SQL = """t as (select conv_id, turn, coalesce(length(text), 0) as chars from conversations where role <> 'system'),
w as (select *, row_number() over (partition by conv_id order by turn desc) as n, sum(chars) over (partition by conv_id order by turn desc rows unbounded preceding) as s from t),
kept as (select conv_id, turn, chars from w where n <= 6 and (s <= 2000 or n = 1))"""


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role <> 'system'").select("conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    return sessions.remembered(rows, "conv_id", "turn", F.col("chars"), 6, 2000)


@query(f"with {TURNS_SQL} select conv_id, turn, chars::bigint as chars from kept")
def session_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir).select("conv_id", "turn", F.col("chars").cast("long").alias("chars"))


@query(f"with {TURNS_SQL} select conv_id, count(*) as turn_count, sum(chars)::bigint as character_count, 6::bigint as max_turns, 2000::bigint as max_chars from kept group by conv_id")
def memory_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.memory_status(_kept(spark, sf_dir), "conv_id", F.col("chars"), 6, 2000)


@query("""with f as (select event_id, sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') as fp from events)
select w.event_id from f w where not exists (select 1 from f d where d.event_id = w.event_id and d.fp = w.fp and d.event_id % 3 > 0)""")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", curation.record_fingerprint("user_id", "event_type").alias("fp"))
    return curation.pending(rows, rows.where("event_id % 3 > 0"), "event_id", "fp").select("event_id")


@query(f"""select id, lower(trim(replace(path, chr(92), '/'), '` ')) as path, regexp_matches(path, '^(?:[A-Za-z]:[\\\\/]|/)') as absolute, left(sha256(lower(path)), 16) as runtime_id,
  regexp_matches(session, '^[A-Za-z0-9_-]{{1,128}}$') as session_valid, lower(path) || '::' || session as key from {S(samples.PATHS)}
union all select cast(page_id as varchar), lower(trim(replace(url, chr(92), '/'), '` ')), regexp_matches(url, '^(?:[A-Za-z]:[\\\\/]|/)'), left(sha256(lower(url)), 16), true, lower(url) || '::' || 's' from pages""")
def path_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples.frame(spark, samples.PATHS).unionByName(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), F.col("url").alias("path"), F.lit("s").alias("session")))
    path = F.col("path")
    return rows.select(
        "id", T.normalise_path(path).alias("path"), T.is_absolute_path(path).alias("absolute"), T.runtime_id(path).alias("runtime_id"),
        sessions.session_id_valid(F.col("session")).alias("session_valid"), sessions.session_key(path, F.col("session")).alias("key"),
    )


def _identifiers_sql(source: str) -> str:
    return f"""idr as (select id, regexp_extract_all(text, '[A-Za-z0-9_./\\\\-]+') as r, regexp_extract_all(text, '[A-Za-z0-9_]+') as w, regexp_extract_all(text, '[A-Za-z0-9_.]+') as d from {source}),
idl as (select id, list_concat(list_filter(list_transform(r, lambda x: regexp_extract(x, '^([A-Za-z0-9_./\\\\-]+\\.(?:[pP][yY]|[jJ][sS][oO][nN]|[yY][aA]?[mM][lL]|[tT][oO][mM][lL]|[mM][dD]|[tT][xX][tT]))(?:[^A-Za-z0-9_].*)?$', 1)), lambda x: x <> ''),
  list_filter(w, lambda x: regexp_matches(x, '^[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+$')), list_filter(d, lambda x: regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)+$')),
  list_filter(w, lambda x: regexp_matches(x, '^(?:[A-Z]{{2,}}[A-Za-z0-9]*|[A-Z][a-z0-9]+(?:[A-Z][A-Za-z0-9]*)+)$'))) as l from idr),
ident as (select id, list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i) as names from idl)"""


def _first_sql(items: str) -> str:
    """Trimmed items that aren't empty and didn't stand earlier in any case, joined."""
    kept = f"list_filter(list_transform({items}, lambda x: regexp_replace(regexp_replace(x, '^[\\x09-\\x0D\\x20]+', ''), '[\\x09-\\x0D\\x20]+$', '')), lambda x: x <> '')"
    return f"array_to_string(list_filter({kept}, lambda x, i: list_position(list_transform({kept}, lambda y: lower(y)), lower(x)) = i), ' ')"


@query(f"""with src as (select id, text from {QUESTIONS_SQL}), {_identifiers_sql('src')} select id, {_intent_sql('text')} as intent,
  {_intent_sql('text')} <> 'general_question' as should_search, text as semantic_query, {_first_sql('list_concat([text], names)')} as keyword_query, array_to_string(names, ',') as identifiers,
  0.5::double as confidence, 'rules' as rewrite_source from src join ident using (id)""")
def query_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = providers.rewrite_by_rules(_questions(spark, sf_dir), "text")
    return rows.select("id", "intent", "should_search", "semantic_query", "keyword_query", F.array_join("identifiers", ",").alias("identifiers"), "confidence", "rewrite_source")


def _made_rewriter(prompt: str) -> str:
    """A model that names a word that is there, one that isn't, and no intent."""
    return "so: " + json.dumps({"semantic_query": f" {prompt} again ", "keyword_query": "", "identifiers": ["made_up_name", "The", None, "the", " "], "confidence": 7, "intent": "none", "should_search": "yes"})


@query(f"""with src as (select id, text from {QUESTIONS_SQL}), {_identifiers_sql('src')}, known as (select exists (select 1 from documents where contains(lower(text), 'the')) as the),
w as (select *, case when the and not list_contains(list_transform(names, lambda x: lower(x)), 'the') then list_concat(names, ['The']) else names end as kept, list_contains(list_transform(names, lambda x: lower(x)), 'the') as own,
  list_contains(list_transform(names, lambda x: lower(x)), 'made_up_name') as made from src join ident using (id), known)
select id, {_intent_sql('text')} as intent, {_intent_sql('text')} <> 'general_question' as should_search, {_first_sql("[text || ' again']")} as semantic_query, {_first_sql('list_concat([text], kept)')} as keyword_query,
  array_to_string(kept, ',') as identifiers, case when made then '' else 'made_up_name:false' end || case when own then '' else ',The:' || the end as checked, 1.0::double as confidence, 'model' as rewrite_source from w""")
def rewrite_with_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    rows = providers.rewrite(_questions(spark, sf_dir), "text", _made_rewriter, files=files)
    said = F.transform(F.filter("identifier_checks", lambda c: c["source"] == "model"), lambda c: F.concat(c["identifier"], F.lit(":"), c["accepted"].cast("string")))
    return rows.select("id", "intent", "should_search", "semantic_query", "keyword_query", F.array_join("identifiers", ",").alias("identifiers"), F.array_join(said, ",").alias("checked"), "confidence", "rewrite_source")


@query(f"""with d as (select doc_id, lang, {LINES} as lines from documents), c as (select doc_id, lines, 1 as a, least(len(lines), 12) as b from d where len(lines) > 0)
select doc_id, array_to_string(lines[a:b], chr(10)) as content from (select *, sum(length(array_to_string(lines[a:b], chr(10)))) over (partition by doc_id) as used from c) where used <= 30000""")
def cited_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), "doc_id", T.line_array(F.col("text")).alias("lines")).where(F.size("lines") > 0)
    cited = docs.select("doc_id", F.lit(0).alias("pos"), "file", F.lit(1).cast("long").alias("start_line"), F.least(F.size("lines"), F.lit(12)).cast("long").alias("end_line"))
    return evidence.cited_lines(cited, docs.select("file", "lines"), "doc_id").select("doc_id", "content")


# A source made of every document: k branches, so k decides length, complexity and warnings.
MADE_SOURCE = """'import os' || chr(10) || chr(10) || chr(10) || 'def step_' || doc_id || '(a, b=[], *, c=1):' || chr(10) || repeat('    if a:' || chr(10) || '        a = b' || chr(10), cast(doc_id % 40 as int)) ||
  '    return a' || chr(10) || chr(10) || '@deco' || chr(10) || 'class K' || doc_id || ':' || chr(10) || '    async def run(self):' || chr(10) || '        return "/srv/x" if self else None' || chr(10) || 'print(1)' || chr(10)"""
SAMPLE_SOURCES = "file in ('a.py', 'b.py', 'c.py', 'd.py', 'e.py')"


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "documents").select(F.concat(F.lit("made/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("file"), F.expr(MADE_SOURCE).alias("text"))
    return samples.frame(spark, samples.PYTHON_FILES).unionByName(made)


@query("""with d as (select 'made/' || doc_id || '.py' as file, doc_id, doc_id % 40 as k from documents)
select file, 1 as start_line, 3 as end_line, 'python_module' as chunk_type, null as name, 12 as chars from d union all select file, 4, 5 + 2 * k, 'function', 'step_' || doc_id, length('def step_' || doc_id || '(a, b=[], *, c=1):') + 1 + k * 24 + 13 from d
union all select file, 7 + 2 * k, 10 + 2 * k, 'class', 'K' || doc_id, length('@deco_class K' || doc_id || ':') + 1 + 25 + 42 from d union all select file, 11 + 2 * k, 11 + 2 * k, 'python_module', null, 9 from d
union all select * from (values ('a.py', 1, 3, 'python_module', null, 32), ('a.py', 4, 11, 'function', 'f', 134), ('a.py', 13, 15, 'class', 'Crate', 80), ('a.py', 16, 17, 'python_module', null, 13), ('b.py', 1, 2, 'python_text', null, 12),
  ('c.py', 1, 1, 'python_text', null, 13), ('e.py', 1, 3, 'async_function', 'h', 57)) as t""")
def ast_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = static_analysis.python_chunks(_sources(spark, sf_dir))
    return found.select("file", F.col("start_line").cast("int"), F.col("end_line").cast("int"), "chunk_type", "name", F.length("content").cast("int").alias("chars"))


def _analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = static_analysis.python_analysis(_sources(spark, sf_dir))
    return rows.where(f"error is null and not {SAMPLE_SOURCES}")


@query("""with d as (select 'made/' || doc_id || '.py' as file, doc_id % 40 as k from documents)
select file, 1::bigint as imports, 1::bigint as classes, 2::bigint as functions, 2 + (2 * k + 2 > 50)::bigint + (2 * k + 2 > 50 and k + 1 > 10)::bigint as warnings, greatest(k + 1, 2) as max_complexity from d""")
def ast_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return static_analysis.analysis_summary(_analysed(spark, sf_dir))


@query("""with d as (select 'made/' || doc_id || '.py' as file, doc_id, doc_id % 40 as k from documents)
select file, 1 as start_line, 1 as end_line, 'import os' as description from d union all select file, 8 + 2 * k, 10 + 2 * k, 'class K' || doc_id from d union all select file, 4, 5 + 2 * k, 'function step_' || doc_id from d union all select file, 9 + 2 * k, 10 + 2 * k, 'function run' from d
union all select file, 4, 4, 'warning mutable_default' from d union all select file, 10 + 2 * k, 10 + 2 * k, 'warning hardcoded_path' from d union all select file, 4, 4, 'warning long_function' from d where 2 * k + 2 > 50 union all select file, 4, 4, 'warning high_complexity' from d where 2 * k + 2 > 50 and k + 1 > 10""")
def ast_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = projections.analysis_evidence(projections.pruned_analysis(_analysed(spark, sf_dir)))
    return found.select("file", F.col("start_line").cast("long"), F.col("end_line").cast("long"), "description")


@query()
def hybrid_search_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search with the local embedder in place of stored vectors, end to end."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    vectors = providers.embed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text").select("doc_id", "embedding")
    asked = providers.embed(items.select("item_id", "text"), "text", prefix="query: ").select("item_id", "embedding")
    dense = retrieval.dense_search(asked, vectors, "item_id", "doc_id", 20)
    return retrieval.fuse(dense, _bm25(spark, sf_dir, 20), "item_id", "doc_id", 5)


@query("""select doc_id, lang as file, left(text, 1000) as content_preview,
  case when length('{"text":"' || doc_id || '"}') > 12 then '{"ok":true,"tool":"read","truncated":true,"preview":"' || replace(left('{"text":"' || doc_id || '"}', 12), '"', chr(92) || '"') || '"}' else '{"text":"' || doc_id || '"}' end as result,
  case when doc_id % 2 = 0 then '<log: ' || length(text) || ' characters>' else text end as argument from documents""")
def result_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("file"), F.col("text").alias("content"))
    arguments = F.create_map(F.when(F.col("doc_id") % 2 == 0, "log_text").otherwise("query"), F.col("content"))
    raw = F.concat(F.lit('{"text":"'), F.col("doc_id").cast("string"), F.lit('"}'))
    rows = rows.withColumns({"result": projections.capped_result(raw, F.lit(True), F.lit("read"), 12), "argument": F.get(F.map_values(projections.sanitised_arguments(arguments)), F.lit(0))})
    return projections.evidence_summary(rows)


@query(f"""with {_bm25_sql(5)} select item_id, md5(string_agg('<evidence id="' || rank || '">' || chr(10) || 'file: ' || source || '/' || doc_id || chr(10) || 'lines: 1-9' || chr(10) || 'type: text' || chr(10) || 'name: None' || chr(10) ||
  'dense rank: None' || chr(10) || 'bm25 rank: ' || rank || chr(10) || 'code:' || chr(10) || '```python' || chr(10) || case when length(text) > 5000 then left(text, 5000) || chr(10) || '...truncated...' else text end || chr(10) || '```' || chr(10) || '</evidence>',
  chr(10) || chr(10) order by rank)) as evidence_md5 from bm25 join documents using (doc_id) group by item_id""")
def evidence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _bm25(spark, sf_dir, 5).join(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    hits = hits.select(
        "item_id", "rank", F.concat_ws("/", "source", "doc_id").alias("file"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), F.lit("text").alias("chunk_type"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("dense_rank"), F.col("rank").alias("bm25_rank"), F.col("text").alias("content"),
    )
    return projections.evidence_block(hits, ["item_id"], "rank").select("item_id", F.md5("evidence").alias("evidence_md5"))


@query(f"""with c as (select id, text, unnest(range(1, length(text) + 1)) as p from {MODEL_JSON_SQL}), o as (select * from c where substring(text, p, 1) = '{{'),
e as (select *, unnest(list_filter(range(p, length(text) + 1), lambda q: substring(text, q, 1) = '}}')) as q from o), v as (select id, p, substring(text, p, q - p + 1) as j from e where json_valid(substring(text, p, q - p + 1))),
f as (select id, arg_min(j, p) as j from v group by id), w as (select id, text from {MODEL_JSON_SQL})
select w.id, json(f.j)::varchar as object from w left join f using (id)""")
def json_object_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = projections.scanned_objects(_model_json(spark, sf_dir), "id", "text")
    return found.select("id", F.try_parse_json("object").cast("string").alias("object"))


@query("""with t as (select * from (values ('src3/3.txt'), ('3.TXT'), ('the'), ('no_such_name'), ('Token')) as t(n) union select regexp_extract(text, '[A-Za-z]{7,}') from documents where regexp_matches(text, '[A-Za-z]{7,}')
  union select 'no_' || regexp_extract(text, '[A-Za-z]{7,}') from documents where regexp_matches(text, '[A-Za-z]{7,}'))
select n as name, exists (select 1 from documents where contains(lower(text), lower(n))) or exists (select 1 from documents where lower(source || '/' || doc_id || '.txt') = lower(n) or ends_with(lower(source || '/' || doc_id || '.txt'), '/' || lower(n))) as exists_in_files from t""")
def identifier_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word of every document, and the same with a prefix that none has, besides five names."""
    docs = table(spark, sf_dir, "documents")
    word = docs.select(F.regexp_extract("text", "[A-Za-z]{7,}", 0).alias("name")).where("name <> ''")
    names = spark.createDataFrame([(n,) for n in ("src3/3.txt", "3.TXT", "the", "no_such_name", "Token")], "name string")
    names = names.unionByName(word).unionByName(word.select(F.concat(F.lit("no_"), "name").alias("name"))).distinct()
    files = docs.select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    return diagnosis.identifier_exists(names, docs, files)


@query(ORACLE_SQL["grep_with_context"])
def grep_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index of trigrams, and a search that reads the documents that can hold the text alone."""
    docs = table(spark, sf_dir, "documents")
    index = gram_index.write_gram_index(docs, scratch(spark, "grams"), "doc_id")
    return gram_index.grep(docs, index, "TOKEN =", context=1, limit=50, path="doc_id")


@query("""with m as (select conv_id, role, octet_length(encode(coalesce(text, ''))) as n from conversations),
c as (select conv_id, sum(octet_length(encode(role)) + 5 + n + 8)::bigint as n_ids, coalesce(sum(n + 7) filter (where role = 'assistant'), 0)::bigint as n_labels from m group by conv_id)
select conv_id, case when n_labels = 0 then 0 else n_ids end as n_ids, n_labels, case when n_labels = 0 then 'nothing_to_learn' end as problem from c""")
def label_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and labels of every conversation under the byte encoder."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    told = batches.label_masks(turns, most=1 << 30, key="conv_id")
    learned = F.size(F.filter("labels", lambda x: x != batches.IGNORED)).cast("long")
    return told.select("conv_id", F.size("ids").cast("long").alias("n_ids"), learned.alias("n_labels"), "problem")


@query(f"with {_bm25_sql(10)} select item_id, doc_id, score, rank from bm25")
def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index, built once, and a search that reads the postings of its terms alone."""
    index = lexical_index.write_lexical_index(table(spark, sf_dir, "documents"), "doc_id", scratch(spark, "lexical"))
    found = lexical_index.search_lexical_index(table(spark, sf_dir, "benchmark"), index, "item_id", "doc_id", 10)
    return found.select("item_id", "doc_id", "score", "rank")


@query(f"with {_bm25_sql(10)} select item_id, doc_id, score, rank from bm25")
def bm25_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of other documents made to hold these by changes alone: a source's files are removed, changed and added."""
    docs, path = table(spark, sf_dir, "documents"), scratch(spark, "lexical")
    before = docs.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.reverse("text")).otherwise(F.col("text")))
    before = before.unionByName(docs.where("doc_id % 3 = 0").withColumn("doc_id", -F.col("doc_id") - 1))
    lexical_index.write_lexical_index(before, "doc_id", path)
    index = lexical_index.update_lexical_index(docs, "doc_id", path)
    found = lexical_index.search_lexical_index(table(spark, sf_dir, "benchmark"), index, "item_id", "doc_id", 10)
    return found.select("item_id", "doc_id", "score", "rank")


ASK_SQL = "case when item_id % 4 > 0 then 'where is load_part ' || text else text end"


SEARCHED_SQL = f"""question as (select item_id, {ASK_SQL} as text from benchmark), questions as (select item_id as id, text from question), {_identifiers_sql('questions')},
wanted as (select q.item_id, q.text, q.text || case when len(names) > 0 then ' ' || array_to_string(names, ' ') else '' end as keywords from question q join ident on ident.id = q.item_id where {_intent_sql('q.text')} <> 'general_question'),
{_dense_sql(30).replace('from benchmark b', 'from wanted b')}, gate as (select w.item_id, max(score) as top1, coalesce(max(score) < 0.38, true) as skipped from wanted w left join dense d using (item_id) group by w.item_id),
passed as (select w.* from wanted w join gate using (item_id) where not skipped), {_bm25_sql(30, 'passed', 'keywords')},
dense_all as (select d.* from dense d join passed using (item_id)),
{FUSED_SQL.replace('from dense union', 'from dense_all union')}, {_ranked_sql(BOTH_FIRST, 20)}, qt as (select item_id, list_distinct({_tokens_sql('text')}) as q from passed),
scored3 as (select h.item_id, h.doc_id, h.rrf_score, h.matched_by, h.rank as pre_rerank_rank, case when t.t is not null then round(coalesce(len(list_intersect(q.q, t.t)) / nullif(len(q.q), 0), 0), 6) end as reranker_score
  from hybrid h join qt q using (item_id) left join tok t using (doc_id)),
final as (select *, row_number() over (partition by item_id order by reranker_score desc nulls last, rrf_score desc, pre_rerank_rank, doc_id) as reranker_rank from scored3)"""


def _searched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 4 > 0, F.concat(F.lit("where is load_part "), "text")).otherwise(F.col("text")).alias("text"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    own = vectors.withColumnRenamed("doc_id", "item_id").join(asked.select("item_id"), "item_id", "left_semi")
    return search.search(asked, table(spark, sf_dir, "documents"), vectors, "item_id", "doc_id", threshold=0.38, query_vectors=own)


@query(f"with {SEARCHED_SQL.replace('where v.vec_id <> b.item_id', '')} select item_id, doc_id, pre_rerank_rank, reranker_rank, reranker_score, rrf_score, matched_by from final where reranker_rank <= 5")
def search_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewriting, both gates, both retrievals, fusion and reranking in one call."""
    hits, _ = _searched(spark, sf_dir)
    return hits.select("item_id", "doc_id", "pre_rerank_rank", "reranker_rank", "reranker_score", "rrf_score", "matched_by")


@query(f"""with {SEARCHED_SQL.replace('where v.vec_id <> b.item_id', '')}, n as (select item_id, count(*) as hits from final where reranker_rank <= 5 group by item_id)
select q.item_id, g.top1, case when g.item_id is null then 'no_search_needed' when skipped then 'below_threshold' when n.hits is null then 'no_hits' end as reason, coalesce(n.hits, 0) as hits from question q left join gate g using (item_id) left join n using (item_id)""")
def search_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, told = _searched(spark, sf_dir)
    return told.select("item_id", "top1", "reason", "hits")


@query(f"""with {FILES_SQL}, f as (select file, {LINES} as lines from files),
s as (select file, lines, unnest(range(0, greatest(len(lines) - 10 - 1, 0) + 1, 70)) as s from f where len(lines) > 0)
select file || ':' || (s + 1) || '-' || least(s + 80, len(lines)) as chunk_id, file, s + 1 as start_line, least(s + 80, len(lines)) as end_line, case when ends_with(file, '.py') then 'python_text' else 'text' end as chunk_type,
  md5(array_to_string(lines[s + 1 : s + 80], chr(10))) as content_md5 from s""")
def repository_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file in chunks, Python sources apart; prose that bears a source's name doesn't parse and goes in windows too."""
    rows = corpus.chunk_table(_files(spark, sf_dir).select(F.col("file").alias("path"), "text"))
    return rows.select("chunk_id", "file", "start_line", "end_line", "chunk_type", F.md5(F.regexp_replace("content", "\n$", "")).alias("content_md5"))


@query(f"""with logs as (select * from {LOGS_SQL}), g as (select id, unnest(regexp_extract_all(text, {LOOSE_SQL}, 1)) as file, unnest(regexp_extract_all(text, {LOOSE_SQL}, 2)) as line, unnest(regexp_extract_all(text, {LOOSE_SQL}, 3)) as function,
  generate_subscripts(regexp_extract_all(text, {LOOSE_SQL}, 1), 1) as n from logs), docs as (select source || '/' || doc_id || '.txt' as path, {LINES} as lines from documents where source is not null),
r as (select g.*, d.path, d.lines from g left join docs d on lower(replace(g.file, chr(92), '/')) = lower(d.path) or ends_with(lower(replace(g.file, chr(92), '/')), '/' || lower(d.path)))
select id, n, path as repository_file, greatest(line::bigint - 8, 1) as start_line, case when path is not null then least(line::bigint + 8, len(lines)) end as end_line,
  md5(case when len(lines) >= greatest(line::bigint - 8, 1) then array_to_string(lines[greatest(line::bigint - 8, 1) : line::bigint + 8], chr(10)) end) as context_md5 from r""")
def analyze_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of logs with their files and the lines around them."""
    docs = table(spark, sf_dir, "documents").where("source is not null")
    files = docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    _, frames = diagnosis.analysed_logs(_logs(spark, sf_dir), files, "id")
    return frames.select("id", "n", "repository_file", "start_line", "end_line", F.md5("context").alias("context_md5"))


@query("""with e as (select *, event_type in ('click', 'view', 'purchase') as should_retrieve, case when event_id % 4 = 0 then 'rules' else 'model' end as src, event_id % 9 = 0 as skipped, case when event_id % 9 = 0 then 0 else event_id % 6 end as retrieved from events)
select count(*) as queries, round(avg(value), 6) as mean_latency_ms, round(avg(value / 4), 6) as mean_rewrite_ms, round(avg(value / 2), 6) as mean_retrieval_ms, count(*) filter (where src = 'rules') as fallbacks, count(*) filter (where event_id % 8 = 0) as failures,
  count(*) filter (where skipped) as skipped, count(*) filter (where event_id % 5 > 0) as reranker_used, count(*) filter (where not skipped and retrieved > 0 and should_retrieve) as fused_relevant, count(*) filter (where not skipped and retrieved > 0 and not should_retrieve) as fused_irrelevant from e""")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    rows = e.select(
        F.col("event_type").isin("click", "view", "purchase").alias("should_retrieve"), F.when(i % 4 == 0, "rules").otherwise("model").alias("rewrite_source"), F.when(i % 8 == 0, "timeout").alias("rewrite_error"),
        (i % 9 == 0).alias("skipped"), F.when(i % 5 > 0, "scored").otherwise("fallback").alias("reranker_status"), F.when(i % 9 == 0, 0).otherwise(i % 6).alias("retrieved"),
        F.col("value").alias("latency_ms"), (F.col("value") / 4).alias("rewrite_ms"), (F.col("value") / 2).alias("retrieval_ms"),
    )
    return evaluation.conditional_counts(rows)


MADE_ARGUMENTS = "case event_id % 6 when 0 then null when 1 then '  ' when 2 then props when 3 then '[' || props || ']' when 4 then left(props, 5) else ' ' || props || ' ' end"


@query(f"""with a as (select event_id, trim({MADE_ARGUMENTS}) as t, value from events), b as (select event_id, value, coalesce(nullif(t, ''), '{{}}') as t from a)
select event_id, case when json_valid(t) and json_type(t) = 'OBJECT' then t end as arguments, case when not json_valid(t) then 'not_json' when json_type(t) <> 'OBJECT' then 'not_an_object' end as error,
  case when value is null then '-' else printf('%.4f', round(value, 2)) end as number, case when event_id % 10 = 0 then '-' else printf('%.2f%%', (event_id % 100)::double) end as percent from b""")
def tool_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    arguments, error = T.tool_arguments(F.expr(MADE_ARGUMENTS))
    share = F.when(F.col("event_id") % 10 != 0, (F.col("event_id") % 100) / 100)
    return table(spark, sf_dir, "events").select("event_id", arguments.alias("arguments"), error.alias("error"), T.show_number(F.round("value", 2)).alias("number"), T.show_percent(share).alias("percent"))


@query("""with a as (select doc_id, case doc_id % 3 when 0 then 'Here:' || chr(10) || '```dockerfile' || chr(10) || 'FROM a' || doc_id || chr(10) || '```' || chr(10) || 'and' || chr(10) || '```py' || chr(10) || 'x = ' || doc_id || chr(10) || '```'
  when 1 then '```' || chr(10) || 'no' || chr(10) || '```' || chr(10) || '```' || chr(10) || 'FROM b' || doc_id || chr(10) || '```' else left(text, 30) end as t from documents where text is not null)
select doc_id, case doc_id % 3 when 0 then 'FROM a' || doc_id when 1 then 'FROM b' || doc_id end as dockerfile, case doc_id % 3 when 0 then 'dockerfile,py' when 1 then ',' else '' end as languages,
  case doc_id % 3 when 0 then 'Dockerfile,snippet.py' when 1 then 'snippet.txt,snippet.txt' else '' end as names from a where not contains(t, '```') or doc_id % 3 < 2""")
def answer_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, d = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    first = F.concat(F.lit("Here:\n```dockerfile\nFROM a"), d, F.lit("\n```\nand\n```py\nx = "), d, F.lit("\n```"))
    second = F.concat(F.lit("```\nno\n```\n```\nFROM b"), d, F.lit("\n```"))
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.when(i == 0, first).when(i == 1, second).otherwise(F.substring("text", 1, 30)).alias("t"))
    blocks = curation.code_blocks(F.col("t"))
    return rows.select(
        "doc_id", curation.extract_dockerfile(F.col("t")).alias("dockerfile"), F.array_join(F.transform(blocks, lambda b: b["language"]), ",").alias("languages"),
        F.array_join(F.transform(blocks, lambda b: b["file_name"]), ",").alias("names"),
    )


@query(f"""with {_bm25_sql(5)}, h as (select item_id, rank, source || '/' || doc_id as file, case when length(text) > 5000 then left(text, 5000) || chr(10) || '...truncated...' else text end as content, text from bm25 join documents using (doc_id))
select item_id, count(*) as hits, md5(string_agg(file || content, '|' order by rank)) as pruned_md5, md5(string_agg(file || left(text, 1500), '|' order by rank)) as judged_md5 from h group by item_id""")
def hit_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits pruned to their nine fields, and as a judge reads them."""
    hits = _bm25(spark, sf_dir, 5).join(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    whole = hits.select(
        "item_id", "rank", F.concat_ws("/", "source", "doc_id").alias("file"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), F.lit("text").alias("chunk_type"), F.lit(None).cast("string").alias("name"),
        F.col("text").alias("content"), F.lit(0.0).alias("rrf_score"), F.lit(None).cast("long").alias("dense_rank"), F.col("rank").alias("bm25_rank"),
    )
    pruned = projections.pruned_hits(whole, keep=("item_id", "rank")).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat("file", "content").alias("t")))).alias("p"))
    judged = whole.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "file", "start_line", "end_line", "content"))).alias("e"))
    joined = lambda c: F.md5(F.array_join(c, "|"))
    return pruned.join(judged, "item_id").select(
        "item_id", F.size("p").cast("long").alias("hits"), joined(F.transform("p", lambda x: x["t"])).alias("pruned_md5"),
        joined(F.transform(projections.judge_evidence(F.col("e")), lambda x: F.concat(x["file"], x["content_preview"]))).alias("judged_md5"),
    )


@query("""with w as (select user_id, event_id, row_number() over (partition by user_id order by event_id desc) as n from events), gone as (select event_id from events where user_id % 4 = 0)
select w.user_id, w.event_id as last_event, (select count(*) from events e where e.user_id = w.user_id and e.event_id not in (select event_id from gone)) as stale from w where n = 1""")
def last_and_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each user, and finished rows whose work is gone."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    stale = curation.stale(e, e.where("user_id % 4 = 0"), "event_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("stale"))
    last = diagnosis.last_by(e, "user_id", "event_id")
    return last.join(stale, "user_id", "left").select("user_id", F.col("event_id").alias("last_event"), F.coalesce("stale", F.lit(0)).cast("long").alias("stale"))


@query(f"""with q as (select id, text from {QUESTIONS_SQL}), low as (select id, text, lower(text) as low from q)
select id, case when contains(low, 'traceback') or contains(low, 'error') then 'analyze_log' when contains(low, 'docker') then 'generate_dockerfile' when regexp_matches(low, '[.]py|_|代码|函数|code') then 'search_codebase' end as pred_tool,
  case when regexp_matches(low, 'traceback|error|docker|[.]py|_|代码|函数|code') then 'call_tool' else 'answer_directly' end as pred_decision, true as json_valid, true as schema_valid from low""")
def route_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions through the router's stand-in, parsed and checked as a model's answers are."""
    return providers.route(_questions(spark, sf_dir), "text").select("id", "pred_tool", "pred_decision", "json_valid", "schema_valid")
