"""Projections of results for readers of limited appetite: pruned hits, previews, capped tool results, evidence of an analysis."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import truncate

HIT_FIELDS = ("file", "start_line", "end_line", "chunk_type", "name", "content", "rrf_score", "dense_rank", "bm25_rank")
HIT_CHARS, PREVIEW_CHARS, JUDGE_CHARS, JUDGE_ITEMS, RESULT_CHARS, IMPORTS = 5000, 1000, 1500, 20, 30_000, 50
MARKER = "\n...truncated..."


def pruned_hits(hits: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The nine fields of a hit, its content cut, and the columns ``keep``."""
    return hits.select(*keep, *(truncate(F.col(c), HIT_CHARS, MARKER).alias(c) if c == "content" else F.col(c) for c in HIT_FIELDS))


def evidence_block(hits: DataFrame, by: list[str], rank: str) -> DataFrame:
    """A text per group: its hits in order of rank, numbered, with place, kind, ranks and cut content."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    head = F.concat(
        F.lit('<evidence id="'), F.col(rank).cast("string"), F.lit('">\nfile: '), F.col("file"), F.lit("\nlines: "), F.col("start_line").cast("string"), F.lit("-"),
        F.col("end_line").cast("string"), F.lit("\ntype: "), F.col("chunk_type"), F.lit("\nname: "), shown("name"), F.lit("\ndense rank: "), shown("dense_rank"),
        F.lit("\nbm25 rank: "), shown("bm25_rank"), F.lit("\ncode:\n```python\n"), truncate(F.col("content"), HIT_CHARS, MARKER), F.lit("\n```\n</evidence>"),
    )
    blocks = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), head.alias("b"))))
    return hits.groupBy(*by).agg(F.array_join(F.transform(blocks, lambda x: x["b"]), "\n\n").alias("evidence"))


def evidence_summary(evidence: DataFrame, content: str = "content") -> DataFrame:
    """Evidence with a preview in place of its content."""
    return evidence.withColumn("content_preview", F.substring(content, 1, PREVIEW_CHARS)).drop(content)


def judge_evidence(evidence: Column) -> Column:
    """The first pieces of an array of evidence with short previews."""
    short = lambda e: F.struct(e["file"].alias("file"), e["start_line"].alias("start_line"), e["end_line"].alias("end_line"), F.substring(e["content"], 1, JUDGE_CHARS).alias("content_preview"))
    return F.slice(F.transform(evidence, short), 1, JUDGE_ITEMS)


def capped_result(result: Column, ok: Column, tool: Column, most: int = RESULT_CHARS) -> Column:
    """A tool's result as JSON; one that is too long becomes a short object with a preview."""
    short = F.to_json(F.struct(ok.alias("ok"), tool.alias("tool"), F.lit(True).alias("truncated"), F.substring(result, 1, most).alias("preview")))
    return F.when(F.length(result) > most, short).otherwise(result)


def sanitised_arguments(arguments: Column) -> Column:
    """A map of arguments in which a log is told by its length alone."""
    told = lambda k, v: F.when(k == "log_text", F.concat(F.lit("<log: "), F.length(v).cast("string"), F.lit(" characters>"))).otherwise(v)
    return F.transform_values(arguments, told)


def analysis_evidence(analysed: DataFrame) -> DataFrame:
    """file, start_line, end_line, description of the imports, classes, functions and warnings of ``python_analysis``."""
    piece = lambda a, b, d: F.struct(a.alias("start_line"), b.alias("end_line"), d.alias("description"))
    parts = F.concat(
        F.transform("imports", lambda x: piece(x["line"], x["line"], F.concat(F.lit("import "), x["module"]))),
        F.transform("classes", lambda x: piece(x["line"], x["end_line"], F.concat(F.lit("class "), x["name"]))),
        F.transform("functions", lambda x: piece(x["line"], x["end_line"], F.concat(F.lit("function "), x["name"]))),
        F.transform("warnings", lambda x: piece(x["line"], x["line"], F.concat(F.lit("warning "), x["type"]))),
    )
    return analysed.select("file", F.inline(parts))


def pruned_analysis(analysed: DataFrame) -> DataFrame:
    """The analysis without arguments, with its first imports."""
    kept = ("name", "type", "class_name", "line", "end_line", "length", "complexity")
    return analysed.withColumns(
        {"functions": F.transform("functions", lambda f: F.struct(*(f[k].alias(k) for k in kept))), "imports": F.slice("imports", 1, IMPORTS)}
    )


def scan_json_object(text: str | None) -> str | None:
    """The first JSON object that decodes from any opening brace, whatever follows it; None without one."""
    body = (text or "").strip()
    try:
        whole = json.loads(body)
        if isinstance(whole, dict):
            return json.dumps(whole, sort_keys=True, ensure_ascii=False)
    except ValueError:
        pass
    decoder, at = json.JSONDecoder(), body.find("{")
    while at >= 0:
        try:
            value, _ = decoder.raw_decode(body, at)
            if isinstance(value, dict):
                return json.dumps(value, sort_keys=True, ensure_ascii=False)
        except ValueError:
            pass
        at = body.find("{", at + 1)
    return None


def scanned_objects(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, object: partial decoding has no SQL form, so it runs in Arrow batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([scan_json_object(t) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["key", "object"])

    kind = rows.schema[key].dataType.simpleString()
    read = rows.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return read.mapInArrow(run, f"key {kind}, object string").withColumnRenamed("key", key)
