"""Evidence and citations: harvesting ranges, extracting ``[path:start-end]``, checking ranges and support."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from quern.functions.text import normalise_path
from quern.operators.corpus import cumulative_budget, line_ranges

# Fixed value: the form of a citation.
CITATION = r"\[([^\[\]:\n]+):([0-9]+)-([0-9]+)\]"
FENCED = r"(?s)```.*?(?:```|\z)"


def citations(answer: Column) -> Column:
    """array<struct<file,start_line,end_line>> in order; fenced blocks don't count, an open fence reaches to the end."""
    plain = F.regexp_replace(F.coalesce(answer, F.lit("")), FENCED, "")
    of = lambda g: F.regexp_extract_all(plain, F.lit(CITATION), F.lit(g))
    zipped = F.arrays_zip(of(1).alias("f"), of(2).alias("s"), of(3).alias("e"))
    return F.transform(
        zipped, lambda x: F.struct(F.btrim(x["f"]).alias("file"), x["s"].cast("long").alias("start_line"), x["e"].cast("long").alias("end_line"))
    )


def extract_citations(answers: DataFrame, key: str, text: str = "text") -> DataFrame:
    return answers.select(key, F.posexplode(citations(F.col(text))).alias("pos", "c")).select(key, F.col("pos").cast("long"), "c.*")


def admissible(file: Column, start: Column, end: Column) -> Column:
    return (F.coalesce(F.btrim(file), F.lit("")) != "") & (start >= 1) & (end >= start)


def distinct_evidence(evidence: DataFrame, by: list[str]) -> DataFrame:
    """Evidence without invalid ranges, one row per normalised range."""
    kept = evidence.where(admissible(F.col("file"), F.col("start_line"), F.col("end_line"))).withColumn("file", normalise_path(F.col("file")))
    return kept.dropDuplicates([*by, "file", "start_line", "end_line"])


def range_reason(total_lines: Column, start: Column, end: Column) -> Column:
    """The first rule that a cited range breaks; null if none. total_lines is null for a file that isn't there."""
    return (
        F.when(total_lines.isNull(), "file_not_found")
        .when(start < 1, "start_before_first_line")
        .when(end < start, "end_before_start")
        .when(end > total_lines, "end_after_last_line")
    )


CELL_LINES = 1024  # first lines that a sort takes together


def contained(cited: DataFrame, evidence: DataFrame, by: list[str]) -> DataFrame:
    """The distinct rows (by, start_line, end_line) of ``cited`` that lie inside one range of ``evidence`` with the same ``by``.

    A range lies in another if, of all that begin no later, the one that reaches furthest reaches its end. So no range is paired with
    another: evidence goes to the furthest end of each first line, first lines to cells of CELL_LINES, and a running maximum goes over
    the cells of a file and over the lines of a cell. A file that many ranges share is sorted by cells in many tasks. Null keys match nothing.
    """
    known = " and ".join(f"`{c}` is not null" for c in by)
    cell = F.floor(F.col("start_line") / CELL_LINES).alias("_cell")
    ends = evidence.where(known).groupBy(*by, "start_line").agg(F.max("end_line").alias("_reach"))
    asked = cited.where(known).where("start_line is not null and end_line is not null").select(*by, "start_line", "end_line").distinct()
    rows = ends.select(*by, cell, "start_line", F.lit(0).alias("_asked"), F.lit(None).cast("long").alias("end_line"), F.col("_reach").cast("long").alias("_reach"))
    rows = rows.unionByName(asked.select(*by, cell, "start_line", F.lit(1).alias("_asked"), F.col("end_line").cast("long").alias("end_line"), F.lit(None).cast("long").alias("_reach")))
    cells = rows.groupBy(*by, "_cell").agg(F.max("_reach").alias("_most"))
    earlier = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # cells of a file
    cells = cells.select(*by, "_cell", F.max("_most").over(earlier).alias("_before"))
    here = Window.partitionBy(*by, "_cell").orderBy("start_line", "_asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = rows.withColumn("_here", F.max("_reach").over(here)).where("_asked = 1").join(cells, [*by, "_cell"])
    return swept.where(F.greatest("_here", "_before") >= F.col("end_line")).select(*by, "start_line", "end_line")


def check_citations(cited: DataFrame, evidence: DataFrame, files: DataFrame, answer: str) -> DataFrame:
    """Cited ranges with reason (null: valid). Ranges must lie in the file and inside one piece of evidence of the same answer.

    cited: answer, pos, file, start_line, end_line; evidence: answer, file, start_line, end_line; files: file, total_lines.
    """
    c = cited.select(F.col(answer).alias("_a"), "pos", "file", "start_line", "end_line", normalise_path(F.col("file")).alias("_f"))
    e = evidence.where(admissible(F.col("file"), F.col("start_line"), F.col("end_line"))).select(F.col(answer).alias("_a"), normalise_path(F.col("file")).alias("_f"), "start_line", "end_line")
    held = contained(c, e, ["_a", "_f"]).withColumn("_held", F.lit(True))
    sizes = files.groupBy(normalise_path(F.col("file")).alias("_f")).agg(F.max("total_lines").alias("_total"))
    joined = c.join(sizes, "_f", "left").join(held, ["_a", "_f", "start_line", "end_line"], "left")
    reason = F.coalesce(range_reason(F.col("_total"), F.col("start_line"), F.col("end_line")), F.when(F.col("_held").isNull(), "unsupported"))
    return joined.select(F.col("_a").alias(answer), "pos", "file", "start_line", "end_line", reason.alias("reason"))


def citation_report(answers: DataFrame, checked: DataFrame, answer: str, required: str | None = None) -> DataFrame:
    """A row per answer: citation_count, valid_count, invalid_count, valid. An answer that must cite and doesn't isn't valid."""
    counts = checked.groupBy(answer).agg(F.count(F.lit(1)).alias("citation_count"), F.count_if(F.col("reason").isNull()).alias("valid_count"))
    rows = answers.select(answer, *([required] if required else [])).join(counts, answer, "left").fillna(0, ["citation_count", "valid_count"])
    must = F.col(required) if required else F.lit(True)
    invalid = F.col("citation_count") - F.col("valid_count")
    return rows.select(answer, "citation_count", "valid_count", invalid.alias("invalid_count"), ((invalid == 0) & (~must | (F.col("citation_count") > 0))).alias("valid"))


def cited_lines(cited: DataFrame, files: DataFrame, answer: str, most_lines: int = 160, most_citations: int = 12, most_chars: int = 30_000) -> DataFrame:
    """The source of each distinct citation, cut at ``most_lines``; first citations within the budgets. files: file, lines array."""
    first = cited.withColumn("_f", normalise_path(F.col("file"))).groupBy(answer, "_f", "start_line", "end_line").agg(F.min("pos").alias("pos"))
    own = files.select(normalise_path(F.col("file")).alias("_f"), "lines")
    sizes = own.select("_f", F.size("lines").cast("long").alias("_total"))
    ranged = first.join(sizes, "_f").withColumn("_last", F.least(F.col("end_line"), F.col("start_line") + most_lines - 1, F.col("_total")))
    read = line_ranges(ranged.where("start_line >= 1"), own, "_f", "lines", "start_line", "_last")
    source = ranged.join(read, ["_f", "start_line", "_last"], "left")
    source = source.select(answer, "pos", F.col("_f").alias("file"), "start_line", "end_line", F.coalesce("content", F.lit("")).alias("content"))
    return cumulative_budget(source, answer, "pos", "content", most_citations, most_chars)


@udtf(returnType="file string, start_line bigint, end_line bigint, content string")
class HarvestEvidence:
    """Every object of a JSON payload, however deep, that names a file and a range of lines."""

    def eval(self, payload: str) -> Iterator[tuple]:
        try:
            stack = [json.loads(payload)]
        except (TypeError, ValueError):
            return
        while stack:
            node = stack.pop()
            if isinstance(node, dict):
                f, a, b = node.get("file"), node.get("start_line"), node.get("end_line")
                if isinstance(f, str) and all(isinstance(x, int) and not isinstance(x, bool) for x in (a, b)):
                    c = node.get("content")
                    yield f, a, b, c if isinstance(c, str) else None
                stack.extend(reversed(list(node.values())))
            elif isinstance(node, list):
                stack.extend(reversed(node))
