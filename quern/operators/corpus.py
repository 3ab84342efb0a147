"""Files as rows: statistics, line windows, slices, search with context, passage formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import line_array, truncate
from quern.operators.static_analysis import python_chunks

# What is scanned, and what is indexed.
SCANNED_SUFFIXES = (".py", ".md", ".json", ".yaml", ".yml", ".txt", ".toml")
INDEXED_SUFFIXES = (".py", ".md", ".json", ".yaml", ".yml", ".toml")
IGNORED_DIRECTORIES = (
    ".git", ".venv", "venv", "__pycache__", ".pytest_cache", ".vscode", "node_modules", "checkpoints", "models",
    "lora_outputs", "runtime_data", "generated_outputs", "dense_index", "bm25_index", "data", "datasets", "reports",
    "logs", "training", "experiments",
)
RERANK_CHARS, TOOL_CHARS = 8000, 12000
MARKER = "\n...truncated..."


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def ignored(path: Column, any_case: bool) -> Column:
    parts = F.split(path, "/")
    if any_case:
        parts = F.transform(parts, F.lower)
    return F.arrays_overlap(parts, F.array(*[F.lit(d) for d in IGNORED_DIRECTORIES]))


def scannable(path: Column) -> Column:
    """Directories are compared as they are written."""
    return ~ignored(path, False) & suffix(path).isin(*SCANNED_SUFFIXES)


def indexable(path: Column, content: Column) -> Column:
    """Directories are compared in any case; blank contents are left out."""
    return ~ignored(path, True) & suffix(path).isin(*INDEXED_SUFFIXES) & F.rlike(content, F.lit(r"\S"))


def line_count(text: Column) -> Column:
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    open_ = F.when((F.length(text) > 0) & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)
    return F.coalesce(ends + open_, F.lit(0)).cast("long")


def repository_stats(files: DataFrame, group: str, kind: str, text: str = "text") -> DataFrame:
    """Files, lines and characters by group, and by group and kind: one shuffle of partial sums."""
    rows = files.select(group, kind, line_count(F.col(text)).alias("lines"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("chars"))
    sets = rows.groupingSets([[F.col(group)], [F.col(group), F.col(kind)]], F.col(group), F.col(kind))
    return sets.agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("total_lines"), F.sum("chars").alias("total_chars"))


def line_windows(files: DataFrame, key: str, text: str = "text", chunk_lines: int = 80, overlap: int = 10) -> DataFrame:
    """Overlapping windows of lines: key, start_line, end_line, content. The window that reaches the end is the last."""
    if not 0 <= overlap < chunk_lines:
        raise ValueError("overlap must be at least 0 and below chunk_lines")
    lines = files.select(key, line_array(F.col(text)).alias("lines")).where(F.size("lines") > 0)
    last = F.greatest(F.size("lines") - F.lit(overlap + 1), F.lit(0))
    starts = lines.select(key, "lines", F.explode(F.sequence(F.lit(0), last, F.lit(chunk_lines - overlap))).alias("s"))
    window = F.slice("lines", F.col("s") + 1, F.lit(chunk_lines))
    return starts.select(
        key,
        (F.col("s") + 1).cast("long").alias("start_line"),
        (F.col("s") + F.size(window)).cast("long").alias("end_line"),
        F.array_join(window, "\n").alias("content"),
    )


def chunk_table(files: DataFrame, path: str = "path", text: str = "text", chunk_lines: int = 80, overlap: int = 10) -> DataFrame:
    """chunk_id, file, start_line, end_line, chunk_type, name, content of all files: Python sources at their definitions, others in
    windows of lines. A file goes one way only, and no chunk needs another file, so nothing is shuffled."""
    own = files.select(F.col(path).alias("file"), F.col(text).alias("text"))
    sources = python_chunks(own.where(suffix(F.col("file")) == ".py"), chunk_lines=chunk_lines, overlap=overlap)
    others = line_windows(own.where(~F.coalesce(suffix(F.col("file")) == ".py", F.lit(False))), "file", "text", chunk_lines, overlap)
    others = others.select("file", "start_line", "end_line", F.lit("text").alias("chunk_type"), F.lit(None).cast("string").alias("name"), "content")
    every = sources.unionByName(others)
    chunk_id = F.format_string("%s:%d-%d", "file", "start_line", "end_line").alias("chunk_id")
    return every.select(chunk_id, "file", "start_line", "end_line", "chunk_type", "name", "content")


def file_slices(files: DataFrame, key: str, start: int, end: int | None, text: str = "text") -> DataFrame:
    """Lines start to end of every file; the end is cut at the file's; an empty file gives zeros and no content."""
    if start < 1 or (end is not None and end < start):
        raise ValueError("lines count from 1 and the end isn't before the start")
    lines = files.select(key, line_array(F.col(text)).alias("lines"))
    total = F.size("lines")
    stop = F.least(total, F.lit(end)) if end is not None else total
    taken = F.when(stop >= start, F.slice("lines", F.lit(start), F.greatest(stop - start + 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return lines.select(
        key,
        F.when(total == 0, 0).otherwise(F.lit(start)).cast("long").alias("start_line"),
        F.when(total == 0, 0).otherwise(stop).cast("long").alias("end_line"),
        total.cast("long").alias("total_lines"),
        F.array_join(taken, "\n").alias("content"),
    )


def grep(files: DataFrame, key: str, query: str, context: int = 2, limit: int | None = 20, text: str = "text") -> DataFrame:
    """Lines that contain ``query`` in any case, with ``context`` lines around them, the hit marked; the first ``limit`` hits.

    The places of a file's hits are found first, its first ``limit`` ones at most, and only what is shown of each leaves the
    line array: no row carries a whole file, no window, no shuffle before the top-k.
    """
    hit_text = query.lower()
    lines = files.where(F.contains(F.lower(text), F.lit(hit_text))).select(key, line_array(F.col(text)).alias("lines"))
    places = F.array_compact(F.transform("lines", lambda x, i: F.when(F.contains(F.lower(x), F.lit(hit_text)), i)))
    if limit is not None:
        places = F.slice(places, 1, limit)

    def shown(i: Column) -> Column:
        first, last = F.greatest(i - context, F.lit(0)), F.least(i + context, F.size("lines") - 1)
        around = F.transform(F.slice("lines", first + 1, last - first + 1), lambda x, j: F.concat(F.when(j + first == i, "> ").otherwise("  "), x))
        return F.struct(
            (i + 1).cast("long").alias("line"), (first + 1).cast("long").alias("start_line"), (last + 1).cast("long").alias("end_line"),
            F.size("lines").cast("long").alias("total_lines"), F.array_join(around, "\n").alias("content"),
        )

    found = lines.select(key, F.transform(places, shown).alias("hits")).select(key, F.inline("hits"))
    return found.orderBy(key, "line").limit(limit) if limit is not None else found


def line_ranges(ranges: DataFrame, files: DataFrame, path: str, lines: str, first: str, last: str) -> DataFrame:
    """path, first, last, content: the lines of every distinct range (of bounded length) of a file.

    A join of line numbers, so that no row carries a file's whole line array however many ranges a file has.
    """
    own = ranges.select(path, first, last).where(F.col(last) >= F.col(first)).distinct()
    asked = own.select(path, first, last, F.explode(F.sequence(first, last)).alias("_n"))
    rows = files.join(own.select(path).distinct(), path, "left_semi").select(path, F.posexplode(lines).alias("_i", "_line"))
    rows = rows.select(path, (F.col("_i") + 1).cast("long").alias("_n"), "_line")
    pieces = F.array_sort(F.collect_list(F.struct("_n", "_line")))
    return asked.join(rows, [path, "_n"]).groupBy(path, first, last).agg(F.array_join(F.transform(pieces, lambda x: x["_line"]), "\n").alias("content"))


def _named(name: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("module"))


def lexical_passage(file: Column, kind: Column, name: Column, content: Column) -> Column:
    return F.concat(F.lit("File: "), file, F.lit("\nType: "), kind, F.lit("\nName: "), _named(name), F.lit("\nCode:\n"), content)


def dense_passage(file: Column, kind: Column, name: Column, content: Column) -> Column:
    return F.concat(F.lit("passage: "), lexical_passage(file, kind, name, content))


def rerank_passage(file: Column, kind: Column, name: Column, start: Column, end: Column, content: Column) -> Column:
    lines = F.concat(F.lit("\nLines: "), start.cast("string"), F.lit("-"), end.cast("string"))
    body = truncate(content, RERANK_CHARS, MARKER)
    return F.concat(F.lit("File: "), file, lines, F.lit("\nType: "), kind, F.lit("\nName: "), _named(name), F.lit("\nCode:\n"), body)


def numbered(text: Column, start: int = 1) -> Column:
    return F.array_join(F.transform(line_array(text), lambda x, i: F.concat(F.lpad((i + start).cast("string"), 4, " "), F.lit(" | "), x)), "\n")


def cumulative_budget(rows: DataFrame, group: str, order: str, text: str, most_rows: int, most_chars: int) -> DataFrame:
    """The first rows of each group within both budgets."""
    w = Window.partitionBy(group).orderBy(order)
    used = F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ranked = rows.withColumns({"_n": F.row_number().over(w), "_used": used})
    return ranked.where((F.col("_n") <= most_rows) & (F.col("_used") <= most_chars)).drop("_n", "_used")
