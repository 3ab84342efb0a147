"""Log diagnosis: frames, exceptions, symbols, frames to files, search queries. A log is one row; no shuffle until a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import classify_exception, first_occurrences, let, line_array, strip, symbols
from quern.operators import matching
from quern.operators.corpus import line_ranges
from quern.session import written

# The forms of a traceback line and of an exception line.
FRAME = r'^\s*File\s+"([^"]+)",\s+line\s+([0-9]+)(?:,\s+in\s+(.+))?\s*$'
EXCEPTION = r"^([A-Za-z0-9_.]+(?:Error|Exception|Interrupt))(?::\s*(.*))?$"
LOOSE_FRAME = r'File\s+"([^"]+)",\s+line\s+([0-9]+)(?:,\s+in\s+([^\n]+))?'
LOOSE_EXCEPTION = r"(?m)^([A-Za-z_][A-Za-z0-9_.]*(?:Error|Exception)):\s*(.*)$"
QUERIES, QUERY_CHARS, SOURCE_CHARS = 5, 500, 300


def _blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def frames(log: Column) -> Column:
    """array<struct<file,line,function,source_line>> of the lines that are frames, with the line below where it is source."""

    def one(line: Column, below: Column) -> Column:
        header = F.startswith(below, F.lit('File "')) | F.startswith(below, F.lit("Traceback"))
        header = header | F.contains(below, F.lit("During handling")) | F.contains(below, F.lit("direct cause"))
        return F.struct(
            F.regexp_extract(line, FRAME, 1).alias("file"),
            F.regexp_extract(line, FRAME, 2).cast("long").alias("line"),
            _blank_to_null(strip(F.regexp_extract(line, FRAME, 3))).alias("function"),
            F.when((below != "") & ~header, below).alias("source_line"),
        )

    of = lambda lines: F.transform(lines, lambda line, i: F.when(F.rlike(line, F.lit(FRAME)), let(strip(F.get(lines, i + 1)), lambda below: one(line, below))))
    return F.array_compact(let(line_array(log), of))


def exceptions(log: Column) -> Column:
    """array<struct<type,message,raw>> of the lines that are exceptions, in order."""
    lines = F.filter(F.transform(line_array(log), strip), lambda x: F.rlike(x, F.lit(EXCEPTION)))
    return F.transform(
        lines,
        lambda x: F.struct(F.regexp_extract(x, EXCEPTION, 1).alias("type"), strip(F.regexp_extract(x, EXCEPTION, 2)).alias("message"), x.alias("raw")),
    )


def loose_frames(log: Column) -> Column:
    """Frames anywhere in the text, also several in a line: array<struct<file,line,function>>."""
    of = lambda g: F.regexp_extract_all(log, F.lit(LOOSE_FRAME), F.lit(g))
    zipped = F.arrays_zip(of(1).alias("file"), of(2).alias("line"), of(3).alias("function"))
    return F.transform(zipped, lambda x: F.struct(x["file"].alias("file"), x["line"].cast("long").alias("line"), x["function"].alias("function")))


def loose_exception(log: Column) -> Column:
    """struct<type,message> of the last line of the form ``XError: message``; null without one."""
    of = lambda g: F.get(F.reverse(F.regexp_extract_all(log, F.lit(LOOSE_EXCEPTION), F.lit(g))), F.lit(0))
    return F.when(of(1).isNotNull(), F.struct(of(1).alias("type"), of(2).alias("message")))


def parse_logs(logs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, frames, exception_chain, final_exception, category, symbols."""
    rows = logs.select(key, F.coalesce(text, F.lit("")).alias("log"))
    rows = rows.withColumns({"frames": frames(F.col("log")), "exception_chain": exceptions(F.col("log"))})
    rows = rows.withColumn("final_exception", F.get(F.reverse("exception_chain"), F.lit(0)))
    kind = classify_exception(F.col("final_exception.type"), F.col("final_exception.message"), F.col("log"))
    return rows.withColumns({"category": kind, "symbols": symbols(F.col("log"))}).drop("log")


def search_queries(parsed: DataFrame) -> DataFrame:
    """``parsed`` with queries: exception, category, functions and sources from the last frame up, symbols; five at most."""
    last = F.col("final_exception")
    exception = F.substring(strip(F.concat_ws(" ", last["type"], last["message"])), 1, QUERY_CHARS)
    upward = F.flatten(
        F.transform(
            F.reverse("frames"),
            lambda f: F.array_compact(
                F.array(F.when(f["function"] != "<module>", f["function"]), F.substring(f["source_line"], 1, SOURCE_CHARS))
            ),
        )
    )
    head = F.array_compact(F.array(F.when(last.isNotNull(), exception), F.when(F.col("category") != "unknown", F.col("category"))))
    return parsed.withColumn("queries", F.slice(first_occurrences(F.concat(head, upward, F.col("symbols"))), 1, QUERIES))


def resolve_frames(found: DataFrame, files: DataFrame, file: str = "file", path: str = "path") -> DataFrame:
    """``found`` with repository_file: the first file (in order of path) that the traceback path is or ends with; else the only one
    of that name; else null. Both steps are equi-joins: on every tail of the path, and on the base name."""
    own = files.select(F.col(path).alias("_path"), F.lower(F.replace(F.col(path), F.lit("\\"), F.lit("/"))).alias("_low")).distinct()
    rows = found.withColumn("_id", F.monotonically_increasing_id()) if "_id" not in found.columns else found
    low = F.lower(F.replace(F.col(file), F.lit("\\"), F.lit("/")))
    asked = rows.select(F.col(file).alias("_f"), low.alias("_asked")).distinct()
    parts = F.split("_asked", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    tails = asked.select("_f", F.explode(F.array_distinct(F.concat(F.array("_asked"), tails))).alias("_low"))
    ends = tails.join(own, "_low").groupBy("_f").agg(F.min("_path").alias("_end"))
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    names = own.groupBy(base("_low").alias("_name")).agg(F.min("_path").alias("_only"), F.count(F.lit(1)).alias("_n")).where("_n = 1")
    by_name = asked.select("_f", base("_asked").alias("_name")).join(names, "_name").select("_f", "_only")
    both = asked.select("_f").join(ends, "_f", "left").join(by_name, "_f", "left").select("_f", F.coalesce("_end", "_only").alias("repository_file"))
    out = rows.join(both, rows[file] == both["_f"], "left").drop("_f")
    return out if "_id" in found.columns else out.drop("_id")


def identifier_exists(names: DataFrame, lines: DataFrame, files: DataFrame, name: str = "name", path: str = "path", text: str = "text") -> DataFrame:
    """name, exists_in_files: a file of that path, a path that ends with it, or a line that contains it, in any case.

    ``names`` are the identifiers of questions; the lines are read once for all of them.
    """
    low = F.lower(F.replace(F.col(name), F.lit("\\"), F.lit("/")))
    asked = written(names.select(F.col(name).alias("_n"), low.alias("_low"), F.lower(name).alias("_said")).distinct(), "names")
    parts = F.split(F.lower(F.col(path)), "/")
    tails = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("_low")).distinct()
    by_path = asked.join(tails, "_low", "left_semi").select("_n")
    held = matching.held_in(lines.select(F.lower(text).alias("_t")), asked.select("_n", "_said"), None, "_t", "_n", "_said")
    found = by_path.unionByName(held).distinct().withColumn("_yes", F.lit(True))
    return asked.join(found, "_n", "left").select(F.col("_n").alias(name), F.coalesce("_yes", F.lit(False)).alias("exists_in_files"))


def context_of(frames_: DataFrame, files: DataFrame, context: int = 8, path: str = "path", text: str = "text") -> DataFrame:
    """Resolved frames (repository_file, line) with start_line, end_line and the lines around them (null: no such file or line)."""
    if not 1 <= context <= 30:
        raise ValueError("context must be between 1 and 30")
    lines = files.select(F.col(path).alias("repository_file"), line_array(F.col(text)).alias("_lines"))
    sizes = lines.select("repository_file", F.size("_lines").cast("long").alias("_total"))
    first, last = F.greatest(F.col("line") - context, F.lit(1)), F.least(F.col("line") + context, F.col("_total"))
    ranged = frames_.join(sizes, "repository_file", "left").withColumns({"start_line": first.cast("long"), "end_line": F.when(F.col("_total").isNotNull(), last).cast("long")})
    read = line_ranges(ranged.where("repository_file is not null and end_line is not null"), lines, "repository_file", "_lines", "start_line", "end_line")
    return ranged.drop("_total").join(read.withColumnRenamed("content", "context"), ["repository_file", "start_line", "end_line"], "left")


def analysed_logs(logs: DataFrame, files: DataFrame, key: str, text: str = "text", path: str = "path", file_text: str = "text", context: int = 8) -> tuple[DataFrame, DataFrame]:
    """(logs, frames) of a log that stands anywhere in a text: key, exception_type, exception_message, frame_count; and a row per
    frame: key, n, file, line, function, repository_file, start_line, end_line, context."""
    own = logs.select(key, strip(F.coalesce(text, F.lit(""))).alias("_log"))
    found = own.select(key, loose_frames(F.col("_log")).alias("_f"), loose_exception(F.col("_log")).alias("_e"))
    told = found.select(key, F.col("_e.type").alias("exception_type"), F.col("_e.message").alias("exception_message"), F.size("_f").cast("long").alias("frame_count"))
    rows = found.select(key, F.posexplode("_f").alias("n", "f")).select(key, (F.col("n") + 1).cast("long").alias("n"), "f.*")
    rows = rows.withColumn("function", strip(_blank_to_null(F.col("function"))))
    resolved = resolve_frames(rows, files, "file", path)
    return told, context_of(resolved, files, context, path, file_text)


ANALYSED, SEARCH_K, DIAGNOSIS_CONTEXT = 4, 4, 10


def diagnose(logs: DataFrame, files: DataFrame, key: str, text: str = "text", path: str = "path", file_text: str = "text") -> dict[str, DataFrame]:
    """What a diagnosis rests on, for many logs at once: ``parsed`` (frames, exceptions, category, symbols), ``frames`` with their
    files and the lines around them, ``analyse`` (key, file: the first ANALYSED files that frames lie in, Python ones), and
    ``queries`` (key, n, query: at most five, for a search with SEARCH_K hits)."""
    parsed = search_queries(parse_logs(logs, key, text))
    told, frames_ = analysed_logs(logs, files, key, text, path, file_text, DIAGNOSIS_CONTEXT)
    first = frames_.where("repository_file is not null").groupBy(key, "repository_file").agg(F.min("n").alias("_n"))
    at = F.row_number().over(Window.partitionBy(key).orderBy("_n"))
    chosen = first.withColumn("_r", at).where((F.col("_r") <= ANALYSED) & F.endswith(F.lower("repository_file"), F.lit(".py")))
    queries = parsed.select(key, F.posexplode("queries").alias("n", "query")).select(key, (F.col("n") + 1).cast("long").alias("n"), "query")
    return {"parsed": parsed.join(told, key), "frames": frames_, "analyse": chosen.select(key, F.col("repository_file").alias("file")), "queries": queries}


def last_by(rows: DataFrame, group: str, order: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


# Files that name dependencies, and files that start a program, in order of preference.
DEPENDENCY_FILES = ("requirements.txt", "pyproject.toml", "setup.py", "setup.cfg", "Pipfile")
ENTRY_FILES = ("main.py", "app.py", "server.py", "manage.py", "api/main.py", "ui/streamlit_app.py")


def present_files(files: DataFrame, candidates: tuple[str, ...], path: str = "path") -> DataFrame:
    """path, preference (from 0) of the candidates that the repository holds."""
    place = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col(path))
    return files.where(F.col(path).isin(*candidates)).select(path, (place - 1).alias("preference")).distinct()


def accepted_identifiers(named: DataFrame, known: DataFrame, name: str = "name", own: str = "from_user") -> DataFrame:
    """``named`` (name, from_user) with exists and accepted: a user's own identifiers stay, a model's only if they exist."""
    joined = named.join(known.select(name, "exists_in_files"), name, "left")
    exists = F.coalesce("exists_in_files", F.lit(False))
    return joined.withColumns({"exists_in_files": exists, "accepted": F.col(own) | exists})
