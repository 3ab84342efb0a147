"""Sources and sinks: repository scans, JSON lines with error reports, index tables, guarded writes."""

from __future__ import annotations

import os
import posixpath
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from quern.functions.text import json_value, runtime_id
from quern.operators.corpus import scannable
from quern.sources import snapshots

MAX_FILE_BYTES = 10 * 1024 * 1024
NAMED = 100  # problems that an error message names


def validate_root(spark: SparkSession, root: str) -> str:
    """The root, if it is a directory in its store."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise ValueError(f"not a directory: {root}")
    return fs.makeQualified(path).toString()


def _clean(path: str) -> str:
    """A local or remote path without ``.``, ``..`` and doubled slashes; links of local paths resolved where they exist."""
    scheme, mark, rest = path.partition("://")
    if mark and scheme != "file":
        host, _, rest = rest.partition("/")
        return f"{scheme}://{host}{posixpath.normpath('/' + rest)}"
    return os.path.realpath(rest if mark else path.removeprefix("file:"))


def inside_root(path: str, root: str, allowed: tuple[str, ...] = ()) -> bool:
    """Whether a relative path stays below the root, and the root in one of the allowed ones (if any are named).

    Paths are file names, so ``#``, ``?`` and ``%`` mean nothing in them. Roots are taken without ``..`` and with links resolved,
    and so is the path below a local root.
    """
    plain = path.replace("\\", "/")
    if plain.startswith("/") or (len(plain) > 1 and plain[1] == ":") or "\0" in path or "://" in plain:
        return False
    depth = 0
    for part in plain.split("/"):
        depth += -1 if part == ".." else part not in ("", ".")
        if depth < 0:
            return False
    below = lambda inner, outer: (inner.rstrip("/") + "/").startswith(outer.rstrip("/") + "/")
    clean = _clean(root)
    if "://" not in clean and not below(_clean(os.path.join(clean, plain)), clean):
        return False
    return not allowed or any(below(clean, _clean(a)) for a in allowed)


def scan_repository(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), text, bytes of every file to scan. Too large files are left out before their contents are read."""
    base = validate_root(spark, root)
    prefix = len(base.rstrip("/")) + 1
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).where(F.col("length") <= MAX_FILE_BYTES)
    full = F.regexp_replace("path", "^([a-z]+:)/+", "$1/")
    start = len(base.rstrip("/").replace("///", "/")) + 2 if "///" in base else prefix + 1
    rows = raw.select(F.substr(full, F.lit(start)).alias("path"), "content", F.col("length").alias("bytes"))
    return rows.where(scannable(F.col("path"))).select("path", F.decode("content", "UTF-8").alias("text"), "bytes")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1, in the file), value of every line below ``path``, with files split as Spark splits them.

    A split's rows have rising ids; its first id and its number of lines, a row a split, give where each split's lines begin in
    its file. Splits are planned alike for both passes over the files, which hold the same.
    """
    place = ["_metadata.file_path", "_metadata.file_block_start"]
    lines = spark.read.text(path).select("value", *(F.col(p).alias(n) for p, n in zip(place, ("file", "split"))), F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("file", "split").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("held"))
    before = F.sum("held").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))  # over splits, not lines
    begins = splits.select("file", "split", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(begins, ["file", "split"]).select("file", (F.col("id") - F.col("first") + F.col("before") + 1).alias("line"), "value")


def jsonl_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """file, line, value, r (the parsed row, null for a bad line), blank, bad: a row for every line.

    A line is good if all of it is one JSON object that fits the schema: what follows an object makes it bad.
    """
    lines = numbered_lines(spark, path).withColumn("value", F.when(F.col("line") == 1, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")))
    wide = StructType([*schema.fields]).add("_corrupt", StringType())
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    whole = F.startswith(F.schema_of_variant(json_value(F.col("value"))), F.lit("OBJECT"))
    rows = lines.select("file", "line", "value", parsed.alias("p"), (F.btrim("value") == "").alias("blank"), F.coalesce(whole, F.lit(False)).alias("whole"))
    good = F.col("whole") & F.col("p").isNotNull() & F.col("p._corrupt").isNull()
    fields = F.struct(*(F.col(f"p.`{f.name}`").alias(f.name) for f in schema.fields))
    return rows.select("file", "line", "value", F.when(good, fields).alias("r"), "blank", (~F.col("blank") & ~good).alias("bad"))


def jsonl_problems(rows: DataFrame, strict: bool = False, key: str | None = None) -> DataFrame:
    """problem, file, line, detail (the whole line, or the key): a row for every bad line and, if ``strict``, every blank line and every
    repeated key, at the first line that repeats it (by file and line). Of any number."""
    told = lambda df, name, detail: df.select(F.lit(name).alias("problem"), "file", "line", detail.alias("detail"))
    out = told(rows.where("bad"), "bad_line", F.col("value"))
    if strict:
        out = out.unionByName(told(rows.where("blank"), "blank_line", F.lit("")))
        if key:
            good = rows.where("not blank and not bad").select("file", "line", F.coalesce(F.col(f"r.`{key}`").cast("string"), F.lit("null")).alias("k"))
            twice = good.groupBy("k").agg(F.min(F.struct("file", "line")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
            later = good.join(twice, "k").where(F.struct("file", "line") > F.col("first")).groupBy("k").agg(F.min(F.struct("file", "line")).alias("at"))
            out = out.unionByName(told(later.select("at.file", "at.line", "k"), f"repeated_{key}", F.col("k")))
    return out


def read_jsonl(spark: SparkSession, path: str, schema: StructType, strict: bool = False, key: str | None = None) -> DataFrame:
    """Rows of JSON-lines files. Bad lines raise; ``strict``: blank lines and repeated keys do too.

    The error counts all problems and names the first ``NAMED`` of each kind by line; ``jsonl_problems`` gives every one as a table.
    """
    rows = jsonl_rows(spark, path, schema)
    told = F.struct("file", "line", F.substring("detail", 1, 80).alias("detail"))
    at = F.row_number().over(Window.partitionBy("problem").orderBy("file", "line"))  # Spark keeps NAMED of each kind a task
    problems = jsonl_problems(rows, strict, key)
    counts = problems.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
    some = problems.withColumn("at", at).where(F.col("at") <= NAMED).groupBy("problem").agg(F.array_sort(F.collect_list(told)).alias("some"))
    said = [
        f"{r['problem']} ({r['n']}): " + "; ".join(f"{x['file'].rsplit('/', 1)[-1]}:{x['line']} {x['detail']}".strip() for x in r["some"])
        for r in counts.join(some, "problem").orderBy("problem").collect()
    ]
    if said:
        raise ValueError("\n".join(said))
    return rows.where("not blank").select(*(F.col(f"r.`{f.name}`") for f in schema.fields))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def write_jsonl(rows: DataFrame, path: str, order: str | None = None, append: bool = False, overwrite: bool = False) -> None:
    """JSON lines; existing outputs are an error unless ``overwrite`` or ``append``."""
    mode = "append" if append else "overwrite" if overwrite else "errorifexists"
    (rows.orderBy(order) if order else rows).write.mode(mode).json(path)


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> str:
    """A small text file (a rendered report, a proposal) in any store; an existing one is an error unless ``overwrite``."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    out = fs.create(target, overwrite)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    return path


def markdown_table(rows: DataFrame, title: str, order: list[str]) -> str:
    """A report of a small table (a row a method, a threshold, a label): numbers with four decimals, missing values as dashes."""
    named = rows.orderBy(*order)
    shown = [F.when(F.col(f.name).isNull(), "-").otherwise(F.format_string("%.4f", f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name).cast("string")).alias(f.name) for f in rows.schema.fields]
    lines = [[str(v).replace("|", "\\|").replace("\n", " ") for v in r] for r in named.select(*shown).collect()]
    head = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join([*head, *("| " + " | ".join(x) + " |" for x in lines)]) + "\n"


def write_proposal(spark: SparkSession, folder: str, repository: str, answer: str, name: str = "proposal", now: datetime | None = None) -> str:
    """A generated change as a new file below ``folder``, stamped with the time; never in the repository, never over another."""
    if inside_root(".", folder, (repository,)):
        raise ValueError("a proposal is not written into the repository")
    stamp = (now or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S_%f")
    return write_text(spark, f"{folder.rstrip('/')}/{name}_{stamp}.md", answer)


def index_path(root: str, repository: str) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), runtime_id(F.lit(repository)))


def write_index(rows: DataFrame, path: str, **properties: str | float | int | bool) -> snapshots.Snapshot:
    """A version of an index table with properties, so that a load can reject another model or other parameters. Readers of the version
    before keep it; ``snapshots.vacuum`` deletes old ones."""
    spark = rows.sparkSession
    part = snapshots.write_part(rows, path, "rows")
    return snapshots.commit(spark, snapshots.opened(spark, path), path, {"rows": [part]}, {"rows": rows.schema}, properties)


def read_index(spark: SparkSession, path: str, version: int | None = None, **properties: str | float | int | bool) -> DataFrame:
    """The rows of the last version (or of the one asked for), if it was built with these properties."""
    found = snapshots.opened(spark, path, version)
    if found is None:
        raise FileNotFoundError(path)
    wrong = sorted(k for k, v in properties.items() if found.properties.get(k) != v)
    if wrong:
        raise ValueError(f"the index was built with other properties: {', '.join(wrong)}")
    return found.table(spark, "rows")


def build_or_load(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False, **properties: str | float | int | bool) -> DataFrame:
    """The index at ``path``, built and written first where there is none or ``rebuild`` is set."""
    if rebuild or not snapshots.versions(spark, path):
        write_index(build(), path, **properties)
    return read_index(spark, path, **properties)
