"""Python sources: chunks at definitions, and static analysis. Parsing needs the language's own parser, so it runs in Arrow
batches; everything behind it (counts, thresholds, ranking) is DataFrame code."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import sliced

LONG_FUNCTION, HIGH_COMPLEXITY = 50, 10
UNPARSED = (SyntaxError, ValueError, MemoryError, RecursionError)  # the parser's stack overflows on texts that nest too deep
_ABSOLUTE = re.compile(r"[A-Za-z]:[\\/]|/")
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.IfExp, ast.ExceptHandler)
ANALYSIS_SCHEMA = (
    "total_lines bigint, imports array<struct<module:string,name:string,alias:string,line:bigint,import_type:string>>, "
    "classes array<struct<name:string,line:bigint,end_line:bigint,decorators:array<string>>>, "
    "functions array<struct<name:string,type:string,class_name:string,line:bigint,end_line:bigint,length:bigint,"
    "complexity:bigint,decorators:array<string>,arguments:array<struct<name:string,default:string>>>>, "
    "warnings array<struct<type:string,line:bigint,detail:string>>"
)


def complexity(node: ast.AST) -> int:
    """One, and one for each branch and each further operand of a boolean operator, nested definitions included."""
    total = 1
    for n in ast.walk(node):
        total += isinstance(n, _BRANCHES)
        if isinstance(n, ast.BoolOp):
            total += len(n.values) - 1
    return total


def _arguments(node: ast.FunctionDef | ast.AsyncFunctionDef) -> list[tuple[ast.arg, ast.expr | None]]:
    a = node.args
    plain = a.posonlyargs + a.args
    padded: list[ast.expr | None] = [None] * (len(plain) - len(a.defaults))
    return [*zip(plain, padded + a.defaults), *zip(a.kwonlyargs, a.kw_defaults)]


def _mutable(value: ast.expr | None) -> bool:
    if isinstance(value, ast.Call):
        return isinstance(value.func, ast.Name) and value.func.id in ("list", "dict", "set")
    return isinstance(value, (ast.List, ast.Dict, ast.Set))


def analyse_source(source: str) -> dict:
    """Imports, classes, functions and warnings in document order. Raises ValueError where the source doesn't parse."""
    try:
        tree = ast.parse(source)
    except UNPARSED as error:
        raise ValueError(f"line {getattr(error, 'lineno', None)}: {error}") from error
    out: dict = {"total_lines": len(source.splitlines()), "imports": [], "classes": [], "functions": [], "warnings": []}

    def warn(kind: str, line: int, detail: str) -> None:
        out["warnings"].append({"type": kind, "line": line, "detail": detail})

    def visit(node: ast.AST, inside: str | None) -> None:
        if isinstance(node, ast.Import):
            for n in node.names:
                out["imports"].append({"module": n.name, "name": n.asname, "alias": None, "line": node.lineno, "import_type": "import"})
            return
        if isinstance(node, ast.ImportFrom):
            for n in node.names:
                out["imports"].append({"module": node.module or "", "name": n.name, "alias": n.asname, "line": node.lineno, "import_type": "from_import"})
            return
        if isinstance(node, ast.Constant):
            if isinstance(node.value, str) and _ABSOLUTE.match(node.value):
                warn("hardcoded_path", node.lineno, node.value)
            return
        if isinstance(node, ast.ClassDef):
            inside = node.name
            out["classes"].append({"name": node.name, "line": node.lineno, "end_line": node.end_lineno, "decorators": [ast.unparse(d) for d in node.decorator_list]})
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            length, paths = node.end_lineno - node.lineno + 1, complexity(node)
            given = _arguments(node)
            out["functions"].append(
                {
                    "name": node.name, "type": "function" if isinstance(node, ast.FunctionDef) else "async_function", "class_name": inside,
                    "line": node.lineno, "end_line": node.end_lineno, "length": length, "complexity": paths,
                    "decorators": [ast.unparse(d) for d in node.decorator_list],
                    "arguments": [{"name": a.arg, "default": ast.unparse(d) if d is not None else None} for a, d in given],
                }
            )
            if length > LONG_FUNCTION:
                warn("long_function", node.lineno, f"{node.name}:{length}")
                if paths > HIGH_COMPLEXITY:
                    warn("high_complexity", node.lineno, f"{node.name}:{paths}")
            for a, d in given:
                if _mutable(d):
                    warn("mutable_default", a.lineno, f"{node.name}:{a.arg}")
        elif isinstance(node, ast.ExceptHandler) and len(node.body) == 1:
            only = node.body[0]
            if isinstance(only, ast.Pass) or (isinstance(only, ast.Expr) and isinstance(only.value, ast.Constant) and only.value.value is Ellipsis):
                warn("empty_except", node.lineno, "")
        for child in ast.iter_child_nodes(node):
            visit(child, inside)

    visit(tree, None)
    return out


def chunk_source(source: str, chunk_lines: int = 80, overlap: int = 10) -> list[tuple[int, int, str, str | None, str]]:
    """(start, end, type, name, content): top-level definitions with their decorators, non-blank code between them; sources
    without definitions, or that don't parse, in line windows."""
    lines = source.splitlines(keepends=True)
    if not lines:
        return []
    try:
        nodes = [n for n in ast.parse(source).body if isinstance(n, _DEFS)]
    except UNPARSED:
        nodes = []
    if not nodes:
        starts = range(0, max(len(lines) - overlap, 1), chunk_lines - overlap)
        return [(s + 1, min(s + chunk_lines, len(lines)), "python_text", None, "".join(lines[s : s + chunk_lines])) for s in starts]
    out, line = [], 1

    def between(a: int, b: int) -> None:
        content = "".join(lines[a - 1 : b])
        if content.strip():
            out.append((a, b, "python_module", None, content))

    for n in nodes:
        start = min([n.lineno, *(d.lineno for d in n.decorator_list)])
        between(line, start - 1)
        kind = "class" if isinstance(n, ast.ClassDef) else "async_function" if isinstance(n, ast.AsyncFunctionDef) else "function"
        out.append((start, n.end_lineno, kind, n.name, "".join(lines[start - 1 : n.end_lineno])))
        line = n.end_lineno + 1
    between(line, len(lines))
    return out


def python_chunks(files: DataFrame, file: str = "file", text: str = "text", chunk_lines: int = 80, overlap: int = 10) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [(f, *c) for f, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for c in chunk_source(t or "", chunk_lines, overlap)]
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["file", "start_line", "end_line", "chunk_type", "name", "content"])

    read = files.select(F.col(file).alias("file"), F.col(text).alias("text"))
    return read.mapInArrow(run, "file string, start_line long, end_line long, chunk_type string, name string, content string")


def python_analysis(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """file, error, and the analysis; a source that doesn't parse has an error and nulls."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found, errors = [], []
            for t in batch.column(1).to_pylist():
                try:
                    found.append(json.dumps(analyse_source(t or "")))
                    errors.append(None)
                except (ValueError, RecursionError) as error:
                    found.append(None)
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(errors, pa.string()), pa.array(found, pa.string())], names=["file", "error", "j"])

    read = files.select(F.col(file).alias("file"), F.col(text).alias("text"))
    parsed = read.mapInArrow(run, "file string, error string, j string")
    return parsed.select("file", "error", F.from_json("j", ANALYSIS_SCHEMA).alias("a")).select("file", "error", "a.*")


def analysis_summary(analysed: DataFrame) -> DataFrame:
    """Counts a file, and its most complex function."""
    return analysed.select(
        "file",
        *(F.size(c).cast("long").alias(c) for c in ("imports", "classes", "functions", "warnings")),
        F.array_max(F.transform("functions", lambda f: f["complexity"])).alias("max_complexity"),
    )
