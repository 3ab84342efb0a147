"""Six named functions over a repository table, called by name with JSON-like arguments, answered in one kind of envelope.

A ``Toolbox`` holds a repository as a DataFrame (path, text). Every function is a plan over it whose small result is read for
the caller: a slice of a file, the hits of a search, the frames of a log. Chunks and vectors are written once, to the shared folder;
``quern.session.clear`` removes them. ``call`` never raises: what goes wrong is in the envelope, {ok, tool, result} or
{ok, tool, error_type, error}.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quern.functions.text import line_array, truncate
from quern.operators import corpus, diagnosis, lexical_index, projections, providers, search, static_analysis
from quern.operators.curation import TOOL_ARGUMENTS
from quern.session import written

COMPLETION_LINES, DEPENDENCY_CHARS, ENTRY_CHARS, LOG_CHARS, LISTED = 200, 8000, 6000, 10_000, 200
TRACE = "step long, tool string, arguments map<string,string>, ok boolean, error_type string, error string, milliseconds double"


def parse_arguments(raw: Any) -> dict:
    """Arguments of a model's call: nothing, an object, or the JSON text of one."""
    if raw is None or (isinstance(raw, str) and not raw.strip()):
        return {}
    if isinstance(raw, str):
        try:
            raw = json.loads(raw)
        except ValueError as error:
            raise ValueError(f"arguments aren't JSON: {error}") from error
    if not isinstance(raw, dict):
        raise ValueError("arguments must be an object")
    return raw


def check_arguments(tool: str, arguments: dict) -> None:
    """Names, kinds, blanks and bounds of the tool's arguments; a missing optional one may be null."""
    rules = {name: (kind, required, least, most) for name, kind, required, least, most in TOOL_ARGUMENTS[tool]}
    if unknown := sorted(set(arguments) - set(rules)):
        raise ValueError(f"unknown arguments: {', '.join(unknown)}")
    for name, (kind, required, least, most) in rules.items():
        value = arguments.get(name)
        if value is None:
            if required:
                raise ValueError(f"missing argument: {name}")
            continue
        if isinstance(value, bool) or not isinstance(value, str if kind == "string" else int):
            raise TypeError(f"{name} must be a {kind}")
        if kind == "string" and not value.strip():
            raise ValueError(f"{name} must not be blank")
        if (least is not None and value < least) or (most is not None and value > most):
            raise ValueError(f"{name} is out of range")


class Toolbox:
    """The functions of one repository. files: path, text; chunks, vectors and index are made from it where they aren't given."""

    def __init__(self, files: DataFrame, name: str = "repository", embedder: providers.Embedder | None = None, index_path: str | None = None):
        self.files, self.name, self.embedder = files.select("path", "text"), name, embedder or providers.hash_embedder()
        chunks = corpus.chunk_table(files).where(corpus.indexable(F.col("file"), F.col("content")))
        self.chunks = written(chunks, "chunks")  # every call reads them, none makes them anew
        kind, named = F.col("chunk_type"), F.coalesce("name", F.lit(""))
        self.passages = self.chunks.select("chunk_id", corpus.lexical_passage(F.col("file"), kind, named, F.col("content")).alias("text"))
        self.vectors = written(providers.embed(self.passages, "text", self.embedder).select("chunk_id", "embedding"), "vectors")
        self.index = lexical_index.write_lexical_index(self.passages, "chunk_id", index_path, overwrite=True) if index_path else None
        self.trace: list[tuple] = []
        self.tools: dict[str, Callable[..., dict]] = {
            "search_codebase": self.search_codebase, "analyze_code": self.analyze_code, "analyze_log": self.analyze_log,
            "complete_code": self.complete_code, "generate_tests": self.generate_tests, "generate_dockerfile": self.generate_dockerfile,
        }

    def call(self, tool: str, arguments: Any = None) -> dict:
        """The envelope of one call; unknown tools, wrong arguments and failures are told in it."""
        began, given = time.perf_counter(), {}
        try:
            if tool not in self.tools:
                raise LookupError(f"unknown tool: {tool}")
            given = parse_arguments(arguments)
            check_arguments(tool, given)
            out = {"ok": True, "tool": tool, "result": self.tools[tool](**{k: v for k, v in given.items() if v is not None})}
        except Exception as error:  # whatever it is, the caller reads it in the envelope
            out = {"ok": False, "tool": tool, "error_type": type(error).__name__, "error": str(error)}
        shown = {k: f"<log: {len(v)} characters>" if k == "log_text" and isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in given.items()}
        spent = 1000 * (time.perf_counter() - began)
        self.trace.append((len(self.trace) + 1, tool, shown, out["ok"], out.get("error_type"), out.get("error"), spent))
        return out

    def trace_table(self) -> DataFrame:
        """A row per call so far, logs told by their length alone."""
        return self.files.sparkSession.createDataFrame(self.trace, TRACE)

    def _lines(self, path: str, first: int, last: int | None, most: int = corpus.TOOL_CHARS, numbered: bool = True) -> dict:
        one = corpus.file_slices(self.files.where(F.col("path") == path), "path", first, last)
        content = truncate(F.col("content"), most, corpus.MARKER)
        shown = F.when(F.col("end_line") >= F.col("start_line"), corpus.numbered(content, first)).otherwise("") if numbered else content
        row = one.select("path", "start_line", "end_line", "total_lines", shown.alias("content")).first()
        if row is None:
            raise FileNotFoundError(path)
        return {"file": row["path"], **{c: row[c] for c in ("start_line", "end_line", "total_lines", "content")}}

    def search_codebase(self, query: str, top_k: int = search.TOP_K) -> dict:
        asked = self.files.sparkSession.createDataFrame([("q", query)], "query_id string, text string")
        found = providers.rewrite_by_rules(asked, "text").withColumn("should_search", F.lit(True))
        hits, _ = search.search(asked, self.passages, self.vectors, "query_id", "chunk_id", search.adapted_ks(top_k), index=self.index, embedder=self.embedder, rewritten=found)
        rows = projections.pruned_hits(hits.join(self.chunks, "chunk_id").orderBy("reranker_rank")).collect()
        return {"query": query, "results": [r.asDict(True) for r in rows]}

    def _analysis(self, path: str) -> Row:
        row = static_analysis.python_analysis(self.files.where(F.col("path") == path), "path").first()
        if row is None:
            raise FileNotFoundError(path)
        if row["error"]:
            raise ValueError(row["error"])
        return row

    def analyze_code(self, relative_path: str) -> dict:
        whole = self._analysis(relative_path).asDict(True)
        counts = {f"{c}_count": len(whole[c]) for c in ("imports", "classes", "functions", "warnings")}
        functions = [{k: v for k, v in f.items() if k != "arguments"} for f in whole["functions"]]
        return {**whole, "functions": functions, "imports": whole["imports"][: projections.IMPORTS], "summary": counts}

    def analyze_log(self, log_text: str, context_lines: int = 8) -> dict:
        log = self.files.sparkSession.createDataFrame([("log", log_text)], "id string, text string")
        told, frames = diagnosis.analysed_logs(log, self.files, "id", context=context_lines)
        rows = [{k: v for k, v in r.asDict(True).items() if k != "id"} for r in frames.orderBy("n").collect()]
        first = told.first()
        cut = log.select(truncate(F.col("text"), LOG_CHARS, corpus.MARKER)).first()[0]
        return {"exception_type": first["exception_type"], "exception_message": first["exception_message"], "frame_count": len(rows), "frames": rows, "raw_log": cut}

    def complete_code(self, relative_path: str, instruction: str, start_line: int = 1, end_line: int | None = None) -> dict:
        last = start_line + COMPLETION_LINES - 1 if end_line is None else end_line
        return {"task_type": "code_completion", "instruction": instruction.strip(), "target_file": relative_path, "existing_code": self._lines(relative_path, start_line, last)}

    def generate_tests(self, relative_path: str, target_name: str | None = None) -> dict:
        analysis = self._analysis(relative_path).asDict(True)
        return {"task_type": "test_generation", "target_file": relative_path, "target_name": target_name, "analysis": analysis, "source": self._lines(relative_path, 1, None)}

    def generate_dockerfile(self, entrypoint: str | None = None, python_version: str = "3.11") -> dict:
        present = lambda names: [r["path"] for r in diagnosis.present_files(self.files, names).orderBy("preference").collect()]
        entries, needs = present(diagnosis.ENTRY_FILES), present(diagnosis.DEPENDENCY_FILES)
        listed = [r["path"] for r in self.files.select("path").orderBy("path").limit(LISTED).collect()]
        return {
            "task_type": "dockerfile_generation", "repository_name": self.name, "python_version": python_version.strip(), "requested_entrypoint": entrypoint,
            "selected_entrypoint": entrypoint or (entries[0] if entries else None), "possible_entrypoints": entries,
            "dependency_files": {p: self._lines(p, 1, None, DEPENDENCY_CHARS, False) for p in needs},
            "entrypoint_files": {p: self._lines(p, 1, None, ENTRY_CHARS, False) for p in entries}, "repository_files": listed,
        }

    def health(self) -> dict:
        stats = self.files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(line_array(F.col("text")))), F.lit(0)).alias("lines")).first()
        return {"repository": self.name, "files": stats["n"], "total_lines": stats["lines"], "chunks": self.chunks.count(), "indexed": self.index is not None}
