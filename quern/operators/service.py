"""Six verbs over indexed repositories: health, index, chat, analyze_log, memory, clear_memory.

``chat`` is one question: the passages that a search finds are the evidence, a model's answer is checked against them, and an
answer whose citations don't hold is repaired once and checked again. Lookups that fail raise LookupError, wrong values
ValueError. What is held here are open repositories and the remembered turns of sessions; data stays in tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import line_array
from quern.operators import evidence, projections, providers, search
from quern.operators.sessions import CHARS, TURNS
from quern.operators.tools import Toolbox
from quern.sources import files

SHOWN, CANDIDATES = 6, 30
NO_EVIDENCE = "No evidence was found for this question."
SESSION = re.compile("[A-Za-z0-9_-]{1,128}")


class Service:
    def __init__(self, spark: SparkSession, client: providers.Client, embedder: providers.Embedder | None = None, allowed: tuple[str, ...] = ()):
        self.spark, self.client, self.embedder, self.allowed = spark, client, embedder, allowed
        self.repositories: dict[str, Toolbox] = {}
        self.sessions: dict[tuple[str, str], list[tuple[str, str]]] = {}

    def health(self) -> dict:
        return {"status": "ok", "repositories": sorted(self.repositories), "sessions": len(self.sessions)}

    def index(self, root: str, index_folder: str | None = None, rebuild: bool = False) -> dict:
        """Scans and indexes a repository below an allowed root; a rebuild forgets its sessions."""
        if not files.inside_root(".", root, self.allowed):
            raise ValueError("the repository isn't below an allowed root")
        base = files.validate_root(self.spark, root)
        name = self.spark.range(1).select(files.index_path("", base)).first()[0].strip("/")
        if name not in self.repositories or rebuild:
            self.repositories[name] = Toolbox(files.scan_repository(self.spark, root), base.rstrip("/").rsplit("/", 1)[-1], self.embedder, f"{index_folder.rstrip('/')}/{name}" if index_folder else None)
            self.sessions = {k: v for k, v in self.sessions.items() if k[0] != name}
        return {"repository_id": name, **self.repositories[name].health()}

    def _box(self, repository: str) -> Toolbox:
        if repository not in self.repositories:
            raise LookupError(f"not indexed: {repository}")
        return self.repositories[repository]

    def _session(self, repository: str, session: str) -> tuple[str, str]:
        if not SESSION.fullmatch(session):
            raise ValueError("a session id has 1 to 128 letters, digits, _ or -")
        self._box(repository)
        return repository, session

    def memory(self, repository: str, session: str) -> dict:
        turns = self.sessions.get(self._session(repository, session), [])
        return {"turn_count": len(turns), "character_count": sum(len(q) + len(a) for q, a in turns), "max_turns": TURNS, "max_chars": CHARS}

    def clear_memory(self, repository: str, session: str) -> bool:
        return self.sessions.pop(self._session(repository, session), None) is not None

    def analyze_log(self, repository: str, log: str, context_lines: int = 8) -> dict:
        return self._box(repository).call("analyze_log", {"log_text": log, "context_lines": context_lines})

    def _checked(self, box: Toolbox, answer: str, hits: DataFrame) -> dict:
        answers = self.spark.createDataFrame([("a", answer)], "id string, text string")
        cited = evidence.extract_citations(answers, "id")
        sizes = box.files.select(F.col("path").alias("file"), F.size(line_array(F.col("text"))).cast("long").alias("total_lines"))
        held = hits.select(F.lit("a").alias("id"), "file", "start_line", "end_line")
        return evidence.citation_report(answers, evidence.check_citations(cited, held, sizes, "id"), "id").first().asDict()

    def chat(self, repository: str, session: str, question: str) -> dict:
        """answer, citation_report, citation_repaired, evidence (previews)."""
        key, box = self._session(repository, session), self._box(repository)
        if not question.strip():
            raise ValueError("the question is blank")
        asked = self.spark.createDataFrame([("q", question)], "query_id string, text string")
        rewritten = providers.rewrite_by_rules(asked, "text").withColumn("should_search", F.lit(True))
        found, _ = search.search(asked, box.passages, box.vectors, "query_id", "chunk_id", search.adapted_ks(SHOWN, CANDIDATES), index=box.index, embedder=box.embedder, rewritten=rewritten)
        rows = found.join(box.chunks, "chunk_id").collect()  # SHOWN rows
        report, repaired = None, False
        if not rows:
            answer = NO_EVIDENCE
        else:
            hits = self.spark.createDataFrame(rows, found.join(box.chunks, "chunk_id").schema)
            block = projections.evidence_block(hits, ["query_id"], "reranker_rank").first()["evidence"]
            before = "\n".join(f"user: {q}\nassistant: {a}" for q, a in self.sessions.get(key, []))
            prompt = f"{before}\n{block}\n\nAnswer with citations [file:first-last].\n{question}".strip()
            answer = self.client(prompt)
            report = self._checked(box, answer, hits)
            if not report["valid"]:
                answer, repaired = self.client(f"{prompt}\n\nThese citations don't hold, use the evidence alone:\n{answer}"), True
                report = self._checked(box, answer, hits)
        turns = [*self.sessions.get(key, []), (question, answer)][-TURNS:]
        while len(turns) > 1 and sum(len(q) + len(a) for q, a in turns) > CHARS:
            turns = turns[1:]
        self.sessions[key] = turns
        shown = [{"file": r["file"], "start_line": r["start_line"], "end_line": r["end_line"], "content_preview": r["content"][: projections.PREVIEW_CHARS]} for r in sorted(rows, key=lambda r: r["reranker_rank"])]
        return {"answer": answer, "citation_report": report, "citation_repaired": repaired, "evidence": shown}
