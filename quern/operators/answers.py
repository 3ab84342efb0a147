"""Answers of a model that are asked for once: over reads, lost tasks and restarts.

A store is a folder: ``journal`` holds a small file for every answer the moment it came, named by the prompt's hash, so that a task
that runs again, or a run after a crash, finds it; a finished run commits its answers as a part of a snapshot
(``sources.snapshots``) and removes the journal's files of them. Writing an answer again changes nothing. Failures aren't kept: who
failed is asked again by the next run.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.session import drop, materialise, written
from quern.sources import snapshots

Client = Callable[[str], str]
# The states in which a service asks to be called again.
RETRIED = frozenset({408, 429, 500, 502, 503, 504})
ANSWERS = StructType().add("hash", "string").add("prompt", "string").add("answer", "string").add("error", "string").add("attempts", "long")


class ProviderError(RuntimeError):
    """A service's refusal, with its HTTP status."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(f"HTTP {status} {message}".strip())
        self.status = status


def called(client: Client, prompt: str, attempts: int, accept: Callable[[str], str | None] | None, backoff: float) -> tuple[str | None, str | None, int]:
    """(answer, error, attempts). Rejected answers are tried again at once; failures after a wait that doubles, unless their ``status``
    says that asking again is of no use."""
    error, tries = None, 0
    while tries < attempts:
        tries += 1
        try:
            answer = client(prompt)
            if accept is None or (error := accept(answer)) is None:
                return answer, None, tries
        except Exception as failure:  # the model's failure, whatever it is, must not lose rows
            error = f"{type(failure).__name__}: {failure}"
            status = getattr(failure, "status", None)
            if status is not None and status not in RETRIED:
                break
            if tries < attempts:
                time.sleep(backoff * 2 ** (tries - 1))
    return None, error, tries


class Journal:
    """A file for every answer, in any store that pyarrow opens (local and shared disks, HDFS, object stores)."""

    def __init__(self, folder: str):
        self.store, self.folder = stores.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (stores.LocalFileSystem(), folder)

    def place(self, key: str) -> str:
        return f"{self.folder}/{key[:2]}/{key}.json"

    def get(self, key: str) -> dict | None:
        if self.store.get_file_info(self.place(key)).type != stores.FileType.File:
            return None
        with self.store.open_input_stream(self.place(key)) as f:
            return json.loads(f.read())

    def put(self, key: str, told: dict) -> None:
        self.store.create_dir(f"{self.folder}/{key[:2]}", recursive=True)
        hidden = f"{self.folder}/{key[:2]}/.{uuid.uuid4().hex}"
        with self.store.open_output_stream(hidden) as f:
            f.write(json.dumps(told).encode())
        self.store.move(hidden, self.place(key))  # there as a whole or not at all

    def remove(self, key: str) -> None:
        if self.store.get_file_info(self.place(key)).type == stores.FileType.File:
            self.store.delete_file(self.place(key))


def _key(prompt: str) -> str:
    return hashlib.sha256(prompt.encode("utf-8", "surrogatepass")).hexdigest()


def _told(prompts: DataFrame, client: Client, attempts: int, accept, backoff: float, folder: str | None) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        journal = Journal(folder) if folder else None
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                rows = []
                for prompt in batch.column(0).slice(start, 64).to_pylist():
                    key = _key(prompt)
                    held = journal.get(key) if journal else None
                    if held is not None and held["prompt"] == prompt:
                        rows.append((key, prompt, held["answer"], None, held["attempts"]))
                        continue
                    answer, error, tries = called(client, prompt, attempts, accept, backoff)
                    if journal and answer is not None:
                        journal.put(key, {"prompt": prompt, "answer": answer, "attempts": tries})
                    rows.append((key, prompt, answer, error, tries))
                columns = list(zip(*rows))
                kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=ANSWERS.names)

    return prompts.select("prompt").mapInArrow(run, "hash string, prompt string, answer string, error string, attempts long")


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """hash, prompt, answer, error, attempts of all answers that runs have committed below ``folder``."""
    found = snapshots.opened(spark, folder)
    return spark.createDataFrame([], ANSWERS) if found is None else found.table(spark, "answers")


def answered(prompts: DataFrame, client: Client, attempts: int = 1, accept: Callable[[str], str | None] | None = None, backoff: float = 1.0, folder: str | None = None) -> DataFrame:
    """hash, prompt, answer, error, attempts of the distinct prompts (column ``prompt``, none null), as a written table: reading it calls nobody.

    Without ``folder`` each run asks anew. With it, prompts that have an answer there aren't asked.
    """
    distinct = prompts.select("prompt").where("prompt is not null").distinct()
    if folder is None:
        return written(_told(distinct, client, attempts, accept, backoff, None), "answers")
    spark = prompts.sparkSession
    base = snapshots.opened(spark, folder)
    known = stored(spark, folder)
    new = distinct.join(known.select("prompt"), "prompt", "left_anti")
    fresh, path = materialise(_told(new, client, attempts, accept, backoff, f"{folder}/journal"), "answers")
    good = fresh.where("answer is not null")
    if not good.isEmpty():
        while True:
            part = snapshots.write_part(good, folder, "answers")
            try:
                snapshots.commit(spark, base, folder, {"answers": [*(base.parts["answers"] if base else []), part]}, {"answers": ANSWERS}, {})
                break
            except snapshots.ConflictError:  # another run has committed; its answers stay beside ours
                base = snapshots.opened(spark, folder)

        def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            journal = Journal(f"{folder}/journal")
            for batch in batches:
                for key in batch.column(0).to_pylist():
                    journal.remove(key)
                yield batch

        good.select("hash").mapInArrow(clean, "hash string").write.format("noop").mode("overwrite").save()
    result = distinct.join(stored(spark, folder).dropDuplicates(["prompt"]), "prompt").select(*ANSWERS.names)
    out = written(result.unionByName(fresh.where("answer is null")), "answers")
    drop(spark, path)
    return out
