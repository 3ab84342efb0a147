"""Versioned sets of tables with an atomic commit.

Below a folder, ``data`` holds parquet parts that are written once and never changed, ``versions`` a small manifest a version. A
manifest names the parts of each table and is written last, under another name, and then renamed; so a version is there as a whole
or not at all. A build that dies leaves parts that no manifest names, readers keep the version that they opened, and of two builds from
the same version the second to commit fails. ``vacuum`` deletes what the last versions don't name.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class ConflictError(RuntimeError):
    """Another writer has committed since the version that this one started from."""


@dataclass(frozen=True)
class Snapshot:
    """A version of the tables at ``path``: parts and schema of each table, and properties of the whole."""

    path: str
    version: int = 0
    parts: dict[str, list[str]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    properties: dict[str, Any] = field(default_factory=dict)

    def schema(self, name: str) -> StructType:
        return StructType.fromJson(json.loads(self.schemas[name]))

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        schema = self.schema(name)
        if not self.parts[name]:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*(f"{self.path}/data/{p}" for p in self.parts[name]))


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, target = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def read_small(spark: SparkSession, path: str) -> str:
    fs, target = _fs(spark, path)
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all; FileExistsError if it is there already."""
    jvm = spark.sparkContext._jvm
    fs, target = _fs(spark, path)
    hidden = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(hidden, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(fs.makeQualified(hidden), fs.makeQualified(target), options)
    except Py4JJavaError as e:
        fs.delete(hidden, False)
        if "AlreadyExists" in e.java_exception.getClass().getName():
            raise FileExistsError(path) from e
        raise


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in names(spark, f"{path}/versions") if n[:1].isdigit()]


def opened(spark: SparkSession, path: str, version: int | None = None) -> Snapshot | None:
    """The last version, or the one asked for; None if nothing was committed yet."""
    held = versions(spark, path)
    if version is None and not held:
        return None
    version = held[-1] if version is None else version
    if version not in held:
        raise FileNotFoundError(f"version {version} of {path}")
    told = json.loads(read_small(spark, f"{path}/versions/{version:010d}.json"))
    return Snapshot(path, version, told["parts"], told["schemas"], told["properties"])


def write_part(rows: DataFrame, path: str, name: str) -> str:
    """Writes ``rows`` as a new part below ``path``; nothing reads it before a commit names it."""
    part = f"{name}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/data/{part}")
    return part


def part_table(spark: SparkSession, path: str, part: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/data/{part}")


def commit(spark: SparkSession, base: Snapshot | None, path: str, parts: dict[str, list[str]], schemas: dict[str, StructType], properties: dict[str, Any]) -> Snapshot:
    """The version after ``base`` (the first if None); ConflictError if there is one already."""
    version = (base.version if base else 0) + 1
    told = {n: json.dumps(s.jsonValue()) for n, s in schemas.items()}
    if held := versions(spark, path):
        if held[-1] >= version:
            raise ConflictError(f"version {version} of {path} is there already")
    try:
        write_new(spark, f"{path}/versions/{version:010d}.json", json.dumps({"parts": parts, "schemas": told, "properties": properties}, sort_keys=True))
    except FileExistsError as e:
        raise ConflictError(f"version {version} of {path} is there already") from e
    return Snapshot(path, version, parts, told, properties)


def vacuum(spark: SparkSession, path: str, keep: int = 1, grace: float = 86_400) -> list[str]:
    """Deletes all versions but the last ``keep``, and parts that none of these names and that are older than ``grace`` seconds
    (a build that runs now has written parts that no version names yet). Returns the names of the deleted parts."""
    held = versions(spark, path)
    if keep < 1:
        raise ValueError("at least one version is kept")
    used = {p for v in held[-keep:] for parts in opened(spark, path, v).parts.values() for p in parts}
    fs, _ = _fs(spark, path)
    for v in held[:-keep]:
        fs.delete(_fs(spark, f"{path}/versions/{v:010d}.json")[1], False)
    gone = []
    for part in names(spark, f"{path}/data"):
        target = _fs(spark, f"{path}/data/{part}")[1]
        if part not in used and fs.getFileStatus(target).getModificationTime() / 1000 <= time.time() - grace:
            fs.delete(target, True)
            gone.append(part)
    return gone
