"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import clear, drop, materialise, shared_dir

__all__ = ["Tables", "clear", "drop", "held", "let_go", "materialise", "parts", "placed", "release", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables:
    """Tables of one run of an operator: those that its result doesn't read go at the end of the block, all of them on an error."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.held: list[tuple[DataFrame, str, bool]] = []

    def __enter__(self) -> Tables:
        return self

    def write(self, df: DataFrame, label: str, keep: bool = False) -> DataFrame:
        """``df`` as a written table; ``keep``: the result reads it."""
        table_, path = materialise(df, label)
        self.held.append((table_, path, keep))
        return table_

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = next(p for d, p, _ in self.held if d is t)
            self.held = [h for h in self.held if h[0] is not t]
            drop(self.spark, path)

    def __exit__(self, kind: object, *_: object) -> None:
        for _, path, keep in self.held:
            if kind is not None or not keep:
                drop(self.spark, path)


def placed(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by place (c0, c1, ...): any names, dots included, pass through Arrow and clash with none."""
    return df.select(*(F.col(f"`{c.replace('`', '``')}`").alias(f"c{i}") for i, c in enumerate(df.columns)))


def parts(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a worker holds few texts as Python objects at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def release() -> None:
    """Gives memory that a worker doesn't use any more back to the system; workers outlive the tasks of many operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_held: list[Any] = [None, None]


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """The large object (a model, a vocabulary) that tasks of an operator share in a worker. A worker holds one: asking for another drops it."""
    if _held[0] != key:
        _held[:] = [None, None]
        release()
        _held[:] = [key, make()]
    return _held[1]


def let_go() -> None:
    """Drops what ``held`` holds in this worker, if anything: for tasks of operators that share no object."""
    if _held[0] is not None:
        _held[:] = [None, None]
        release()
