"""Session construction and table access."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


# A union whose inputs are dealt alike keeps their partitioning in this release, and fails, or joins the wrong rows, once adaptive
# execution deals one of them anew.
UNION = "spark.sql.unionOutputPartitioning"


def get_session(app: str = "quern", cores: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; cluster settings win over these defaults."""
    builder = SparkSession.builder.appName(app)
    if cores:
        builder = builder.master(f"local[{cores}]")
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        UNION: "false",
        "spark.ui.enabled": os.environ.get("QUERN_UI", "false"),
    }
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``; the path may be in any store that Spark reads."""
    spark.conf.set(UNION, "false")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where the scan has fewer partitions than that (one small file); else untouched, without a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores else rows


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches of a task in slices, so that it holds few long texts as Python objects at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


# A scan and a Python worker hold so much of rows that are long lists at a time; a task has several such batches, whatever it reads.
LONG_ROWS = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.parquet.columnarReaderBatchSize": "256"}


@contextlib.contextmanager
def long_rows(spark: SparkSession) -> Iterator[None]:
    """For what runs inside: batches of few rows. By default a scan holds 4,096 rows of a task and a batch 64 MB, in the JVM and in Python."""
    before = {name: spark.conf.get(name, None) for name in LONG_ROWS}
    for name, value in LONG_ROWS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where the setting is absent, one of our own, but on a local master only: on a
    cluster every executor would write to its own disk."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='quern-checkpoint-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_written: set[str] = set()


def materialise(rows: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``rows`` as a table in the shared folder, and its path: cuts lineage, is read as often as wanted, survives lost executors."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/quern-{label}-{uuid.uuid4().hex}"
    try:
        rows.write.parquet(path)
    except BaseException:
        drop(spark, path)
        raise
    _written.add(path)
    return spark.read.schema(rows.schema).parquet(path), path


def written(rows: DataFrame, label: str) -> DataFrame:
    """A table that a result reads; ``clear`` removes it once the result has been used."""
    return materialise(rows, label)[0]


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's path in the shared folder (for an index that a query builds); ``clear`` removes it."""
    path = f"{shared_dir(spark)}/quern-{label}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that ``materialise`` wrote and nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _written.discard(path)


def clear(spark: SparkSession) -> int:
    """Delete all tables that results of this process read, once those results have been used; how many there were."""
    left = sorted(_written)
    for path in left:
        drop(spark, path)
    return len(left)
