"""Media columns: texts or bytes kept as FLAC streams, and read back as PCM blocks with seekable sample offsets.

``encode_media`` adds a binary column ``media``; ``decode_media`` returns a row per PCM block; ``media_features`` reads
whole streams back. The codec (``flac_codec``) verifies every frame's checksums and the MD5 of the samples; a stream that
fails raises, since a silently shortened media column would lose rows. Payload: the bytes of the value, padded with bytes
255 to a positive multiple of 576, as 8-bit samples (byte - 128).

Defined results: null and empty values have no bytes of their own and hold one block of padding; a value of any length is
handled (frames go through in groups of a fixed number); equal values give equal streams; rows with the same id stay
separate; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flac_codec
from .common import parts, table

GROUP_BYTES = flac_codec.CHUNK * flac_codec.BLOCK  # payload bytes that go through the codec at a time
SLICE = 1024  # values that a worker holds as Python objects at a time


def pad(value: bytes) -> bytes:
    return value + b"\xff" * (-len(value) % flac_codec.BLOCK or (0 if value else flac_codec.BLOCK))


def _groups(values: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    first, held = 0, 0
    for i, v in enumerate(values):
        if held and held + len(v) > limit:
            yield first, i
            first, held = i, 0
        held += len(v)
    if first < len(values):
        yield first, len(values)


def encode_media(df: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """Rows (id, n_bytes, media) with the FLAC stream of each value (string, as UTF-8, or binary)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, SLICE):
            ids, values = batch.column(0), [v or b"" for v in batch.column(1).to_pylist()]
            for a, b in _groups(values, GROUP_BYTES):
                media = flac_codec.encode([pad(v) for v in values[a:b]])
                sizes = pa.array([len(v) for v in values[a:b]], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), sizes, pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    read = df.select(F.col(id_col).alias("id"), F.col(value_col).cast("binary").alias("value"))
    return read.mapInArrow(run, f"id {kind}, n_bytes long, media binary")


def decode_media(media: DataFrame) -> DataFrame:
    """Rows (id, block, sample_offset, byte_offset, pcm): byte_offset counts from the first frame, as seek points do."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, SLICE):
            ids, streams = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _groups(streams, GROUP_BYTES):
                rows = [(i, n, *r) for i, blocks in zip(ids[a:b], flac_codec.decode(streams[a:b])) for n, r in enumerate(blocks)]
                cols = list(zip(*rows)) or [(), (), (), (), ()]
                kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "block", "sample_offset", "byte_offset", "pcm"]
                )

    kind = media.schema["id"].dataType.simpleString()
    return media.select("id", "media").mapInArrow(run, f"id {kind}, block long, sample_offset long, byte_offset long, pcm binary")


def features(payload: bytes) -> str:
    """Blocks, sum, energy and zero crossings of the samples, as whole numbers."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"blocks={len(x) // flac_codec.BLOCK};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings}"


def media_features(media: DataFrame) -> DataFrame:
    """A row per stream with digests and features of what is read back from it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, SLICE):
            streams = batch.column(2).to_pylist()
            for a, b in _groups(streams, GROUP_BYTES):
                whole = [b"".join(r[2] for r in blocks) for blocks in flac_codec.decode(streams[a:b])]
                cols = [
                    pa.array([len(p) for p in whole], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in whole], pa.string()),
                    pa.array([zlib.crc32(p[-32:]) for p in whole], pa.int64()),
                    pa.array([len(s) for s in streams[a:b]], pa.int64()),
                    pa.array([hashlib.sha256(s).hexdigest() for s in streams[a:b]], pa.string()),
                    pa.array([features(p) for p in whole], pa.string()),
                ]
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *cols], names=["id", "n_bytes", *names]
                )

    kind = media.schema["id"].dataType.simpleString()
    return media.select("id", "n_bytes", "media").mapInArrow(
        run,
        f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string",
    )


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` stored as FLAC and read back."""
    media = encode_media(table(spark, sf_dir, "documents"), "doc_id", "text")
    return media_features(media).withColumnRenamed("id", "doc_id")
