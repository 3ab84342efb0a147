"""Many texts looked for in many texts at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.session import sliced

BLOCK_TEXTS, BLOCK_CHARS = 50_000, 8_000_000  # texts looked for together, and their characters, about
LEAST_BITS, BITS = 12, 26  # of the bitmap of hashes: as many as the asked texts need, at most 8 MB
WORDS, WORD_CHARS, PIECE_CHARS = 200_000, 64, 1 << 18  # words that a task remembers, their length, and characters looked through together
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd, so that BASE has an inverse modulo 2 ** 64
BLANK = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"  # what str.split() splits at


class _Windows:
    """Hashes of all windows of a length in some pieces of text: differences of one running sum, brought to the same power."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(max(n, PIECE_CHARS), base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def of(self, pieces: list[str], lengths: list[int], bits: int) -> Iterator[tuple[int, np.ndarray, str, np.ndarray]]:
        """length, the hashes of its windows by where they begin in the joined pieces, these, and where each piece ends. ``lengths`` ascend."""
        pieces = sorted(pieces, key=len, reverse=True)
        sizes = np.array([len(x) for x in pieces], dtype=np.int64)
        joined, ends = "".join(pieces), np.cumsum(sizes)
        self._powers(len(joined) + 1)
        code = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        total = np.zeros(len(code) + 1, dtype=np.uint64)
        np.cumsum(code * self.up[: len(code)], out=total[1:])
        for n in lengths:
            long = int(np.searchsorted(-sizes, -n, side="right"))  # pieces of that length or more
            if not long:
                break
            last = int(ends[long - 1]) - n + 1
            hashed = (total[n : last + n] - total[:last]) * self.down[:last] * np.uint64(MIX)
            yield n, (hashed >> np.uint64(64 - bits)).astype(np.int64), joined, ends


def _bitmap(asked: DataFrame, bits: int) -> np.ndarray:
    """Packed bits, set at the hash of each asked text (one column)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, marks = _Windows(), np.zeros(1 << (bits - 6), dtype=np.int64)
        for batch in sliced(batches, 4096):
            by_length: dict[int, list[str]] = {}
            for x in batch.column(0).to_pylist():
                by_length.setdefault(len(x), []).append(x)
            for n, same in by_length.items():
                step = max(1, PIECE_CHARS // n)
                for i in range(0, len(same), step):
                    for _, spots, *_ in windows.of(same[i : i + step], [n], bits):
                        spots = spots[::n]  # the windows that are whole pieces
                        np.bitwise_or.at(marks, spots >> 6, np.int64(1) << (spots & 63))
        at = np.flatnonzero(marks)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(marks[at])], names=["word", "mask"])

    found = asked.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[found["word"].to_numpy()] = found["mask"].to_numpy()
    return out.view(np.uint8)


def held_texts(texts: DataFrame, text: str, asked: DataFrame, asked_text: str) -> DataFrame:
    """Column ``t``: the asked texts, each once, that some text holds. One pass over the texts, however many are asked.

    A text holds an asked one without blanks if one of its words does. So a task looks through each word that is new to it, and through
    whole texts only for asked ones with blanks: at all windows of the lengths that are asked, whose hashes a bitmap of the asked ones
    lets pass. What passes is cut out, and joined with the asked texts, which decides.
    """
    own = asked.select(F.col(asked_text).alias("t")).where("t is not null").distinct()
    apart = F.rlike("t", F.lit(BLANK))
    counts = own.groupBy(F.length("t").alias("n"), apart.alias("apart")).agg(F.count(F.lit(1)).alias("c")).collect()
    bits = min(BITS, max(LEAST_BITS, (32 * sum(r["c"] for r in counts)).bit_length()))
    inside, across = (sorted(r["n"] for r in counts if r["n"] and r["apart"] == x) for x in (False, True))
    shared = texts.sparkSession.sparkContext.broadcast(_bitmap(own.where("t <> ''"), bits))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, known, told, met = _Windows(), shared.value, set(), set()

        def passing(pieces: Iterable[str], lengths: list[int]) -> Iterator[str]:
            group, size = [], 0
            for piece in (*pieces, None):
                if group and (piece is None or size + len(piece) > PIECE_CHARS):
                    for n, spots, joined, ends in windows.of(group, lengths, bits):
                        at = np.flatnonzero(known[spots >> 3] >> (spots & 7).astype(np.uint8) & 1)
                        at = at[at + n <= ends[np.searchsorted(ends, at, side="right")]]  # not across two pieces
                        yield from (joined[i : i + n] for i in at.tolist())
                    group, size = [], 0
                if piece:
                    group.append(piece)
                    size += len(piece)

        for batch in sliced(batches):
            rows = batch.column(0).to_pylist()
            found = {""} if rows else set()
            if inside:
                words: set[str] = set()
                for x in rows:
                    words.update(x.split())
                words -= met
                found.update(passing(words, inside))
                if len(met) + len(words) > WORDS:
                    met.clear()
                met.update(w for w in words if len(w) <= WORD_CHARS)
            if across:
                found.update(passing(rows, across))
            found -= told
            if len(told) + len(found) > WORDS:
                told.clear()
            told |= found
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], names=["t"])

    passed = texts.select(F.col(text).alias("x")).where("x is not null").mapInArrow(run, "t string")
    return own.join(passed, "t", "left_semi")


def held_in(texts: DataFrame, asked: DataFrame, key: str | None, text: str, asked_key: str, asked_text: str) -> DataFrame:
    """Rows (asked_key, key) for every text that holds an asked one; without ``key``, asked_key once or more.

    Asked texts go out in blocks of bounded size as one automaton, which reads each text once however many are asked; without ``key``,
    see ``held_texts``. Null texts hold nothing; an empty asked text is held by every text that isn't null; null asked texts are held by none.
    """
    if not key:
        held = held_texts(texts, text, asked, asked_text)
        return asked.join(held.withColumnRenamed("t", "_held"), F.col(asked_text) == F.col("_held"), "left_semi").select(asked_key)
    kind, arrow = asked.schema[asked_key].dataType.simpleString(), to_arrow_type(asked.schema[asked_key].dataType)
    own = asked.select(F.col(asked_key).alias("k"), F.col(asked_text).alias("t")).where("t is not null")
    size = own.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // BLOCK_TEXTS), -(-size["chars"] // BLOCK_CHARS))
    read = texts.select(F.col(key).alias("d"), F.col(text).alias("x")).where("x is not null")
    schema = f"k {kind}, d {texts.schema[key].dataType.simpleString()}"
    out = None
    for block in range(blocks):
        rows = [(r["k"], r["t"]) for r in own.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == block).collect()]
        shared = texts.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder, empty = ahocorasick.Automaton(), []
            for i, (_, t) in enumerate(shared.value):
                if t:
                    finder.add_word(t, [*finder.get(t, []), i])
                else:
                    empty.append(i)
            if len(finder):
                finder.make_automaton()
            keys = [k for k, _ in shared.value]
            for batch in sliced(batches):
                of, found = [], []
                for d, x in enumerate(batch.column(1).to_pylist()):
                    here = set(empty)
                    if len(finder):
                        for _, same in finder.iter(x):
                            here.update(same)
                    of += [d] * len(here)
                    found += [keys[i] for i in sorted(here)]
                yield pa.RecordBatch.from_arrays([pa.array(found, arrow), batch.column(0).take(pa.array(of, pa.int64()))], names=["k", "d"])

        part = read.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.toDF(asked_key, key)
