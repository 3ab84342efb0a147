"""Benchmark decontamination: passages of items within a bounded edit distance, found by CGK embedding and bit sampling.

Texts and items become tokens: ASCII letters lower-cased, ASCII punctuation and white space as separators. A match is a run
of a document's tokens whose edit distance (insert, delete, replace a token) to a whole item is at most
``floor(RATIO * tokens of the item)``.

CGK walk: at step j the embedding emits the token under the pointer, and the pointer moves on if a random bit of
(step, token) is set. Two strings a few edits apart re-align soon, so edit distance shows as few differing coordinates.
Items are put in classes of like length; every token of a document starts a window of the class's length, walked to its end
(two steps a token). Keys are hashes of SAMPLED coordinates of the walk, drawn from the whole walk, its first half and its
first few steps, KEYS for each of WALKS walks. An item's windows begin at every ANCHOR-th token of it, so that edits that
destroy one part of it leave the walks over the others as they were. Equal keys are candidates, and each is verified by a
bit-parallel edit distance search over the tokens around it. Recall of the walk alone is at least 0.9 for edits up to the
bound at the head, middle or tail or spread, dropped, replaced or inserted (README, measured in the tests).

What the walk misses is found by pieces: an item allowed e edits is cut into e + 1 disjoint pieces of like length, one of
which every match holds unedited; the hash of each piece is looked up at every token of a document. So no match within the
distance is lost, wherever its edits are.

Windows with more tokens foreign to the class's items than the distance allows can't match and are not walked.

Items go through in blocks of ITEM_BLOCK items or ITEM_CHARS characters, which bounds what executors receive; documents are read once for each block.

Defined results: null and empty texts and items without tokens match nothing; texts of any length are searched whole;
repeated rows are searched each; repeated items each match; null ids pass through; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, parts, placed, table

RATIO = 0.2
WALKS, KEYS, SAMPLED, ANCHOR = 3, 9, 5, 4
ITEM_BLOCK, ITEM_CHARS = 20_000, 4_000_000  # items of a block, and their characters, about
CHUNK = 400_000  # tokens walked together
WIDEST = 8  # tokens of a piece that are hashed at most; fewer give more candidates, not fewer matches
HITS = 1_000_000  # candidates expanded together
_SPLIT = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_SPLIT).split() if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    return (x ^ (x >> np.uint64(29))) * _M2


def search(pattern: list[int], text: list[int], most: int) -> tuple[int, int] | None:
    """(distance, end) of the best match of the whole pattern ending anywhere in text, if within ``most``; Myers' bit vectors."""
    m = len(pattern)
    where: dict[int, int] = {}
    for i, t in enumerate(pattern):
        where[t] = where.get(t, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, (m, 0)
    for j, t in enumerate(text):
        eq = where.get(t, 0)
        x = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(x | plus)), plus & x
        score += 1 if up & top else -1 if down & top else 0
        up, down = (up << 1) & full, (down << 1) & full
        keep = eq | minus
        plus, minus = down | (full & ~(keep | up)), up & keep
        if score < best[0]:
            best = (score, j + 1)
    return best if best[0] <= most else None


def _run_keys(names: list[np.ndarray]) -> np.ndarray:
    """Hashes of runs of tokens: names[j] are those of the j-th tokens."""
    key = np.full(len(names[0]), len(names), dtype=np.uint64)
    for name in names:
        key = (key ^ name) * _M1
        key ^= key >> np.uint64(32)
    return key * _M2


def _table(column: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys, where each was, and a bitmap of their first bits."""
    order = np.argsort(column, kind="stable")
    seen = np.zeros(1 << bits, dtype=bool)
    seen[(column >> np.uint64(64 - bits)).astype(np.int64)] = True
    return column[order], order, seen


def _equal(column: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in column, places in the table) of equal keys, about HITS at a time."""
    sorted_, order, seen = table
    maybe = np.flatnonzero(seen[(column >> np.uint64(64 - int(len(seen)).bit_length() + 1)).astype(np.int64)])
    a = np.searchsorted(sorted_, column[maybe], side="left")
    n = np.searchsorted(sorted_, column[maybe], side="right") - a
    maybe, a, n = maybe[n > 0], a[n > 0], n[n > 0]
    group = np.cumsum(n) // HITS
    for first, last in zip(*(np.searchsorted(group, np.unique(group), side=side) for side in ("left", "right"))):
        m, f, k = maybe[first:last], a[first:last], n[first:last]
        inside = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        yield np.repeat(m, k), order[np.repeat(f, k) + inside]


class Items:
    """Embedded items of a block."""

    def __init__(self, rows: list[tuple[object, str]], ratio: float = RATIO, by_pieces: bool = True):
        rows = [(i, t) for i, text in rows if (t := tokens(text))]
        self.ids = [i for i, _ in rows]
        self.vocabulary: dict[bytes, int] = {}
        self.items = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in t] for _, t in rows]
        self.most = [int(ratio * len(t)) for t in self.items]
        base = np.array([0, *(xxhash.xxh3_64_intdigest(w) for w in self.vocabulary)], dtype=np.uint64)
        self.name = _mix(base + _M1)  # of each token id
        self.bits = [_mix(base * np.uint64(2 * r + 1) + np.uint64(977 * (r + 1))) for r in range(WALKS)]
        self.holds = [frozenset(t) for t in self.items]
        self.classes = []
        self.class_of = np.zeros(len(self.items), dtype=np.int64)
        longest, lo = max(map(len, self.items), default=0), 1
        while lo <= longest:
            hi = max(lo, int(lo * 1.25))
            own = [i for i, t in enumerate(self.items) if lo <= len(t) <= hi]
            if own:
                self.class_of[own] = len(self.classes)
                self.classes.append(self._class(lo, hi, own))
            lo = hi + 1
        self.pad = longest + 2
        self.lengths, self.edits = np.array([len(t) for t in self.items], dtype=np.int64), np.array(self.most, dtype=np.int64)
        self.pieces = self._pieces() if by_pieces else []

    def _pieces(self) -> list[tuple[int, tuple, np.ndarray]]:
        """For each width of pieces: their hashes as a table, and (item, offset in it) of each."""
        by_width: dict[int, list[tuple[int, int]]] = {}
        for i, t in enumerate(self.items):
            n = min(self.most[i] + 1, len(t))
            own = by_width.setdefault(min(WIDEST, len(t) // n), [])
            own += [(i, p * len(t) // n) for p in range(n)]
        out = []
        for width, whose in sorted(by_width.items()):
            names = self.name[np.array([self.items[i][a : a + width] for i, a in whose], dtype=np.int64)]
            out.append((width, _table(_run_keys([names[:, j] for j in range(width)]), 20), np.array(whose, dtype=np.int64)))
        return out

    def _class(self, lo: int, hi: int, own: list[int]) -> dict:
        known = np.zeros(len(self.name), dtype=np.int32)
        for i in own:
            known[self.items[i]] = 1
        steps = 2 * lo
        rng = np.random.default_rng(lo)
        plans = []
        for r in range(WALKS):
            picks = []
            for k in range(KEYS):
                span = max(1, min(steps, (2 * SAMPLED, steps // 2, steps)[k % 3]))
                picks.append(np.sort(rng.choice(span, SAMPLED, replace=span < SAMPLED)))
            plans.append(np.array(picks))
        starts, whose, flat = [], [], []
        for i in own:
            for a in range(0, len(self.items[i]), max(1, min(ANCHOR, len(self.items[i]) // 7))):
                starts.append(len(flat) + a)
                whose.append((i, a))
            flat += self.items[i] + [0] * (steps + 1)
        c = {"lo": lo, "least": lo - max(self.most[i] for i in own), "known": known, "steps": steps, "plans": plans}
        ids = np.array(flat, dtype=np.int32)
        keys = self.keys(c, ids, np.array(starts, dtype=np.int64))
        c["tables"] = []
        for column in keys:
            c["tables"].append(_table(column, 16))
        c["whose"] = np.array(whose, dtype=np.int64)
        return c

    def keys(self, c: dict, ids: np.ndarray, start: np.ndarray) -> Iterator[np.ndarray]:
        """Key columns of the windows of ids that begin at start, one after another."""
        for r, picks in enumerate(c["plans"]):
            bits = self.bits[r]
            pointer = start.copy()
            used = set(picks.ravel().tolist())
            emitted = {}
            for j in range(c["steps"]):
                token = ids[pointer]
                if j in used:
                    emitted[j] = self.name[token]
                pointer += ((bits[token] >> np.uint64(j)) & np.uint64(1)).astype(np.int64)
            for k, pick in enumerate(picks):
                key = np.full(len(start), 1 + k + 100 * r, dtype=np.uint64)
                for j in pick.tolist():
                    key = (key ^ emitted[j]) * _M1
                    key ^= key >> np.uint64(32)
                yield key * _M2

    def candidates(self, ids: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, position where it would begin) of equal keys, sorted. ids end with padding; texts begin at firsts."""
        n = len(ids) - self.pad
        good, room = [], []  # windows with tokens enough of the class's items, and how many there are before each position
        for c in self.classes:
            total = np.concatenate([[0], np.cumsum(c["known"][ids])])
            start = np.arange(n)
            good.append((total[np.minimum(start + c["lo"], len(ids))] - total[start]) >= c["least"])
            room.append(np.concatenate([[0], np.cumsum(good[-1])]))
        codes = [np.zeros(0, dtype=np.int64)]

        def add(start: np.ndarray, column: np.ndarray, table: tuple, whose: np.ndarray) -> None:
            for at, e in _equal(column, table):
                p = start[at]
                i, a = whose[e, 0], whose[e, 1]
                begin = np.maximum(p - a, firsts[np.searchsorted(firsts, p, side="right") - 1])
                for k in np.unique(self.class_of[i]).tolist():
                    own = self.class_of[i] == k
                    x, at_, most = i[own], begin[own], self.edits[i[own]]
                    kept = room[k][np.minimum(at_ + most + 1, n)] > room[k][np.maximum(at_ - most, 0)]
                    codes.append(np.unique((x[kept] << 32) + at_[kept]))

        for k, c in enumerate(self.classes):
            start = np.flatnonzero(good[k] & (ids[:n] > 0))
            if not len(start):
                continue
            for column, table in zip(self.keys(c, np.concatenate([ids, np.zeros(c["steps"] + 1, np.int32)]), start), c["tables"]):
                add(start, column, table, c["whose"])
        names = self.name[ids]
        for width, table, whose in self.pieces:
            foreign = np.concatenate([[0], np.cumsum(ids == 0)])
            start = np.flatnonzero(foreign[width : n + width] == foreign[:n])
            add(start, _run_keys([names[start + j] for j in range(width)]), table, whose)
        found = np.unique(np.concatenate(codes))
        return found >> 32, found & ((1 << 32) - 1)

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item, distance, first token, last token + 1): the best match of every item found."""
        found: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        if not self.items:
            return [[] for _ in texts]
        get = self.vocabulary.get
        held, bounds, size = [], [], 0
        begins: dict[int, int] = {}
        gap = np.zeros(self.pad, dtype=np.int32)

        def verify(ids: np.ndarray, stretch: tuple[int, int, int, int] | None) -> None:
            if stretch is None:
                return
            i, d, a, b = stretch
            most, m, read = self.most[i], len(self.items[i]), ids[a:b].tolist()
            if sum(map(self.holds[i].__contains__, read)) < m - most:
                return
            hit = search(self.items[i], read, most)
            if hit and (i not in found[d] or hit[0] < found[d][i][0]):
                end, first = a + hit[1], begins[d]
                back = search(self.items[i][::-1], ids[max(a, end - m - most) : end][::-1].tolist(), most)
                found[d][i] = (hit[0], end - (back[1] if back else m) - first, end - first)

        def flush() -> None:
            nonlocal held, bounds, size
            if held:
                ids = np.concatenate(held)
                firsts = [b[1] for b in bounds]
                stretch = None  # (item, text, first token, last token + 1) that candidates ask to search; overlapping ones are one
                for i, at in zip(*(x.tolist() for x in self.candidates(ids, np.array(firsts)))):
                    d, first, last = bounds[bisect_right(firsts, at) - 1]
                    a, b = max(first, at - self.most[i]), min(last, at + len(self.items[i]) + 2 * self.most[i] + 4)
                    if stretch and stretch[:2] == (i, d) and a <= stretch[3]:
                        stretch = (i, d, stretch[2], max(b, stretch[3]))
                        continue
                    verify(ids, stretch)
                    stretch = (i, d, a, b)
                verify(ids, stretch)
            held, bounds, size = [], [], 0

        for d, text in enumerate(texts):
            ids = np.array([get(w, 0) for w in tokens(text)], dtype=np.int32)
            if not len(ids) or not ids.any():
                continue
            bounds.append((d, size, size + len(ids)))
            begins[d] = size
            held += [ids, gap]
            size += len(ids) + self.pad
            if size > CHUNK:
                flush()
        flush()
        return [[(i, *v) for i, v in sorted(f.items())] for f in found]


def char_span(text: str, first: int, last: int) -> tuple[int, int]:
    """Code points of the tokens first to last - 1."""
    raw = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_SPLIT))]
    a, b = spans[max(0, first)][0], spans[min(len(spans), last) - 1][1]
    return len(raw[:a].decode("utf-8", "surrogatepass")), len(raw[:b].decode("utf-8", "surrogatepass"))


def item_blocks(items: DataFrame, item_id: str, item_text: str) -> Iterator[list[tuple[object, str]]]:
    """Rows of the items, about ITEM_BLOCK or ITEM_CHARS at a time; an item is never cut."""
    rows = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).where("text is not null")
    held = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, ceil(held["n"] / ITEM_BLOCK), ceil(held["chars"] / ITEM_CHARS))
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        yield sorted(((r["id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, *([] if r[0] is None else [r[0]]), r[1]))


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", ratio: float = RATIO) -> DataFrame:
    """Rows (doc_id, item_id, distance, item_tokens, start, end) for every document and item that match; best match each."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in item_blocks(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], shared=shared, name=("items", uuid.uuid4().hex)) -> Iterator[pa.RecordBatch]:
            own = held(name, lambda: Items(shared.value, ratio))
            for batch in parts(batches):
                texts = batch.column(1).to_pylist()
                of, rows = [], []
                for d, found in enumerate(own.find(texts)):
                    for i, distance, first, last in found:
                        of.append(d)
                        rows.append((own.ids[i], distance, len(own.items[i]), *char_span(texts[d], first, last)))
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(of)), pa.array(cols[0]), *(pa.array(c, pa.int64()) for c in cols[1:])],
                        names=["doc_id", "item_id", "distance", "item_tokens", "start", "end"],
                    )

        part = read.mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, distance long, item_tokens long, start long, end long")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", ratio: float = RATIO) -> DataFrame:
    """The rows of ``docs``, all columns, that match no item."""
    at, columns, docs = docs.columns.index(text_col), docs.columns, placed(docs)
    for block in item_blocks(items, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], shared=shared, name=("items", uuid.uuid4().hex)) -> Iterator[pa.RecordBatch]:
            own = held(name, lambda: Items(shared.value, ratio))
            for batch in parts(batches):
                yield batch.filter(pa.array([not f for f in own.find(batch.column(at).to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs.toDF(*columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
