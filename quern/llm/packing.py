"""Best-fit packing of documents into sequences of at most ``capacity`` tokens, improved by swap-based local search.

Tokens: a document is the ids of its text, then an end id. Longer documents are cut into pieces of exactly ``capacity``
tokens, the first of which may be shorter. Pieces matter to packing by their length alone, so the plan is made on the
histogram of lengths (``capacity`` numbers at most, whatever the corpus): *kinds* of bins, each a multiset of lengths with
the number of bins of that kind. Best fit decreasing fills kinds as it would fill single bins. The local search then looks
at pairs of underfull kinds and applies the exchange (move one, one for one, two for one) that raises the squared fill
most, to as many bins as both kinds have, until no pair improves; bins that become empty go. The squared fill rises with every
exchange, so the search ends by itself; there is no limit on its steps. It ends before only where the bins are as few as any
packing's (``least_bins``), since no exchange can empty another.

Every (kind, length) covers a range of ranks in its length class. A piece's rank comes from cell counts, running totals and
a row number inside cells of a few thousand rows, so a length that a third of all pieces share is no hot group.

Defined results: null and empty texts are the end id alone; texts of any length are cut as above; repeated rows are
packed each; null ids pass through; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, held, parts, table

CAPACITY, END_ID = 2048, 0
CELL_ROWS = 4000
Kind = tuple[tuple[int, int], ...]  # (length, how many of it), longest first


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of a byte-level BPE vocabulary file.

    The file's vocabulary is run by an engine that is several times faster than the file's own library; its ids are the
    same, which ``check`` confirms on texts of every slice. Texts that spell a special token go through the library itself, and
    so does every text if the file asks for more than byte-level pairs split by the usual pattern.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        self.fast = None
        if not plain or spec.get("normalizer") or model.get("type") != "BPE" or any(model.get(k) for k in odd):
            return
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
        if any(model["vocab"][a] >= model["vocab"][b] for a, b in zip(merged, merged[1:])):  # the fast engine merges by id, the file by place
            return
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<u4")
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.own.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    def check(self, texts: list[str | None]) -> None:
        """Compares the engines on the shortest text and on the one that a hash picks, whatever its length."""
        held = [t for t in texts if t]
        if held and self.fast is not None:
            for t in {min(held, key=len), min(held, key=lambda t: zlib.crc32(t[:4096].encode("utf-8", "surrogatepass")))}:
                if self.own.encode(t, add_special_tokens=False).ids != self.ids(t).tolist():
                    raise RuntimeError("the two engines differ on a text")


def encoder(path: str) -> Encoder:
    return held(("encoder", path), lambda: Encoder(path))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenised_pieces(docs: DataFrame, capacity: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32) of every document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([END_ID], dtype="<u4")
        for batch in parts(batches):
            texts = batch.column(1).to_pylist()
            enc.check(texts)
            rows, of = [], []
            for i, t in enumerate(texts):
                ids = np.concatenate([enc.ids(t), end])
                for p, (s, n) in enumerate(cut(len(ids), capacity)):
                    of.append(i)
                    rows.append((p, s, n, zlib.crc32(ids[s : s + n].tobytes())))
            cols = list(zip(*rows)) or [(), (), (), ()]
            taken = batch.column(0).take(pa.array(of, pa.int64()))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [taken, *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["id", "piece", "start", "length", "ids_crc32"]
            )

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(histogram: dict[int, int], capacity: int) -> Counter:
    """Kinds of bins and their numbers by best fit decreasing, on counts."""
    open_bins: list[list] = [[] for _ in range(capacity + 1)]  # by room left: [items, number of bins]
    live: set[int] = set()

    def put(room: int, items: Kind, n: int) -> None:
        if n:
            open_bins[room].append((items, n))
            live.add(room)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            rooms = [r for r in live if r >= length]
            if not rooms:
                each = capacity // length
                put(capacity - each * length, ((length, each),), left // each)
                if left % each:
                    put(capacity - left % each * length, ((length, left % each),), 1)
                break
            room = min(rooms)
            items, n = open_bins[room].pop()
            each = room // length
            full = min(n, left // each)
            put(room - each * length, (*items, (length, each)), full)
            left -= full * each
            if full < n and left:  # fewer than fill one more bin are left
                put(room - left * length, (*items, (length, left)), 1)
                put(room, items, n - full - 1)
                left = 0
            else:
                put(room, items, n - full)
            if not open_bins[room]:
                live.discard(room)
    out: Counter = Counter()
    for group in open_bins:
        for items, n in group:
            out[items] += n
    return out


def _fill(kind: Kind) -> int:
    return sum(length * n for length, n in kind)


def _change(kind: Kind, out: Iterable[int], into: Iterable[int]) -> Kind:
    c = Counter(dict(kind))
    c.subtract(Counter(out))
    c.update(Counter(into))
    return tuple(sorted(((length, n) for length, n in c.items() if n), reverse=True))


def _sums(kind: Kind) -> tuple[list[int], list[int]]:
    """The lengths of a kind, and the sums of two of its items."""
    singles = [x for x, _ in kind]
    pairs = {x + y for i, (x, n) in enumerate(kind) for y in (singles[i:] if n > 1 else singles[i + 1 :])}
    return singles, sorted(pairs)


def _two(kind: Kind, total: int) -> tuple[int, int]:
    """Two items of a kind that sum to total."""
    held = dict(kind)
    for x, n in kind:
        if total - x in held and (total != 2 * x or n > 1):
            return x, total - x
    raise AssertionError("no such items")


class _Open:
    """Underfull kinds in rows of arrays, so that a kind is held against all others at once.

    A row of ``one`` says, for every t, the least sum >= t that its kind can give back for one item: nothing, an item, or
    two; of ``two`` the same for two items: an item. From a bin of fill b into one of fill a >= b, items of sum x for items of
    sum y raise the squared fill by d * (a - b + d), d = x - y; most if d is largest, that is y least.
    """

    def __init__(self, capacity: int):
        self.capacity, self.none = capacity, capacity + 1
        self.row: dict[Kind, int] = {}
        self.kind: list[Kind | None] = []
        self.free: list[int] = []
        self.count, self.fill = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.width = np.int16 if capacity < 32_000 else np.int32
        self.one, self.two = (np.zeros((0, capacity + 1), dtype=self.width) for _ in "ab")
        self.given: list[tuple[np.ndarray, np.ndarray]] = []  # of each row: what one item, what two sum to
        self.flat: tuple[np.ndarray, ...] | None = None  # the same of all rows in one, while rows stay as they are
        self.late: list[int] = []  # rows added since

    def add(self, kind: Kind, n: int) -> bool:
        """True if the kind is new."""
        if kind in self.row:
            self.count[self.row[kind]] += n
            return False
        if not self.free:
            more = max(64, len(self.kind))
            self.free = list(range(len(self.kind) + more - 1, len(self.kind) - 1, -1))
            self.kind += [None] * more
            self.given += [(np.zeros(0, dtype=np.int64),) * 2] * more
            self.count, self.fill = (np.concatenate([x, np.zeros(more, dtype=np.int64)]) for x in (self.count, self.fill))
            self.one, self.two = (np.concatenate([x, np.full((more, x.shape[1]), self.none, dtype=self.width)]) for x in (self.one, self.two))
        r = self.free.pop()
        singles, pairs = _sums(kind)
        self.row[kind], self.kind[r], self.count[r], self.fill[r] = r, kind, n, _fill(kind)
        self.given[r] = (np.array(singles, dtype=np.int64), np.array(pairs, dtype=np.int64))
        for table, sums in ((self.one, [0, *singles, *pairs]), (self.two, singles)):
            line = np.full(table.shape[1], self.none, dtype=self.width)
            line[sums] = sums
            table[r] = np.minimum.accumulate(line[::-1])[::-1]
        self.late.append(r)
        return True

    def take(self, kind: Kind, n: int) -> None:
        r = self.row[kind]
        self.count[r] -= n
        if not self.count[r]:
            del self.row[kind]
            self.kind[r] = None  # the row is used again once ``flat`` is made anew

    def partner(self, low: Kind) -> tuple[Kind, tuple[int, ...], tuple[int, ...]] | None:
        """The kind, what goes to it and what comes back, that raise the squared fill most; None if nothing does."""
        r = self.row[low]
        highs = np.flatnonzero((self.count > 0) & (self.fill >= self.fill[r]))
        if self.count[r] < 2:
            highs = highs[highs != r]
        if not len(highs):
            return None
        gap, room = self.fill[highs] - self.fill[r], self.capacity - self.fill[highs]
        best = (0, 0, 0, 0, False)
        for table, sums, double in ((self.one, self.given[r][0], False), (self.two, self.given[r][1], True)):
            if not len(sums):
                continue
            x = sums[:, None]
            y = table[highs, np.maximum(x - room, 0)]
            gain = np.where(y < x, (x - y) * (gap + x - y), 0)
            at = int(gain.argmax())
            if gain.flat[at] > best[0]:
                i, j = divmod(at, len(highs))
                best = (int(gain.flat[at]), int(sums[i]), int(y[i, j]), int(highs[j]), double)
        if not best[0]:
            return None
        _, x, y, h, double = best
        high = self.kind[h]
        back = () if not y else (y,) if y in dict(high) else _two(high, y)
        return high, _two(low, x) if double else (x,), back

    def givers(self, high: Kind) -> list[Kind]:
        """Kinds, as full or less, that an exchange with ``high`` improves."""
        r = self.row[high]
        if self.flat is None or len(self.late) > 64:
            live = sorted(self.row.values())
            self.free = [i for i, k in enumerate(self.kind) if k is None]
            self.flat = tuple(z for t in (0, 1) for z in (np.concatenate([self.given[i][t] for i in live]), np.repeat(live, [len(self.given[i][t]) for i in live])))
            self.late = []
        out: set[int] = set()
        room = self.capacity - self.fill[r]
        late = [(self.given[i][t], np.full(len(self.given[i][t]), i)) for i in self.late for t in (0, 1)]
        for table, groups in ((self.one, [self.flat[:2], *late[::2]]), (self.two, [self.flat[2:], *late[1::2]])):
            x, of = (np.concatenate(z) for z in zip(*groups))
            out.update(np.unique(of[table[r, np.maximum(x - room, 0)] < x]).tolist())
        return [k for i in sorted(out) if (k := self.kind[i]) and self.fill[i] <= self.fill[r] and (i != r or self.count[r] > 1)]


def least_bins(histogram: dict[int, int], capacity: int) -> int:
    """A number of bins that no packing goes below.

    For every k up to half the capacity: lengths above half need a bin each; those above ``capacity - k`` leave no room for
    lengths of k or more, and the room that the others leave takes only part of the lengths from k to half.
    """
    n = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in histogram.items():
        n[length] = count
    half = capacity // 2
    count, total = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    k = np.arange(half + 1)
    alone, large, room = count[-1] - count[capacity - k], count[capacity - k] - count[half], total[capacity - k] - total[half]
    small = total[half] - np.where(k > 0, total[np.maximum(k, 1) - 1], 0)
    over = np.maximum(0, -(-(small - (large * capacity - room)) // capacity))
    return max(-(-int(total[-1]) // capacity), int((alone + large + over).max()))


def local_search(kinds: Counter, capacity: int, least: int = 0) -> Counter:
    """Exchanges between underfull bins until none raises the squared fill, or no more than ``least`` bins are left. Same kinds
    and numbers, same result.

    Kinds wait in a queue, emptiest first. One for which no other offers an exchange leaves it, and comes back only when a
    kind appears, or has a second bin, that does; so the end is that of trying every pair again after every exchange.
    """
    done = Counter({k: n for k, n in kinds.items() if not 0 < _fill(k) < capacity})
    open_ = _Open(capacity)
    waiting: set[Kind] = set()
    queue: list[tuple[int, Kind]] = []

    def wait(kind: Kind) -> None:
        if kind not in waiting:
            waiting.add(kind)
            heappush(queue, (_fill(kind), kind))

    for k in sorted(kinds):
        if 0 < _fill(k) < capacity and kinds[k]:
            open_.add(k, kinds[k])
            wait(k)
    held = sum(kinds.values())
    while queue and held > least:
        _, low = heappop(queue)
        waiting.discard(low)
        if low not in open_.row:
            continue
        found = open_.partner(low)
        if found is None:
            continue
        high, out, back = found
        have = int(open_.count[open_.row[low]])
        n = have // 2 if low == high else min(have, int(open_.count[open_.row[high]]))
        for kind in (low, high):
            open_.take(kind, n)
        if low in open_.row:
            wait(low)
        for kind in (_change(low, out, back), _change(high, back, out)):
            if not kind:
                held -= n
                continue
            if _fill(kind) == capacity:
                done[kind] += n
                continue
            new = open_.add(kind, n)
            wait(kind)
            if new:
                for other in open_.givers(kind):
                    wait(other)
    return done + Counter({k: int(open_.count[r]) for k, r in open_.row.items()})


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, ...]:
    """Slots in order of (length, first rank): length, first rank, how many in each bin, first bin, offset in the bin."""
    kinds = local_search(best_fit(histogram, capacity), capacity, least_bins(histogram, capacity))
    used: Counter = Counter()
    rows, base = [], 0
    for kind in sorted(kinds, key=lambda k: (-_fill(k), k)):
        n, at = kinds[kind], 0
        for length, times in kind:
            rows.append((length, used[length], times, base, at))
            used[length] += n * times
            at += length * times
        base += n
    if used != Counter(histogram):
        raise AssertionError("the plan doesn't hold every piece")
    rows.sort()
    return tuple(np.array(c, dtype=np.int64) for c in (zip(*rows) if rows else ((), (), (), (), ())))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """The rows of ``pieces`` (with id, piece, length) with sequence_id and offset. Read twice: pass a written table."""
    sizes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows
    slots = plan(sizes, capacity)
    spread = F.array(*[F.lit(max(1, sizes.get(n, 0) // CELL_ROWS)) for n in range(1, capacity + 1)])
    celled = pieces.withColumn("_cell", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.element_at(spread, F.col("length").cast("int"))))
    counts = celled.groupBy("length", "_cell").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    firsts = counts.select("length", "_cell", (F.sum("n").over(upto) - F.col("n")).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("length", "_cell").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = celled.withColumn("_in", inside).join(firsts, ["length", "_cell"])
    ranked = ranked.select(*pieces.columns, (F.col("_first") + F.col("_in")).alias("_rank"))
    at = ranked.columns.index("length")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, times, base, offset = slots
        keys = (length << 44) + first
        for batch in batches:
            n, r = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (at, len(ranked_names) - 1))
            s = np.searchsorted(keys, (n << 44) + r, side="right") - 1
            into = r - first[s]
            sequence, place = base[s] + into // times[s], offset[s] + into % times[s] * n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence, pa.int64()), pa.array(place, pa.int64())],
                names=[*ranked_names[:-1], "sequence_id", "offset"],
            )

    ranked_names = ranked.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields), "sequence_id long, offset long"])
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """A row per piece of every document: id, piece, start, length, ids_crc32, sequence_id, offset."""
    with Tables(docs.sparkSession) as tables:
        return pack(tables.write(tokenised_pieces(docs, capacity, path or vocabulary_path(), id_col), "pieces", keep=True), capacity)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
