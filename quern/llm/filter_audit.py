"""Filter interaction audit: what every order of a set of filters keeps, removes and costs, from packed bitmaps.

``text_failures`` says which filters each document fails, ``first_copies`` adds the one that looks across the table,
``subset_counts`` keeps a bit a row for every filter, outcome and part in packed 64-bit words, a part's rows beside each
other from a word of their own. For each subset of filters the rows that no filter of it removes are one AND-NOT away from
those of a smaller subset; their popcounts, alone and ANDed with each outcome, are added up a part and partition, then over
partitions. These counts (2 ** filters a part) hold all that ``report`` says of the orders, since what a filter removes after
others depends on their set, not on their order.

Defined results: null texts and null parts are empty strings; a row without an id counts like any other, has no outcomes, and is a
copy of every row that has an id and its text; rows that share an id are rows of their own and none is the other's copy; an
outcome holds for an id if any of its label rows says so; texts of any length are read whole; other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, parts, table

MARKS = b"#$%&*|"
_CAPITALS, _MARKS = (bytes(b for b in range(256) if b not in kept) for kept in (range(65, 91), MARKS))
HELD = 4096  # parts whose counts a task holds before it hands them on


def failures(text: str | None) -> tuple[bool, bool, bool, bool]:
    """Few words (A), few different ones (B), many capitals (C), marks (D): true where the text fails."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    capitals = len(raw.translate(None, _CAPITALS))
    return len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * capitals > 5 * len(text or ""), bool(raw.translate(None, _MARKS))


def text_failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Rows (doc_id, part, A, B, C, D, digest) of every row of ``docs``; equal texts, and no others, have equal digests."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = batch.column(2).to_pylist()
            failed = np.array([failures(t) for t in texts], dtype=bool).reshape(-1, 4)
            digests = [hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
            columns = [batch.column(0), batch.column(1), *(pa.array(failed[:, i]) for i in range(4)), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "A", "B", "C", "D", "digest"])

    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, f"doc_id {kind}, part string, A boolean, B boolean, C boolean, D boolean, digest binary")


def first_copies(rows: DataFrame, into: str = "E") -> DataFrame:
    """``rows`` with a boolean in place of the digest: whether a row with a smaller id has the same digest."""
    least = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("held"))
    nulls = rows.where("doc_id is null").select("digest", F.lit(True).alias("anonymous")).distinct()
    # Digests of one row alone stay out of the join.
    several = least.join(nulls, "digest", "left").where("held > 1 or anonymous").select("digest", "least")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.col("least").isNotNull())
    return rows.join(several, "digest", "left").select(*(c for c in rows.columns if c != "digest"), copy.alias(into))


def outcomes(rows: DataFrame, labels: DataFrame, found: dict[str, Column], id_col: str = "doc_id") -> DataFrame:
    """``rows`` with a boolean of each outcome, given as conditions on ``labels``."""
    own = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id"))
    own = own.agg(*(F.max(F.coalesce(c, F.lit(False))).alias(name) for name, c in found.items()))
    joined = rows.join(own, "doc_id", "left")
    return joined.select(*rows.columns, *(F.coalesce(name, F.lit(False)).alias(name) for name in found))


def _counts(part: pa.Array, bits: list[np.ndarray], filters: int) -> tuple[list[str], np.ndarray]:
    """The parts of a batch and, a row each, counts of (outcome, subset): outcome 0 is any row."""
    coded = part.dictionary_encode()
    names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    held = np.bincount(code, minlength=len(names))
    words = (held + 63) // 64
    first = np.cumsum(words) - words
    order = np.argsort(code, kind="stable")
    place = np.empty(len(code), dtype=np.int64)
    place[order] = np.arange(len(code)) - np.repeat(np.cumsum(held) - held, held) + np.repeat(first * 64, held)

    def packed(rows: np.ndarray) -> np.ndarray:
        flat = np.zeros(int(words.sum()) * 64, dtype=bool)
        flat[place] = rows
        return np.packbits(flat).view(np.uint64)

    bitsets = [packed(b) for b in bits]
    left = [packed(np.ones(len(code), dtype=bool))]
    for subset in range(1, 1 << filters):
        top = subset.bit_length() - 1
        left.append(left[subset ^ (1 << top)] & ~bitsets[top])
    kept = [rows if mark is None else rows & mark for mark in (None, *bitsets[filters:]) for rows in left]
    return names, np.stack([np.add.reduceat(np.bitwise_count(k).astype(np.int64), first) for k in kept], axis=1)


def subset_counts(rows: DataFrame, filters: Sequence[str], marks: Sequence[str], part_col: str = "part") -> DataFrame:
    """Rows (part, kept, one array a mark): for subset s of ``filters`` (bit i: filter i), element s of ``kept`` counts the part's rows
    that fail no filter of s, and that of a mark's array those of them with the mark. The filters and marks are boolean columns."""
    names, width = [*filters, *marks], 1 << len(filters)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def hand_on() -> pa.RecordBatch:
            values = pa.array([v.tolist() for v in held.values()], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), values], names=["part", "counts"])

        for batch in batches:
            if batch.num_rows:
                bits = [batch.column(i + 1).to_numpy(zero_copy_only=False).astype(bool) for i in range(len(names))]
                for part, found in zip(*_counts(batch.column(0), bits, len(filters))):
                    held[part] = held[part] + found if part in held else found
                if len(held) > HELD:
                    yield hand_on()
                    held = {}
        if held:
            yield hand_on()

    read = rows.select(F.coalesce(F.col(part_col), F.lit("")).alias("part"), *(F.coalesce(F.col(n), F.lit(False)).alias(f"b{i}") for i, n in enumerate(names)))
    counted = read.mapInArrow(run, "part string, counts array<long>").select("part", F.posexplode("counts").alias("at", "n"))
    counted = counted.groupBy("part", "at").agg(F.sum("n").alias("n"))
    whole = counted.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("c"))  # width * (marks + 1) a part
    whole = whole.select("part", F.transform("c", lambda x: x["n"]).alias("c"))
    return whole.select("part", *(F.slice("c", 1 + i * width, width).alias(n) for i, n in enumerate(["kept", *marks])))


def report(counts: DataFrame, filters: Sequence[str], marks: Sequence[str]) -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, <mark>_lost ..., shapley) of every order of the filters:
    the step's filter after those before it, and its removals summed over all orders."""
    n = len(filters)
    every = (1 << n) - 1
    orders = F.expr("array(" + ", ".join(f"array{p}" for p in permutations(range(n)) if n > 1) + ")") if n > 1 else F.array(F.array(F.lit(0)))
    rows = counts.select("*", F.explode(orders).alias("at"))
    rows = rows.select("*", F.posexplode("at").alias("before", "f"))
    name = F.array(*map(F.lit, filters))

    def of(values: str, subset: Column) -> Column:
        return F.element_at(values, (subset + 1).cast("int"))

    def bit(f: Column) -> Column:
        return F.element_at(F.array(*(F.lit(1 << i) for i in range(n))), f + 1)

    rows = rows.withColumn("was", F.aggregate(F.slice("at", 1, F.col("before")), F.lit(0), lambda s, f: s + bit(f)))
    rows = rows.withColumn("own", bit(F.col("f"))).withColumn("now", F.col("was") + F.col("own"))
    removed = of("kept", F.col("was")) - of("kept", F.col("now"))
    fails = F.element_at("kept", 1) - of("kept", F.col("own"))
    unique = of("kept", F.lit(every) - F.col("own")) - F.element_at("kept", every + 1)
    shapley = [
        sum(
            (math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count()) * (F.element_at("kept", s + 1) - F.element_at("kept", (s | 1 << f) + 1)))
            for s in range(1 << n) if not s >> f & 1
        )
        for f in range(n)
    ]
    return rows.select(
        "part", F.array_join(F.transform("at", lambda f: F.element_at(name, f + 1)), "").alias("filter_order"), (F.col("before") + 1).cast("int").alias("step"), of("kept", F.col("now")).alias("kept"), removed.alias("removed"),
        (fails - removed).alias("redundant"), unique.alias("unique_fails"),
        *((of(m, F.col("was")) - of(m, F.col("now"))).alias(f"{m}_lost") for m in marks),
        F.element_at(F.array(*shapley), F.col("f") + 1).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of five text filters over ``documents``, by source, with the good and toxic documents they cost."""
    filters, marks = list("ABCDE"), {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    with Tables(spark) as tables:
        rows = tables.write(text_failures(table(spark, sf_dir, "documents")), "failures")
        marked = outcomes(first_copies(rows), table(spark, sf_dir, "labels"), marks)
        counts = tables.write(subset_counts(marked, filters, list(marks)), "subsets", keep=True)
        return report(counts, filters, list(marks))


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as t, coalesce(source, '') as part from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from d),
least as (select t, min(doc_id) as least from d group by t),
l as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by doc_id),
f as (select part, len(w) < 50 as "A", 100 * len(list_distinct(w)) < 65 * len(w) as "B", 100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 5 * length(w.t) as "C",
  regexp_matches(w.t, '[#$%&*|]') as "D", coalesce(w.doc_id > least, least is not null) as "E", coalesce(good, false) as good, coalesce(toxic, false) as toxic
  from w join least on least.t = w.t left join l on l.doc_id = w.doc_id),
b as (select part, good, toxic, "A"::int + 2 * "B"::int + 4 * "C"::int + 8 * "D"::int + 16 * "E"::int as failed, count(*) as n from f group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select filter_order, step, 1 << (ascii(filter_order[step]) - 65) as own, coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::int as was
  from o, (select unnest(range(1, 6))::int as step)),
r as (select part, filter_order, step, own, coalesce(sum(n) filter (where failed & (was | own) = 0), 0)::bigint as kept, coalesce(sum(n) filter (where failed & was = 0 and failed & own > 0), 0)::bigint as removed,
  coalesce(sum(n) filter (where failed & was > 0 and failed & own > 0), 0)::bigint as redundant, coalesce(sum(n) filter (where failed = own), 0)::bigint as unique_fails,
  coalesce(sum(n) filter (where good and failed & was = 0 and failed & own > 0), 0)::bigint as good_lost, coalesce(sum(n) filter (where toxic and failed & was = 0 and failed & own > 0), 0)::bigint as toxic_lost
  from b, s group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from r
"""
