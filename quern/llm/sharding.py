"""Sharding by balanced label propagation: linked documents move towards their neighbours' shard under quotas.

Links are given by a key (here: the digest of the text): documents that share a key are linked, so the graph is kept as
documents and keys and never as pairs. A round tallies each key's documents by shard (summed on the map side), lets every
document of the key prefer the shard that holds most of it, and moves those whose preferred shard has room. Room is
dealt by *cells*: movers are hashed to a fixed number of cells, anew in each round, and demand is summed by (from, to,
cell). All moves are granted first, so that what leaves a shard in a round is room for what comes; then shards above their
quota give cells back until none is. Small keys are hashed whole, so that a key moves as one, large ones by document, so
that a key larger than a shard can be split. What reaches the driver are the tallies by shards and cell, whose number
depends on the shard count alone. Rounds go on until nothing is to move or the number of keys in parts stops falling; the
quota gets a slack of a 64th once that number stops falling, which the exact balance takes back in whole keys.

Law ``rows``: after the rounds, shards over their exact quota give up that many documents, unlinked ones first, then those
of keys larger than a shard, and shards below it take them: counts differ by one at most. Ranks in a shard come from cell
counts, running totals and a row number inside each cell of a few thousand rows, so no task ever sorts a whole shard or a whole key. Per-key tables are written
before they are joined, which leaves both sides of each join to adaptive execution, and that splits hot keys.

``shard_linked`` takes any links between documents in place of equal texts. A round counts each linked document's neighbours
by shard and moves those that have more of them elsewhere than here, under the same quotas with a slack of an eighth that
falls to none; a hash lets one half of them move in a round, another in the next, so that two neighbours don't change places
for ever. Rounds go on until none moves or the cut has not fallen for ``PATIENCE`` rounds; the labels of the least cut are
then balanced as above.

Defined results: a null text is empty (size 1, CRC 0) and shares a key with the empty text; null document ids and
repeated rows are kept as rows of their own; other columns are ignored; an empty table gives an empty table. Links with a null
end, of a document to itself or to an id that isn't there count for nothing; repeated links count once; rows that share an id
are one end of their links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, table

CELLS = 256  # cells in which room is dealt
CELL_ROWS = 4000  # rows aimed at in a ranking cell
PATIENCE = 6


def _bucket(n: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def _pick(values: list[int], index: str) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), (F.expr(index) + 1).cast("int"))


def _granted(flows: dict[tuple[int, int, int], int], loads: list[int], most: list[int]) -> tuple[set[tuple[int, int]], list[int]]:
    """The (to, cell) of ``flows`` (from, to, cell) that may move, and the loads then; none is above ``most`` that wasn't."""
    loads = loads[:]
    units: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for (s, t, c), n in sorted(flows.items()):
        units.setdefault((t, c), []).append((s, n))
        loads[s] -= n
        loads[t] += n
    while over := [s for s in range(len(loads)) if loads[s] > most[s]]:
        t = max(over, key=lambda s: (loads[s] - most[s], -s))
        into = sorted((sum(n for _, n in parts), u) for u, parts in units.items() if u[0] == t)
        _, back = next((x for x in into if x[0] >= loads[t] - most[t]), into[-1])
        for s, n in units.pop(back):
            loads[s] += n
            loads[t] -= n
    return set(units), loads


def _grants(units: set[tuple[int, int]], shards: int) -> Column:
    """Whether a mover (best, cell) may move."""
    bits = F.lit("".join("1" if (s, c) in units else "0" for s in range(shards) for c in range(CELLS)))
    return F.substring(bits, F.col("best") * CELLS + F.col("cell") + 1, F.lit(1)) == "1"


def _flows(voted: DataFrame) -> dict[tuple[int, int, int], int]:
    """Movers by (from, to, cell): shards x shards x CELLS numbers at most."""
    demand = voted.where("best <> shard").groupBy("shard", "best", "cell").agg(F.count(F.lit(1)).alias("n"))
    return {(r["shard"], r["best"], r["cell"]): r["n"] for r in demand.collect()}


def propagate(tables: Tables, linked: DataFrame, loads: list[int], capacity: int, shards: int) -> DataFrame:
    """Rows of ``linked`` (key, held: documents of the key, shard, ...) with the shards that the rounds give them."""
    current = tables.write(linked, "linked", keep=True)
    large = max(1, capacity // 64)
    closed: list[int] = []
    fewest, idle, turn, slack = None, 0, 0, 0  # keys in parts, at the least, and rounds in which they did not become fewer
    while True:
        tallies = current.groupBy("key", "shard").agg(F.count(F.lit(1)).alias("n"), F.max("held").alias("held"))
        # A small key in parts leaves shards that had no room, for another of its own or, failing that, for any open one.
        stuck = F.col("shard").isin(*closed) & (F.col("n") < F.col("held")) & (F.col("held") <= large) if closed else F.lit(False)
        rank = F.struct((~stuck).cast("int").alias("open"), "n", F.xxhash64("key", "shard").alias("h"))
        best = tallies.groupBy("key").agg(F.max(F.struct(rank.alias("rank"), "shard", (F.col("n") < F.col("held")).alias("split"))).alias("m"))
        others = [s for s in range(shards) if s not in closed]
        refuge = _pick(others, f"pmod(xxhash64(key, {turn}), {len(others)})") if closed and others else F.col("m.shard")
        best = best.select("key", F.when(F.col("m.rank.open") == 0, refuge).otherwise(F.col("m.shard")).alias("best"), "m.split")
        best = tables.write(best, "best")
        split = best.where("split").count()
        if split and (fewest is None or split < fewest):
            fewest, idle = split, 0
        else:
            idle, slack = idle + 1, large
        if not split or idle == 3:
            return current
        spot = F.when(F.col("held") > large, F.xxhash64("doc_id", "key", "salt", F.lit(turn))).otherwise(F.xxhash64("key", F.lit(turn)))
        voted = current.join(best.drop("split"), "key").withColumn("cell", F.pmod(spot, F.lit(CELLS)).cast("int"))
        voted = tables.write(voted, "voted")
        flows = _flows(voted)
        units, after = _granted(flows, loads, [max(load, capacity + slack) for load in loads])
        loads[:] = after
        closed = sorted({t for _, t, c in flows if (t, c) not in units})
        following = voted.withColumn("shard", F.when(_grants(units, shards), F.col("best")).otherwise(F.col("shard")))
        following = tables.write(following.select(*linked.columns), "linked", keep=True)
        tables.drop(best, voted, current)
        current, turn = following, turn + 1


def propagate_links(tables: Tables, labels: DataFrame, edges: DataFrame, loads: list[int], capacity: int, shards: int) -> DataFrame:
    """labels (doc_id, rows, shard) after the rounds. edges: (a, b), each link both ways; loads are kept up to date."""
    current = tables.write(labels, "labels")
    least, kept, kept_loads, idle, still, turn = None, current, loads[:], 0, 0, 0
    while True:
        by_shard = edges.join(current.select(F.col("doc_id").alias("b"), "shard"), "b").groupBy("a", "shard").agg(F.count(F.lit(1)).alias("n"))
        held = F.collect_list(F.struct("n", F.col("shard").alias("s"))).alias("held")  # a row a shard at most
        voted = by_shard.groupBy(F.col("a").alias("doc_id")).agg(held).join(current, "doc_id")
        here = F.aggregate("held", F.lit(0).cast("long"), lambda total, x: total + F.when(x["s"] == F.col("shard"), x["n"]).otherwise(0))
        all_ = F.aggregate("held", F.lit(0).cast("long"), lambda total, x: total + x["n"])
        awake = F.pmod(F.xxhash64(F.lit(turn), "doc_id"), F.lit(2)) == 0
        best = F.when(awake, F.coalesce(F.array_max(F.filter("held", lambda x: x["n"] > here))["s"], F.col("shard"))).otherwise(F.col("shard"))
        cell = F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(CELLS)).cast("int")
        voted = tables.write(voted.select("doc_id", "rows", "shard", best.alias("best"), cell.alias("cell"), (all_ - here).alias("away")), "voted")
        cut = voted.agg(F.coalesce(F.sum("away"), F.lit(0))).first()[0] // 2
        if least is None or cut < least:
            if kept is not current:
                tables.drop(kept)
            least, kept, kept_loads, idle = cut, current, loads[:], 0
        else:
            idle += 1
        flows = {}
        for r in voted.where("best <> shard").groupBy("shard", "best", "cell").agg(F.sum("rows").alias("n")).collect():
            flows[r["shard"], r["best"], r["cell"]] = r["n"]
        still = 0 if flows else still + 1
        if still == 3 or idle == PATIENCE:
            loads[:] = kept_loads
            return kept
        slack = max(2, capacity // 8) >> turn // 4
        units, loads[:] = _granted(flows, loads, [max(load, capacity + slack) for load in loads])
        moved = voted.select("doc_id", "rows", F.when(_grants(units, shards), F.col("best")).otherwise(F.col("shard")).alias("shard"))
        following = tables.write(moved, "labels")
        tables.drop(voted, *([current] if current is not kept else []))
        current, turn = following, turn + 1


def balance_rows(docs: DataFrame, loads: list[int], shards: int) -> DataFrame:
    """Exact quotas by count, and gapless slots. docs: doc_id, key, held, shard and others."""
    n = sum(loads)
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    over = [max(0, a - q) for a, q in zip(loads, quota)]
    under = [max(0, q - a) for a, q in zip(loads, quota)]
    before = [sum(over[:s]) for s in range(shards)]
    starts = [sum(under[:s]) for s in range(shards)]
    spread = max(1, n // shards // CELL_ROWS)
    docs = docs.withColumns(
        {
            "multi": F.when(F.col("held") == 1, 0).when(F.col("held") > n // shards, 1).otherwise(2),  # what goes first costs least
            "kb": _bucket(spread, "key"),
            "sub": F.pmod(F.xxhash64("doc_id", "salt"), F.greatest(F.lit(1), (F.col("held") / CELL_ROWS).cast("long"))).cast("int"),
        }
    )
    cell = ["shard", "multi", "kb", "sub"]
    counts = docs.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("shard").orderBy("multi", "kb", "sub").rowsBetween(Window.unboundedPreceding, 0)
    offsets = counts.select(*cell, (F.sum("n").over(upto) - F.col("n")).alias("first"))
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy("key", "doc_id")) - 1
    ranked = docs.withColumn("inside", inside).join(offsets, cell).withColumn("rank", F.col("first") + F.col("inside"))
    gives = F.col("rank") < _pick(over, "shard")
    index = _pick(before, "shard") + F.col("rank")
    target, place = F.lit(None).cast("int"), F.lit(None).cast("long")
    for s in reversed(range(shards)):
        if under[s]:
            here = index < starts[s] + under[s]
            target = F.when(here, F.lit(s)).otherwise(target)
            place = F.when(here, index - starts[s] + loads[s]).otherwise(place)
    return ranked.withColumns(
        {
            "slot": F.when(gives, place).otherwise(F.col("rank") - _pick(over, "shard")).cast("long"),
            "shard": F.when(gives, target).otherwise(F.col("shard")).cast("int"),
        }
    ).drop("multi", "kb", "sub", "inside", "first", "rank", "salt")


def _nodes(docs: DataFrame, key: Column, shards: int) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        key.alias("key"),
        F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)).cast("int").alias("salt"),  # deals repeated rows to cells
    ).withColumn("shard", _bucket(shards, "doc_id", "key"))


def _loads(marked: DataFrame, shards: int) -> tuple[list[int], list[int]]:
    """Rows by shard: unlinked, linked."""
    single, multi = [0] * shards, [0] * shards
    for r in marked.groupBy("shard", (F.col("held") > 1).alias("linked")).agg(F.count(F.lit(1)).alias("n")).collect():
        (multi if r["linked"] else single)[r["shard"]] = r["n"]
    return single, multi


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, key, shard, slot of every row of ``docs`` (doc_id, text). See the module.

    Only linked documents count against the quota while labels move: unlinked ones can make room later at no cost.
    """
    with Tables(docs.sparkSession) as tables:
        digest = F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32))
        nodes = tables.write(_nodes(docs, digest, shards), "nodes")
        # Written out, so that the join below shuffles both sides anew and adaptive execution can split a hot key.
        held = tables.write(nodes.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "held")
        marked = tables.write(nodes.join(held, "key", "left").withColumn("held", F.coalesce("held", F.lit(1))), "marked", keep=True)
        single, multi = _loads(marked, shards)
        capacity = (sum(single) + sum(multi)) // shards
        linked = propagate(tables, marked.where("held > 1"), multi, capacity, shards)  # keeps multi up to date
        loads = [a + b for a, b in zip(single, multi)]
        return balance_rows(marked.where("held = 1").unionByName(linked.select(*marked.columns)), loads, shards)


def cut_links(links: DataFrame, placed: DataFrame) -> DataFrame:
    """One row (links, cut): the links (a, b) between rows of ``placed`` (doc_id, shard), and those whose ends are in different shards."""
    ends = placed.groupBy("doc_id").agg(F.min("shard").alias("lo"), F.max("shard").alias("hi"))
    pairs = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = pairs.join(ends.toDF("a", "alo", "ahi"), "a").join(ends.toDF("b", "blo", "bhi"), "b")
    cut = (F.col("alo") != F.col("blo")) | (F.col("ahi") != F.col("bhi")) | (F.col("alo") != F.col("ahi"))
    return both.agg(F.count(F.lit(1)).alias("links"), F.count_if(cut).alias("cut"))


def shard_linked(docs: DataFrame, links: DataFrame, shards: int = 8) -> tuple[DataFrame, dict[str, int]]:
    """The same columns as ``shard_documents`` for any links (a, b) between doc_ids, and {links, cut_before, cut_after}: how many
    links join different shards under a hash of the id, and in the result."""
    with Tables(docs.sparkSession) as tables:
        nodes = _nodes(docs, F.unhex(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), shards)
        nodes = tables.write(nodes.withColumn("shard", _bucket(shards, "doc_id")), "nodes")
        ids = tables.write(nodes.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("shard").alias("shard")), "ids")
        pairs = links.where("a <> b").select("a", "b")
        edges = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        for end in ("a", "b"):
            edges = edges.join(ids.select(F.col("doc_id").alias(end)), end, "left_semi")
        edges = tables.write(edges, "edges")
        labels = tables.write(ids.join(edges.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_semi"), "linked")
        _, multi = _loads(nodes.join(labels.select("doc_id"), "doc_id").withColumn("held", F.lit(2)), shards)
        capacity = nodes.count() // shards
        moved = propagate_links(tables, labels, edges, multi, capacity, shards).select("doc_id", F.col("shard").alias("moved"))
        marked = nodes.join(moved, "doc_id", "left").withColumns(
            {"held": F.when(F.col("moved").isNull(), 1).otherwise(2), "shard": F.coalesce("moved", "shard")}
        )
        marked = tables.write(marked.drop("moved"), "marked", keep=True)
        single, multi = _loads(marked, shards)
        placed = tables.write(balance_rows(marked, [a + b for a, b in zip(single, multi)], shards), "placed", keep=True)
        before, after = cut_links(edges, nodes).first(), cut_links(edges, placed).first()
        return placed, {"links": before["links"], "cut_before": before["cut"], "cut_after": after["cut"]}


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
