"""Ball k-means, the filter interaction audit and the subspace join."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quern.llm import ball_kmeans, filter_audit, subspace_join
from tests.test_oracles import compare

VECTORS = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32()), ("cluster", pa.string()), ("v", pa.int64())])


def vectors(path, rows) -> str:
    columns = list(zip(*rows)) or [[], [], []]
    held = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(pa.float32())), pa.array(columns[2], pa.int32())]
    held += [pa.array(["x"] * len(rows), pa.string()), pa.array([None] * len(rows), pa.int64())]  # names that operators use too
    pq.write_table(pa.Table.from_arrays(held, schema=VECTORS), path / "embeddings.parquet")
    return str(path)


def odd_vectors(rng) -> list:
    whole = rng.standard_normal(64).tolist()
    return [
        (9001, None, 1), (9002, [], 1), (9003, [0.0] * 64, 1), (9004, [math.nan] + whole[1:], 1), (9005, [None] + whole[1:], 1), (9006, [-math.inf] + whole[1:], 1),
        (9007, whole, None), (9008, whole, 1), (9008, whole, 1), (9008, [-0.0] + whole[1:], 1), (9009, [0.0] + whole[1:], 1), (None, whole, 1), (None, whole[::-1], 2), (None, whole[::-1], 2),
        (9010, [1.0, 0, 0, 0], 1), (9011, [49.0, 9, 3, 3], 1), (9012, [48.9, 9, 3, 3], 1), (9013, [1.0, 0, 0], 1), (9014, [2.5], 1), (9015, [7.0], 1), (9016, [-7.0], 1),
        (9017, [1e30, 1e30] + [0.0] * 62, 3), (9018, [1e-30, 1e-30] + [0.0] * 62, 3), (9019, [1e-42] * 64, 3), (9020, [3e38] * 64, 3),
    ]


# clusters


@pytest.mark.parametrize("n, spread", [(700, 0.02), (500, 1.0), (25, 0.3)])
def test_clusters_equal_plain_rounds(spark, tmp_path, n, spread):
    rng = np.random.default_rng(n)
    at = rng.standard_normal((60, 64)) / 8
    rows = [(int(i), (at[i % 60] + spread * rng.standard_normal(64) / 8).astype(np.float32).tolist(), 0) for i in rng.permutation(n)]
    rows += [r for r in rows[:20]] + [(10_000 + i, rows[3][1], None) for i in range(40)] + [r for r in odd_vectors(rng) if r[1] is None or len(r[1]) != 64 or 9003 <= (r[0] or 0) <= 9006]
    rows += [(None, rows[5][1], 1), (77_777, [200.0] * 64, 1)]
    compare(spark, "q", {"q": ball_kmeans.op11_clusters}, {"q": ball_kmeans.ORACLE}, vectors(tmp_path, rows))


def test_clusters_of_nothing_and_of_one(spark, tmp_path):
    assert ball_kmeans.op11_clusters(spark, vectors(tmp_path, [])).collect() == []
    one = spark.createDataFrame([(5, [0.5, -0.25])], "vec_id long, embedding array<double>")
    r = ball_kmeans.cluster(one, k=3, size=2).collect()
    assert [tuple(x) for x in r] == [(5, 0, 0, 0, 0, hashlib.sha256(b"128,-64").hexdigest())]


def test_reassignment_equals_all_comparisons():
    rng = random.Random(4)
    for _ in range(200):
        k, n, wide = rng.randint(1, 9), rng.randint(1, 60), rng.choice([2, 6, 50, 5000])
        was = np.array([[rng.randint(-wide, wide) for _ in range(3)] for _ in range(k)])
        x = np.array([[rng.randint(-wide, wide) for _ in range(3)] for _ in range(n)])
        before, _ = ball_kmeans.nearest(x, was, np.arange(k))
        now = was + np.array([[rng.choice([0, 0, rng.randint(-2, 2)])] * 3 for _ in range(k)])
        cluster, far = ball_kmeans.reassign(x, before, now, ball_kmeans.squares(now, now), (now != was).any(axis=1))
        plain = ((x[:, None] - now[None]) ** 2).sum(axis=2)
        assert (cluster == plain.argmin(axis=1)).all() and (far == plain.min(axis=1)).all()


def test_distances_of_large_components_are_exact_or_refused():
    x = np.array([[1 << 25] * 64, [-(1 << 25)] * 64])
    assert ball_kmeans.squares(x, x)[0, 1] == 64 << 52
    with pytest.raises(ArithmeticError):
        ball_kmeans.squares(4 * x, x)


# audit


def plain_audit(docs, labels):
    """A set a document, an order at a time."""
    failed, part = [], []
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, s in docs:
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        f = set()
        f |= {"A"} if len(w) < 50 else set()
        f |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        f |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else set()
        f |= {"D"} if set(t) & set("#$%&*|") else set()
        f |= {"E"} if t in first and (i is None or i > first[t]) else set()
        failed.append(f)
        part.append(s or "")
    good = [any(a == i and q == 1 for a, q, _ in labels) and i is not None for i, _, _ in docs]
    toxic = [any(a == i and x == 1 for a, _, x in labels) and i is not None for i, _, _ in docs]
    out = {}
    for p in set(part):
        mine = [i for i in range(len(docs)) if part[i] == p]
        sums = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = set(mine)
            for step, f in enumerate(order):
                gone = {i for i in left if f in failed[i]}
                late = sum(f in failed[i] for i in mine) - len(gone)
                left -= gone
                sums[f] += len(gone)
                out[p, "".join(order), step + 1] = [len(left), len(gone), late, sum(failed[i] == {f} for i in mine), sum(good[i] for i in gone), sum(toxic[i] for i in gone)]
        for key in out:
            if key[0] == p:
                out[key].append(sums[key[1][key[2] - 1]])
    return out


def test_audit_equals_sets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD", 3)
    rng = random.Random(12)
    pool = ["a", "B", "cc", "Dd", "é", "#x", "*", "\xa0y", "z" * 30]
    docs = []
    for i in range(700):
        n = rng.choice([0, 1, 3, 49, 50, 51, 80, 400])
        t = rng.choice([" ", "\t", "\n", "\x0b "]).join(rng.choices(pool, k=n) if rng.random() < 0.5 else [f"w{j}" for j in range(n)])
        docs.append((rng.choice([i, i, i, 5, None]), rng.choice([t, t, t, t, None, "", "hot text", "Hot Text $"]), rng.choice(["s", "t", "", None, f"own {i}"])))
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 700, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (100_000, 1, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as part", "2 as E", "'x' as digest").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 as part").write.parquet(f"{tmp_path}/labels.parquet")
    got = filter_audit.op12_filter_audit(spark, str(tmp_path)).collect()
    plain = plain_audit(docs, labels)
    assert len(got) == len(plain)
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == plain[r.part, r.filter_order, r.step], r


def test_audit_of_nothing_and_of_other_filters(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert filter_audit.op12_filter_audit(spark, str(tmp_path)).collect() == []
    rows = spark.createDataFrame([("p", True, None), ("p", False, True), (None, True, True)], "part string, short boolean, long boolean")
    got = filter_audit.report(filter_audit.subset_counts(rows, ["short", "long"], []), ["short", "long"], []).collect()
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in got if r.part == "p"} == {
        ("p", "shortlong", 1): (1, 1, 0, 1, 2), ("p", "shortlong", 2): (0, 1, 0, 1, 2), ("p", "longshort", 1): (1, 1, 0, 1, 2), ("p", "longshort", 2): (0, 1, 0, 1, 2),
    }
    assert all(r.removed + r.redundant == 1 and r.shapley == 1 for r in got if r.part == "")
    one = filter_audit.report(filter_audit.subset_counts(rows, ["short"], []), ["short"], []).collect()
    assert sorted((r.part, r.kept, r.removed, r.shapley) for r in one) == [("", 0, 1, 1), ("p", 1, 1, 1)]


def test_very_long_text_and_many_parts_of_a_batch():
    text = "Word " * 3_000_000
    assert filter_audit.failures(text) == (False, True, True, False) and filter_audit.failures(None) == (True, False, False, False)
    names, counts = filter_audit._counts(pa.array([f"p{i % 900}" for i in range(1800)]), [np.arange(1800) % 2 == 0, np.ones(1800, dtype=bool)], 1)
    at = names.index("p7")
    assert counts[at].tolist() == [2, 2, 2, 2] and counts[names.index("p8")].tolist() == [2, 0, 2, 0]


# links


def plain_links(rows, threshold=0.98):
    """All pairs."""
    n, parent = len(rows), list(range(len(rows)))
    fit = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    count = [0] * n

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    groups = {}
    for i in range(n):
        if fit[i]:
            groups.setdefault((rows[i][2], len(rows[i][1])), []).append(i)
    for at in groups.values():
        x = np.array([np.float32(rows[i][1]) for i in at], dtype=np.float64)
        x = x / np.abs(x).max(axis=1)[:, None] if np.abs(x).max() > 1e18 or np.abs(x).max(axis=1).min() < 1e-18 else x
        near = (x @ x.T) / np.sqrt((x * x).sum(axis=1)[:, None] * (x * x).sum(axis=1)[None, :]) >= threshold
        for a, b in zip(*np.nonzero(near)):
            if a != b:
                count[at[a]] += 1
                parent[top(at[a])] = top(at[b])
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[top(i)] = min(rows[i][0], least.get(top(i), rows[i][0]))
    found = [least.get(top(i)) for i in range(n)]
    return sorted((repr(rows[i][0]), count[i], repr(found[i]), found[i] is None if rows[i][0] is None else rows[i][0] == found[i]) for i in range(n))


def groups(rng, size, labels=3) -> list:
    rows = []
    for i in range(size):
        rows.append((rng.standard_normal(64), int(rng.integers(labels))))
    for g in range(8):  # around a centre, so that some pairs are links and some are not
        centre, label = rng.standard_normal(64), int(rng.integers(labels))
        rows += [(centre + rng.uniform(0.05, 0.2) * rng.standard_normal(64), label) for _ in range(40)]
    chain = rng.standard_normal(64)  # links through others alone
    for _ in range(30):
        chain = chain + 0.15 * rng.standard_normal(64)
        rows.append((chain, 0))
    out = [(int(i), (v / np.linalg.norm(v)).astype(np.float32).tolist(), label) for i, (v, label) in zip(rng.permutation(len(rows)), rows)]
    out += [(20_000 + i, out[size][1], out[size][2]) for i in range(60)] + [(30_000 + i, (3 * np.array(out[size + 1][1])).tolist(), out[size + 1][2]) for i in range(9)]
    return out


@pytest.mark.parametrize("cell, tile", [(2048, 8192), (16, 8192), (64, 50), (4, 20)])
def test_links_equal_all_pairs(spark, tmp_path, monkeypatch, cell, tile):
    monkeypatch.setattr(subspace_join, "CELL_ROWS", cell)
    monkeypatch.setattr(subspace_join, "TILE", tile)
    rng = np.random.default_rng(cell + tile)
    rows = groups(rng, 500) + odd_vectors(rng)
    got = subspace_join.op13_embedding_links(spark, vectors(tmp_path, rows)).collect()
    plain = plain_links(rows)
    assert sorted((repr(r.vec_id), r.n_links, repr(r.component_id), r.kept) for r in got) == plain
    assert sum(p[1] for p in plain) > 5000 and any(p[1] == 0 for p in plain)


def test_links_equal_their_sql(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = groups(rng, 60)[:200] + [r for r in odd_vectors(rng) if not 9017 <= (r[0] or 0) <= 9020]
    compare(spark, "q", {"q": subspace_join.op13_embedding_links}, {"q": subspace_join.ORACLE}, vectors(tmp_path, rows))


def test_links_of_nothing_and_other_thresholds(spark, tmp_path):
    assert subspace_join.op13_embedding_links(spark, vectors(tmp_path, [])).collect() == []
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(rng.standard_normal((150, 5)).astype(np.float32))]
    out = subspace_join.linked_vectors(spark.createDataFrame(rows, "id long, e array<float>, kind string"), 0.7, "id", "e", "kind").collect()
    assert sorted((repr(r.vec_id), r.n_links, repr(r.component_id), r.kept) for r in out) == plain_links(rows, 0.7)


def test_pairs_within_the_budget_meet_once():
    rng = np.random.default_rng(6)
    space = subspace_join.Space(64, 0.9)
    raw = rng.standard_normal((40, 64))
    u = space.rotated(np.concatenate([raw, raw + 0.2 * rng.standard_normal((40, 64))]))
    for block in range(8):
        near = space.near(u, u, block)
        row, cell, own = space.cells(u, block, 11)
        home = dict(zip(row[own].tolist(), cell[own].tolist()))
        held = set(zip(row.tolist(), cell.tolist()))
        assert (near == near.T).all()
        for i, j in zip(*np.nonzero(np.triu(near, 1))):
            at = {home[i], home[j]}
            assert sum((i, c) in held and (j, c) in held for c in at) == 1 and (home[i] <= home[j]) == ((i, home[j]) in held)


def test_items_with_ids_of_strings(spark):
    from quern.llm import decontam

    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([("", "one two three four five six seven"), ("b", "other words that are not there"), (None, "one two three four five six seven")], "item_id string, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.matches(docs, items).collect()} == {(1, ""), (1, None)}
