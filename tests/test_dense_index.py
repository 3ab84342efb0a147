"""The stored index of vectors against a plain search."""

from __future__ import annotations

import numpy as np
import pytest

from quern.operators import dense_index, retrieval

ROWS = "k string, embedding array<float>"


def clustered(rng, n, unit=True):
    centres = rng.standard_normal((20, 24))
    x = centres[rng.integers(20, size=n)] + 0.05 * rng.standard_normal((n, 24))
    return x / np.linalg.norm(x, axis=1)[:, None] if unit else x * rng.uniform(0, 3, size=n)[:, None]


@pytest.mark.parametrize("unit", [True, False])
def test_hits_are_those_of_the_plain_search(spark, tmp_path, monkeypatch, unit):
    rng = np.random.default_rng(5)
    x = clustered(rng, 900, unit)
    rows = [(f"k{i}", v.tolist()) for i, v in enumerate(x)] + [("k3", x[4].tolist()), ("k5", x[5].tolist()), (None, x[1].tolist()), ("none", None), ("zero", [0.0] * 24)]
    items = spark.createDataFrame(rows, ROWS).repartition(3)
    asked = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(clustered(rng, 40, unit))] + [("same", x[7].tolist()), ("null", None), (None, x[8].tolist())], "q string, embedding array<float>")
    index = dense_index.write_dense_index(items, "k", str(tmp_path / "i"), model="m")
    told = {}
    for k in (1, 9):
        plain = sorted(map(repr, retrieval.dense_search(asked, items, "q", "k", k).collect()))
        assert sorted(map(repr, dense_index.search_dense_index(asked, index, "q", "k", k, told=told).collect())) == plain
    assert 0 < told["scored"] <= told["pairs"] * (0.25 if unit else 0.9)
    monkeypatch.setattr(dense_index, "QUERY_BLOCK", 10)
    assert sorted(map(repr, dense_index.search_dense_index(asked, index, "q", "k", 9).collect())) == plain
    with pytest.raises(ValueError):
        dense_index.read_dense_index(spark, str(tmp_path / "i"), model="other")
    with pytest.raises(ValueError):
        dense_index.search_dense_index(asked, index, "q", "k", 0)


def test_an_empty_index_and_more_hits_than_vectors(spark, tmp_path):
    none = dense_index.write_dense_index(spark.createDataFrame([], ROWS), "k", str(tmp_path / "none"))
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "q string, embedding array<float>")
    assert dense_index.search_dense_index(asked, none, "q", "k").count() == 0
    few = dense_index.write_dense_index(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [-1.0, 0.0])], ROWS), "k", str(tmp_path / "few"))
    assert [(r.k, r.score, r["rank"]) for r in dense_index.search_dense_index(asked, few, "q", "k", 10).orderBy("rank").collect()] == [("a", 1.0, 1), ("b", 1.0, 2), ("c", -1.0, 3)]
    older = dense_index.write_dense_index(spark.createDataFrame([("z", [0.0, 1.0])], ROWS), "k", str(tmp_path / "few"))
    assert dense_index.search_dense_index(asked, older, "q", "k").count() == 1 and dense_index.search_dense_index(asked, few, "q", "k").count() == 3
