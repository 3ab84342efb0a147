"""What a worker holds is bounded, and the results don't depend on the bounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quern.llm import common
from quern.operators import retrieval


def test_dense_search_is_the_same_in_small_slices_and_leaves_k_rows_a_task(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = rng.integers(-1, 2, (300, 4)).astype(float) / 2  # many ties
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "i long, embedding array<double>").repartition(2).cache()
    asked = items.where("i % 50 = 0").select(F.col("i").alias("q"), "embedding")
    plain = {}
    for q in range(0, 300, 50):
        score = np.round(vectors @ vectors[q], 6) + 0.0
        plain[q] = [d for d in sorted(range(300), key=lambda d: (-score[d], d)) if d != q][:7]
    monkeypatch.setattr(retrieval, "DENSE_CELLS", 30)
    found = retrieval.dense_search(asked, items, "q", "i", 7, exclude_same=True).orderBy("q", "rank").collect()
    got = {}
    for r in found:
        got.setdefault(r.q, []).append(r.i)
    assert got == plain


def test_a_worker_lets_go_of_another_stage_s_object():
    assert common.held(("x", 1), lambda: [1]) == [1] and common._held[1] is not None
    common.let_go()
    assert common._held == [None, None]
