"""Lists of files by trigram, made where the texts are read."""

from __future__ import annotations

import random

from quern.operators import gram_index


def test_lists_are_whole_however_runs_are_cut_and_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(2)
    texts = {i + (i // 60 << 33): "".join(rng.choice("abc ") for _ in range(rng.randrange(30))) for i in range(120)}
    want = {(g, file) for file, t in texts.items() for g in gram_index.grams(t)}
    rows = spark.createDataFrame(list(texts.items()), "file long, t string").coalesce(1)
    for most in (50, 4_000_000):
        monkeypatch.setattr(gram_index, "RUN_CHARS", most)
        lists = gram_index._listed(rows)
        assert "Exchange" not in lists._jdf.queryExecution().executedPlan().toString()
        found = lists.collect()
        pairs = [(r.gram, f) for r in found for f in r.files]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want
        assert all(f >> 10 == r.block for r in found for f in r.files) and all(list(r.files) == sorted(r.files) for r in found)
