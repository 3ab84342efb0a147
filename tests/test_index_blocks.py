"""An index whose postings are made of neighbouring documents, without a shuffle."""

from __future__ import annotations

import random

from quern.operators import lexical_index


def test_postings_are_a_row_a_block_and_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(3)
    rows = spark.createDataFrame([(i, "f", " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(9)))) for i in range(100)], "key long, file string, text string")
    numbered = lexical_index._numbered(lexical_index._tokenised(rows).coalesce(1), 1).coalesce(1).cache()
    held = lexical_index._postings(numbered, 4.0, 1.5, 0.75)
    assert "Exchange" not in held._jdf.queryExecution().sparkPlan().toString().replace("InMemoryTableScan", "").split("InMemoryRelation")[0]
    docs = {r.doc: dict(zip(r.terms, r.tfs)) for r in numbered.collect()}
    got: dict[int, dict] = {d: {} for d in docs}
    found = held.collect()
    for r in found:
        term = [t for t, n in zip(r.terms, r.ns) for _ in range(n)]
        for t, at, tf in zip(term, r["at"], r.tfs, strict=True):
            assert r.docs[at] >> 3 == r.block
            got[r.docs[at]][t] = tf
    assert got == docs and len(found) == len({d >> 3 for d in docs})
