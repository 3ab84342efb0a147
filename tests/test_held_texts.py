"""Names are looked for in one pass over the texts, however many there are."""

from __future__ import annotations

import random
import re

from quern.operators import diagnosis, matching


def _rows(rng, alphabet):
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(300))) for _ in range(200)] + [None, "ab" * 200_000]
    asked = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(14))) for _ in range(3000)]
    return texts, [*asked, None, "ab" * 100_001, "ab" * 200_001, texts[5], texts[6] + "a"]


def test_many_names_are_found_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK_TEXTS", 7)
    monkeypatch.setattr(matching, "WORDS", 50)  # what a task remembers is dropped now and then
    texts, asked = _rows(random.Random(9), ["a", "b", "_", "é", "😀", "cd", " ", "\n", " ", "　"])
    t, a = spark.createDataFrame([(x,) for x in texts], "text string"), spark.createDataFrame(list(enumerate(asked)), "k int, text string")
    found = matching.held_in(t, a, None, "text", "k", "text")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = [r.k for r in found.collect()]
    expected = {k for k, x in enumerate(asked) if x is not None and any(y is not None and x in y for y in texts)}
    assert set(got) == expected and len(got) == len(expected) and 1000 < len(expected) < 2500


def test_texts_or_names_may_be_missing(spark):
    t = spark.createDataFrame([("a b",), (None,)], "text string")
    a = spark.createDataFrame([("",), (" ",), (None,), ("c",)], "name string")
    assert sorted(r.t for r in matching.held_texts(t, "text", a, "name").collect()) == ["", " "]
    assert matching.held_texts(t, "text", a.limit(0), "name").count() == 0
    assert matching.held_texts(t.limit(0), "text", a, "name").count() == 0


def test_words_end_where_blanks_are():
    assert all(bool(re.fullmatch(matching.BLANK, chr(i))) == chr(i).isspace() for i in range(0x110000))


def test_names_are_made_once(spark):
    docs = spark.range(50).selectExpr("concat('Word', id, ' and Other', id) as text")
    names = spark.range(100).selectExpr("concat('word', id) as name")
    files = spark.range(5).selectExpr("concat('src/', id, '.py') as path")
    got = diagnosis.identifier_exists(names, docs, files)
    assert "Range (0, 100" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.name for r in got.where("exists_in_files").collect()} == {f"word{i}" for i in range(50)}
