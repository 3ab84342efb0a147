"""Shared parts of expressions are evaluated once, however many rules name them."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import curation, providers


def _parses(spark, error) -> int:
    return spark.range(1).select(error(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString().lower().count("parse")


def test_rules_parse_a_json_text_once(spark):
    assert _parses(spark, lambda c: T.json_value(c)) > 0
    once = _parses(spark, lambda c: T.json_value(c))
    for error, texts in ((curation.target_error, 1), (curation.metadata_error, 1), (curation.judgment_error, 1), (curation.sample_error, 3)):
        assert _parses(spark, error) == texts * once  # a sample's target and metadata are texts of their own


def test_many_items_are_told_apart_in_little_more_than_their_number(spark):
    rng = random.Random(3)
    words = [rng.choice(["", " ", "\t"]) + rng.choice(["Ab_c", "ab_C", "é", "É", "x"]) + str(rng.randrange(2500)) + rng.choice(["", " "]) for _ in range(6000)] + ["", "  ", None]
    seen, plain = set(), []
    for w in words:
        w = (w or "").strip()
        if w and w.lower() not in seen:
            seen.add(w.lower())
            plain.append(w)
    began = time.perf_counter()
    got = spark.createDataFrame([(words,)], "w array<string>").select(T.first_occurrences(F.col("w"))).first()[0]
    assert got == plain and time.perf_counter() - began < 15


def test_identifiers_are_whole_runs(spark):
    import re

    def plain(text):
        forms = (
            (r"[A-Za-z0-9_./\\-]+", r"^([A-Za-z0-9_./\\-]+\.(?:py|json|ya?ml|toml|md|txt))(?:[^A-Za-z0-9_].*)?$", re.I), ("[A-Za-z0-9_]+", "^([A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+)$", 0),
            ("[A-Za-z0-9_.]+", r"^([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)$", 0), ("[A-Za-z0-9_]+", "^([A-Z]{2,}[A-Za-z0-9]*|[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]*)$", 0),
        )
        seen, out = set(), []
        for run, form, flags in forms:
            for r in re.findall(run, text):
                m = re.match(form, r, flags)
                if m and m[1].lower() not in seen:
                    seen.add(m[1].lower())
                    out.append(m[1])
        return out

    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "B", "Cd", "_", ".", ".py", ".Md", "/", "-", "\\", " ", "9", "é", "AB", "\n"]) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.identifiers(F.col("t")).alias("i")).collect()
    assert all(r.i == plain(r.t) for r in rows) and sum(map(len, (r.i for r in rows))) > 3000


def test_long_runs_of_capitals_end(spark):
    text = "Ab" + "CDEFGHIJ" * 40 + "_ x " + "A.b" * 300 + "."
    assert spark.createDataFrame([(text,)], "t string").select(T.identifiers(F.col("t"))).first()[0] == []


def test_identifiers_take_one_pass_and_no_pattern_over_texts(spark):
    texts = [None, "", "a.", "Bc x_", "_y a.b", None, "end.", "Next Ab.Cd/ef.py é_a ABé AB", "x\ny.z", "aB", "AbC\x00D.e", "Ab AB aB. ab"]
    expected = [None, [], [], [], ["a.b"], None, [], ["Ab.Cd/ef.py", "Ab.Cd", "ef.py", "AB"], ["y.z"], [], ["D.e", "AbC"], ["AB"]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).select("i", T.identifiers(F.col("t")).alias("k"))
    assert [r.k for r in rows.orderBy("i").collect()] == expected
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp" not in plan


def test_a_rewrite_looks_for_identifiers_once(spark):
    ruled = providers.rewrite_by_rules(spark.createDataFrame([("see a_b and AbC",)], "text string"), "text")
    assert ruled._jdf.queryExecution().optimizedPlan().toString().count("_identifiers(") == 1
    assert ruled.columns[1:6] == ["intent", "should_search", "semantic_query", "keyword_query", "identifiers"]
    r = ruled.first()
    assert r.identifiers == ["a_b", "AbC"] and r.keyword_query == "see a_b and AbC a_b AbC"
