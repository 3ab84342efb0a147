"""Lines with numbers, JSON lines, and answers that are asked for once."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.operators import answers, providers
from quern.sources import files, snapshots

SCHEMA = StructType().add("id", "string").add("n", "long")


def test_lines_of_split_files_have_their_numbers(spark, tmp_path):
    for name, count in (("a.jsonl", 4000), ("b.jsonl", 3), ("c.jsonl", 1500)):
        (tmp_path / name).write_text("".join(f"{name} {i}{'x' * (i % 40)}\n" for i in range(1, count + 1)))
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "open.jsonl").write_text("open.jsonl 1\n\nopen.jsonl 3")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        lines = files.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        for _ in range(2):
            got = lines.where("value <> ''").select(F.split("value", " ")[0].alias("f"), F.regexp_extract("value", " ([0-9]+)", 1).cast("long").alias("n"), "line", F.substring_index("file", "/", -1).alias("g")).collect()
            assert len(got) == 5505 and all(r.f == r.g and r.n == r.line for r in got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_problems_of_json_lines_are_named_by_line(spark, tmp_path):
    text = '﻿{"id": "a", "n": 1}\n{"id": "b", "n": 2} trailing\n\n{"id": "a", "n": 3}\n{"id": "c", "n": "x"}\n[1]\n{"id": "d"}\n{"id": "e", "n": 5}{"id": "f"}\n{"id": "g", "n": 1]}\n{"id": "a"}\n'
    (tmp_path / "x.jsonl").write_text(text + json.dumps({"id": "y" * 300}) + " z\n", encoding="utf-8")
    rows = files.jsonl_rows(spark, str(tmp_path / "x.jsonl"), SCHEMA)
    assert [(r.line, r.r.id, r.r.n) for r in rows.where("r is not null").orderBy("line").collect()] == [(1, "a", 1), (4, "a", 3), (7, "d", None), (10, "a", None)]
    found = sorted((r.problem, r.line) for r in files.jsonl_problems(rows, strict=True, key="id").collect())
    assert found == [("bad_line", 2), ("bad_line", 5), ("bad_line", 6), ("bad_line", 8), ("bad_line", 9), ("bad_line", 11), ("blank_line", 3), ("repeated_id", 4)]
    assert max(len(r.detail) for r in files.jsonl_problems(rows).collect()) == 312
    with pytest.raises(ValueError, match=r"bad_line \(6\): x.jsonl:2 .* trailing; x.jsonl:5 "):
        files.read_jsonl(spark, str(tmp_path / "x.jsonl"), SCHEMA)


def test_written_lines_and_reports_are_read_again(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2), ("a", 1), ("c", None)], "id string, n long")
    path = str(tmp_path / "out")
    files.write_jsonl(rows, path, order="id")
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        files.write_jsonl(rows, path)
    files.write_jsonl(rows.where("id = 'a'").withColumn("id", F.lit("z")), path, append=True)
    assert sorted(map(tuple, files.read_jsonl(spark, path, SCHEMA, strict=True, key="id").collect()), key=str) == [("a", 1), ("b", 2), ("c", None), ("z", 1)]
    files.write_jsonl(rows.limit(1), path, overwrite=True)
    assert files.read_jsonl(spark, path, SCHEMA).count() == 1
    (tmp_path / "report.json").write_text('{\n "method": "m",\n "hit_at_1": 0.5\n}')
    assert files.read_report(spark, str(tmp_path / "report.json")).first().asDict() == {"hit_at_1": 0.5, "method": "m"}


def counting(folder):
    os.makedirs(folder, exist_ok=True)

    def client(prompt):
        with open(f"{folder}/{prompt}", "a") as f:
            f.write("x")
        if prompt == "refused":
            raise answers.ProviderError(401, "no")
        if prompt == "busy" and os.path.getsize(f"{folder}/{prompt}") < 3:
            raise answers.ProviderError(429)
        if prompt.startswith("kill") and os.path.getsize(f"{folder}/{prompt}") == 1:
            os._exit(1)
        return f"answer {prompt}"

    return client, lambda: {n: os.path.getsize(f"{folder}/{n}") for n in sorted(os.listdir(folder))}


def test_answers_are_asked_for_once(spark, tmp_path):
    client, calls = counting(str(tmp_path / "calls"))
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("refused",), ("busy",)], "t string")
    told = providers.ask(rows, "t", client, attempts=3, backoff=0.01)
    for _ in range(2):
        got = told.collect()
        assert len(got) == 6 and calls() == {"a": 1, "b": 1, "busy": 3, "refused": 1}  # a refusal isn't tried again, a busy service is
    assert {(r.t, r.answer, r.error, r.attempts) for r in got} == {("a", "answer a", None, 1), ("b", "answer b", None, 1), (None, None, None, None), ("refused", None, "ProviderError: HTTP 401 no", 1), ("busy", "answer busy", None, 3)}


def test_answers_outlive_lost_tasks_and_restarts(spark, tmp_path):
    client, calls = counting(str(tmp_path / "calls"))
    store = str(tmp_path / "store")
    rows = spark.createDataFrame([(f"p{i}",) for i in range(20)] + [("kill",), ("refused",)], "t string").coalesce(1)
    with pytest.raises(Exception):  # noqa: B017 - the worker died
        providers.ask(rows, "t", client, answers=store)
    early = calls()
    assert early["kill"] == 1 and snapshots.versions(spark, store) == []
    for turn in range(2):  # a restart, and another
        got = providers.ask(rows, "t", client, answers=store, backoff=0).collect()
        assert {r.t: r.answer for r in got} == {**{f"p{i}": f"answer p{i}" for i in range(20)}, "kill": "answer kill", "refused": None}
        now = calls()
        assert all(now[f"p{i}"] == 1 for i in range(20)) and now["kill"] == 2
    more = providers.ask(spark.createDataFrame([("p3",), ("new",)], "t string"), "t", client, answers=store).collect()
    assert calls()["p3"] == 1 and calls()["new"] == 1 and {r.answer for r in more} == {"answer p3", "answer new"}
    kept = answers.stored(spark, store)
    assert kept.count() == 22 and kept.select("hash").distinct().count() == 22
    assert not [f for _, _, names in os.walk(f"{store}/journal") for f in names]


def test_a_models_names_are_looked_up(spark):
    files_ = spark.createDataFrame([("src/tree.py", "def fold_leaf_pages():\n    pass"), ("a.md", "nothing")], "path string, text string")
    rows = spark.createDataFrame([("fold_leaf_pages",), ("fold_leaf_pages",), (" where is Fold_x and TreeNode ",), ("no answer",), (None,), ("",)], "t string")

    def client(prompt):
        if prompt == "no answer":
            return "sorry"
        return json.dumps({"identifiers": ["made_up_name", "FOLD_LEAF_PAGES", "tree.py", 3, None], "keyword_query": "pages Pages", "should_search": False, "intent": "code_analysis"})

    ruled = {r.t: r for r in providers.rewrite(rows, "t", files=files_).collect()}
    assert ruled["fold_leaf_pages"].keyword_query == "fold_leaf_pages" and ruled["fold_leaf_pages"].identifier_checks[0].exists_in_repository
    assert ruled[" where is Fold_x and TreeNode "].keyword_query == "where is Fold_x and TreeNode Fold_x TreeNode"
    got = providers.rewrite(rows, "t", client, files=files_).collect()
    assert len(got) == 6
    by = {r.t: r for r in got}
    one = by["fold_leaf_pages"]
    assert (one.identifiers, one.keyword_query, one.should_search, one.semantic_query, one.rewrite_source) == (["fold_leaf_pages", "tree.py"], "pages Pages fold_leaf_pages tree.py", False, "fold_leaf_pages", "model")
    assert [tuple(c) for c in one.identifier_checks] == [("fold_leaf_pages", "question", True, True), ("made_up_name", "model", False, False), ("tree.py", "model", True, True), ("3", "model", False, False)]
    assert by["no answer"].rewrite_source == "rules" and by["no answer"].rewrite_error == "no JSON object"
    assert by[" where is Fold_x and TreeNode "].identifiers == ["Fold_x", "TreeNode", "FOLD_LEAF_PAGES", "tree.py"]
    blind = {r.t: r for r in providers.rewrite(rows, "t", client).collect()}
    assert blind["fold_leaf_pages"].identifiers == ["fold_leaf_pages"] and not any(c.accepted for c in blind["fold_leaf_pages"].identifier_checks if c.source == "model")
