"""Column functions on cases worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import corpus, diagnosis, evidence


def values(spark, inputs, column):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i long, x string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("x"))).collect()]


def test_tokens(spark):
    got = values(spark, ["foo", "generateWithCache2X", "model_state 42", "HTTPServer", "在哪里", "x=缓存", None, ""], T.code_tokens)
    assert got == [
        ["foo", "foo"], ["generatewithcache2x", "generate", "with", "cache", "2", "x"], ["model_state", "model", "state", "42", "42"],
        ["httpserver", "httpserver"], ["在", "哪", "里", "在哪", "哪里"], ["x", "x", "缓", "存", "缓存"], [], [],
    ]


def test_bag_holds_the_same_tokens(spark):
    texts = ["fooBar_baz9Qux 12ab _x __Ab1 İK é Zoë9", "在哪里 modelState", "a.b.C9d"]
    assert [sorted(t) for t in values(spark, texts, T.token_bag)] == [sorted(t) for t in values(spark, texts, T.code_tokens)]


@pytest.mark.parametrize("n, expected", [(0, []), (1, [(1, 1)]), (80, [(1, 80)]), (81, [(1, 80), (71, 81)]), (150, [(1, 80), (71, 150)]), (151, [(1, 80), (71, 150), (141, 151)])])
def test_windows(spark, n, expected):
    df = spark.createDataFrame([(1, "\n".join("x" for _ in range(n)))], "k long, text string")
    assert sorted((r.start_line, r.end_line) for r in corpus.line_windows(df, "k").collect()) == expected


def test_windows_reject_overlap(spark):
    with pytest.raises(ValueError):
        corpus.line_windows(spark.createDataFrame([(1, "a")], "k long, text string"), "k", chunk_lines=5, overlap=5)


def test_trailing_line_end_opens_no_line(spark):
    assert values(spark, ["a\nb\n", "a\nb", "\n", "", None], T.line_array) == [["a", "b"], ["a", "b"], [""], [], []]
    assert values(spark, ["a\nb\n", "a\nb", "\n", "", None], corpus.line_count) == [2, 2, 1, 0, 0]


def test_empty_file_slice(spark):
    df = spark.createDataFrame([(1, ""), (2, "a\nb\nc"), (3, None)], "k long, text string")
    got = {r.k: (r.start_line, r.end_line, r.total_lines, r.content) for r in corpus.file_slices(df, "k", 2, 9).collect()}
    assert got == {1: (0, 0, 0, ""), 2: (2, 3, 3, "b\nc"), 3: (0, 0, 0, "")}


def test_confidence(spark):
    assert values(spark, ["0.25", "7", "-1", "x", None], T.clamp_confidence) == [0.25, 1.0, 0.0, 0.5, 0.5]


def test_json_repair(spark):
    got = values(spark, ['{"a": 1}', "```json\n{\"b\": 2}\n```", 'so {"c": 3} there', "[1]", "{broken", None], T.repair_json_object)
    assert got == ['{"a": 1}', '{"b": 2}', '{"c": 3}', None, None, None]
    assert values(spark, ["x [1, 2] y"], T.repair_json_array) == ["[1, 2]"]


def test_identifiers(spark):
    assert values(spark, ["see src/model.py and generate_with_cache in TransformerLM, RMSNorm model.load"], T.identifiers) == [
        ["src/model.py", "generate_with_cache", "model.py", "model.load", "TransformerLM", "RMSNorm"]
    ]


def test_exception_rules(spark):
    df = spark.createDataFrame([("ModuleNotFoundError: No module named 'x'",), ("ValueError: size mismatch",), ("fine",)], "x string")
    got = [r[0] for r in df.select(T.classify_exception(F.lit(None), F.lit(None), F.col("x"))).collect()]
    assert got == ["missing_dependency", "tensor_shape_mismatch", "unknown"]


def test_citations_outside_fences(spark):
    got = values(spark, ["see [a.py:1-3] and ```\n[b.py:1-2]\n``` end", "``` [a.py:1-2]", "[a.py:5]"], evidence.citations)
    assert [[tuple(c) for c in r] for r in got] == [[("a.py", 1, 3)], [], []]


def test_ranges_are_not_merged(spark):
    cited = spark.createDataFrame([(1, 0, "a.py", 5, 9)], "id long, pos long, file string, start_line long, end_line long")
    held = spark.createDataFrame([(1, "a.py", 1, 6), (1, "a.py", 6, 10)], "id long, file string, start_line long, end_line long")
    files = spark.createDataFrame([("a.py", 50)], "file string, total_lines long")
    assert [r.reason for r in evidence.check_citations(cited, held, files, "id").collect()] == ["unsupported"]


def test_frames(spark):
    log = 'Traceback\n  File "a/b.py", line 3, in f\n    x = 1\n  File "c.py", line 9\nKeyError: \'k\'\nKeyboardInterrupt'
    f = values(spark, [log], diagnosis.frames)[0]
    assert [(x.file, x.line, x.function, x.source_line) for x in f] == [("a/b.py", 3, "f", "x = 1"), ("c.py", 9, None, "KeyError: 'k'")]
    assert [(x.type, x.message) for x in values(spark, [log], diagnosis.exceptions)[0]] == [("KeyError", "'k'"), ("KeyboardInterrupt", "")]


def test_identifier_exists(spark):
    names = spark.createDataFrame([("model.py",), ("Cache",), ("nope",)], "name string")
    lines = spark.createDataFrame([("a cache here",)], "text string")
    files = spark.createDataFrame([("src/model.py",)], "path string")
    got = {r.name: r.exists_in_files for r in diagnosis.identifier_exists(names, lines, files).collect()}
    assert got == {"model.py": True, "Cache": True, "nope": False}


def test_harvest(spark):
    payload = '{"r": [{"file": "a", "start_line": 1, "end_line": 2, "content": "x", "in": {"file": "b", "start_line": 3, "end_line": 3}}, {"file": "c", "start_line": true, "end_line": 2}]}'
    df = spark.createDataFrame([(payload,), ("no",)], "p string").lateralJoin(evidence.HarvestEvidence(F.col("p").outer()))
    assert sorted((r.file, r.start_line) for r in df.collect()) == [("a", 1), ("b", 3)]


def test_small_functions(spark):
    df = spark.createDataFrame([("a <q> what is it </q> b", " YES "), ("none", "0"), (None, None)], "t string, f string")
    got = [tuple(r) for r in df.select(T.between(F.col("t"), "<q>", "</q>"), T.flag(F.col("f"))).collect()]
    assert got == [("what is it", True), (None, False), (None, False)]
    assert spark.createDataFrame([([0.1, 0.9],), ([0.3],)], "v array<double>").select(T.prediction_score(F.col("v"))).collect()[0][0] == 0.9


def test_present_files_and_acceptance(spark):
    files = spark.createDataFrame([("app.py",), ("api/main.py",), ("x.py",)], "path string")
    got = {r.path: r.preference for r in diagnosis.present_files(files, diagnosis.ENTRY_FILES).collect()}
    assert got == {"app.py": 1, "api/main.py": 4}
    named = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "name string, from_user boolean")
    known = spark.createDataFrame([("b", True), ("c", False)], "name string, exists_in_files boolean")
    assert {r.name: r.accepted for r in diagnosis.accepted_identifiers(named, known).collect()} == {"a": True, "b": True, "c": False}
