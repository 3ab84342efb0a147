"""Operators on small rows: retrieval, evaluation, curation, sessions, sources, static analysis."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quern.functions import text as T
from quern.operators import corpus, curation, diagnosis, evaluation, matching, providers, retrieval, search, service, sessions, static_analysis, tools
from quern.sources import files
from quern.streaming import sessions as streaming


def test_bm25_score_by_hand(spark):
    docs = spark.createDataFrame([(1, "cat dog"), (2, "dog"), (3, None)], "k long, text string")
    asked = spark.createDataFrame([("q", "cat cat")], "q string, text string")
    r = retrieval.bm25_search(asked, docs, "q", "k").collect()
    idf, avgdl = math.log(1 + 2.5 / 1.5), 2.0
    assert [(x.k, x.rank) for x in r] == [(1, 1)]
    assert r[0].score == pytest.approx(4 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 4 / avgdl)), abs=1e-6)


def test_dense_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    items = spark.createDataFrame(rows, "v long, embedding array<float>").repartition(4)
    asked = items.where("v < 10").withColumnRenamed("v", "q")
    one = sorted(map(tuple, retrieval.dense_search(asked, items, "q", "v", 3).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    assert sorted(map(tuple, retrieval.dense_search(asked, items, "q", "v", 3).collect())) == one


def test_fusion_by_hand(spark):
    ddl = "q string, k long, score double, rank long"
    dense = spark.createDataFrame([("q", 1, 0.9, 1), ("q", 2, 0.8, 2)], ddl)
    lexical = spark.createDataFrame([("q", 3, 9.0, 1), ("q", 1, 8.0, 2)], ddl)
    got = {r.k: (r.rrf_score, r.matched_by, r["rank"]) for r in retrieval.fuse(dense, lexical, "q", "k").collect()}
    assert got[1] == (round(1 / 61 + 1 / 62, 9), "dense,bm25", 1) and got[3][2] == 2 and got[2][2] == 3


def test_rerank_falls_back(spark):
    rows = spark.createDataFrame([("q", 1, 0.3, 1, None), ("q", 2, 0.2, 2, None)], "q string, k long, rrf_score double, rank long, reranker_score double")
    assert [(r.k, r.reranker_status) for r in retrieval.rerank(rows, "q", "k").orderBy("reranker_rank").collect()] == [(1, "fallback"), (2, "fallback")]


def test_threshold(spark):
    rows = spark.createDataFrame([(0.9, True), (0.8, True), (0.7, False), (0.6, False)], "score double, should_retrieve boolean")
    assert evaluation.calibrate(rows, 1.0).first().threshold == 0.8


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([(True, 1, 1.0, 5), (True, 3, 1 / 3, 5), (True, None, 0.0, 5), (False, None, 0.0, 0)], "should_retrieve boolean, first_rank long, reciprocal_rank double, retrieved long")
    r = evaluation.retrieval_metrics(rows).first()
    assert (r.mrr, r.hit_at_3, r.irrelevant_fp_rate) == (0.444444, 0.666667, 0.0)
    empty = evaluation.retrieval_metrics(rows.where("not should_retrieve")).first()
    assert empty.mrr is None


@pytest.mark.parametrize("n, sizes", [(3, (1, 1, 1)), (5, (3, 1, 1)), (10, (6, 2, 2)), (35, (21, 7, 7))])
def test_split_sizes(spark, n, sizes):
    got = curation.group_split(spark.createDataFrame([(i, "a") for i in range(n)], "g long, l string"), "g", "l")
    counts = {r.split: r["count"] for r in got.groupBy("split").count().collect()}
    assert (counts["train"], counts["validation"], counts["test"]) == sizes


def test_memory_equals_replay(spark):
    rng = random.Random(2)
    rows = [(s, t, rng.randrange(0, 900)) for s in range(40) for t in range(rng.randrange(1, 15))]
    df = spark.createDataFrame(rows, "session string, turn long, chars long")
    kept = sessions.remembered(df, "session", "turn", F.col("chars"), 6, 1500)
    got = {}
    for r in kept.collect():
        got.setdefault(r.session, []).append(r.turn)
    for s in range(40):
        turns, chars = [], []
        for _, t, c in sorted(x for x in rows if x[0] == s):
            turns, chars = streaming.remember([*turns, t], [*chars, c], 6, 1500)
        assert sorted(got[str(s)]) == turns


def test_streaming_memory(spark, tmp_path):
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"session": ["a"] * 8, "turn": range(8), "chars": [10] * 8}))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streaming.streaming_memory(stream).writeStream.outputMode("update").format("memory").queryName("held").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.turn_count, r.first_turn, r.last_turn) for r in spark.table("held").collect()] == [(6, 2, 7)]


def test_static_analysis():
    source = "import os as o\nfrom a import b\nclass K:\n  def f(self, x=[], *, y=dict()):\n    try:\n      return x and y or '/p'\n    except E:\n      ...\n"
    r = static_analysis.analyse_source(source)
    f = r["functions"][0]
    assert (f["class_name"], f["complexity"], f["length"]) == ("K", 4, 5)
    assert sorted(w["type"] for w in r["warnings"]) == ["empty_except", "hardcoded_path", "mutable_default", "mutable_default"]
    with pytest.raises(ValueError):
        static_analysis.analyse_source("def (")


def test_chunks_cover_the_file():
    source = "x = 1\n@d\ndef f():\n    pass\n\n\nclass C:\n    pass\ny = 2\n"
    got = static_analysis.chunk_source(source)
    assert [(a, b, k, n) for a, b, k, n, _ in got] == [(1, 1, "python_module", None), (2, 4, "function", "f"), (7, 8, "class", "C"), (9, 9, "python_module", None)]
    assert [c[2] for c in static_analysis.chunk_source("def broken(")] == ["python_text"]
    for deep in ("(" * 9000, "-" * 9000 + "1", "a" + ".b" * 30_000, "x = " + "[" * 150 + "]" * 150):
        assert [c[2] for c in static_analysis.chunk_source(deep)] == ["python_text"]


def test_repository_scan(spark, tmp_path):
    for name, text in {"a.py": "x\n", "b/c.MD": "y", "data/d.py": "no", "Data/e.py": "yes", "f.bin": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert sorted(r.path for r in files.scan_repository(spark, str(tmp_path)).collect()) == ["Data/e.py", "a.py", "b/c.MD"]
    with pytest.raises(ValueError):
        files.validate_root(spark, str(tmp_path / "a.py"))


@pytest.mark.parametrize("path", ["../x", "/etc", "a/../../b", "ok#/../../../etc/passwd", "ok?/../../../etc/passwd", "C:\\x", "..\\x", "a/./../../x", "file:///etc/passwd", "s3://b/x", "a\0b", "%2e%2e/../../x"])
def test_paths_that_leave_the_root(path):
    assert not files.inside_root(path, "/r")


def test_paths_stay_inside(tmp_path):
    assert all(files.inside_root(p, "/r") for p in ("a/b.py", "a/../b", "./a", "odd#name?.py", "..a/b", ""))
    assert files.inside_root("a", "/ok/r", ("/ok",)) and not files.inside_root("a", "/okay", ("/ok",)) and files.inside_root("a", "/ok", ("/ok/",))
    assert not files.inside_root("a.py", "/allowed/../etc", ("/allowed",)) and not files.inside_root("a.py", "s3://b/allowed/../etc", ("s3://b/allowed",))
    assert files.inside_root("a.py", "s3://b/allowed/r", ("s3://b/allowed",)) and not files.inside_root("a.py", "s3://c/allowed/r", ("s3://b/allowed",))
    root, outside = tmp_path / "root", tmp_path / "outside"
    root.mkdir(), outside.mkdir()
    (root / "link").symlink_to(outside)
    assert not files.inside_root("link/x.py", str(root)) and files.inside_root("own/x.py", str(root)) and not files.inside_root("x.py", str(root / "link"), (str(root),))


def test_all_problems_of_a_file_are_there(spark, tmp_path):
    schema = StructType([StructField("id", StringType()), StructField("n", LongType())])
    path = tmp_path / "b.jsonl"
    path.write_text("".join(f'{{"id": "i{i % 150}", "n": {i}}}\n' if i % 2 else f"{{oops {i}\n" for i in range(600)) + "\n")
    rows = files.jsonl_rows(spark, str(path), schema)
    told = {r.problem: r["count"] for r in files.jsonl_problems(rows, True, "id").groupBy("problem").count().collect()}
    assert told == {"bad_line": 300, "blank_line": 1, "repeated_id": 75}
    with pytest.raises(ValueError, match=r"bad_line \(300\)"):
        files.read_jsonl(spark, str(path), schema)


def test_reports_and_proposals(spark, tmp_path):
    rows = spark.createDataFrame([("b|x", 0.5, 3), ("a", None, 4)], "method string, mrr double, n int")
    text = files.markdown_table(rows, "Methods", ["method"])
    assert text == "# Methods\n\n| method | mrr | n |\n|---|---|---|\n| a | - | 4 |\n| b\\|x | 0.5000 | 3 |\n"
    target = str(tmp_path / "out" / "r.md")
    files.write_text(spark, target, text)
    assert open(target).read() == text
    with pytest.raises(FileExistsError):
        files.write_text(spark, target, text)
    repository = tmp_path / "repo"
    repository.mkdir()
    with pytest.raises(ValueError):
        files.write_proposal(spark, str(repository / "sub"), str(repository), "x")
    a, b = (files.write_proposal(spark, str(tmp_path / "proposals"), str(repository), "x") for _ in "ab")
    assert a != b and open(a).read() == "x"


def test_jsonl(spark, tmp_path):
    schema = StructType([StructField("id", StringType()), StructField("n", LongType())])
    good, bad = tmp_path / "g.jsonl", tmp_path / "b.jsonl"
    good.write_text('{"id": "a", "n": 1}\n\n{"id": "b", "n": 2}\n')
    bad.write_text('{"id": "a", "n": 1}\n{"id": oops\n')
    assert files.read_jsonl(spark, str(good), schema).count() == 2
    with pytest.raises(ValueError, match="blank_line"):
        files.read_jsonl(spark, str(good), schema, strict=True, key="id")
    with pytest.raises(ValueError, match="bad_line"):
        files.read_jsonl(spark, str(bad), schema)


def test_index_rejects_another_model(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([(1, "a")], "k long, v string")
    assert files.build_or_load(spark, path, lambda: rows, model="m").count() == 1
    with pytest.raises(ValueError):
        files.build_or_load(spark, path, lambda: rows, model="other")
    odd = spark.createDataFrame([(1, 0.5)], "k long, _score double")
    pinned = files.read_index(spark, path, model="m")
    assert files.build_or_load(spark, path, lambda: odd, rebuild=True, model="m' or '1'='0").columns == ["k", "_score"]
    with pytest.raises(ValueError):
        files.read_index(spark, path, model="m' or '1'='1")
    assert pinned.columns == files.read_index(spark, path, 1, model="m").columns == ["k", "v"] and pinned.count() == 1


def test_providers(spark):
    rows = spark.createDataFrame([("a b", "a b"), ("", "x")], "q string, p string")
    assert [r.reranker_score for r in providers.cross_score(rows, "q", "p").collect()] == [1.0, 0.0]

    def broken(pairs):
        raise RuntimeError("no model")

    assert [r.reranker_score for r in providers.cross_score(rows, "q", "p", broken).collect()] == [None, None]
    assert len(providers.embed(rows, "q").first().embedding) == 64


def test_chat_samples(spark):
    good = [{"role": r, "content": c} for r, c in (("system", "s"), ("user", "u"), ("assistant", '{"decision": 1, "tool_name": 2, "arguments": {}}'))]
    df = spark.createDataFrame([(1, good), (2, good[::-1]), (3, good[:2])], "i long, m array<struct<role:string,content:string>>")
    assert [r.v for r in df.orderBy("i").select(curation.chat_sample_valid(F.col("m")).alias("v")).collect()] == [True, False, False]


def test_grep_of_a_file_of_hits(spark):
    n = 20_000
    df = spark.createDataFrame([(1, "\n".join(f"hit number {i}" for i in range(n))), (2, "no"), (3, None), (4, "a\nHIT\nb")], "k long, text string")
    got = corpus.grep(df, "k", "hit", context=1, limit=20).collect()
    assert [(r.k, r.line) for r in got] == [(1, i + 1) for i in range(20)] and got[0].content == "> hit number 0\n  hit number 1" and got[1].total_lines == n
    assert corpus.grep(df, "k", "hit", context=2, limit=None).count() == n + 1


def test_line_ranges(spark):
    df = spark.createDataFrame([("a", ["1", "2", "3"]), ("b", [])], "path string, lines array<string>")
    asked = spark.createDataFrame([("a", 1, 2), ("a", 2, 9), ("a", 1, 2), ("b", 1, 1), ("c", 1, 2), ("a", 3, 2)], "path string, first long, last long")
    got = {(r.path, r["first"], r["last"]): r.content for r in corpus.line_ranges(asked, df, "path", "lines", "first", "last").collect()}
    assert got == {("a", 1, 2): "1\n2", ("a", 2, 9): "2\n3"}


def test_matching_equals_contains(spark, monkeypatch):
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice("ab ") for _ in range(rng.randrange(0, 30)))) for i in range(60)] + [(99, None)]
    asked = [(j, "".join(rng.choice("ab ") for _ in range(rng.randrange(0, 4)))) for j in range(40)] + [(77, None), (78, "ab"), (79, "ab")]
    t, a = spark.createDataFrame(texts, "d long, text string"), spark.createDataFrame(asked, "k int, text string")
    expected = {(k, d) for k, x in asked for d, y in texts if x is not None and y is not None and x in y}
    for block in (10_000, 7):
        monkeypatch.setattr(matching, "BLOCK_TEXTS", block)
        got = [tuple(r) for r in matching.held_in(t, a, "d", "text", "k", "text").collect()]
        assert set(got) == expected and len(got) == len(expected)
    assert {r.k for r in matching.held_in(t, a, None, "text", "k", "text").collect()} == {k for k, _ in expected}
    assert matching.held_in(t, a.limit(0), "d", "text", "k", "text").count() == 0


def test_search_in_small_sets_and_blocks(spark, monkeypatch):
    rng = random.Random(6)
    words = ["the"] * 30 + [f"w{i}" for i in range(60)] + ["foo_bar", "缓存在"]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))) for i in range(150)] + [(500, None), (501, "")], "k long, text string").repartition(3)
    asked = spark.createDataFrame([(f"q{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))) for i in range(30)] + [("none", None), ("new", "zzz")], "q string, text string")
    plain = sorted(map(tuple, retrieval.bm25_search(asked, docs, "q", "k", 7).collect()))
    assert len(plain) > 100
    for name, value in (("QUERY_SET", 8), ("LEXICAL_BLOCK", 3), ("BLOCK_BYTES", 200)):
        monkeypatch.setattr(retrieval, name, value)
        assert sorted(map(tuple, retrieval.bm25_search(asked, docs, "q", "k", 7).collect())) == plain
    assert retrieval.bm25_search(asked.limit(0), docs, "q", "k").count() == 0 and retrieval.bm25_search(asked, docs.limit(0), "q", "k").count() == 0


@pytest.mark.parametrize("ks", [(0, 20, 30), (11, 20, 30), (5, 4, 30), (5, 20, 19), (True, 20, 30)])
def test_numbers_of_hits(ks):
    with pytest.raises(ValueError):
        search.chained_ks(*ks)
    assert search.adapted_ks(5) == (5, 20, 30) and search.adapted_ks(10, 50) == (10, 40, 50)


def test_distribution_is_exact(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "QUANTILES", 8)
    rng = random.Random(3)
    rows = [("a", rng.choice([1.0, 2.0, 5.0])) for _ in range(400)] + [("b", rng.gauss(0, 1)) for _ in range(333)] + [("b", 1e9), ("c", 4.0), (None, 2.0), (None, 3.0), ("d", None)]
    got = {r.g: r for r in evaluation.distribution(spark.createDataFrame(rows, "g string, s double"), "g", "s").collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, r in got.items():
        v = sorted(s for h, s in rows if h == g)
        for name, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75)):
            at = p * (len(v) - 1)
            lo, hi = v[math.floor(at)], v[math.ceil(at)]
            assert r[name] == pytest.approx(lo + (hi - lo) * (at - math.floor(at)), abs=1e-6)


def test_split_cells_change_nothing(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "abc"[i % 3] if i % 40 else None) for i in range(900)], "g long, l string")
    whole = sorted(map(tuple, curation.group_split(rows, "g", "l").collect()), key=repr)
    monkeypatch.setattr(curation, "CELL_GROUPS", 5)
    assert sorted(map(tuple, curation.group_split(rows, "g", "l").collect()), key=repr) == whole


def test_json_is_read_whole(spark):
    texts = ['{"a": 1}', '{"a": 1} x', '{"a": 1}] {', '{"a": 1}}', '{"a": 1}, "b": 2', "[1]", " {} ", "", None, "{"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = [r[0] for r in df.orderBy("i").select(T.json_value(F.col("t")).cast("string")).collect()]
    assert got == ['{"a":1}', None, None, None, None, "[1]", "{}", None, None, None]


def test_providers_are_asked_once_and_lose_nothing(spark):
    rows = spark.createDataFrame([("a b",), ("a b",), ("c d",), (None,), ("bad",)], "t string")

    def client(prompt):
        if prompt == "bad":
            raise RuntimeError("down")
        return f'so: {{"semantic_query": "{prompt} better", "should_search": true, "intent": "code_search", "identifiers": ["x"], "confidence": 3}}'

    told = providers.ask(rows, "t", client, attempts=2).collect()
    assert len(told) == 5 and {(r.t, r.attempts) for r in told} == {("a b", 1), ("c d", 1), (None, None), ("bad", 2)} and [r.error for r in told if r.t == "bad"] == ["RuntimeError: down"]
    got = {r.t: r for r in providers.rewrite(rows, "t", client).collect()}
    assert (got["a b"].semantic_query, got["a b"].rewrite_source, got["a b"].confidence) == ("a b better", "model", 1.0)
    assert got["bad"].rewrite_source == "rules" and got["bad"].rewrite_error == "RuntimeError: down" and got["bad"].semantic_query == "bad"
    judged = {r.t: r for r in providers.judge(rows.dropDuplicates(), "t").collect()}
    assert judged["a b"].status == "ok" and judged[None].status == "error"
    broken = providers.judge(rows.limit(1), "t", lambda p: '{"answer_supported": 1}').first()
    assert (broken.status, broken.judge_error) == ("error", "not_a_flag:answer_supported")
    silent = providers.judge(rows.limit(1), "t", lambda p: "nothing", attempts=3).first()
    assert (silent.attempts, silent.judge_error) == (3, "no JSON object")
    routed = {r.t: (r.pred_tool, r.schema_error) for r in providers.route(spark.createDataFrame([("my docker",), ("hello",)], "t string"), "t").collect()}
    assert routed == {"my docker": ("generate_dockerfile", None), "hello": (None, None)}


def test_search_tells_why(spark):
    docs = spark.createDataFrame([(1, "fold_leaf of the cart"), (2, "press the pears"), (3, "cart cart")], "k long, text string")
    vectors = providers.embed(docs, "text").select("k", "embedding")
    asked = spark.createDataFrame([("q1", "where is fold_leaf"), ("q2", "hello"), ("q3", "zzz_yyy")], "q string, text string")
    hits, told = search.search(asked, docs, vectors, "q", "k", scorer=providers.overlap_scorer())
    reasons = {r.q: r.reason for r in told.collect()}
    assert reasons["q2"] == "no_search_needed" and reasons["q1"] is None
    best = hits.where("q = 'q1'").orderBy("reranker_rank").first()
    assert best.k == 1 and best.reranker_status == "scored" and "bm25" in best.matched_by
    _, told = search.search(asked, docs, vectors, "q", "k", threshold=2.0)
    assert {r.reason for r in told.collect()} == {"no_search_needed", "below_threshold"}


def test_chunk_table(spark):
    rows = [("a.py", "import os\n\ndef f():\n    return 1\n"), ("b.md", "x\ny\n"), ("C.PY", "no def here"), ("e.py", ""), ("n.txt", None)]
    got = {r.chunk_id: (r.chunk_type, r.name) for r in corpus.chunk_table(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a.py:1-2": ("python_module", None), "a.py:3-4": ("function", "f"), "b.md:1-2": ("text", None), "C.PY:1-1": ("python_text", None)}


def test_diagnosis(spark):
    files_ = spark.createDataFrame([("api/run.py", "\n".join(f"line {i}" for i in range(1, 41))), ("lib/io.py", "one"), ("notes.md", "x")], "path string, text string")
    log = 'Traceback (most recent call last):\n  File "/srv/api/run.py", line 20, in go\n    x = 1\n  File "/srv/notes.md", line 1\n  File "/else/where.py", line 3, in h\nKeyError: \'plum\''
    logs = spark.createDataFrame([("l1", log), ("l2", "fine"), ("l3", None)], "id string, text string")
    found = diagnosis.diagnose(logs, files_, "id")
    frames = {r.n: (r.repository_file, r.start_line, r.end_line, r.context) for r in found["frames"].where("id = 'l1'").collect()}
    assert frames[1] == ("api/run.py", 10, 30, "\n".join(f"line {i}" for i in range(10, 31))) and frames[2] == ("notes.md", 1, 1, "x") and frames[3][0] is None
    assert [(r.id, r.file) for r in found["analyse"].collect()] == [("l1", "api/run.py")]
    parsed = {r.id: r for r in found["parsed"].collect()}
    assert parsed["l1"].exception_type == "KeyError" and parsed["l1"].frame_count == 3 and parsed["l2"].frame_count == 0 and len(parsed) == 3
    assert {r.query for r in found["queries"].collect()} >= {"KeyError 'plum'", "missing_dictionary_key"}


def test_toolbox(spark, tmp_path):
    source = 'import os\n\n\ndef fold_leaf(a, b=[]):\n    """Folds."""\n    return a\n'
    rows = [("main.py", source), ("requirements.txt", "numpy\n"), ("readme.md", "fold_leaf is in main\n"), ("broken.py", "def (")]
    box = tools.Toolbox(spark.createDataFrame(rows, "path string, text string"), index_path=str(tmp_path / "lex"))
    found = box.call("search_codebase", '{"query": "where is fold_leaf", "top_k": 2}')
    assert found["ok"] and found["result"]["results"][0]["file"] in ("main.py", "readme.md") and len(found["result"]["results"]) == 2
    analysis = box.call("analyze_code", {"relative_path": "main.py"})["result"]
    assert analysis["summary"]["functions_count"] == 1 and "arguments" not in analysis["functions"][0]
    log = box.call("analyze_log", {"log_text": 'File "x/main.py", line 4, in fold_leaf\nValueError: no', "context_lines": 1})["result"]
    assert (log["exception_type"], log["frame_count"], log["frames"][0]["repository_file"]) == ("ValueError", 1, "main.py") and log["frames"][0]["start_line"] == 3
    code = box.call("complete_code", {"relative_path": "main.py", "instruction": " add ", "start_line": 4, "end_line": 5})["result"]
    assert code["instruction"] == "add" and code["existing_code"]["content"].startswith("   4 | def fold_leaf")
    assert box.call("generate_tests", {"relative_path": "main.py"})["result"]["analysis"]["functions"][0]["arguments"][0]["name"] == "a"
    image = box.call("generate_dockerfile")["result"]
    assert image["selected_entrypoint"] == "main.py" and list(image["dependency_files"]) == ["requirements.txt"] and len(image["repository_files"]) == 4
    wrong = [("grep", {}, "LookupError"), ("analyze_code", {}, "ValueError"), ("analyze_code", {"relative_path": "no.py"}, "FileNotFoundError"), ("analyze_code", {"relative_path": "broken.py"}, "ValueError"),
             ("search_codebase", {"query": "a", "top_k": 0}, "ValueError"), ("search_codebase", {"query": "a", "top_k": True}, "TypeError"), ("search_codebase", "[1]", "ValueError"), ("search_codebase", "{", "ValueError"),
             ("analyze_log", {"log_text": " "}, "ValueError"), ("analyze_code", {"relative_path": "main.py", "x": 1}, "ValueError")]
    for tool, arguments, kind in wrong:
        out = box.call(tool, arguments)
        assert not out["ok"] and out["error_type"] == kind and out["tool"] == tool
    trace = box.trace_table().orderBy("step").collect()
    assert len(trace) == 6 + len(wrong) and trace[2].arguments["log_text"].startswith("<log: ") and trace[6].error_type == "LookupError"
    assert box.health()["files"] == 4


def test_service(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "lib").mkdir(parents=True)
    (root / "lib" / "leaf.py").write_text("def fold_leaf(a):\n    return a\n")
    (root / "readme.md").write_text("fold_leaf folds a leaf\n")
    said = []

    def client(prompt):
        said.append(prompt)
        return "It folds [lib/leaf.py:1-2]." if len(said) != 1 else "It folds [lib/leaf.py:1-99]."

    s = service.Service(spark, client, allowed=(str(tmp_path),))
    with pytest.raises(ValueError):
        s.index("/etc")
    told = s.index(str(root), str(tmp_path / "index"))
    name = told["repository_id"]
    assert told["files"] == 2 and len(name) == 16 and s.health()["repositories"] == [name]
    out = s.chat(name, "me", "what does fold_leaf do")
    assert out["citation_repaired"] and out["citation_report"]["valid"] and out["evidence"][0]["file"] in ("lib/leaf.py", "readme.md") and len(said) == 2
    s.chat(name, "me", "and fold_leaf again")
    assert "what does fold_leaf do" in said[-1] and s.memory(name, "me")["turn_count"] == 2
    for i in range(6):
        s.sessions[name, "me"].append((f"q{i}", "a" * 4000))
    s.chat(name, "me", "fold_leaf")
    assert s.memory(name, "me")["character_count"] <= 18_000 and s.memory(name, "me")["turn_count"] <= 6
    assert s.analyze_log(name, 'File "lib/leaf.py", line 1, in f\nKeyError: x')["result"]["frames"][0]["repository_file"] == "lib/leaf.py"
    assert s.clear_memory(name, "me") and not s.clear_memory(name, "me")
    with pytest.raises(LookupError):
        s.chat("none", "me", "x")
    with pytest.raises(ValueError):
        s.chat(name, "no spaces", "x")


def test_variants(spark):
    seeds = spark.createDataFrame([("s1", "How big is it?"), ("s2", "bad"), ("s3", None)], "id string, text string")

    def client(prompt):
        if prompt == "bad":
            return "no array"
        return '["how big is it", "How large is it?", "how LARGE is it", " ", "What size?", "Known one", "third", "fourth"]'

    known = spark.createDataFrame([("known one!",)], "t string")
    got = [tuple(r) for r in providers.variants(seeds, "id", "text", client, known, 3).orderBy("n").collect()]
    assert got == [("s1", 1, "How large is it?"), ("s1", 2, "What size?"), ("s1", 3, "third")]


def test_chat_dataset_errors(spark):
    good = [{"role": r, "content": c} for r, c in (("system", "s"), ("user", "u"), ("assistant", '{"decision": 1, "tool_name": 2, "arguments": {}}'))]
    df = spark.createDataFrame([("a", good), ("a", good), ("b", good[:2]), (" ", good), (None, None)], "id string, messages array<struct<role:string,content:string>>")
    assert {(r.id, r.rule, r.times) for r in curation.chat_dataset_errors(df).collect()} == {("a", "repeated_id", 2), ("b", "invalid_messages", 1), (" ", "blank_id", 1), (None, "blank_id", 1), (None, "invalid_messages", 1)}


def test_steps_stop_at_the_first_failure(spark):
    kept = {}

    def fail():
        raise ValueError("no")

    told = evaluation.run_all([("a", lambda: spark.range(2)), ("b", fail), ("c", lambda: spark.range(1))], lambda name, df: kept.update({name: df.count()}))
    assert [(t["step"], t["ok"], t["error"]) for t in told] == [("a", True, None), ("b", False, "ValueError: no")] and kept == {"a": 2}


def test_logs_told_by_length_hold_anything(spark):
    df = spark.createDataFrame([("<log: 12 characters>", ["x"]), ("Some X", ["x", "some"]), ("y", ["x"])], "v string, e array<string>")
    assert [r[0] for r in df.select(evaluation.contains_all(F.col("v"), F.col("e"))).collect()] == [True, True, False]


def test_pending_stream(spark, tmp_path):
    spark.range(6).write.parquet(str(tmp_path / "in"))
    done = spark.range(3)
    stream = streaming.pending_stream(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), done, "id")
    q = stream.writeStream.format("memory").queryName("pending").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.id for r in spark.table("pending").collect()} == {3, 4, 5}
