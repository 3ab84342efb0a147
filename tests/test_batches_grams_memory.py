"""Training batches, the trigram index, and session memory under any order of arrival."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import batches, corpus, diagnosis, gram_index, sessions
from quern.streaming import sessions as streaming

SAMPLES = "id string, messages array<struct<role string, content string, more int>>"


def test_labels_are_what_the_assistant_says(spark):
    rng = random.Random(3)
    words = ["word", "é", "缓存", "<|end|>", ""]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(f"s{i}", [("system", "be brief", 1), ("user", say(rng.randint(0, 30)), 2), ("assistant", f"reply {i} " + say(rng.randint(0, 9)), 3)]) for i in range(150)]
    rows += [("none", None), ("empty", []), ("mute", [("user", "x", 1)]), ("long", [("user", "x" * 5000, 1), ("assistant", "y", 1)]), ("null", [("assistant", None, 1)]), ("s3", [("assistant", "again", 1), ("user", "é", 1), ("assistant", "and again", 1)])]
    made, problems = batches.training_batches(spark.createDataFrame(rows, SAMPLES), most=1000, size=8, width=50)
    assert {(r.id, r.problem) for r in problems.collect()} == {("none", "no_messages"), ("empty", "no_messages"), ("mute", "nothing_to_learn"), ("long", "too_long")}
    out = made.collect()
    assert len(out) == 152
    plain = {}
    for key, messages in rows:
        if messages and key not in ("mute", "long"):
            ids, labels = [], []
            for role, content, _ in messages:
                head, body = f"<|{role}|>\n".encode(), f"{content or ''}<|end|>".encode()
                ids += [*head, *body, 10]
                labels += [-100] * len(head) + (list(body) if role == "assistant" else [-100] * len(body)) + [-100]
            plain.setdefault(key, []).append((ids, labels))
    held = {}
    for r in out:
        n = r.length
        assert (r.ids[:n], r.labels[:n]) in plain[r.id]
        assert r.ids[n:] == [0] * (len(r.ids) - n) and r.labels[n:] == [-100] * (len(r.ids) - n) and r.attention == [1] * n + [0] * (len(r.ids) - n)
        held.setdefault(r.batch, []).append(r)
    for rows_ in held.values():
        assert len(rows_) <= 8 and len({len(r.ids) for r in rows_}) == 1 and max(r.length for r in rows_) == len(rows_[0].ids) and len({(r.length - 1) // 50 for r in rows_}) == 1
    assert len(held) < 40


def test_a_token_over_a_border_is_a_problem():
    whole = lambda text: [(7, 0, len(text))]
    assert batches.masked([{"role": "assistant", "content": "x"}], whole, 10) == ([], [], "crosses_a_border")


def test_grams_leave_few_files_and_lose_none(spark, tmp_path):
    rng = random.Random(8)
    syllables = ["ka", "Lo", "mi", "_", "\n", " ", "é", "存", "tu"]
    rows = [(f"d{i % 7}/f{i}.py", "".join(rng.choice(syllables) for _ in range(rng.randint(0, 60)))) for i in range(300)] + [("null", None), ("same", "kalomi"), ("same", "tutu")]
    files = spark.createDataFrame(rows, "path string, text string")
    index = gram_index.write_gram_index(files, str(tmp_path / "g"))
    asked = ["kalomi", "KA_lo", "é存", "ka", "", "tu\nka", "no such thing", "mimimimi", "存é ", "f7.py", "d1/f8.py"]
    found = gram_index.candidates(index, spark.createDataFrame([(a, a) for a in asked] + [("n", None)], "q string, t string"), "q", "t").collect()
    for a in asked:
        held = {p for p, t in rows if t is not None and a.lower() in t.lower()}
        assert held <= {r.path for r in found if r.q == a} and (len(gram_index.grams(a.lower())) < 4 or len({r.path for r in found if r.q == a}) <= 3 * len(held) + 5)
    for q in ("kalomi", "KA_lo", "ka", "no such thing"):
        assert sorted(map(tuple, gram_index.grep(files, index, q, 1, None).collect())) == sorted(map(tuple, corpus.grep(files, "path", q, 1, None).collect()))
    names = spark.createDataFrame([(a,) for a in asked], "name string")
    assert sorted(map(tuple, gram_index.identifier_exists(names, files, gram_index.read_gram_index(spark, str(tmp_path / "g"))).collect())) == sorted(map(tuple, diagnosis.identifier_exists(names, files, files).collect()))
    none = gram_index.write_gram_index(files.limit(0), str(tmp_path / "g"))
    assert gram_index.grep(files, none, "kalomi").count() == 0 and gram_index.grep(files, index, "kalomi").count() > 0


def test_late_turns_are_put_in_place():
    rng = random.Random(1)
    for _ in range(2000):
        turns = [(t, rng.choice([0, 5, 40, 90])) for t in range(rng.randint(1, 9))]
        kept, floor = [], None
        for t, c in rng.sample(turns, len(turns)):
            kept, floor = streaming.placed(kept, floor, t, c, 4, 100)
        plain = streaming.remember([t for t, _ in turns], [c for _, c in turns], 4, 100)
        assert ([t for t, _ in kept], [c for _, c in kept]) == plain


def test_stream_equals_the_batch_in_any_order(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"s{s}", t, rng.choice([10, 400, 900])) for s in range(6) for t in range(rng.randint(1, 14))]
    rng.shuffle(rows)
    schema = "session string, turn long, chars long"
    for part in range(3):
        spark.createDataFrame(rows[part::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for n, restart in enumerate((False, True)):  # the second run goes on from the checkpoint and finds nothing new
        q = streaming.streaming_memory(stream, 6, 1500).writeStream.outputMode("update").format("memory").queryName(f"mem{n}").option("checkpointLocation", str(tmp_path / f"c{n}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    last = {}
    for r in spark.table("mem0").collect():
        old = last.get(r.session)
        last[r.session] = r if old is None or r.last_turn > old.last_turn or (r.last_turn == old.last_turn and r.first_turn >= old.first_turn) else old
    frame = spark.createDataFrame(rows, schema)
    kept = sessions.remembered(frame, "session", "turn", F.col("chars"), 6, 1500).groupBy("session").agg(F.count(F.lit(1)), F.sum("chars"), F.min("turn"), F.max("turn")).collect()
    batch = {r[0]: tuple(r)[1:] for r in kept}
    every = {(r.session, r.turn_count, r.character_count, r.first_turn, r.last_turn) for r in spark.table("mem0").collect()}
    assert set(last) == set(batch) and all((s, *v) in every for s, v in batch.items())


def test_idle_sessions_are_forgotten(spark, tmp_path):
    schema = "session string, turn long, chars long"
    spark.createDataFrame([("a", 1, 5)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = streaming.streaming_memory(stream, idle_ms=100).writeStream.outputMode("update").format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            q.awaitTermination(1)
            if spark.table("idle").where("turn_count = 0").count():
                break
    finally:
        q.stop()
    assert [(r.session, r.turn_count, r.first_turn) for r in spark.table("idle").orderBy(F.desc("turn_count")).collect()] == [("a", 1, 1), ("a", 0, None)]
