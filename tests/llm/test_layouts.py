"""Layouts of chat records: nothing that a record says is lost without being named."""

from __future__ import annotations

import json
import random

from quern.llm import chat

RECORDS = [
    ({"instruction": "i", "output": "o", "system": "s", "history": [["q1", "a1"], ["q2", "a2"]]}, [("system", "s"), ("user", "q1"), ("assistant", "a1"), ("user", "q2"), ("assistant", "a2"), ("user", "i"), ("assistant", "o")], set()),
    ({"messages": [{"role": "user", "content": "x"}, {"from": "gpt", "value": "y"}, {"role": "assistant", "content": None, "tool_calls": [{"name": "f"}]}], "id": "n7"}, [("user", "x"), ("assistant", "y"), ("assistant", '[{"name":"f"}]')], {"id"}),
    ({"instruction": "i", "context": "c", "response": "r"}, [("user", "i\n\nc"), ("assistant", "r")], set()),
    ({"conversations": [{"role": "human", "content": "x", "note": "n"}]}, [("user", "x")], {"conversations[].note"}),
    ({"prompt": "p", "chosen": "c", "rejected": "r"}, [("user", "p"), ("assistant", "c")], {"rejected"}),
    ({"data": {"messages": [{"role": "user", "content": "x"}], "lang": "en"}, "n": 3}, [("user", "x")], {"data.lang"}),
    ({"instruction": "i", "input": "", "output": "o", "system": ""}, [("user", "i"), ("assistant", "o")], set()),
]


def frame(spark, records):
    return spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "conv_id long, record string")


def test_layouts_and_what_they_leave(spark):
    df = frame(spark, [r for r, _, _ in RECORDS])
    got, left = {}, {}
    for r in chat.canonical_turns(df).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    for r in chat.unread_paths(df).collect():
        left.setdefault(r.conv_id, set()).add(r.path)
    for i, (_, turns, unread) in enumerate(RECORDS):
        assert (got[i], left.get(i, set())) == (turns, unread), i


def test_fingerprints_are_of_all_nested_paths(spark):
    records = [{"messages": [{"role": "user", "content": "x"}]}, {"messages": [{"role": "a", "content": None}, {"content": 3, "role": "b"}]}, {"messages": [{"role": "user", "content": "x"}], "system": "s"}, {"messages": [{"role": "user", "content": "x", "name": "n"}]}]
    marks = [r.fingerprint for r in chat.record_turns(frame(spark, records), "conv_id", "record").dropDuplicates(["conv_id"]).orderBy("conv_id").collect()]
    assert marks[0] == marks[1] and len(set(marks)) == 3


def strings(value):
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for v in value.values():
            yield from strings(v)
    elif isinstance(value, list):
        for v in value:
            yield from strings(v)


def test_no_text_is_lost_without_a_word(spark):
    rng = random.Random(4)
    counter = iter(range(10**6))
    word = lambda: f"w{next(counter)}x"
    said = lambda: rng.choice([word(), word(), None, [{"type": "text", "text": word()}, {"type": "image", "url": word()}]])

    def message():
        m = {rng.choice(["role", "role", "from"]): rng.choice(["user", "human", "gpt", "system"]), rng.choice(["content", "content", "value", "text"]): said()}
        return m | ({rng.choice(["name", "weight", "tool_calls", "meta"]): rng.choice([word(), 3, [{"f": word()}]])} if rng.random() < 0.4 else {})

    records = []
    for _ in range(300):
        kind = rng.random()
        first = {"role": "user", "content": word()} if rng.random() < 0.5 else {"from": "human", "value": word()}
        if kind < 0.4:
            r = {"conversations" if "from" in first else rng.choice(["messages", "conversations"]): [first, *(message() for _ in range(rng.randint(0, 4)))]}
        elif kind < 0.5:
            r = {"data": {"messages": [{"role": "user", "content": word()}, message()], "other": word()}}
        else:
            r = {k: word() for k in rng.choice([("prompt", "response"), ("completion", "prompt"), ("question", "answer"), ("instruction", "output"), ("instruction", "input", "output"), ("instruction", "context", "response"), ("prompt", "chosen", "rejected")])}
            r |= {"history": [[word(), word()] for _ in range(rng.randint(0, 2))]} if rng.random() < 0.4 else {}
        r |= {k: rng.choice([word(), {"a": [word()]}, 7]) for k in ("system", "source", "id", "tags") if rng.random() < 0.3 and not (k == "system" and False)}
        if isinstance(r.get("system"), dict):
            r["system"] = word()
        records.append(r)
    df = frame(spark, records)
    turns, left = {}, {}
    for r in chat.canonical_turns(df).collect():
        turns.setdefault(r.conv_id, []).append(f"{r.role} {r.text}")
    for r in chat.unread_paths(df).collect():
        left.setdefault(r.conv_id, set()).add(r.path)
    unknown = {r.conv_id for r in chat.unknown_records(df).collect()}

    def named(record, path):
        head, _, rest = path.partition(".")
        values = record.get(head.removesuffix("[]")) if isinstance(record, dict) else None
        return list(strings(values)) if not rest else [s for v in (values if isinstance(values, list) else [values]) for s in named(v, rest)]

    for i, record in enumerate(records):
        if i in unknown:
            continue
        told = " ".join(turns[i])
        missing = [s for s in strings(record) if s.startswith("w") and s not in told]
        reported = {s for p in left.get(i, ()) for s in named(record, p)}
        assert set(missing) <= reported, (record, turns[i], left.get(i))
    assert len(unknown) < 30
