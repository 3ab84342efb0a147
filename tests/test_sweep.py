"""Containment of ranges by a running maximum, and whole JSON values."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import evidence

RANGES = "a string, f string, start_line long, end_line long"


@pytest.mark.parametrize("cell", [1024, 4])
def test_contained_equals_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(evidence, "CELL_LINES", cell)
    rng = random.Random(cell)
    some = lambda n: [(rng.choice(["x", "y", None]), rng.choice(["f", "g", "h", None]), s := rng.randrange(1, 60), s + rng.choice([0, 0, 1, 3, 20, -1])) for _ in range(n)]
    cited, known = some(300) + [("x", "f", None, 3), ("x", "f", 3, None)], some(120)
    plain = {c for c in cited if None not in c and any(e[:2] == c[:2] and e[2] <= c[2] and e[3] >= c[3] for e in known)}
    got = evidence.contained(spark.createDataFrame(cited, RANGES), spark.createDataFrame(known, RANGES), ["a", "f"]).collect()
    assert {tuple(r) for r in got} == plain and len(got) == len(plain) and 20 < len(plain) < 200


def test_many_ranges_of_one_file_take_linear_time(spark):
    def run(n):
        made = lambda seed, wide: spark.range(n).select(F.lit("x").alias("a"), F.lit("f").alias("f"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(4 * n)) + 1).alias("start_line"), "id").select("a", "f", "start_line", (F.col("start_line") + F.pmod(F.xxhash64("id"), F.lit(wide))).alias("end_line"))
        began = time.perf_counter()
        return evidence.contained(made(1, 20), made(2, 60), ["a", "f"]).count(), time.perf_counter() - began

    run(1000)
    few, short = run(25_000)
    many, long = run(100_000)
    assert 0 < few < many and long < 3 + 4 * short


def test_json_values_are_whole(spark):
    good = ["{}", '{"a": [1, {"b": "]"}]}', "[1]", "[]", "null", "3", '"x]"', ' {"a":1}\n', "[[1],[2]]", "true", '{"a":"],["}']
    bad = ["", " ", "{", '{"a":1} trailing', '{"a":1}{"b":2}', "1,2", "1],[2", '{"a":1}],[{"b":2}', '1},"y":{', "nul", '{"a":1]', "]", "1]", "[1]]", None, '2}, "z": [1']
    rows = spark.createDataFrame([(x,) for x in good + bad], "t string").select("t", T.json_value(F.col("t")).isNotNull().alias("ok"), T.json_value(F.col("t")).cast("string").alias("v")).collect()
    assert [r.t for r in rows if r.ok] == good
    assert [json.loads(r.v) if r.v is not None and r.t not in ('"x]"',) else r.v for r in rows[:7]] == [{}, {"a": [1, {"b": "]"}]}, [1], [], None, 3, "x]"]
