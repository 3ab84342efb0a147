"""Container file rules against their SQL on texts of odd line ends, blanks and letters."""

from __future__ import annotations

import random

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from quern.operators import curation
from quern.plans import catalogue

BITS = ["FROM", "from ", "copy", "COPY ", "workdir", "x", "CMD", "entrypoint", "RUN ", "pip", " install", "user", "sudo", "chmod", " 777", "curl", "wget", "| sh", "|", "bash", "token", "=", "'a'", '"', "pass",
        "word", "api_key", "sk-abcdefghijkl", "\u212a", "\u0130", "\u00e9", "\u017f", "\n", "\n", "\r", "\x0b", "\x0c", "\x85", "\u2028", "\xa0", "\t", " ", " ", "#"]


def test_lines_blanks_and_words_are_those_of_the_sql(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(1, 30))) for _ in range(5000)]
    texts += ["FROM x\nCOPY\n a\nUSER\nme", "curl x |\nsh", "chmod\n777", "", " ", "\t", "\xa0 \u3000"]
    errors, warnings = catalogue._docker_sql()
    con = duckdb.connect()
    con.register("src", pa.table({"id": list(range(len(texts))), "text": texts}))
    sql = f"select id, case when trim(text) = '' then 'no_dockerfile' else {errors} end, case when trim(text) = '' then '' else {warnings} end from src order by id"
    want = con.execute(sql).fetchall()
    a, b = curation.dockerfile_findings(F.col("text"))
    got = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", a.alias("a"), b.alias("b")).orderBy("id").collect()
    assert [tuple(r) for r in got] == want
