"""Work grows with the input: steps are neither repeated by the plan nor by what is looked for."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import retrieval
from quern.plans import catalogue


def test_a_filter_on_made_columns_repeats_no_step(spark, tiny):
    for name, form in (("search_query_fanout", "File"), ("extract_symbols", '"([^"')):
        rows = catalogue.QUERIES[name](spark, tiny)._jdf.queryExecution()
        plan = rows.optimizedPlan().toString()
        filters = [line for line in plan.splitlines() if "Filter " in line]
        assert filters and not any(form in line or "regexp" in line for line in filters)


def test_tokens_come_in_order_by_passes_over_whole_texts(spark):
    def plain(text):
        out = []
        for w in re.findall("[A-Za-z][A-Za-z0-9_]*|[0-9]+", text):
            out += [w.lower(), *(p.lower() for p in re.findall("[A-Za-z]+|[0-9]+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", w.replace("_", " "))))]
        for run in re.findall("[\u4e00-\u9fff]+", text):
            out += [*run, *(run[i : i + 2] for i in range(len(run) - 1))]
        return out

    rng = random.Random(6)
    texts = ["", "__", "a_", "缓", "在" * 3000, "A" * 50, *("".join(rng.choice(["a", "bc", "B", "_", "__", "9", "42", " ", "-", "é", "İ", "缓", "缓存在", "\n", "\r", "\u2028", "😀", "$1"]) for _ in range(rng.randrange(40))) for _ in range(3000))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.code_tokens(F.col("t")).alias("k"), T.cjk_tokens(F.col("t")).alias("c"))
    assert all(r.k == plain(r.t) and r.c == [x for x in plain(r.t) if x >= "\u4e00"] for r in rows.collect())
    texts = retrieval.token_texts(spark.createDataFrame([(t, t) for t in [*texts, None]], "k string, t string"), "k", "t").collect()
    assert all(r.tokens == " ".join(plain(r.k or "")) and r.n_tokens == len(plain(r.k or "")) for r in texts)
    # A step for each identifier of a text would be a lambda with patterns in it.
    plan = rows.select("k")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with") >= 1 and "transform(regexp_extract_all" not in plan
