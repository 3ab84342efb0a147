"""Evaluation analytics: retrieval metrics, method ranking, threshold calibration, routing, agent and judge summaries."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import json_value

TOOLS = ("search_codebase", "analyze_code", "analyze_log", "complete_code", "generate_tests", "generate_dockerfile")
DIRECT = "answer_directly"
INVALID_JSON, INVALID_DECISION, INVALID_TOOL = "__invalid_json__", "__invalid_decision__", "__invalid_tool__"
SCORE_BUCKETS, QUANTILES = 1024, 256


def ratio(a: Column, b: Column) -> Column:
    """a / b, zero where b is zero."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def share(condition: Column) -> Column:
    """Mean of a condition over rows where it isn't null; null without such rows."""
    return F.avg(condition.cast("double"))


def first_relevant(results: DataFrame, labels: DataFrame, query: str, key: str) -> DataFrame:
    """query, first_rank: the best rank of a labelled row. results: query, key, rank; labels: query, key."""
    return results.join(labels.select(query, key).distinct(), [query, key]).groupBy(query).agg(F.min("rank").alias("first_rank"))


def retrieval_rows(queries: DataFrame, results: DataFrame, labels: DataFrame, query: str, key: str) -> DataFrame:
    """A row per query (with should_retrieve and what else ``queries`` has): first_rank, reciprocal_rank, retrieved."""
    counts = results.groupBy(query).agg(F.count(F.lit(1)).alias("retrieved"))
    rows = queries.join(first_relevant(results, labels, query, key), query, "left").join(counts, query, "left")
    return rows.withColumns(
        {"retrieved": F.coalesce("retrieved", F.lit(0)).cast("long"), "reciprocal_rank": F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))}
    )


def retrieval_metrics(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Hit at 1, 3, 5, MRR over queries that should retrieve, false positives over the others; overall and, with ``by``, by type."""
    wanted = F.col("should_retrieve")
    hit = lambda k: F.round(share(F.when(wanted, F.coalesce(F.col("first_rank") <= k, F.lit(False)))), 6).alias(f"hit_at_{k}")
    metrics = [
        F.count(F.lit(1)).alias("queries"),
        F.count_if(wanted).alias("relevant"),
        hit(1), hit(3), hit(5),
        F.round(F.avg(F.when(wanted, F.col("reciprocal_rank"))), 6).alias("mrr"),
        F.round(share(F.when(~wanted, F.col("retrieved") > 0)), 6).alias("irrelevant_fp_rate"),
    ]
    if by is None:
        return rows.agg(*metrics)
    return rows.groupingSets([[], [F.col(by)]], F.col(by)).agg(*metrics)


def conditional_counts(results: DataFrame) -> DataFrame:
    """One row of latency means and of how often each way was taken.

    results: should_retrieve, rewrite_source (rules: the fallback), rewrite_error, skipped, reranker_status, retrieved,
    latency_ms, rewrite_ms, retrieval_ms.
    """
    mean = lambda c: F.round(F.avg(c), 6).alias(f"mean_{c}")
    fused = ~F.coalesce(F.col("skipped"), F.lit(False)) & (F.col("retrieved") > 0)
    return results.agg(
        F.count(F.lit(1)).alias("queries"),
        mean("latency_ms"), mean("rewrite_ms"), mean("retrieval_ms"),
        F.count_if(F.col("rewrite_source") == "rules").alias("fallbacks"),
        F.count_if(F.col("rewrite_error").isNotNull()).alias("failures"),
        F.count_if("skipped").alias("skipped"),
        F.count_if(F.col("reranker_status") == "scored").alias("reranker_used"),
        F.count_if(fused & F.col("should_retrieve")).alias("fused_relevant"),
        F.count_if(fused & ~F.col("should_retrieve")).alias("fused_irrelevant"),
    )


def run_all(steps: list[tuple[str, Callable[[], DataFrame]]], sink: Callable[[str, DataFrame], None]) -> list[dict]:
    """Evaluation steps in order, each handed to ``sink``; the first that fails ends the run. step, ok, seconds, error of each."""
    told = []
    for name, step in steps:
        began = time.perf_counter()
        try:
            sink(name, step())
        except Exception as error:  # whatever it is, it is reported and ends the run
            told.append({"step": name, "ok": False, "seconds": time.perf_counter() - began, "error": f"{type(error).__name__}: {error}"})
            break
        told.append({"step": name, "ok": True, "seconds": time.perf_counter() - began, "error": None})
    return told


def rank_methods(summaries: DataFrame) -> DataFrame:
    """method, hit_at_5, mrr, hit_at_3, irrelevant_fp_rate, latency_ms, and place: best first."""
    z = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    order = [z("hit_at_5", 0.0).desc(), z("mrr", 0.0).desc(), z("hit_at_3", 0.0).desc(), z("irrelevant_fp_rate", 1.0).asc(), z("latency_ms", 1e18).asc(), F.asc("method")]
    return summaries.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))  # a row per method


def confusion_by_threshold(scores: DataFrame, score: str = "score", wanted: str = "should_retrieve") -> DataFrame:
    """threshold, tp, fp, tn, fn, recall, fpr, accuracy at every candidate threshold (predict positive at or above it).

    Candidates are the distinct scores, one below all and one above all. Rows are counted by distinct score, then summed from
    the top by score buckets and inside buckets, so that no task sorts all scores.
    """
    rows = scores.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(wanted).alias("w"))
    points = rows.groupBy("s").agg(F.count_if("w").alias("pos"), F.count_if(~F.col("w")).alias("neg"))
    span = rows.agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count_if("w").alias("all_pos"), F.count_if(~F.col("w")).alias("all_neg")).where("lo is not null")
    edge = points.crossJoin(F.broadcast(span))  # the other side is one row
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("s")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    edge = edge.withColumn("bucket", F.least(F.floor(width * SCORE_BUCKETS), F.lit(SCORE_BUCKETS - 1)).cast("int"))
    buckets = edge.groupBy("bucket").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # SCORE_BUCKETS rows at most
    buckets = buckets.select("bucket", F.coalesce(F.sum("bp").over(before), F.lit(0)).alias("bp"), F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("bn"))
    inside = Window.partitionBy("bucket").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    counted = edge.join(F.broadcast(buckets), "bucket").select(
        F.col("s").alias("threshold"), "all_pos", "all_neg",
        (F.col("bp") + F.sum("pos").over(inside)).alias("tp"), (F.col("bn") + F.sum("neg").over(inside)).alias("fp"),
    )
    ends = span.select((F.col("lo") - 1e-6).alias("threshold"), "all_pos", "all_neg", F.col("all_pos").alias("tp"), F.col("all_neg").alias("fp")).unionByName(
        span.select((F.col("hi") + 1e-6).alias("threshold"), "all_pos", "all_neg", F.lit(0).alias("tp"), F.lit(0).alias("fp"))
    )
    every = counted.unionByName(ends)
    return every.select(
        "threshold", "tp", "fp", (F.col("all_neg") - F.col("fp")).alias("tn"), (F.col("all_pos") - F.col("tp")).alias("fn"),
        F.round(ratio(F.col("tp"), F.col("all_pos")), 9).alias("recall"), F.round(ratio(F.col("fp"), F.col("all_neg")), 9).alias("fpr"),
        F.round(ratio(F.col("tp") + F.col("all_neg") - F.col("fp"), F.col("all_pos") + F.col("all_neg")), 9).alias("accuracy"),
    )


def calibrate(scores: DataFrame, minimum_recall: float = 0.95, score: str = "score", wanted: str = "should_retrieve") -> DataFrame:
    """The threshold of least false positive rate among those of enough recall; then most recall, then the least threshold."""
    found = confusion_by_threshold(scores, score, wanted).where(F.col("recall") >= minimum_recall)
    return found.orderBy(F.asc("fpr"), F.desc("recall"), F.asc("threshold")).limit(1)


def distribution(scores: DataFrame, by: str, score: str = "score") -> DataFrame:
    """by, min, p25, median, p75, max, mean; quantiles are exact, interpolated between neighbours.

    Rows are counted by distinct value; values go to buckets between approximate quantiles, and only running totals over
    buckets and inside buckets are taken, so that no task holds a group's values.
    """
    rows = scores.where(F.col(score).isNotNull()).select(F.col(by).alias("_b"), F.col(score).cast("double").alias("_s"))
    points = rows.groupBy("_b", "_s").agg(F.count(F.lit(1)).alias("_c"))
    steps = [i / QUANTILES for i in range(1, QUANTILES)]
    whole = rows.groupBy("_b").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_s").alias("min"), F.max("_s").alias("max"), F.avg("_s").alias("mean"), F.percentile_approx("_s", steps, 20 * QUANTILES).alias("_e")
    )
    same = F.col("_b").eqNullSafe(F.col("_g"))
    placed = points.join(whole.select(F.col("_b").alias("_g"), "_e", "_n"), same).withColumn("_k", F.size(F.filter("_e", lambda e: e < F.col("_s"))))
    placed = placed.select("_b", "_s", "_c", "_n", "_k")
    buckets = placed.groupBy("_b", "_k").agg(F.sum("_c").alias("_m"))
    before = Window.partitionBy("_b").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)  # QUANTILES rows at most
    buckets = buckets.select(F.col("_b").alias("_g"), F.col("_k").alias("_h"), F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_f"))
    inside = Window.partitionBy("_b", "_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.withColumn("_i", F.sum("_c").over(inside)).join(buckets, same & (F.col("_k") == F.col("_h")))
    last = F.col("_f") + F.col("_i") - 1  # rows of a value have the ranks last - _c + 1 to last, from 0
    picks = []
    for name, share_ in (("p25", 0.25), ("median", 0.5), ("p75", 0.75)):
        at = (F.col("_n") - 1) * share_
        for end, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((rank <= last) & (rank > last - F.col("_c")), F.col("_s"))).alias(f"{name}_{end}"))
    found = ranked.groupBy("_b").agg(*picks).withColumnRenamed("_b", "_g")

    def quantile(name: str, share_: float) -> Column:
        at = (F.col("_n") - 1) * share_
        return F.round(F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (at - F.floor(at)), 6).alias(name)

    out = whole.join(found, same)
    quantiles = [quantile(n, q) for n, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))]
    return out.select(F.col("_b").alias(by), "min", *quantiles, "max", F.round("mean", 6).alias("mean"))


def target_label(decision: Column, tool: Column) -> Column:
    return F.when(decision == DIRECT, F.lit(DIRECT)).otherwise(F.coalesce(tool, F.lit(INVALID_TOOL)))


def prediction_label(json_valid: Column, decision: Column, tool: Column) -> Column:
    return (
        F.when(~F.coalesce(json_valid, F.lit(False)), INVALID_JSON)
        .when(F.coalesce(decision, F.lit("")) == DIRECT, DIRECT)
        .when(F.coalesce(decision, F.lit("")) != "call_tool", INVALID_DECISION)
        .when(~F.coalesce(tool.isin(*TOOLS), F.lit(False)), INVALID_TOOL)
        .otherwise(tool)
    )


def routing_metrics(records: DataFrame) -> DataFrame:
    """One row of counts and rates.

    records: gold_decision, gold_tool, gold_args and pred_args (JSON texts; what is no object has no keys), pred_decision,
    pred_tool, json_valid, schema_valid, api_error. Arguments are compared as JSON values: 5 isn't "5".
    """
    call = F.col("gold_decision") == "call_tool"
    no = lambda c: F.coalesce(c, F.lit(False))
    tool_right = no(call & (F.col("pred_decision") == "call_tool") & (F.col("pred_tool") == F.col("gold_tool")))
    parsed = records.withColumns({"_g": json_value(F.col("gold_args")), "_p": json_value(F.col("pred_args"))})  # one parse each
    object_ = lambda v, c: F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.col(c))
    gold, predicted = F.coalesce(object_("_g", "gold_args"), F.lit("{}")), object_("_p", "pred_args")
    args = tool_right & predicted.isNotNull()
    covered = args & no(F.size(F.array_except(F.json_object_keys(gold), F.json_object_keys(predicted))) == 0)
    # Fields of a variant are in order of their names.
    exact = args & no(F.coalesce(F.when(object_("_g", "gold_args").isNotNull(), F.col("_g").cast("string")), F.lit("{}")) == F.col("_p").cast("string"))
    invented = no((F.col("pred_decision") == "call_tool") & ~no(F.col("pred_tool").isin(*TOOLS)))
    counts = parsed.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(F.col("api_error").isNull()).alias("successful_requests"),
        F.count_if(F.col("api_error").isNotNull()).alias("api_error_count"),
        F.count_if("json_valid").alias("json_valid_count"),
        F.count_if("schema_valid").alias("schema_valid_count"),
        F.count_if(no(F.col("pred_decision") == F.col("gold_decision"))).alias("decision_correct_count"),
        F.count_if(call).alias("gold_tool_call_count"),
        F.count_if(tool_right).alias("tool_name_correct_count"),
        F.count_if(covered).alias("argument_keys_covered_count"),
        F.count_if(exact).alias("arguments_exact_match_count"),
        F.count_if(invented).alias("hallucinated_tool_count"),
    )
    rates = (
        ("api_success_rate", "successful_requests", "total_samples"),
        ("json_valid_rate", "json_valid_count", "total_samples"),
        ("schema_valid_rate", "schema_valid_count", "total_samples"),
        ("decision_accuracy", "decision_correct_count", "total_samples"),
        ("tool_name_accuracy", "tool_name_correct_count", "gold_tool_call_count"),
        ("argument_key_coverage_rate", "argument_keys_covered_count", "gold_tool_call_count"),
        ("arguments_exact_match_rate", "arguments_exact_match_count", "gold_tool_call_count"),
        ("tool_hallucination_rate", "hallucinated_tool_count", "total_samples"),
    )
    return counts.withColumns({name: F.round(ratio(F.col(a), F.col(b)), 6) for name, a, b in rates})


def confusion_matrix(records: DataFrame) -> DataFrame:
    gold = target_label(F.col("gold_decision"), F.col("gold_tool")).alias("gold")
    predicted = prediction_label(F.col("json_valid"), F.col("pred_decision"), F.col("pred_tool")).alias("predicted")
    return records.select(gold, predicted).groupBy("gold", "predicted").agg(F.count(F.lit(1)).alias("n"))


def generation_stats(records: DataFrame) -> DataFrame:
    """Mean latency, and tokens a second over all rows."""
    rate = ratio(F.sum("generated_tokens"), F.sum("latency_seconds"))
    return records.agg(F.round(F.avg("latency_seconds"), 6).alias("mean_latency"), F.round(rate, 6).alias("tokens_per_second"))


LOG_MARK = "<log: "  # how a trace tells a log that it doesn't show


def contains_all(value: Column, expected: Column) -> Column:
    """Whether the text contains every expected string in any case; a log told by its length alone holds whatever is expected."""
    return F.startswith(value, F.lit(LOG_MARK)) | F.forall(expected, lambda e: F.contains(F.lower(value), F.lower(e)))


def agent_summary(cases: DataFrame) -> DataFrame:
    """One row. cases: completed, should_call_tool, called_tool, expected_tools, actual_tools, arguments_correct,
    evidence_hit, citation_valid (null where it doesn't apply), latency_ms."""
    done = F.col("completed")
    right = F.col("should_call_tool") == F.col("called_tool")
    wrong_call, missed = ~F.col("should_call_tool") & F.col("called_tool"), F.col("should_call_tool") & ~F.col("called_tool")
    return cases.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(done).alias("completed"),
        F.round(share(F.when(done, right)), 6).alias("decision_accuracy"),
        F.round(share(F.when(done, F.col("expected_tools") == F.col("actual_tools"))), 6).alias("selection_accuracy"),
        F.round(share(F.when(done & F.col("should_call_tool"), F.col("arguments_correct"))), 6).alias("argument_accuracy"),
        F.round(share(F.when(done, F.col("evidence_hit"))), 6).alias("evidence_hit_rate"),
        F.round(share(F.when(done, F.col("citation_valid"))), 6).alias("citation_accuracy"),
        F.count_if(done & wrong_call).alias("false_positives"),
        F.count_if(done & missed).alias("false_negatives"),
        F.round(ratio(F.count_if(done & wrong_call), F.count_if(done & ~F.col("should_call_tool"))), 6).alias("false_positive_rate"),
        F.round(ratio(F.count_if(done & missed), F.count_if(done & F.col("should_call_tool"))), 6).alias("false_negative_rate"),
        F.round(F.avg(F.when(done, F.col("latency_ms"))), 6).alias("mean_latency_ms"),
    )


def judge_summary(judgments: DataFrame) -> DataFrame:
    """One row. judgments: status, answer_supported, hallucination, relevance_score, evidence_score, citation_score, attempts."""
    ok = F.col("status") == "ok"
    mean = lambda c: F.round(F.avg(F.when(ok, F.col(c).cast("double"))), 6)
    return judgments.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(ok).alias("judged"),
        F.count_if(~ok).alias("failed"),
        F.round(share(F.when(ok, F.col("answer_supported"))), 6).alias("supported_rate"),
        F.round(share(F.when(ok, F.col("hallucination"))), 6).alias("hallucination_rate"),
        mean("relevance_score").alias("relevance"),
        mean("evidence_score").alias("evidence_support"),
        mean("citation_score").alias("citation_support"),
        F.coalesce(F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))), F.lit(0)).cast("long").alias("retries"),
    )


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule: a row for every broken rule (a rule is a condition that must hold; null counts as broken)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
