"""Models behind small interfaces, with deterministic local stand-ins: no network, no weights.

A ``Client`` turns a prompt into an answer and may raise. ``ask`` calls it once for every distinct prompt, with retries, and
never loses a row: a prompt that fails has a null answer and the error. Rewriting, routing and judging are prompts, ``ask``,
and a check of what comes back.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import INTENT_ELSE, INTENT_RULES, clamp_confidence, first_occurrences, identifiers, infer_intent, normalise_question, repair_json_array, repair_json_object, strip
from quern.operators.answers import Client, answered
from quern.operators.curation import judgment_error, target_error
from quern.operators.diagnosis import accepted_identifiers, identifier_exists
from quern.operators.evaluation import DIRECT
from quern.session import sliced, written

Embedder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[tuple[str, str]]], list[float | None]]


def hash_embedder(dim: int = 64) -> Embedder:
    """Signed feature hashing of words: equal texts, equal vectors; shared words, similar ones."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % dim] += 1 if h >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)

    return embed


def overlap_scorer() -> Scorer:
    def score(pairs: list[tuple[str, str]]) -> list[float | None]:
        out = []
        for q, p in pairs:
            asked = set(q.lower().split())
            out.append(len(asked & set(p.lower().split())) / len(asked) if asked else 0.0)
        return out

    return score


def embed(rows: DataFrame, text: str, embedder: Embedder | None = None, into: str = "embedding", prefix: str = "passage: ") -> DataFrame:
    """``rows`` with unit vectors, batch by batch."""
    base = rows.drop(into)
    at, use = base.columns.index(text), embedder or hash_embedder()
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields), f"`{into}` array<float>"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            vectors = use([prefix + (t or "") for t in batch.column(at).to_pylist()])
            column = pa.array([v.astype(np.float32) for v in vectors], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, into])

    return base.mapInArrow(run, schema)


def cross_score(rows: DataFrame, query: str, passage: str, scorer: Scorer | None = None, into: str = "reranker_score") -> DataFrame:
    """``rows`` with a score of each pair; a scorer that fails gives nulls, which later keep the recall order."""
    base = rows.drop(into)
    a, b, use = base.columns.index(query), base.columns.index(passage), scorer or overlap_scorer()
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields), f"`{into}` double"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            pairs = [(q or "", p or "") for q, p in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist())]
            try:
                scores = use(pairs)
            except Exception:  # the model's failure, whatever it is, must not lose rows
                scores = [None] * len(pairs)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, into])

    return base.mapInArrow(run, schema)


def ask(
    rows: DataFrame, prompt: str, client: Client, attempts: int = 1, accept: Callable[[str], str | None] | None = None, backoff: float = 1.0, answers: str | None = None
) -> DataFrame:
    """``rows`` with answer, error and attempts. Equal prompts are one call; null prompts none.

    ``accept`` gives a reason to reject an answer (null: none); a rejected or failing call is tried again, ``attempts`` times in
    all, and its last error stays. The calls are made now, spread over all tasks, and their answers written, so that reading the
    result calls nobody. ``answers``: a folder that keeps them over runs (``operators.answers``).
    """
    base = rows.drop("answer", "error", "attempts")
    told = answered(base.select(F.col(prompt).alias("prompt")), client, attempts, accept, backoff, answers)
    told = told.select(F.col("prompt").alias("_p"), "answer", "error", "attempts")
    return base.join(told, base[prompt] == told["_p"], "left").drop("_p")


CHECK = "array<struct<identifier string, source string, exists_in_repository boolean, accepted boolean>>"
INTENT_NAMES = sorted({name for name, _ in INTENT_RULES} | {INTENT_ELSE})


def _checked(rows: DataFrame, lines: DataFrame | None, files: DataFrame | None) -> DataFrame:
    """``rows`` (_row, identifiers, _said: a model's) with identifier_checks and the accepted identifiers."""
    own = F.transform("identifiers", lambda x: F.struct(x.alias("identifier"), F.lit("question").alias("source")))
    lowered = F.transform("identifiers", F.lower)
    said = F.filter(first_occurrences(F.filter(F.coalesce("_said", F.array().cast("array<string>")), lambda x: x.isNotNull())), lambda x: ~F.array_contains(lowered, F.lower(x)))
    named = rows.select("_row", F.posexplode(F.concat(own, F.transform(said, lambda x: F.struct(x.alias("identifier"), F.lit("model").alias("source"))))).alias("n", "i"))
    named = named.select("_row", "n", F.col("i.identifier").alias("name"), (F.col("i.source") == "question").alias("from_user"))
    if files is None:  # nothing to look names up in: a model's aren't believed
        checked = named.withColumns({"exists_in_files": F.lit(None).cast("boolean"), "accepted": F.col("from_user")})
    else:
        known = identifier_exists(named.select("name").distinct(), lines if lines is not None else files, files)
        checked = accepted_identifiers(named, known)
    each = F.struct("n", F.col("name").alias("identifier"), F.when(F.col("from_user"), "question").otherwise("model").alias("source"), F.col("exists_in_files").alias("exists_in_repository"), "accepted")
    checks = checked.groupBy("_row").agg(F.array_sort(F.collect_list(each)).alias("_c"))  # what one question and answer name
    checks = checks.select("_row", F.transform("_c", lambda c: F.struct(c["identifier"].alias("identifier"), c["source"].alias("source"), c["exists_in_repository"].alias("exists_in_repository"), c["accepted"].alias("accepted"))).alias("identifier_checks"))
    joined = rows.join(checks, "_row", "left").withColumn("identifier_checks", F.coalesce("identifier_checks", F.array().cast(CHECK)))
    return joined.withColumn("identifiers", F.transform(F.filter("identifier_checks", lambda c: c["accepted"]), lambda c: c["identifier"]))


def rewrite(
    questions: DataFrame, text: str, client: Client | None = None, prompt: Callable[[Column], Column] | None = None,
    files: DataFrame | None = None, lines: DataFrame | None = None, answers: str | None = None,
) -> DataFrame:
    """``questions`` rewritten by a model: the columns of ``rewrite_by_rules`` with identifier_checks and rewrite_error. Fields that an answer
    lacks, and answers that aren't a JSON object, are as the rules have them; rewrite_source says which, rewrite_error why.

    Identifiers of the question always stay; a model's are looked up in the repository (``files``: path, text; ``lines``: text,
    where it isn't in ``files``) and only those that exist are added, to the keywords too. Without ``files`` none is. Equal
    questions are one call, which is made now; ``answers``: see ``ask``.
    """
    ruled = rewrite_by_rules(questions, text)
    if client is None:
        ruled = ruled.withColumns({"rewrite_error": F.lit(None).cast("string"), "_row": F.monotonically_increasing_id(), "_said": F.lit(None).cast("array<string>")})
        return _checked(written(ruled, "rewrites"), lines, files).drop("_row", "_said")
    said = ask(ruled.withColumn("_prompt", (prompt or (lambda c: c))(F.col(text))), "_prompt", client, answers=answers)
    said = said.withColumn("_v", F.try_parse_json(repair_json_object(F.col("answer"))))  # a column, so parsed once for all fields
    v = F.col("_v")
    field = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    filled = lambda name: F.when(F.rlike(field(name, "string"), F.lit(r"\S")), strip(field(name, "string")))
    good = v.isNotNull()
    intent = F.when(field("intent", "string").isin(*INTENT_NAMES), field("intent", "string"))
    new = {
        "intent": intent, "should_search": F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(v, "$.should_search", "variant")) == "BOOLEAN", field("should_search", "boolean")), intent != "general_question"),
        "semantic_query": filled("semantic_query"), "confidence": clamp_confidence(field("confidence", "string")),
    }
    columns = {name: F.when(good, F.coalesce(c, F.col(name))).otherwise(F.col(name)) for name, c in new.items()}
    why = F.when(~good, F.coalesce("error", F.lit("no JSON object")))
    columns |= {"rewrite_source": F.when(good, "model").otherwise("rules"), "rewrite_error": why, "_said": F.when(good, field("identifiers", "array<string>"))}
    columns |= {"_keywords": F.coalesce(F.when(good, filled("keyword_query")), strip(F.col(text))), "_row": F.monotonically_increasing_id()}
    told = _checked(written(said.withColumns(columns).drop("_v"), "rewrites"), lines, files)
    keywords = F.array_join(first_occurrences(F.concat(F.array("_keywords"), F.col("identifiers"))), " ")
    return told.withColumn("keyword_query", keywords).drop("_prompt", "answer", "error", "attempts", "_row", "_said", "_keywords")


def route(questions: DataFrame, text: str, client: Client | None = None) -> DataFrame:
    """``questions`` with raw_text, json_valid, schema_error, schema_valid, pred_decision, pred_tool, pred_args, api_error: the
    prediction records that ``evaluation.routing_metrics`` reads."""
    said = ask(questions, text, client or rule_router).withColumnsRenamed({"answer": "raw_text", "error": "api_error"}).drop("attempts")
    found = repair_json_object(F.col("raw_text"))
    said = said.withColumn("_o", found).withColumn("_v", F.try_parse_json("_o"))
    v = F.col("_v")
    error = F.when(F.col("_o").isNotNull(), target_error(F.col("_o")))
    arguments = F.try_variant_get(v, "$.arguments", "variant")
    return said.withColumns({
        "json_valid": F.col("_o").isNotNull(), "schema_error": error, "schema_valid": F.col("_o").isNotNull() & error.isNull(),
        "pred_decision": F.try_variant_get(v, "$.decision", "string"), "pred_tool": F.try_variant_get(v, "$.tool_name", "string"), "pred_args": arguments.cast("string"),
    }).drop("_o", "_v")


def variants(seeds: DataFrame, key: str, text: str, client: Client, existing: DataFrame | None = None, most: int = 5) -> DataFrame:
    """key, n, text: up to ``most`` new wordings of each seed, from a model's JSON array of strings. Blank ones go, and those that
    say the same as a seed, as an earlier wording or as a text of ``existing`` (one column) once normalised."""
    said = ask(seeds.select(key, text), text, client)
    items = F.try_variant_get(F.try_parse_json(repair_json_array(F.col("answer"))), "$", "array<string>")
    rows = said.select(key, F.posexplode(items).alias("_n", "_t")).select(key, "_n", F.trim("_t").alias("_t")).withColumn("_h", F.sha2(normalise_question(F.col("_t")), 256))
    rows = rows.where(F.rlike("_t", F.lit(r"\S")))
    known = seeds.select(F.sha2(normalise_question(F.col(text)), 256).alias("_h"))
    if existing is not None:
        known = known.unionByName(existing.select(F.sha2(normalise_question(F.col(existing.columns[0])), 256).alias("_h")))
    fresh = rows.join(known.distinct(), "_h", "left_anti")
    first = fresh.groupBy("_h").agg(F.min(F.struct(key, "_n", "_t")).alias("m")).select("m.*")
    place = F.row_number().over(Window.partitionBy(key).orderBy("_n"))  # what one answer holds
    return first.withColumn("n", place.cast("long")).where(F.col("n") <= most).select(key, "n", F.col("_t").alias(text))


def rule_router(question: str) -> str:
    """The local stand-in of a router: words that the intents know, else a direct answer."""
    low = question.lower()
    tool, arguments = None, {}
    if "traceback" in low or "error" in low:
        tool, arguments = "analyze_log", {"log_text": question}
    elif "docker" in low:
        tool = "generate_dockerfile"
    elif any(w in low for w in (".py", "_", "代码", "函数", "code")):
        tool, arguments = "search_codebase", {"query": question}
    return json.dumps({"decision": "call_tool" if tool else DIRECT, "tool_name": tool, "arguments": arguments}, ensure_ascii=False)


def judge(items: DataFrame, prompt: str, client: Client | None = None, attempts: int = 2) -> DataFrame:
    """``items`` with status (ok or error), the judgment's fields, judge_error and attempts. Answers that hold no JSON object are
    asked for again; one that breaks a rule is an error that names the rule."""
    said = ask(items, prompt, client or overlap_judge, attempts, _no_object)
    said = said.withColumn("_o", repair_json_object(F.col("answer")))
    said = said.withColumns({"_v": F.try_parse_json("_o"), "_e": F.coalesce("error", judgment_error(F.col("_o")))})
    v, error = F.col("_v"), F.col("_e")
    kinds = {
        "answer_supported": "boolean", "hallucination": "boolean", "relevance_score": "bigint", "evidence_support_score": "bigint",
        "citation_support_score": "bigint", "unsupported_claims": "array<string>", "reason": "string",
    }
    fields = {name: F.when(error.isNull(), F.try_variant_get(v, f"$.{name}", kind)) for name, kind in kinds.items()}
    return said.withColumns({"status": F.when(error.isNull(), "ok").otherwise("error"), "judge_error": error, **fields}).drop("_o", "_v", "_e", "answer", "error")


def _no_object(answer: str) -> str | None:
    first, last = (answer or "").find("{"), (answer or "").rfind("}")
    try:
        return None if 0 <= first < last and isinstance(json.loads(answer[first : last + 1]), dict) else "no JSON object"
    except ValueError:
        return "no JSON object"


def overlap_judge(prompt: str) -> str:
    """The local stand-in of a judge: how much of the prompt's second half its first half says already."""
    words = prompt.lower().split()
    first, second = set(words[: len(words) // 2]), set(words[len(words) // 2 :])
    share = len(first & second) / max(1, len(second))
    return json.dumps({
        "answer_supported": share >= 0.2, "hallucination": share < 0.1, "relevance_score": 1 + round(4 * share), "evidence_support_score": None,
        "citation_support_score": None, "unsupported_claims": [], "reason": f"{len(first & second)} words in common",
    })


def rewrite_by_rules(questions: DataFrame, text: str) -> DataFrame:
    """The rewriter's fallback: intent, should_search, queries, identifiers, confidence 0.5."""
    intent = infer_intent(F.col(text))
    return questions.withColumn("_named", identifiers(F.col(text))).withColumns(
        {
            "intent": intent,
            "should_search": intent != "general_question",
            "semantic_query": F.col(text),
            "keyword_query": F.array_join(first_occurrences(F.concat(F.array(F.col(text)), F.col("_named"))), " "),
            "identifiers": F.col("_named"),
            "confidence": clamp_confidence(F.lit("0.5")),
            "rewrite_source": F.lit("rules"),
        }
    ).drop("_named")
