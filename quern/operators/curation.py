"""Dataset curation: target validation, grouped splits, leakage, chat samples, fingerprints, incremental work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import json_value, let, normalise_question
from quern.operators.evaluation import DIRECT, TOOLS

# Arguments of each tool as (name, type, required, minimum, maximum).
TOOL_ARGUMENTS = {
    "search_codebase": (("query", "string", True, None, None), ("top_k", "integer", False, 1, 10)),
    "analyze_code": (("relative_path", "string", True, None, None),),
    "analyze_log": (("log_text", "string", True, None, None), ("context_lines", "integer", False, 1, 30)),
    "complete_code": (
        ("relative_path", "string", True, None, None), ("instruction", "string", True, None, None),
        ("start_line", "integer", False, 1, None), ("end_line", "integer", False, 1, None),
    ),
    "generate_tests": (("relative_path", "string", True, None, None), ("target_name", "string", False, None, None)),
    "generate_dockerfile": (("entrypoint", "string", False, None, None), ("python_version", "string", False, None, None)),
}
DIFFICULTIES, SOURCES = ("easy", "medium", "hard"), ("manual", "ai_assisted")
QUERY_TYPES = ("identifier", "natural_language", "colloquial_zh", "cross_file", "misleading_keyword", "irrelevant")


def _kind(v: Column, path: str = "$") -> Column:
    """The kind of a part of a variant: OBJECT<...>, ARRAY<...>, STRING, BIGINT, BOOLEAN, ...; VOID for null; null where there is none."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _is(v: Column, path: str, kind: str) -> Column:
    return F.coalesce(F.startswith(_kind(v, path), F.lit(kind)), F.lit(False))


def _filled(v: Column, path: str) -> Column:
    return _is(v, path, "STRING") & F.rlike(F.try_variant_get(v, path, "string"), F.lit(r"\S"))


def _first(rules: list[tuple[Column, Column | str] | Column]) -> Column:
    """The code of the first rule that is broken; null if none is. A column is a rule's code itself, null where it isn't broken."""
    return F.coalesce(*(r if isinstance(r, Column) else F.when(F.coalesce(r[0], F.lit(False)), F.lit(r[1]) if isinstance(r[1], str) else r[1]) for r in rules))


def _parsed(text: Column, rules: Callable[[Column, Column], list[tuple[Column, Column | str] | Column]]) -> Column:
    """The first rule that a JSON text breaks; ``rules`` name the text and its value as often as they like: each is evaluated once."""
    return let(text, lambda t: let(json_value(t), lambda v: _first(rules(t, v))))


def _lacking(names: Column, required: tuple[str, ...]) -> Column:
    return F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.coalesce(names, F.array().cast("array<string>"))))


def metadata_error(metadata: Column) -> Column:
    """The first rule that a sample's JSON metadata breaks: an object with a known difficulty and source and a group id."""

    def rules(t: Column, v: Column) -> list:
        lacking = _lacking(F.json_object_keys(t), ("difficulty", "group_id", "source"))
        text = lambda path: F.try_variant_get(v, path, "string")
        return [
            (~_is(v, "$", "OBJECT"), "metadata_not_an_object"),
            let(lacking, lambda x: F.when(F.size(x) > 0, F.concat(F.lit("missing_metadata:"), F.array_join(x, ",")))),
            (~(_is(v, "$.difficulty", "STRING") & text("$.difficulty").isin(*DIFFICULTIES)), "unknown_difficulty"),
            (~_filled(v, "$.group_id"), "blank_group_id"),
            (~(_is(v, "$.source", "STRING") & text("$.source").isin(*SOURCES)), "unknown_source"),
        ]

    return _parsed(metadata, rules)


def sample_error(sample: Column) -> Column:
    """The first rule that a routing sample (JSON: id, user_query, target, metadata) breaks; null if it is valid."""

    def rules(t: Column, v: Column) -> list:
        lacking = _lacking(F.json_object_keys(t), ("id", "metadata", "target", "user_query"))
        part = lambda path: F.try_variant_get(v, path, "variant").cast("string")
        return [
            (~_is(v, "$", "OBJECT"), "not_an_object"),
            let(lacking, lambda x: F.when(F.size(x) > 0, F.concat(F.lit("missing_fields:"), F.array_join(x, ",")))),
            (~_filled(v, "$.id"), "blank_id"),
            (~_filled(v, "$.user_query"), "blank_user_query"),
            target_error(part("$.target")),
            metadata_error(part("$.metadata")),
        ]

    return _parsed(sample, rules)


def judgment_error(judgment: Column) -> Column:
    """The first rule that a judge's JSON answer breaks: two flags, scores from 1 to 5 (all but relevance may be null; a flag is no
    score), a list of claims, a reason."""

    def rules(_: Column, v: Column) -> list:
        def score(name: str) -> list:
            given = F.coalesce(_kind(v, f"$.{name}"), F.lit("VOID")) != "VOID"
            number = F.try_variant_get(v, f"$.{name}", "bigint")
            return [(given & ~_is(v, f"$.{name}", "BIGINT"), f"not_an_integer:{name}"), (given & ~number.between(1, 5), f"out_of_range:{name}")]

        return [
            (~_is(v, "$", "OBJECT"), "not_an_object"),
            *((~_is(v, f"$.{name}", "BOOLEAN"), f"not_a_flag:{name}") for name in ("answer_supported", "hallucination")),
            *score("relevance_score"),
            (F.coalesce(_kind(v, "$.relevance_score"), F.lit("VOID")) == "VOID", "missing:relevance_score"),
            (~_is(v, "$.unsupported_claims", "ARRAY"), "not_a_list:unsupported_claims"),
            (~_is(v, "$.reason", "STRING"), "not_a_string:reason"),
            *score("evidence_support_score"),
            *score("citation_support_score"),
        ]

    return _parsed(judgment, rules)


REQUIRED = ("id", "repository_id", "split", "query_type", "query", "should_retrieve", "relevant_files", "relevant_chunks")


def retrieval_dataset_errors(queries: DataFrame, repositories: DataFrame, files: DataFrame, own: str) -> DataFrame:
    """id, rule, detail: a row for every rule that a retrieval query breaks. queries: the columns ``REQUIRED``; repositories: id;
    files: path, of the repository ``own``. Repeated ids and queries (in any case) break theirs at every row but the first of
    each: one row tells the least id and how many follow."""
    rows = queries.select(*REQUIRED, F.lower(F.trim("query")).alias("_q"))
    whole = F.lit(True)
    for c in REQUIRED:
        whole = whole & F.col(c).isNotNull()
    lacking = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in sorted(REQUIRED)]))
    answers = F.size("relevant_files") > 0
    broken = {
        "blank_query": F.col("_q") == "",
        "unknown_query_type": ~F.col("query_type").isin(*QUERY_TYPES),
        "unknown_split": ~F.col("split").isin("dev", "test"),
        "no_answers": F.col("should_retrieve") & ~answers,
        "unwanted_answers": ~F.col("should_retrieve") & (answers | (F.size("relevant_chunks") > 0)),
    }
    value = {"unknown_query_type": F.col("query_type"), "unknown_split": F.col("split")}
    found = [F.when(c, F.struct(F.lit(n).alias("rule"), value.get(n, F.lit("")).alias("detail"))) for n, c in broken.items()]
    missing = F.when(~whole, F.array(F.struct(F.lit("missing_fields").alias("rule"), F.array_join(lacking, ",").alias("detail"))))
    out = rows.select("id", F.inline(F.coalesce(missing, F.array_compact(F.array(*found)))))
    whole_rows = rows.where(whole)
    for rule, by in (("repeated_id", "id"), ("repeated_query", "_q")):
        times = whole_rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_id")).where("_n > 1")
        extra = times.select(F.col("_id").alias("id"), F.lit(rule).alias("rule"), (F.col("_n") - 1).cast("string").alias("detail"))
        out = out.unionByName(extra)
    strange = whole_rows.join(repositories.select(F.col("id").alias("repository_id")).distinct(), "repository_id", "left_anti")
    out = out.unionByName(strange.select("id", F.lit("unknown_repository").alias("rule"), F.col("repository_id").alias("detail")))
    asked = whole_rows.where(F.col("repository_id") == own).select("id", F.explode("relevant_files").alias("path"))
    absent = asked.join(files.select("path").distinct(), "path", "left_anti")
    return out.unionByName(absent.select("id", F.lit("missing_file").alias("rule"), F.col("path").alias("detail")))


def target_error(target: Column) -> Column:
    """The first rule that a JSON route target breaks, as a code; null if it is valid.

    Every check reads the parsed variant: names of fields, kinds (an integer is no boolean), blank strings, bounds. Text, variant,
    names and the arguments' names are evaluated once; rules of other tools than the target's aren't.
    """
    names_of = lambda t: F.coalesce(F.json_object_keys(t), F.array().cast("array<string>"))

    def of_tool(name: str, v: Column, given: Column) -> Column:
        arguments = TOOL_ARGUMENTS[name]
        lacking = _lacking(given, tuple(a[0] for a in arguments if a[2])) if any(a[2] for a in arguments) else F.array().cast("array<string>")
        rules: list = [
            (F.size(lacking) > 0, F.concat(F.lit("missing_arguments:"), F.array_join(lacking, ","))),
            (F.size(F.array_except(given, F.array(*[F.lit(a[0]) for a in arguments]))) > 0, "unknown_arguments"),
        ]
        for argument, wanted, _, least, most in arguments:
            path = f"$.arguments.{argument}"
            own: list = [(F.coalesce(_kind(v, path), F.lit("VOID")) != {"string": "STRING", "integer": "BIGINT"}[wanted], f"wrong_type:{argument}")]
            if wanted == "string":
                own.append((~F.rlike(F.try_variant_get(v, path, "string"), F.lit(r"\S")), f"blank:{argument}"))
            number = F.try_variant_get(v, path, "bigint")
            if least is not None:
                own.append((number < least, f"below_minimum:{argument}"))
            if most is not None:
                own.append((number > most, f"above_maximum:{argument}"))
            rules.append(F.when(F.array_contains(given, argument), _first(own)))
        return _first(rules)

    def of_tools(tool: Column, v: Column, given: Column) -> Column:
        out = F.when(~tool.isin(*TOOLS), "unknown_tool")
        for name in TOOL_ARGUMENTS:
            out = out.when(tool == name, of_tool(name, v, given))
        return out

    def of_decision(v: Column, decision: Column, given: Column) -> Column:
        kind = F.coalesce(_kind(v, "$.tool_name"), F.lit("VOID"))
        direct = _first([(kind != "VOID", "direct_with_tool"), (F.size(given) > 0, "direct_with_arguments")])
        called = _first([(kind != "STRING", "tool_name_not_a_string"), let(F.try_variant_get(v, "$.tool_name", "string"), lambda tool: of_tools(tool, v, given))])
        return F.when(decision == DIRECT, direct).otherwise(called)

    def rules(t: Column, v: Column) -> list:
        missing = F.array_sort(F.array_except(F.array(F.lit("decision"), F.lit("tool_name"), F.lit("arguments")), names_of(t)))
        decision = F.try_variant_get(v, "$.decision", "string")
        given = names_of(F.try_variant_get(v, "$.arguments", "variant").cast("string"))
        return [
            (~_is(v, "$", "OBJECT"), "not_an_object"),
            let(missing, lambda x: F.when(F.size(x) > 0, F.concat(F.lit("missing_fields:"), F.array_join(x, ",")))),
            (~F.coalesce(decision.isin("call_tool", DIRECT), F.lit(False)), "unknown_decision"),
            (~_is(v, "$.arguments", "OBJECT"), "arguments_not_an_object"),
            let(given, lambda g: of_decision(v, decision, g)),
        ]

    return _parsed(target, rules)


CELL_GROUPS = 4000  # groups aimed at in a ranking cell


def group_split(samples: DataFrame, group: str, label: str, ratios: tuple[float, float, float] = (0.6, 0.2, 0.2), seed: int = 42) -> DataFrame:
    """group, label, split: whole groups per label, in order of a hash, to train, validation and test.

    validation and test get max(1, round half even (n * ratio)) groups each, less if train would get none; a label needs
    three groups. A group's place in its label comes from counts of cells (the hash's first digits), their running totals
    and a row number inside the cell, so that no task holds a label.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")))
    groups = samples.groupBy(group).agg(F.min(label).alias(label)).withColumn("_o", order)
    digits, total = 0, groups.count()
    while total > CELL_GROUPS * 16**digits and digits < 5:
        digits += 1
    celled = groups.withColumns({"_l": F.xxhash64(label, F.col(label).isNull()), "_c": F.substring("_o", 1, digits)})
    counts = celled.groupBy("_l", "_c").agg(F.count(F.lit(1)).alias("_k"))
    upto = Window.partitionBy("_l").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)  # 16 ** digits rows at most
    sums = counts.select("_l", "_c", F.coalesce(F.sum("_k").over(upto), F.lit(0)).alias("_first"), F.sum("_k").over(Window.partitionBy("_l")).alias("_n"))
    inside = F.row_number().over(Window.partitionBy("_l", "_c").orderBy("_o", group))
    sized = celled.withColumn("_in", inside).join(sums, ["_l", "_c"]).withColumns(
        {
            "_i": F.col("_first") + F.col("_in"),
            "_v": F.greatest(F.lit(1), F.bround(F.col("_n") * ratios[1]).cast("long")),
            "_t": F.greatest(F.lit(1), F.bround(F.col("_n") * ratios[2]).cast("long")),
        }
    )
    room = F.greatest(F.col("_n") - F.col("_v") - F.col("_t"), F.lit(1))
    validation = F.least(F.col("_v"), F.greatest(F.col("_n") - room - 1, F.lit(1)))
    split = F.when(F.col("_i") <= room, "train").when(F.col("_i") <= room + validation, "validation").otherwise("test")
    return sized.select(group, label, split.alias("split"))


def mixed_groups(samples: DataFrame, group: str, label: str) -> DataFrame:
    """Groups that carry more than one label: they break the rule that a group has one."""
    return samples.groupBy(group).agg(F.count_distinct(label).alias("labels")).where("labels > 1")


def split_manifest(samples: DataFrame, assigned: DataFrame, group: str, label: str, with_groups: bool = False) -> DataFrame:
    """split, label, samples, groups; ``with_groups``: and the sorted group ids, for manifests that a person reads."""
    joined = samples.select(group).join(assigned, group)
    ids = [F.array_sort(F.collect_set(group)).alias("group_ids")] if with_groups else []
    return joined.groupBy("split", label).agg(F.count(F.lit(1)).alias("samples"), F.count_distinct(group).alias("groups"), *ids)


def leaks(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys in more than one split."""
    return rows.groupBy(key).agg(F.count_distinct(split).alias("splits"), F.array_join(F.array_sort(F.collect_set(split)), ",").alias("in_splits")).where("splits > 1")


def first_keys(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The least key of every normalised text; texts with nothing left have none. Only hashes and keys are shuffled."""
    named = rows.select(key, normalise_question(F.col(text)).alias("_q")).where("_q <> ''")
    return named.groupBy(F.sha2("_q", 256).alias("_h")).agg(F.min(key).alias(key)).select(key)


def first_by_question(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Rows whose normalised text didn't occur at a lower key (a unique column)."""
    return rows.join(first_keys(rows, key, text), key, "left_semi")


def pending(work: DataFrame, done: DataFrame, key: str, fingerprint: str | None = None) -> DataFrame:
    """Rows of ``work`` that ``done`` doesn't hold, by key or by key and fingerprint."""
    keys = [key] + ([fingerprint] if fingerprint else [])
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def stale(done: DataFrame, work: DataFrame, key: str) -> DataFrame:
    return done.join(work.select(key).distinct(), key, "left_anti")


def record_fingerprint(*columns: str) -> Column:
    """SHA-256 of the named columns as JSON, fields in alphabetical order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def chat_sample(question: Column, target: Column, system: Column) -> Column:
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", system), message("user", question), message("assistant", target))


def chat_sample_valid(messages: Column) -> Column:
    """Roles are exactly system, user, assistant; nothing is blank; the answer is an object of exactly the target's fields."""
    roles = F.transform(messages, lambda m: m["role"]) == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    filled = F.forall(messages, lambda m: F.rlike(m["content"], F.lit(r"\S")))
    keys = F.array_sort(F.json_object_keys(F.element_at(messages, -1)["content"]))
    fields = F.array(F.lit("arguments"), F.lit("decision"), F.lit("tool_name"))
    return F.coalesce(roles & filled & (keys == fields), F.lit(False))


def chat_dataset_errors(rows: DataFrame, key: str = "id", messages: str = "messages") -> DataFrame:
    """key, rule, times: blank ids, invalid messages (``chat_sample_valid``) and ids that occur more than once."""
    blank = ~F.coalesce(F.rlike(F.col(key).cast("string"), F.lit(r"\S")), F.lit(False))
    broken = F.array_compact(F.array(F.when(blank, F.lit("blank_id")), F.when(~chat_sample_valid(F.col(messages)), F.lit("invalid_messages"))))
    found = rows.select(key, F.explode(broken).alias("rule")).groupBy(key, "rule").agg(F.count(F.lit(1)).alias("times"))
    twice = rows.where(~blank).groupBy(key).agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    return found.unionByName(twice.select(key, F.lit("repeated_id").alias("rule"), "times"))


# Rules for a container file as (code, pattern); the first must match, the second should, the third mustn't. Each
# looks at a line: lines end at line feeds alone, blanks are ASCII ones, and words are of ASCII characters.
_BLANK, _START, _END = r"[ \t\f\r]", "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_FILLED = rf"{_BLANK}+[^ \t\n\f\r]"
DOCKERFILE_REQUIRED = (
    ("FROM", rf"(?imd)^{_BLANK}*FROM{_FILLED}"), ("WORKDIR", rf"(?imd)^{_BLANK}*WORKDIR{_FILLED}"), ("COPY", rf"(?imd)^{_BLANK}*COPY{_BLANK}"),
    ("CMD_OR_ENTRYPOINT", rf"(?imd)^{_BLANK}*(?:CMD|ENTRYPOINT){_BLANK}"),
)
DOCKERFILE_ADVISED = (("pip_install", rf"(?imd)^{_BLANK}*RUN{_BLANK}+.*pip{_BLANK}+install"), ("USER", rf"(?imd)^{_BLANK}*USER{_FILLED}"))
SPACES = " \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"  # what an empty file may hold: Unicode's space separators
API_KEY = r"sk-[A-Za-z0-9_-]{10,}"
DOCKERFILE_FORBIDDEN = (
    ("plain_secret", r"""(?i)(?:password|api_key|token)[ \t\n\f\r]*=[ \t\n\f\r]*["'][^"']+["']"""),
    ("chmod_777", rf"(?i){_START}chmod{_BLANK}+777{_END}"), ("remote_script", rf"(?id)(?:curl|wget).*\|{_BLANK}*(?:sh|bash)"), ("sudo", rf"(?i){_START}sudo{_END}"),
)


def dockerfile_findings(text: Column) -> tuple[Column, Column]:
    """Comma-separated codes of errors and of warnings."""
    t = F.coalesce(text, F.lit(""))
    low = F.translate(t, "\u0130\u212a", "ik")  # the only letters outside ASCII whose lower case is in it
    lacks = lambda rules, prefix: [F.when(~F.rlike(low, F.lit(p)), F.lit(prefix + n)) for n, p in rules]
    bad = [F.when(F.rlike(t, F.lit(API_KEY)), F.lit("forbidden:api_key"))] + [F.when(F.rlike(low, F.lit(p)), F.lit("forbidden:" + n)) for n, p in DOCKERFILE_FORBIDDEN]
    errors = F.concat_ws(",", *lacks(DOCKERFILE_REQUIRED, "missing:"), *bad)
    empty = F.btrim(t, F.lit(SPACES)) == ""
    return F.when(empty, "no_dockerfile").otherwise(errors), F.when(empty, "").otherwise(F.concat_ws(",", *lacks(DOCKERFILE_ADVISED, "")))


def extract_dockerfile(answer: Column) -> Column:
    """The first block fenced as dockerfile, else the first fenced block with a FROM line."""
    named = F.regexp_extract(answer, r"(?s)```(?:dockerfile|Dockerfile)\s*(.*?)\s*```", 1)
    blocks = F.regexp_extract_all(answer, F.lit(r"(?s)```\s*(.*?)\s*```"), F.lit(1))
    generic = F.get(F.filter(blocks, lambda b: F.rlike(b, F.lit(DOCKERFILE_REQUIRED[0][1]))), F.lit(0))
    return F.coalesce(F.nullif(named, F.lit("")), generic)


# Languages of fenced blocks, the names their files get, and their media types.
BLOCK_FILES = {"py": "snippet.py", "python": "snippet.py", "dockerfile": "Dockerfile", "json": "snippet.json", "yaml": "snippet.yaml", "yml": "snippet.yaml", "bash": "snippet.sh", "sh": "snippet.sh", "sql": "snippet.sql", "markdown": "snippet.md"}
BLOCK_TYPES = {"py": "text/x-python", "python": "text/x-python", "json": "application/json", "markdown": "text/markdown"}


def code_blocks(answer: Column) -> Column:
    """array<struct<language,content,file_name,media_type>> of the fenced blocks."""
    of = lambda g: F.regexp_extract_all(answer, F.lit(r"(?s)```([A-Za-z0-9_+-]*)[ \t]*\n(.*?)```"), F.lit(g))
    known = lambda table, key, other: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(other))
    return F.transform(
        F.arrays_zip(of(1).alias("a"), of(2).alias("b")),
        lambda x: F.struct(
            F.lower(x["a"]).alias("language"), x["b"].alias("content"),
            known(BLOCK_FILES, F.lower(x["a"]), "snippet.txt").alias("file_name"), known(BLOCK_TYPES, F.lower(x["a"]), "text/plain").alias("media_type"),
        ),
    )
