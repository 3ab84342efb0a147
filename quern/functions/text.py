"""Column functions on text: tokenising, identifiers, rule-based labels, normalisation. All but ``identifiers`` stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
IDENTIFIER, PART, CJK = "[A-Za-z][A-Za-z0-9_]*|[0-9]+", "[A-Za-z]+|[0-9]+", r"[\x{4e00}-\x{9fff}]+"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which is evaluated once however often ``f`` names it: a lambda's variable holds it."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def filled(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """key and ``value`` as ``name``, of the rows where it isn't empty. A filter on a column goes below all steps that make it, which
    then run twice, each as often as others name it; it doesn't go below a generator."""
    return rows.select(key, F.explode_outer(F.array(value)).alias(name)).where(F.col(name) != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _extract(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _split_words(text: Column) -> Column:
    """``snake_case`` and ``camelCase`` apart."""
    return F.regexp_replace(F.replace(text, F.lit("_"), F.lit(" ")), "([a-z0-9])([A-Z])", "$1 $2")


def cjk_tokens(text: Column) -> Column:
    """For every run of ideographs: its characters, then its character pairs. A few passes over all runs, a line each, however many or
    long they are."""

    def grams(runs: Column) -> Column:
        singles = F.split(F.regexp_replace(runs, "(?<=[^\n])(?=[^\n])", " "), "\n")
        pairs = F.split(F.regexp_replace(F.regexp_replace(runs, "([^\n])(?=([^\n]))", "$1$2 "), "(?m) ?[^\n ]$", ""), "\n")
        return F.split(F.array_join(F.zip_with(singles, pairs, lambda a, b: F.concat_ws(" ", a, F.nullif(b, F.lit("")))), " "), " ")

    none = F.array().cast("array<string>")
    return let(F.array_join(_extract(text, CJK), "\n"), lambda runs: F.when(runs == "", none).otherwise(grams(runs)))


def split_identifier(name: Column) -> Column:
    """The whole identifier and its parts, lower-cased: ``foo`` gives ``[foo, foo]``."""
    return F.concat(F.array(ascii_lower(name)), F.transform(_extract(_split_words(name), PART), ascii_lower))


def code_tokens(text: Column) -> Column:
    """Tokens in order: every identifier with its parts, then all ideograph tokens. Null text: none.

    What ``split_identifier`` gives of each, by a few passes over all identifiers, a line each, instead of three an identifier.
    """

    def split_all(names: Column) -> Column:  # ASCII only
        apart = F.regexp_replace(F.lower(_split_words(names)), "(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", " ")
        parts = F.regexp_replace(F.regexp_replace(apart, "(?m) +$", ""), " {2,}", " ")
        return F.split(F.array_join(F.zip_with(F.split(F.lower(names), "\n"), F.split(parts, "\n"), lambda a, b: F.concat_ws(" ", a, b)), " "), " ")

    text, none = F.coalesce(text, F.lit("")), F.array().cast("array<string>")
    named = let(F.array_join(_extract(text, IDENTIFIER), "\n"), lambda names: F.when(names == "", none).otherwise(split_all(names)))
    return F.concat(named, cjk_tokens(text))


def token_bag(text: Column) -> Column:
    """The same tokens as ``code_tokens`` in another order, by three passes over the text instead of two an identifier.

    Splitting the whole text gives the parts of all its identifiers, since what stands outside identifiers has no part.
    """
    text = F.coalesce(text, F.lit(""))
    return F.concat(_extract(ascii_lower(text), IDENTIFIER.replace("A-Z", "")), _extract(ascii_lower(_split_words(text)), PART.replace("A-Z", "")), cjk_tokens(text))


def line_array(text: Column) -> Column:
    """Lines without their ends; a last line end opens no further line; empty or null text has no line."""
    body = F.when(F.endswith(text, F.lit("\n")), F.expr("1")).isNotNull()
    trimmed = F.when(body, F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, "\n"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def first_occurrences(items: Column) -> Column:
    """Trimmed, non-empty items whose lower-cased form didn't stand earlier, in order: by two sorts, so that many items cost little
    more than their number."""
    trimmed = F.filter(F.transform(items, strip), lambda x: x != "")
    placed = F.sort_array(F.transform(trimmed, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("x"))))

    def firsts(all_: Column) -> Column:
        kept = F.filter(all_, lambda a, i: (i == 0) | (F.get(all_, i - 1)["low"] != a["low"]))
        return F.transform(F.sort_array(F.transform(kept, lambda a: F.struct(a["i"], a["x"]))), lambda a: a["x"])

    return let(placed, firsts)


def identifiers(text: Column) -> Column:
    """Code identifiers named in a question: file names, snake_case, dotted names, CamelCase and acronyms, in this order.

    Each pattern takes a whole run of its characters: what stands before and after is named, so that no word boundary is asked of
    the regex engine (their idea of a word differs on accented letters), and a run is tried at its start alone. No pattern looks beyond
    a run of the characters of file names, so a task tries the patterns on the runs that may hold an identifier, once while it remembers it.
    """
    return F.arrow_udf(_identifiers, "array<string>")(text)


# File names, snake_case, dotted names, CamelCase and acronyms, each as a whole run of its characters.
IDENTIFIER_FORMS = (
    r"(?<![A-Za-z0-9_./\\-])[A-Za-z0-9_./\\-]+\.(?:[pP][yY]|[jJ][sS][oO][nN]|[yY][aA]?[mM][lL]|[tT][oO][mM][lL]|[mM][dD]|[tT][xX][tT])(?![A-Za-z0-9_])",
    "(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9]*+(?:_[A-Za-z0-9]++)++(?![A-Za-z0-9_])",
    r"(?<![A-Za-z0-9_.])[A-Za-z_][A-Za-z0-9_]*+(?:\.[A-Za-z_][A-Za-z0-9_]*+)++(?![A-Za-z0-9_.])",
    "(?<![A-Za-z0-9_])[A-Z](?:[A-Z]|[a-z0-9]++[A-Z])[A-Za-z0-9]*+(?![A-Za-z0-9_])",
)
RUNS, RUN_CHARS, TEXTS = 100_000, 64, 512  # runs that a task remembers, and their length; texts looked through together

# Kinds of bytes, a bit each: of a file name, of a word, what joins words, capitals, letters and digits.
IN_RUN, IN_WORD, JOINT, CAPITAL, ALNUM = 1, 2, 4, 8, 16
_ALNUM = UPPER + LOWER + "0123456789"
_KINDS = np.zeros(256, dtype=np.uint8)
for _kind, _chars in ((IN_RUN, _ALNUM + "_./\\-"), (IN_WORD, _ALNUM + "_"), (JOINT, "_."), (CAPITAL, UPPER), (ALNUM, _ALNUM)):
    _KINDS[list(_chars.encode())] |= _kind


class _Named(dict):
    """What each form finds in a run of the characters of file names; nothing for some."""

    def __init__(self) -> None:
        self.forms = [re.compile(p) for p in IDENTIFIER_FORMS]

    def __missing__(self, run: bytes) -> list[list[str]]:
        found = [form.findall(run.decode()) for form in self.forms]
        found = found if any(found) else []
        if len(run) <= RUN_CHARS:
            if len(self) >= RUNS:
                self.clear()
            self[run] = found
        return found


_named = _Named()


def _runs(texts: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Runs of the characters of file names that may hold an identifier, in order, and which text each is of. All identifiers hold a
    dot or low line before a letter, digit or low line, or a capital behind a letter or digit."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    if at[0] == at[-1]:
        return at[:0], []
    data = memoryview(texts.buffers()[2])[at[0] : at[-1]]
    at, kinds = at - at[0], _KINDS[np.frombuffer(data, np.uint8)]
    one, two = kinds[:-1], kinds[1:]
    hint = np.flatnonzero((one & JOINT > 0) & (two & IN_WORD > 0) | (one & ALNUM > 0) & (two & CAPITAL > 0))
    stops = np.flatnonzero(kinds & IN_RUN == 0)
    place, of = np.searchsorted(stops, hint), np.searchsorted(at, hint, side="right") - 1
    stops = np.concatenate([[-1], stops, [len(kinds)]])
    start, end = np.maximum(stops[place] + 1, at[of]), np.minimum(stops[place + 1], at[of + 1])
    first = np.flatnonzero(np.diff(start, prepend=-1))
    return of[first], [bytes(data[i:j]) for i, j in zip(start[first].tolist(), end[first].tolist())]


def _identifiers(texts: pa.Array) -> pa.Array:
    out = [pa.array([], pa.list_(pa.string()))]
    for i in range(0, len(texts), TEXTS):
        part = texts.slice(i, TEXTS)
        of, runs = _runs(part)
        edges, named = np.searchsorted(of, np.arange(len(part) + 1)).tolist(), []
        for null, a, b in zip(part.is_null().to_pylist(), edges, edges[1:]):
            found = [f for f in map(_named.__getitem__, dict.fromkeys(runs[a:b])) if f]
            firsts: dict[str, str] = {}
            for form in range(len(IDENTIFIER_FORMS) if found else 0):
                for f in found:
                    for x in f[form]:
                        firsts.setdefault(x.lower(), x)
            named.append(None if null else list(firsts.values()))
        out.append(pa.array(named, pa.list_(pa.string())))
    return pa.concat_arrays(out)


# Intents and the words that decide them, first match wins.
INTENT_RULES = (
    ("log_diagnosis", ("traceback", "runtimeerror", "报错", "异常", "错误日志")),
    ("dockerfile_generation", ("dockerfile", "docker", "容器")),
    ("test_generation", ("pytest", "单元测试", "生成测试", "测试用例")),
    ("code_completion", ("补全代码", "修改代码", "重构", "实现代码", "修复代码")),
    ("code_analysis", ("代码质量", "圈复杂度", "静态分析", "分析文件")),
    ("code_search", ("仓库", "项目", "代码", "文件", "函数", "类", "实现", "定义", "调用", "模型", "缓存", "训练", "推理", ".py", "_")),
)
INTENT_ELSE = "general_question"

# Categories of exceptions and the phrases that decide them, first match wins.
ERROR_RULES = (
    ("model_state_dict_mismatch", ("missing key(s) in state_dict", "unexpected key(s) in state_dict")),
    ("tensor_shape_mismatch", ("size mismatch", "shapes cannot be multiplied", "the size of tensor")),
    ("cuda_out_of_memory", ("cuda out of memory", "cuda error: out of memory")),
    ("missing_dependency", ("modulenotfounderror", "no module named")),
    ("missing_file", ("filenotfounderror", "no such file or directory")),
    ("python_syntax_error", ("syntaxerror",)),
    ("missing_attribute", ("attributeerror",)),
    ("missing_dictionary_key", ("keyerror",)),
    ("index_out_of_range", ("indexerror",)),
    ("invalid_type_or_call", ("typeerror",)),
    ("invalid_value", ("valueerror",)),
    ("network_or_timeout", ("connectionerror", "timeout")),
)
ERROR_ELSE = "unknown"


def by_rules(text: Column, rules: tuple, otherwise: str) -> Column:
    """The label of the first rule one of whose phrases the lower-cased text contains."""

    def told(low: Column) -> Column:
        out = F.lit(otherwise)
        for label, phrases in reversed(rules):
            hit = F.lit(False)
            for p in phrases:
                hit = hit | F.contains(low, F.lit(p))
            out = F.when(hit, F.lit(label)).otherwise(out)
        return out

    return let(F.lower(text), told)


def infer_intent(question: Column) -> Column:
    return by_rules(F.coalesce(question, F.lit("")), INTENT_RULES, INTENT_ELSE)


def classify_exception(kind: Column, message: Column, log: Column) -> Column:
    whole = F.concat_ws(" ", F.coalesce(kind, F.lit("")), F.coalesce(message, F.lit("")), F.coalesce(log, F.lit("")))
    return by_rules(whole, ERROR_RULES, ERROR_ELSE)


def symbols(text: Column, most: int = 20) -> Column:
    """Quoted strings (double, single, back quotes) and dotted names worth searching for, 3 to 200 characters."""
    quoted = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in ('"([^"\\n]{2,200})"', "'([^'\\n]{2,200})'", "`([^`\\n]{2,200})`")]
    dotted = _extract(text, r"(?<![A-Za-z0-9_.])[A-Za-z_][A-Za-z0-9_]*+(?:\.[A-Za-z0-9_]++)++(?![A-Za-z0-9_.])")
    every = F.transform(F.concat(*quoted, dotted), strip)
    sized = F.filter(every, lambda x: (F.length(x) >= 3) & (F.length(x) <= 200))
    return F.slice(first_occurrences(sized), 1, most)


def normalise_path(path: Column) -> Column:
    """Forward slashes, lower case, without outer blanks and back quotes."""
    return F.lower(F.btrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("` ")))


def is_absolute_path(path: Column) -> Column:
    return F.rlike(path, F.lit(r"^(?:[A-Za-z]:[\\/]|/)"))


def runtime_id(path: Column) -> Column:
    return F.substring(F.sha2(F.lower(path), 256), 1, 16)


WHITE_SPACE = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Punctuation that does not tell questions apart.
QUESTION_MARKS = "，。！？、；：“”‘’（）,.!?;:\"'()"


def normalise_question(text: Column) -> Column:
    return F.translate(F.lower(text), WHITE_SPACE + QUESTION_MARKS, "")


def truncate(text: Column, most: int, marker: str) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(marker))).otherwise(text)


def clamp_confidence(value: Column) -> Column:
    number = F.coalesce(F.try_to_number(value, F.lit("9.999999")).cast("double"), value.try_cast("double"), F.lit(0.5))
    return F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0))


def json_value(text: Column) -> Column:
    """The text as a variant if all of it is one JSON value; else null.

    The parser stops at the end of the first value, so the text is parsed inside an array, which must have one element. Only a text
    with a closing bracket can end that array early; it must be a value inside an object too.
    """
    def value(t: Column) -> Column:
        in_object = F.try_parse_json(F.concat(F.lit('{"x":'), t, F.lit("}"))).isNotNull()
        in_array = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
        one = lambda a: F.when((F.size(a) == 1) & (~F.contains(t, F.lit("]")) | in_object), F.get(a, F.lit(0)))
        return let(F.try_variant_get(in_array, "$", "array<variant>"), one)

    return let(text, value)


def _repaired(text: Column, between: str, kind: str) -> Column:
    """The JSON value of a kind that a model's answer is without its fence, else what stands ``between`` brackets in it, as a string; or null."""
    valid = lambda t: let(t, lambda x: F.when(F.startswith(F.schema_of_variant(json_value(x)), F.lit(kind)), x))
    inner = F.regexp_replace(strip(text), r"(?is)^```(?:json)?\s*(.*?)\s*```$", "$1")
    return let(inner, lambda x: F.coalesce(valid(strip(x)), valid(F.regexp_extract(x, between, 1))))


def repair_json_object(text: Column) -> Column:
    """The JSON object in a model's answer as a string: fence removed, else from the first ``{`` to the last ``}``; or null."""
    return _repaired(text, r"(?s)(\{.*\})", "OBJECT")


def repair_json_array(text: Column) -> Column:
    return _repaired(text, r"(?s)(\[.*\])", "ARRAY")


def prediction_score(values: Column) -> Column:
    """The score of a model's output row: the value itself, or the last of several."""
    return F.element_at(values, -1)


def between(text: Column, start: str, end: str) -> Column:
    """Trimmed text between two markers; null where the first is missing, to the end where the second is."""
    after = F.substring_index(text, start, -1)
    return F.when(F.contains(text, F.lit(start)), strip(F.substring_index(after, end, 1)))


def flag(value: Column) -> Column:
    """Whether a setting's text means yes."""
    return F.coalesce(F.lower(strip(value)).isin("1", "true", "yes", "on"), F.lit(False))


def tool_arguments(raw: Column) -> tuple[Column, Column]:
    """(arguments as a JSON object, error) of a model's tool call: nothing is the empty object; anything but an object is an error."""
    given = F.coalesce(F.nullif(strip(raw), F.lit("")), F.lit("{}"))
    parsed = F.schema_of_variant(json_value(given))
    error = F.when(parsed.isNull(), "not_json").when(~F.startswith(parsed, F.lit("OBJECT")), "not_an_object")
    return F.when(error.isNull(), given), error


def show_number(value: Column) -> Column:
    """Four decimals; a dash for a missing value."""
    return F.when(value.isNull(), "-").otherwise(F.format_string("%.4f", value.cast("double")))


def show_percent(value: Column) -> Column:
    return F.when(value.isNull(), "-").otherwise(F.format_string("%.2f%%", value.cast("double") * 100))
