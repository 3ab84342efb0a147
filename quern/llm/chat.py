"""Chat formatting: schema fingerprints pick declarative mappings to canonical turns.

A record's *fingerprint* is the SHA-256 of all its nested field paths, array elements taken together and kinds of values left out, so records
with and without a ``system`` field differ. A mapping is registered under the SHA-256 of the paths it needs and is a plain SQL
expression that yields ``array<struct<role,text>>``. A mapping fits a record if the record's paths, narrowed to those the
mapping knows (a field may be null), hash to that; of those that fit, the one with most paths is taken, then that with most
values, then the first. What a mapping doesn't read of a record's texts, ``unread_paths`` names. Tables that hold a turn a row are
fingerprinted by their columns. All of it is DataFrame expressions: no Python runs on the executors.

A message's content may be a list of parts: the texts of its parts are joined, and a part without text stays as its JSON. Messages of one list
may have different keys, and one that has only ``tool_calls`` says these as JSON. A ``system`` text and a ``history`` of pairs beside a
question and an answer come first.

Template, per turn: ``<s>[ROLE]`` role ``[/ROLE]`` text ``</s>``. Control strings are ``<s>``, ``</s>`` and any
bracketed upper-case tag such as ``[INST]``. Inside texts and roles the mark U+241B is written as mark + ``0`` and
the first character of a control string is followed by mark + ``1``; ``unescape`` undoes both.

Defined results: null text or role is an empty string; a null turn number sorts first; equal turn numbers sort by role,
then text, and repeated rows stay; a null conversation id is a conversation of its own; other columns are ignored; a
record that no mapping fits has layout ``unknown`` and no turns, and ``unknown_records`` returns it; an empty table gives an
empty table.
A conversation's formatted text is one value, so one task holds one conversation (never more than that).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

MARK = "␛"
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


ELEMENT = ("role", "from", "speaker", "content", "value", "text", "tool_calls")  # what is read of a message


@dataclass(frozen=True)
class Layout:
    name: str
    paths: tuple[str, ...]
    turns: str  # SQL over the variant column v
    messages: str | None = None  # the path of a list of messages


def _text(m: str, path: str) -> str:
    """SQL of a text or of a list of parts."""
    part = "coalesce(try_variant_get(p, '$.text', 'string'), cast(p as string))"
    parts = f"array_join(transform(try_variant_get({m}, '{path}', 'array<variant>'), p -> {part}), '')"
    kind = f"schema_of_variant(try_variant_get({m}, '{path}', 'variant'))"
    return f"case when startswith({kind}, 'ARRAY') then {parts} else try_variant_get({m}, '{path}', 'string') end"


def _list(path: str) -> str:
    """SQL of the turns of a list of messages, each of which may have its own keys; a message that only calls tools says its calls."""
    known = ", ".join(f"'{a}', '{b}'" for a, b in ROLES.items())
    kind = "coalesce(" + ", ".join(f"try_variant_get(m, '$.{r}', 'string')" for r in ELEMENT[:3]) + ")"
    said = [f"nullif({_text('m', f'$.{t}')}, '')" for t in ELEMENT[3:6]]
    return (
        f"transform(try_variant_get(v, '$.{path}', 'array<variant>'), m -> named_struct('role', coalesce(element_at(map({known}), {kind}), {kind}), "
        f"'text', coalesce(nullif(concat({', '.join(f"coalesce({t}, '')" for t in said)}, coalesce(try_variant_get(m, '$.tool_calls', 'string'), '')), ''), {_text('m', '$.content')})))"
    )


def _field(name: str) -> str:
    return f"try_variant_get(v, '$.{name}', 'string')"


def _pair(question: str, answer: str) -> str:
    """SQL of a question and an answer, after the system's text and earlier pairs where the record has them."""
    turn = lambda role, text: f"named_struct('role', '{role}', 'text', {text})"
    system = f"case when {_field('system')} <> '' then array({turn('system', _field('system'))}) else array() end"
    earlier = "transform(coalesce(try_variant_get(v, '$.history', 'array<variant>'), array()), h -> array(" + ", ".join(turn(r, f"try_variant_get(h, '$[{i}]', 'string')") for i, r in enumerate(("user", "assistant"))) + "))"
    return f"concat({system}, flatten({earlier}), array({turn('user', question)}, {turn('assistant', _field(answer))}))"


def _both(first: str, second: str) -> str:
    return f"concat_ws('\\n\\n', {_field(first)}, nullif({_field(second)}, ''))"


LAYOUTS = (
    Layout("messages", ("messages[0].content", "messages[0].role"), _list("messages"), "messages"),
    Layout("nested_messages", ("data.messages[0].content", "data.messages[0].role"), _list("data.messages"), "data.messages"),
    Layout("from_value", ("conversations[0].from", "conversations[0].value"), _list("conversations"), "conversations"),
    Layout("conversations", ("conversations[0].content", "conversations[0].role"), _list("conversations"), "conversations"),
    Layout("prompt_response", ("prompt", "response"), _pair(_field("prompt"), "response")),
    Layout("prompt_completion", ("completion", "prompt"), _pair(_field("prompt"), "completion")),
    Layout("prompt_chosen", ("chosen", "prompt", "rejected"), _pair(_field("prompt"), "chosen")),
    Layout("question_answer", ("answer", "question"), _pair(_field("question"), "answer")),
    Layout("instruction", ("instruction", "output"), _pair(_field("instruction"), "output")),
    Layout("instruction_input", ("input", "instruction", "output"), _pair(_both("instruction", "input"), "output")),
    Layout("instruction_response", ("instruction", "response"), _pair(_field("instruction"), "response")),
    Layout("instruction_context", ("context", "instruction", "response"), _pair(_both("instruction", "context"), "response")),
)
ROW_COLUMNS = ("role", "text", "turn")
KNOWN_PATHS = tuple(sorted({p for layout in LAYOUTS for p in layout.paths}))


def fingerprint(paths: tuple[str, ...] | list[str]) -> str:
    """SHA-256 of the sorted paths, one per line."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def shape_of(v: str) -> Column:
    """SHA-256 of all nested field paths of a variant, the elements of an array taken together, whatever the kinds of their values."""
    scalars = r"\b(?:STRING|BIGINT|BOOLEAN|DOUBLE|FLOAT|VOID|DATE|TIMESTAMP(?:_NTZ)?|BINARY|UUID|DECIMAL\([0-9]+,[0-9]+\))(?=[,>]|$)"
    return F.sha2(F.coalesce(F.regexp_replace(F.schema_of_variant(v), scalars, "_"), F.lit("")), 256)


def _described(df: DataFrame, conv_id: str, record: str) -> DataFrame:
    """conv_id, record, v, fingerprint, layout (null: unknown)."""
    v = df.select(F.col(conv_id).alias("conv_id"), F.col(record).alias("record"), F.try_parse_json(F.col(record)).alias("v"))
    there = lambda p: F.expr(f"try_variant_get(v, '$.{p}', 'variant')").isNotNull()
    filled = lambda p: F.expr(f"try_variant_get(v, '$.{p}', 'string')").isNotNull()
    v = v.withColumn("held", F.array_compact(F.array(*[F.when(there(p), F.lit(p)) for p in KNOWN_PATHS])))
    v = v.withColumn("fingerprint", shape_of("v"))
    fits = []
    for i, x in enumerate(LAYOUTS):
        narrowed = F.array_intersect("held", F.array(*[F.lit(p) for p in x.paths]))
        values = sum((filled(p).cast("int") for p in x.paths), F.lit(0))
        rank = F.struct(F.lit(len(x.paths)).alias("paths"), values.alias("values"), F.lit(-i).alias("order"), F.lit(x.name).alias("layout"))
        fits.append(F.when(F.sha2(F.array_join(narrowed, "\n"), 256) == fingerprint(x.paths), rank))
    return v.select("conv_id", "record", "v", "fingerprint", F.array_max(F.array_compact(F.array(*fits)))["layout"].alias("layout"))


def record_turns(df: DataFrame, conv_id: str, record: str) -> DataFrame:
    """Rows (conv_id, turn, role, text) of JSON records of any registered layout, with ``layout`` and ``fingerprint``."""
    turns = F.expr("cast(array() as array<struct<role:string,text:string>>)")
    for x in LAYOUTS:
        turns = F.when(F.col("layout") == x.name, F.expr(x.turns)).otherwise(turns)
    named = _described(df, conv_id, record)
    rows = named.select("conv_id", "fingerprint", F.coalesce("layout", F.lit("unknown")).alias("layout"), F.posexplode_outer(turns).alias("turn", "m"))
    return rows.select("conv_id", F.col("turn").cast("long"), "m.role", "m.text", "layout", "fingerprint")


def unread_paths(df: DataFrame, conv_id: str = "conv_id", record: str = "record") -> DataFrame:
    """Rows (conv_id, layout, path) of the fields of mapped records that hold text and that their mapping doesn't read."""
    spark, known = df.sparkSession, _described(df, conv_id, record).where("layout is not null").select("conv_id", "layout", "v")
    text = lambda c: F.contains(F.schema_of_variant(c), F.lit("STRING"))

    def inside(rows: DataFrame, prefix: Column, read: Column) -> DataFrame:
        found = rows.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        return found.where(F.col("key").isNotNull() & ~F.array_contains(read, F.col("key"))).where(text(F.col("value"))).select("conv_id", "layout", F.concat(prefix, F.col("key")).alias("path"))

    def of(values: dict[str, list[str]]) -> Column:
        out = F.array().cast("array<string>")
        for name, keys in values.items():
            out = F.when(F.col("layout") == name, F.lit(keys)).otherwise(out)
        return out

    top = {x.name: [x.messages.split(".")[0]] if x.messages else [p for p in x.paths if p != "rejected"] + ["system", "history"] for x in LAYOUTS}
    out = inside(known, F.lit(""), of(top))
    for x in LAYOUTS:
        if x.messages:
            own = known.where(F.col("layout") == x.name)
            if "." in x.messages:
                head, tail = x.messages.split(".")
                out = out.unionByName(inside(own.withColumn("v", F.expr(f"try_variant_get(v, '$.{head}', 'variant')")), F.lit(f"{head}."), F.lit([tail])))
            each = own.select("conv_id", "layout", F.explode(F.expr(f"try_variant_get(v, '$.{x.messages}', 'array<variant>')")).alias("v"))
            out = out.unionByName(inside(each, F.lit(f"{x.messages}[]."), F.lit(list(ELEMENT))))
    return out.distinct()


def unknown_records(df: DataFrame, conv_id: str = "conv_id", record: str = "record") -> DataFrame:
    """Rows (conv_id, record, fingerprint) of the records that no mapping fits."""
    return _described(df, conv_id, record).where("layout is null").select("conv_id", "record", "fingerprint")


def canonical_turns(df: DataFrame, conv_id: str = "conv_id", record: str | None = None) -> DataFrame:
    """Rows (conv_id, turn, role, text) of a table, whose columns' fingerprint tells turn rows from JSON records."""
    if fingerprint([c for c in df.columns if c in ROW_COLUMNS]) == fingerprint(ROW_COLUMNS):
        return df.select(F.col(conv_id).alias("conv_id"), F.col("turn").cast("long"), "role", "text")
    return record_turns(df, conv_id, record or "record").where("turn is not null").select("conv_id", "turn", "role", "text")


def escape(text: Column) -> Column:
    marked = F.replace(text, F.lit(MARK), F.lit(MARK + "0"))
    return F.regexp_replace(marked, r"<(?=/?s>)|\[(?=/?[A-Z]+\])", f"$0{MARK}1")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(MARK + "1"), F.lit("")), F.lit(MARK + "0"), F.lit(MARK))


def format_chat(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row per conversation: conv_id, formatted, loss_mask.

    loss_mask: array of (piece, start, length, offset): code points from ``start`` of the piece-th turn, which begin at
    ``offset`` of the whole text. One shuffle on the conversation serves both the running offset and the gathering.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit("<s>[ROLE]"), escape(role), F.lit("[/ROLE]"))
    body = escape(text)
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), head.alias("head"), body.alias("body"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    size = F.length("head") + F.length("body") + F.lit(len("</s>"))
    rows = rows.select(
        "conv_id",
        (F.row_number().over(order) - 1).alias("piece"),
        (F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size).alias("at"),
        F.col("role").isin(*loss_roles).alias("loss"),
        "head",
        "body",
    )
    turn = F.struct(
        "piece",
        F.concat("head", "body", F.lit("</s>")).alias("shown"),
        F.when(
            F.col("loss"),
            F.struct("piece", F.length("head").alias("start"), F.length("body").alias("length"), (F.col("at") + F.length("head")).alias("offset")),
        ).alias("mask"),
    )
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return whole.select(
        "conv_id",
        F.array_join("turns.shown", "").alias("formatted"),
        F.array_compact("turns.mask").alias("loss_mask"),
    )


def parse_chat(formatted: Column) -> Column:
    """array<struct<role,text>> read back from a formatted text."""

    def one(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(len("<s>[ROLE]") + 1))
        role = F.substring_index(inner, "[/ROLE]", 1)
        return F.struct(
            unescape(role).alias("role"),
            unescape(F.substr(inner, F.length(role) + F.lit(len("[/ROLE]") + 1))).alias("text"),
        )

    return F.transform(pieces(formatted), one)


def pieces(formatted: Column) -> Column:
    """The turns as they stand, without their end marks."""
    found = F.split(formatted, "</s>", -1)
    return F.slice(found, 1, F.size(found) - 1)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the formatted text of every conversation, read back from it."""
    own = '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(own).alias("record"))
    turns = canonical_turns(table(spark, sf_dir, "conversations")).unionByName(canonical_turns(extra))
    done = format_chat(turns)
    done = done.select(
        "conv_id",
        F.length("formatted").cast("long").alias("formatted_chars"),
        parse_chat(F.col("formatted")).alias("turns"),
        pieces(F.col("formatted")).alias("pieces"),
        "loss_mask",
    )
    loss = F.array_join(
        F.transform("loss_mask", lambda m: unescape(F.substr(F.get("pieces", m["piece"]), m["start"] + 1, m["length"]))), ""
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), shown as (
  select *, length(role) + length(text)
    + (length(role) - length(replace(role, chr(9243), ''))) + (length(text) - length(replace(text, chr(9243), '')))
    + 2 * len(regexp_extract_all(role, '</?s>|\[/?[A-Z]+\]')) + 2 * len(regexp_extract_all(text, '</?s>|\[/?[A-Z]+\]'))
    + length('<s>[ROLE][/ROLE]</s>') as chars
  from turns
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from shown group by conv_id
"""
