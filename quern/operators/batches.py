"""Training batches of chats: token ids, labels of what the assistant says, attention masks, batches of like lengths.

A sample's messages are put into one text by a template; an ``Encoder`` gives each text's ids with the places they come from, and the
ids that lie inside an assistant's content are their own labels, all others -100. Samples are batched with others of their length
class, padded to the longest of the batch.

Defined results: a sample without messages, without a labelled id, of more than ``most`` ids, or whose ids cross the border of an
assistant's content is a problem, not a row; null contents are empty; samples that share an id are samples of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.session import written

# A text's ids with first and last + 1 code point each.
Encoder = Callable[[str], list[tuple[int, int, int]]]
IGNORED = -100
CELL_ROWS = 4096  # samples of a length class that are numbered together, about


def byte_encoder(text: str) -> list[tuple[int, int, int]]:
    """The local stand-in of a tokenizer: an id for every byte of UTF-8."""
    return [(b, i, i + 1) for i, c in enumerate(text) for b in c.encode("utf-8", "surrogatepass")]


def laid_out(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
    """The text of some messages and where the assistant's contents, with the mark that ends them, stand in it."""
    out, spans, at = [], [], 0
    for m in messages:
        head, body = f"<|{m['role']}|>\n", f"{m['content'] or ''}<|end|>"
        out += [head, body, "\n"]
        if m["role"] == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + 1
    return "".join(out), spans


def masked(messages: list[dict] | None, encode: Encoder, most: int) -> tuple[list[int], list[int], str | None]:
    """(ids, labels, problem) of a sample."""
    if not messages:
        return [], [], "no_messages"
    text, spans = laid_out(messages)
    tokens = encode(text)
    if len(tokens) > most:
        return [], [], "too_long"
    labels, s = [], 0
    for number, first, last in tokens:
        while s < len(spans) and spans[s][1] <= first:
            s += 1
        inside = s < len(spans) and spans[s][0] <= first and last <= spans[s][1]
        if not inside and s < len(spans) and first < spans[s][1] and last > spans[s][0]:
            return [], [], "crosses_a_border"
        labels.append(number if inside else IGNORED)
    return ([t[0] for t in tokens], labels, None) if any(x != IGNORED for x in labels) else ([], [], "nothing_to_learn")


def label_masks(samples: DataFrame, encode: Encoder = byte_encoder, most: int = 2048, key: str = "id", messages: str = "messages") -> DataFrame:
    """key, ids, labels, problem of every sample."""
    kind = samples.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids, labels, problems = zip(*(masked(m, encode, most) for m in part.column(1).to_pylist()))
                columns = [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(labels, pa.list_(pa.int32())), pa.array(problems, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "ids", "labels", "problem"])

    read = samples.select(F.col(key).alias("k"), F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("m"))
    return read.mapInArrow(run, f"k {kind}, ids array<int>, labels array<int>, problem string").withColumnRenamed("k", key)


def training_batches(
    samples: DataFrame, encode: Encoder = byte_encoder, most: int = 2048, size: int = 8, width: int = 64, pad: int = 0, key: str = "id", messages: str = "messages"
) -> tuple[DataFrame, DataFrame]:
    """(rows, problems). rows: key, batch, length, ids, labels, attention, padded to the longest of their batch, which holds ``size`` samples or
    fewer, all of one class of ``width`` lengths. problems: key, problem.

    A class is dealt to cells of bounded size by a hash and numbered inside them, so no task holds a class of many samples.
    """
    told = written(label_masks(samples, encode, most, key, messages), "masks")
    good = told.where("problem is null").select(F.col(key).alias("k"), "ids", "labels", F.size("ids").cast("long").alias("length"))
    good = good.withColumn("class", F.floor((F.col("length") - 1) / width))
    cells = good.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).alias("cells"))  # most / width rows
    good = good.join(F.broadcast(cells), "class").withColumn("cell", F.pmod(F.xxhash64("k", "ids"), F.col("cells")))
    place = F.row_number().over(Window.partitionBy("class", "cell").orderBy("length", "k", "ids")) - 1
    good = good.withColumn("part", F.floor(place / size)).withColumn("batch", F.concat_ws("-", "class", "cell", "part"))
    longest = F.max("length").over(Window.partitionBy("class", "cell", "part"))
    good = good.withColumn("missing", (longest - F.col("length")).cast("int"))
    filled = lambda c, v: F.concat(F.col(c), F.array_repeat(F.lit(v), F.col("missing")))
    attention = F.concat(F.array_repeat(F.lit(1), F.col("length").cast("int")), F.array_repeat(F.lit(0), F.col("missing")))
    rows = good.select(F.col("k").alias(key), "batch", "length", filled("ids", pad).alias("ids"), filled("labels", IGNORED).alias("labels"), attention.alias("attention"))
    return rows, told.where("problem is not null").select(key, "problem")
