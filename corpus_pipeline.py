"""A corpus pipeline: language, near duplicates, benchmark passages, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` applies them to ``documents`` in order, each on what
the one before it wrote. Stages but
the last return the columns of ``documents`` (others that the input has stay too):

1. ``language`` drops documents without a language (null texts, texts without a letter);
2. ``near_duplicates`` keeps the first document of each group at a similarity of 0.8 or more on five-word shingles;
3. ``decontamination`` drops documents that hold a benchmark passage within its edit distance;
4. ``secrets`` replaces confirmed and pattern secrets in the texts by their kind;
5. ``packing`` packs all that is left into sequences of at most 2048 tokens: a row per piece.

Nulls, empty texts and repeated rows: as the operators' modules define them. In stage 2, rows that repeat both a document id and
its text are one document, of which one row stays; rows of one id with different texts, and rows without an id, are documents
of their own, told apart by id and text. Columns may have any names: inside the stages they go by their places.

Each stage's table in the shared folder goes once the next is written; ``quern.llm.common.clear`` removes what the result reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from quern.llm import decontam, language, near_dup, packing, secret_scan
from quern.llm.common import Tables

ORACLE_SQL = None


def _placed(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named by place, so that no name clashes with an operator's."""
    return docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))


def _named(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. Learned from the documents that have one."""
    columns = docs.columns
    found = language.identify(_placed(docs), language.train(docs), f"c{columns.index('text')}", into=("p", "s"))
    return _named(found.where(F.col("p") != language.UNKNOWN), columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of least id; rows whose id doesn't tell them apart go last."""
    columns = docs.columns
    rows, doc_id, text = _placed(docs), f"c{columns.index('doc_id')}", f"c{columns.index('text')}"
    # Rows without an id, and ids that hold several texts, get an id of their own above all ids below 2 ** 62.
    apart = F.lit(1 << 62) + F.pmod(F.xxhash64(doc_id, text), F.lit(1 << 61))
    with Tables(spark) as tables:
        digest = F.xxhash64(F.coalesce(text, F.lit("")))
        several = rows.where(f"{doc_id} is not null").groupBy(doc_id).agg(F.min(digest).alias("lo"), F.max(digest).alias("hi"))
        several = tables.write(several.where("lo <> hi").select(F.col(doc_id).alias("own")), "several")
        own = F.coalesce(F.col(doc_id), apart)
        if several.isEmpty():
            rows = rows.withColumn("own", own)
        else:
            marked = near_dup.maybe_in(rows.withColumn("own", F.col(doc_id)), near_dup.bitmap_of(several, "own"), "own", "maybe")
            held = marked.where("maybe").join(several.withColumn("several", F.lit(True)), "own", "left")
            held = held.select(*rows.columns, F.when(F.col("several"), apart).otherwise(own).alias("own"))
            rows = held.unionByName(marked.where("not maybe").select(*rows.columns, own.alias("own")))
            rows = tables.write(rows, "named", keep=True)
        found = near_dup.near_duplicates(rows, size=5, id_col="own", text_col=text).groupBy(F.col("doc_id").alias("own"))
        verdicts = found.agg(F.count_if("kept").alias("kept")).where("kept <> 1")  # dropped, or there more than once
        verdicts = tables.write(verdicts, "verdicts", keep=True)
        # Rows that the bitmap clears stay where they are; only the others' texts are shuffled, to be looked up exactly.
        seen = near_dup.maybe_in(rows, near_dup.bitmap_of(verdicts, "own"), "own", "hit")
        looked = seen.where("hit").join(verdicts, "own", "left").where("kept is null or kept > 1")
        if not verdicts.where("kept > 1").isEmpty():
            # Rows equal in id and text: one stays. Least by the columns that have an order, summed on the map side.
            ordered = [f.name for f in rows.schema.fields if isinstance(f.dataType, AtomicType)]
            first = F.min_by(F.struct(*rows.columns), F.struct(*ordered)).alias("row")
            looked = looked.groupBy("own").agg(first).select("row.*")
        kept = seen.where("not hit").select(*rows.columns).unionByName(looked.select(*rows.columns))
        return _named(kept, columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, secrets in their texts replaced."""
    return secret_scan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Tables(spark) as tables:
        for name, stage in STAGES[:-1]:
            before, docs = docs, tables.write(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
            if name != STAGES[0][0]:
                tables.drop(before)
        packed = STAGES[-1][1](spark, docs, sf_dir)
        tables.drop(docs)  # packing has written its pieces and reads no text any more
        return packed
