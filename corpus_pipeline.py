"""From documents to a training mix: five stages, each written and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.common import only_this, written
from listwright.llm.op1_decontaminate import contamination
from listwright.llm.op4_mixing import mixed
from listwright.llm.op7_language import fit, predicted
from listwright.llm.op8_personal import personal_data
from listwright.llm.op9_minmax import classes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what is in no language: null and empty texts and texts without a letter.

    Rows that repeat, null ids and ties of the languages change nothing; other columns than
    those of documents are dropped; an empty table gives no rows.
    """
    return predicted(docs, fit(docs), keep=COLUMNS).where("lang_pred != 'und'").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each class of near copies (five-word shingles, 0.8).

    Rows without an id stand in by a hash of their text, above all real ids.  Of rows that
    repeat a kept id in one class one stays; an id whose texts are of several classes stays
    once in each that it is the smallest id of.  Texts that are null or have no word are
    near nothing and all stay.  Of rows of one id and class that differ the first by text,
    source, language and size stays, so reruns agree.  Other columns than those of documents
    are dropped; an empty table gives no rows.
    """
    stand_in = F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))
    d = docs.select(*COLUMNS, F.coalesce("doc_id", stand_in).alias("key"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    found = classes(d.where(worded).select(F.col("key").alias("doc_id"), "text"), width=5, percent=80)
    kept = found.where("kept").select(F.col("doc_id").alias("key"), "h", "root").distinct()
    stays = d.where(worded).withColumn("h", F.xxhash64("text")).join(kept, ["key", "h"])
    stays = stays.groupBy("key", "root").agg(F.min(F.struct("text", "source", "lang", "n_chars", "doc_id")).alias("r")).select("r.*")
    return stays.select(*COLUMNS).unionByName(d.where(~worded).select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Null and empty texts hold none; rows that repeat, null ids and ties of items change
    nothing; other columns than those of documents are dropped; an empty table or an empty
    benchmark drops nothing.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, benchmark, keep=COLUMNS).where("not contaminated").select(*COLUMNS)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and keys by the name of their kind; n_chars follows the text.

    Null and empty texts stay as they are; rows that repeat are replaced alike; of spans that
    overlap one mark stands for all; other columns than those of documents are dropped; an
    empty table gives no rows.
    """
    found = personal_data(docs, keep=COLUMNS, redact=True)
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.char_length("redacted").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes, with their number of repeats and words taken.

    Documents without words are never taken; a null source is one of its own; rows that are
    alike in id, text and source are taken or left together; other columns than those of
    documents are dropped; an empty table gives no rows.
    """
    return mixed(docs, keep=COLUMNS[:3] + ["n_chars"]).where("taken > 0").select(*COLUMNS, "size", "target", "repeats", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("personal", personal),
    ("mix", mix),
]

#: Language models, min-max hashing, string tiling, bootstrapping and min-cost flow are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; of the tables written on the way only the last stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with only_this(spark) as last:
        for name, stage in STAGES:
            with only_this(spark) as kept:
                docs = written(stage(spark, docs, sf_dir), name)
                kept.append(docs)
        last.append(docs)
    return docs
