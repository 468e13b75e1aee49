"""A corpus pipeline of the operators in foliomill.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of documents.  ``run`` writes each
stage's rows to the shared folder and reads them back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import decontaminate, language, near_duplicates, packing, secrets
from foliomill.llm.rows import unpacked
from foliomill.plans.scratch import Scratch, scope


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence.

    Null and empty texts and those without a letter go, long texts are read
    whole, repeated rows are kept or dropped alike, and an empty table gives
    none; columns may have any names.
    """
    return unpacked(language.identify_languages(docs, language.train(docs)).where("not rejected"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8).

    Null and empty texts stay, as do rows without an id; of equal rows one
    stays; columns may have any names.
    """
    return near_duplicates.without_near_duplicates(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark.

    Null and empty texts stay; repeated rows are kept or dropped alike; columns
    may have any names.
    """
    return decontaminate.clean_documents(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret and ``n_chars`` brought up to date.

    Null texts stay null, empty ones empty; repeated rows are changed alike; a
    table without ``n_chars`` has only its texts changed; columns may have any
    names.
    """
    found = secrets.find_secrets(docs, redacted=True)
    text = F.when(F.size("spans") > 0, F.col("redacted")).otherwise(F.col("row.text"))
    n_chars = F.when(F.size("spans") > 0, F.char_length("redacted")).otherwise(F.col("row.n_chars"))
    new = {"text": text, "n_chars": n_chars.cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": text}
    return found.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens.

    Null and empty texts are one piece of the end id alone; each row of a
    repeated document is packed by itself; other columns aren't read.
    """
    return packing.pack_documents(spark, docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: Training, sketches and tokenization can't be put in SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        with scope(spark):  # what a stage writes on its way goes with it
            made = scratch.table(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(docs)
        docs = made
    return docs
