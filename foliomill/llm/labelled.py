"""Bounded samples of labelled rows for fitting classifiers on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest text, in bytes, that is drawn for fitting (scoring has no such bound).
SAMPLE_TEXT_BYTES = 8192
#: Training texts for each class.
SAMPLE_ROWS = 1500


def fold(key: Column, folds: int) -> Column:
    """The remainder of crc32 of the key as text; null for a null key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))


def held_out(key: Column, folds: int, remainder: int) -> Column:
    """Whether a row is kept from fitting; rows without a key are."""
    return F.coalesce(fold(key, folds) == remainder, F.lit(True))


def place(key: Column) -> Column:
    """A number from 0 to 1 that depends on the key alone."""
    return F.shiftrightunsigned(F.xxhash64(key.cast("string"), F.lit(11)), 11) / F.lit(float(1 << 53))


def ids_of(key: Column) -> Column:
    """About how many different ids there are, so that one id of very many rows doesn't count for them."""
    return F.approx_count_distinct(key, 0.02)


def share_for(count: int, ids: int) -> float:
    """The share of about ``ids`` ids to draw so that ``count`` of them come but for a chance of one in a million."""
    return 1.0 if ids <= count else 1.1 * (count + 5 * math.sqrt(count) + 20) / ids


def draw(rows: DataFrame, count: int) -> list:
    """At most ``count`` different ids of rows (doc_id), the same ones however the table is dealt.

    Those whose hash lies under the share that is wanted come to the driver,
    each once and little more than ``count`` however large the table; the last
    are cut.
    """
    share = share_for(count, rows.agg(ids_of(F.col("doc_id"))).first()[0])
    drawn = rows.select("doc_id", place(F.col("doc_id")).alias("place")).where(F.col("place") < share).distinct().collect()
    ordered = sorted(((r["doc_id"], r["place"]) for r in drawn), key=lambda x: (x[1], str(x[0])))
    return [k for k, _ in ordered[:count]]


def short_enough(known: DataFrame, docs: DataFrame, most: int = SAMPLE_TEXT_BYTES) -> DataFrame:
    """The labelled rows that have a text of at most ``most`` bytes, so that a draw from them gives texts."""
    return known.join(docs.where(F.octet_length("text") <= most).select("doc_id"), "doc_id", "left_semi")


def texts_of(docs: DataFrame, wanted: dict, most: int = SAMPLE_TEXT_BYTES) -> list[tuple[object, str]]:
    """Pairs (doc_id, text) of the wanted ids, in order; ``wanted`` is a bounded sample.

    Of several texts of one id the least is taken; longer ones, nulls and ids
    without a text give none.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = spark.createDataFrame([(k,) for k in wanted], f"doc_id {kind}")
    found = docs.where(F.octet_length("text") <= most).join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return sorted((tuple(r) for r in found.collect()), key=lambda r: str(r[0]))
