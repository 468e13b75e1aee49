"""Sharding by extendible hashing, in DataFrame operations only.

The directory is indexed by the leading bits of a hash of the key.  A bucket
over its byte limit splits on one more bit, and only it; the bits of depth 0 to
the first guess are tried from one histogram, and what is still too large then
goes on with more bits.  The rows of one key share all bits of its hash; where
they alone exceed the limit, the bits of a hash of the row number follow.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.plans.scratch import Scratch

SHARD_BYTES = 1 << 20
KEY_BITS = 60
#: Bits beyond those that equal shards would need, tried from one histogram.
SPARE_BITS = 4


def key_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text; a null key is the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(depth: Column) -> list[Column]:
    """The leading ``depth`` bits, as a pair of numbers: of the key's hash, and of the row's."""
    key = F.expr("shiftright(h, greatest(0, {0} - d))".format(KEY_BITS))
    row = F.expr("CASE WHEN d > {0} THEN shiftright(g, greatest(0, 2 * {0} - d)) ELSE 0L END".format(KEY_BITS))
    return [key.alias("p"), row.alias("r")]


def extendible_shards(spark: SparkSession, docs: DataFrame, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, bytes, depth, shard (its bits), shard_bytes, shard_docs.

    A shard holds at most ``limit`` bytes of UTF-8 text, or a single document.
    Null texts have 0 bytes.  Rows of equal key share a shard unless they
    exceed the limit together; then they are told apart by row number, down to
    one row a shard.  An empty table gives no rows.  Other columns are not
    read, whatever their names.  The text is read once; dealt and joined are
    three numbers for each document, and the directory, a few rows for each
    shard, stays distributed.  A round's tables are deleted when the next has
    taken their place.
    """
    scratch = Scratch(spark, "sharding")
    size = F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long")
    row = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - KEY_BITS)
    slim = scratch.table(docs.select(docs[key].alias("k"), size.alias("bytes"), key_hash(docs[key]).alias("h"), row.alias("g")), "sizes")
    out, left = [], slim
    total, start = slim.agg(F.sum("bytes")).first()[0] or 0, 0
    while True:
        # Each round goes on at the depth where the last one ended, up to all bits of both hashes.
        more = max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE_BITS
        end = min(start + more, 2 * KEY_BITS)
        if start < KEY_BITS:
            end = min(end, KEY_BITS)
        leaf = left.withColumn("d", F.lit(end)).select("k", "bytes", "h", "g", *_prefix(F.col("d")))
        leaves = leaf.groupBy("p", "r").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"), F.min("h").alias("h"), F.min("g").alias("g"), (F.min("h") == F.max("h")).alias("one_key"))
        leaves = scratch.table(leaves, "leaves")
        # Every leaf under each of its prefixes; a prefix that fits is a bucket, the shortest one wins.
        levels = leaves.select(F.col("p").alias("leaf_p"), F.col("r").alias("leaf_r"), "bytes", "docs", "h", "g", F.explode(F.sequence(F.lit(start), F.lit(end))).alias("d"))
        levels = levels.select("leaf_p", "leaf_r", "d", "bytes", "docs", *_prefix(F.col("d")))
        sums = levels.groupBy("d", "p", "r").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | (F.col("d") == 2 * KEY_BITS))
        best = F.min(F.struct("d", "p", "r", "shard_bytes", "shard_docs")).alias("bucket")
        directory = scratch.table(levels.join(fits, ["d", "p", "r"]).groupBy("leaf_p", "leaf_r").agg(best), f"directory{end}")
        placed = leaf.join(directory, (F.col("p") == F.col("leaf_p")) & (F.col("r") == F.col("leaf_r")), "left").select("k", leaf["bytes"], "h", "g", "bucket")
        large = leaves.join(directory, (F.col("p") == F.col("leaf_p")) & (F.col("r") == F.col("leaf_r")), "left_anti")
        total, several = large.agg(F.max("bytes"), F.count_if(~F.col("one_key"))).first()
        if total is None:
            out.append(placed)
            break
        placed = scratch.table(placed, "placed")
        out.append(placed.where("bucket is not null"))
        left = placed.where("bucket is null").select("k", "bytes", "h", "g")
        for done in (slim, leaves, directory):
            scratch.drop(done)
        # A key that fills a leaf alone shares all further bits of its hash with itself.
        start = end if several or end > KEY_BITS else KEY_BITS
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    bits = lambda x, n: F.expr(f"lpad(bin({x}), {n}, '0')")
    shard = F.concat(bits("bucket.p", f"least(bucket.d, {KEY_BITS})"), F.when(F.col("bucket.d") > KEY_BITS, bits("bucket.r", f"bucket.d - {KEY_BITS}")).otherwise(""))
    return found.select(F.col("k").alias(key), "bytes", F.col("bucket.d").alias("depth"), shard.alias("shard"), "bucket.shard_bytes", "bucket.shard_docs")


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS bytes,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents
), levels AS (
  SELECT doc_id, bytes, d, h >> ({KEY_BITS} - d) AS p,
         sum(bytes) OVER (PARTITION BY d, h >> ({KEY_BITS} - d)) AS shard_bytes,
         count(*) OVER (PARTITION BY d, h >> ({KEY_BITS} - d)) AS shard_docs
  FROM sized, (SELECT unnest(range(0, 41))::INTEGER AS d)
), fitting AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d) AS n
  FROM levels WHERE shard_bytes <= {SHARD_BYTES} OR shard_docs = 1
)
SELECT doc_id, bytes, d AS depth, CASE WHEN d = 0 THEN '' ELSE lpad(bin(p), d, '0') END AS shard,
       shard_bytes::BIGINT AS shard_bytes, shard_docs::BIGINT AS shard_docs
FROM fitting WHERE n = 1
"""
