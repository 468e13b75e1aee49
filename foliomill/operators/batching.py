"""Packing the items of a page into batches, and what is computed from batches."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.functions import text as tf

SINGLE, SMALL, LARGE, STANDARD = "Single", "Small", "Large", "Standard"
MERGE_LARGE_CHARS = 9000 * 8 // 10


@dataclass(frozen=True)
class BatchConfig:
    """Limits and switches of packing."""

    max_chars: int = 9000
    max_effective: float = 13500.0
    min_chars: int = 2000
    small: int = 2
    smart_grouping: bool = True
    smart_sizing: bool = True
    merging: bool = True


@dataclass(frozen=True)
class _Batch:
    items: tuple[int, ...]
    kind: str
    priority: int
    chars: int
    effective: np.float32
    duration: int


def _duration(priorities: list[int], effective: np.float32) -> int:
    per = {3: np.float32(1.3), 2: np.float32(1.1), 1: np.float32(1.0), 0: np.float32(0.9)}
    total = np.float32(0)
    for p in priorities:
        total = np.float32(total + per[p])
    base = 150 + int(effective) * 8 // 10 + 10 * len(priorities)
    return int(np.float32(base) * np.float32(total / np.float32(len(priorities))))


def pack(chars: list[int], effective: list[np.float32], priority: list[int], config: BatchConfig = BatchConfig()) -> list[_Batch]:
    """Batches of items that are already in order; numbers are positions in the lists."""

    def made(items: list[int], kind: str) -> _Batch:
        size = np.float32(0)
        for i in items:
            size = np.float32(size + effective[i])
        return _Batch(tuple(items), kind, max(priority[i] for i in items), sum(chars[i] for i in items), size, _duration([priority[i] for i in items], size))

    out: list[_Batch] = []
    if config.smart_grouping:
        for level in (3, 2, 1, 0):
            open_: list[int] = []
            size, weight = 0, np.float32(0)
            for i in [i for i, p in enumerate(priority) if p == level] + [-1]:
                over = i < 0 or size + chars[i] > config.max_chars or (config.smart_sizing and np.float32(weight + effective[i]) > config.max_effective)
                if open_ and over:
                    out.append(made(open_, batch_kind(len(open_), size, weight, config)))
                    open_, size, weight = [], 0, np.float32(0)
                if i >= 0:
                    open_.append(i)
                    size, weight = size + chars[i], np.float32(weight + effective[i])
    else:
        open_, size = [], 0

        def close() -> None:
            nonlocal open_, size
            if open_:
                out.append(made(open_, SMALL if len(open_) <= config.small else LARGE if size > config.max_chars * 8 // 10 else STANDARD))
            open_, size = [], 0

        for i, n in enumerate(chars):
            if n > config.max_chars:
                close()
                out.append(made([i], SINGLE))
                continue
            if open_ and size + n > config.max_chars and (size >= config.min_chars or size > config.max_chars * 8 // 10):
                close()
            open_.append(i)
            size += n
        close()
    return merged(out, config) if config.merging and len(out) > 1 else out


def batch_kind(items: int, chars: int, effective: float, config: BatchConfig) -> str:
    if items == 1:
        return SINGLE
    if items <= config.small:
        return SMALL
    if config.smart_sizing and (chars > config.max_chars * 8 // 10 or effective > np.float32(config.max_effective) * np.float32(0.9)):
        return LARGE
    return STANDARD


def merged(batches: list[_Batch], config: BatchConfig) -> list[_Batch]:
    """Runs of small batches joined while they go together; the first one's effective size stays as it was."""
    out: list[_Batch] = []
    joinable = False
    for b in batches:
        last = out[-1] if out else None
        fits = joinable and b.kind == SMALL and last.kind not in (SINGLE, LARGE) and abs(last.priority - b.priority) <= 1 and np.float32(last.effective + b.effective) <= config.max_effective
        if fits:
            n, size = len(last.items) + len(b.items), last.chars + b.chars
            kind = LARGE if size > MERGE_LARGE_CHARS else SMALL if n <= 2 else STANDARD
            out[-1] = replace(last, items=last.items + b.items, kind=kind, priority=max(last.priority, b.priority), chars=size, duration=last.duration + b.duration)
        else:
            out.append(b)
            joinable = b.kind == SMALL
    return out


BATCHED = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("batch_id", T.IntegerType()),
        T.StructField("place", T.IntegerType()),
        T.StructField("ord", T.LongType()),
        T.StructField("batch_type", T.StringType()),
        T.StructField("batch_priority", T.IntegerType()),
        T.StructField("chars", T.LongType()),
        T.StructField("effective", T.FloatType()),
        T.StructField("duration_ms", T.LongType()),
    ]
)


def create_batches(items: DataFrame, config: BatchConfig = BatchConfig()) -> DataFrame:
    """The batch of every item of a page (page_id, rank, ord, text, text_type, priority, depth, parent_tag).

    Only numbers go to Python, a page's items at a time; ``place`` counts an
    item within its batch from 0 and batches are numbered from 1 in each page.
    """
    size = tf.effective_size(F.col("text"), F.col("text_type"), F.col("depth"), F.lit(None).cast("string"))
    slim = items.select("page_id", "rank", "ord", "priority", F.char_length("text").alias("chars"), size.alias("effective"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        col = lambda c: table.column(c).to_pylist()
        ords, page = col("ord"), table.column("page_id")[0].as_py()
        batches = pack(col("chars"), [np.float32(x) for x in col("effective")], col("priority"), config)
        rows = [(page, k, i, ords[at], b.kind, b.priority, b.chars, float(b.effective), b.duration) for k, b in enumerate(batches, 1) for i, at in enumerate(b.items)]
        from pyspark.sql.pandas.types import to_arrow_schema

        return pa.Table.from_pylist([dict(zip(BATCHED.fieldNames(), r, strict=True)) for r in rows], to_arrow_schema(BATCHED))

    return slim.groupBy("page_id").applyInArrow(run, BATCHED)


def split_batches(batched: DataFrame, items: DataFrame, max_chars: int) -> DataFrame:
    """Batches over ``max_chars`` cut in order; further parts get ids raised by 1000 each and all become standard."""
    sized = batched.join(items.select("page_id", "ord", F.char_length("text").alias("n")), ["page_id", "ord"])
    step = lambda s, x: F.when((s["size"] + x["n"] > max_chars) & (s["size"] > 0), F.struct((s["part"] + 1).alias("part"), x["n"].cast("long").alias("size"), F.concat(s["out"], F.array(F.struct(x["ord"].alias("ord"), (s["part"] + 1).alias("part")))).alias("out"))).otherwise(F.struct(s["part"].alias("part"), (s["size"] + x["n"]).alias("size"), F.concat(s["out"], F.array(F.struct(x["ord"].alias("ord"), s["part"].alias("part")))).alias("out")))
    start = F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("size"), F.array().cast("array<struct<ord:bigint,part:int>>").alias("out"))
    listed = sized.groupBy("page_id", "batch_id", "batch_type", "chars").agg(F.array_sort(F.collect_list(F.struct("place", "ord", F.col("n").cast("long").alias("n")))).alias("xs"))
    parts = listed.withColumn("p", F.explode(F.aggregate("xs", start, step)["out"]))
    large = F.col("chars") > max_chars
    return parts.select("page_id", F.when(large, F.col("batch_id") + 1000 * F.col("p.part")).otherwise(F.col("batch_id")).alias("batch_id"), F.col("p.ord").alias("ord"), F.when(large, STANDARD).otherwise(F.col("batch_type")).alias("batch_type"))


def queue_order(batches: DataFrame, by: str = "batch_id") -> DataFrame:
    """Batches with ``lane``: 0 critical and high, 1 normal, 2 low; within a lane first in, first out."""
    lane = F.when(F.col("batch_priority") >= 2, 0).when(F.col("batch_priority") == 1, 1).otherwise(2)
    return batches.withColumn("lane", lane).orderBy("page_id", "lane", by)


def batches_of(batched: DataFrame) -> DataFrame:
    """One row for each batch."""
    keys = ["page_id", "batch_id", "batch_type", "batch_priority", "chars", "effective", "duration_ms"]
    return batched.groupBy(*keys).agg(F.count("*").alias("items"))


def batch_statistics(batched: DataFrame) -> DataFrame:
    """Items, batches, mean size and efficiency (batches of 9000 items that would do, over batches) of each page."""
    per = batches_of(batched).groupBy("page_id").agg(F.sum("items").alias("items"), F.count("*").alias("batches"), F.sum("chars").alias("chars"))
    return per.select("*", (F.col("items") / F.col("batches")).alias("mean_items"), (F.ceil(F.col("items") / 9000) / F.col("batches")).alias("efficiency"))
