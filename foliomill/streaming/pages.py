"""Streams of pages and of cache entries, with the operators of the batch side."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliomill.operators.collect import collect_items
from foliomill.sources.pages import page_nodes

PAGES = "page_id bigint, url string, html string"
HIT = T.StructType([T.StructField("text", T.StringType()), T.StructField("translated", T.StringType()), T.StructField("hits", T.LongType())])
STATE = T.StructType([T.StructField("translated", T.StringType()), T.StructField("hits", T.LongType())])


def page_stream(spark: SparkSession, folder: str, files_at_once: int = 16) -> DataFrame:
    """Pages as Parquet files of them arrive in a folder."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def item_stream(pages: DataFrame) -> DataFrame:
    """The items of arriving pages; every page by itself, so no state is kept."""
    return collect_items(page_nodes(pages))


def counts_by_window(items: DataFrame, at: str = "at", delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Items by tumbling window and priority; rows later than the delay are left out."""
    return items.withWatermark(at, delay).groupBy(F.window(at, width), "priority").agg(F.count("*").alias("n"))


def cached_translations(requests: DataFrame, ttl_ms: int = 3_600_000) -> DataFrame:
    """Requests (text, translated) against a cache kept as state for each text.

    A text's first translation is kept for the time to live and then
    forgotten, as a sweep of the batch cache forgets it.
    """

    def update(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known, hits = state.get if state.exists else (None, 0)
        for frame in rows:
            offered = [t for t in frame["translated"] if t]
            hits += len(frame) if known else max(0, len(frame) - 1)
            known = known or (offered[0] if offered else None)
        state.update((known, hits))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"text": [key[0]], "translated": [known], "hits": [hits]})

    return requests.groupBy("text").applyInPandasWithState(update, HIT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
