"""Framing batches for a translator, reading its answers, caches, errors and health."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.functions.html import parse_html, serialize
from foliomill.functions.text import trimmed
from foliomill.operators import collect
from foliomill.operators.batching import BatchConfig, create_batches
from foliomill.plans.scratch import Scratch
from foliomill.sources.pages import page_nodes
from foliomill.sources.rows import each_row, written

SUCCESS_SHARE = 0.8


def framed(items: DataFrame, key: str = "batch_id") -> DataFrame:
    """One request text for each batch: lines ``[i] text`` in order, i from 0."""
    ordered = F.array_sort(F.collect_list(F.struct("place", trimmed(F.col("text")).alias("text"))))
    lines = F.transform(ordered, lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), x["text"]))
    return items.groupBy(key).agg(F.array_join(lines, "\n").alias("request"), F.count("*").alias("n_items"))


def read_answers(responses: DataFrame, key: str = "batch_id") -> DataFrame:
    """(key, place, translated) of the numbered lines of an answer; empty ones dropped, the last of a number wins."""
    lines = responses.select(key, F.posexplode(F.split("response", "\n")).alias("line_no", "line"))
    line = trimmed(F.col("line"))
    number = F.regexp_extract(line, r"^\[(\d+)\]\s*(.*)$", 1)
    text = trimmed(F.regexp_extract(line, r"^\[(\d+)\]\s*(.*)$", 2))
    found = lines.select(key, "line_no", number.try_cast("int").alias("place"), text.alias("translated")).where("place is not null and translated <> ''")
    return found.groupBy(key, "place").agg(F.max_by("translated", "line_no").alias("translated"))


def joined_back(items: DataFrame, answers: DataFrame, key: str = "batch_id") -> DataFrame:
    """Items with their translations, null where an answer lacks the number."""
    return items.join(answers, [key, "place"], "left")


def judged(joined: DataFrame, key: str = "batch_id") -> DataFrame:
    """For each batch whether enough of its items were matched; matches count even where it fails."""
    matched = F.count("translated")
    return joined.groupBy(key).agg(F.count("*").alias("n_items"), matched.alias("n_matched"), (matched / F.count("*") >= SUCCESS_SHARE).alias("success"))


def strategy(batch_type: Column, items: Column, small: int = 2) -> Column:
    """How a batch is sent: its one item, item by item where it is a small one, or as numbered lines."""
    return F.when(batch_type == "Single", "single").when((batch_type == "Small") & (items <= small), "individual").otherwise("indexed")


def unmatched(joined: DataFrame, verdicts: DataFrame, key: str = "batch_id") -> DataFrame:
    """The items of failed batches that have no translation and are sent one by one."""
    return joined.where("translated is null").join(verdicts.where("not success").select(key), key, "left_semi")


def processor_statistics(verdicts: DataFrame) -> DataFrame:
    """Batches, those that went well, items, and the shares of batches and of indexed ones that went well (0 without any).

    verdicts: how (a strategy), success, n_matched.  A single item isn't counted among the items.
    """
    share = lambda part, whole: F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))
    done, indexed = F.count_if("success"), F.col("how") == "indexed"
    return verdicts.agg(
        F.count("*").alias("batches"),
        done.alias("successful"),
        F.coalesce(F.sum(F.when(F.col("how") != "single", F.col("n_matched"))), F.lit(0)).cast("long").alias("items"),
        share(done, F.count("*")).alias("success_rate"),
        share(F.count_if(indexed & F.col("success")), F.count_if(indexed)).alias("indexed_success_rate"),
    )


class ServiceCounters:
    """Counts of what passes through a stream of frames, taken while other actions run, with no pass of their own.

    ``counted`` names measures of a frame; once an action has run over it,
    ``snapshot`` holds their sums over all frames since the last ``reset``.
    """

    def __init__(self) -> None:
        self._seen: list[tuple[Observation, list[str]]] = []

    def counted(self, frame: DataFrame, **measures: Column) -> DataFrame:
        seen = Observation()
        self._seen.append((seen, list(measures)))
        return frame.observe(seen, *[F.coalesce(m, F.lit(0)).cast("long").alias(k) for k, m in measures.items()])

    def snapshot(self) -> dict[str, int]:
        """Sums by name; waits for the action over each counted frame."""
        out: dict[str, int] = {}
        for seen, names in self._seen:
            got = seen.get
            for name in names:
                out[name] = out.get(name, 0) + int(got.get(name) or 0)
        return out

    def reset(self) -> None:
        self._seen = []


def translated_or_original(translated: Column, original: Column) -> Column:
    return F.coalesce(F.when(translated != "", translated), original)


# Caches: text, translated, source_lang, target_lang, created_at, last_accessed, access_count.


def cache_key(source: Column, target: Column, text: Column) -> Column:
    return F.concat_ws(":", source, target, text)


def cache_lookup(items: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int = 3600, by_language: bool = False) -> DataFrame:
    """Items with ``translated`` and ``hit``; entries older than the time to live are misses.

    ``by_language`` joins on languages too, which plain lookups leave out.
    """
    keys = ["text", "source_lang", "target_lang"] if by_language else ["text"]
    live = cache.where(F.col("created_at") + F.make_dt_interval(secs=F.lit(ttl_seconds)) >= now)
    newest = live.groupBy(*keys).agg(F.max_by("translated", "created_at").alias("translated"))
    return items.join(newest, keys, "left").withColumn("hit", F.col("translated").isNotNull())


def cache_sweep(cache: DataFrame, now: Column, ttl_seconds: int = 3600) -> DataFrame:
    return cache.where(F.col("created_at") + F.make_dt_interval(secs=F.lit(ttl_seconds)) >= now)


def cache_upsert(cache: DataFrame, entries: DataFrame, capacity: int) -> DataFrame:
    """The newest entry of each text, and of those the ``capacity`` last used.

    A top-k on the order of use keeps a bounded number of rows for each task.
    """
    both = cache.unionByName(entries)
    rest = [c for c in both.columns if c != "text"]
    newest = both.groupBy("text").agg(F.max_by(F.struct(*rest), F.struct("last_accessed", "created_at")).alias("e")).select("text", "e.*")
    return newest.orderBy(F.desc("last_accessed"), "text").limit(capacity).select(*cache.columns)


def cache_statistics(looked_up: DataFrame) -> DataFrame:
    hits = F.count_if("hit")
    rate = F.coalesce(F.try_divide(hits.cast("double"), F.count("*")), F.lit(0.0))
    return looked_up.agg(F.count("*").alias("lookups"), hits.alias("hits"), (F.count("*") - hits).alias("misses"), rate.alias("hit_rate"), (F.lit(1.0) - rate).alias("miss_rate"))


# Kind of error, whether to retry, severity, category.
ERRORS = [
    ("ConfigError", False, "Critical", "Configuration"),
    ("NetworkError", True, "Warning", "Network"),
    ("RateLimitExceeded", False, "Warning", "RateLimit"),
    ("InvalidInput", False, "Info", "Input"),
    ("CacheError", True, "Warning", "Cache"),
    ("BatchProcessingError", True, "Error", "Processing"),
    ("TextCollectionError", False, "Error", "Processing"),
    ("TranslationServiceError", True, "Error", "Service"),
    ("TimeoutError", True, "Warning", "Timeout"),
    ("ParseError", False, "Error", "Parsing"),
    ("SerializationError", False, "Error", "Serialization"),
    ("ConcurrencyError", True, "Warning", "Concurrency"),
    ("ResourceExhausted", True, "Warning", "Resource"),
    ("ProcessingError", True, "Error", "Processing"),
    ("InternalError", False, "Critical", "Internal"),
]


def error_kinds(spark: SparkSession) -> DataFrame:
    """The fixed table of 15 kinds; small enough to send to every task."""
    return spark.createDataFrame(ERRORS, "kind string, retryable boolean, severity string, category string")


def classified(errors: DataFrame, kinds: DataFrame) -> DataFrame:
    return errors.join(F.broadcast(kinds), "kind", "left")


def error_statistics(errors: DataFrame) -> DataFrame:
    """Counts by category, by severity and in all, from one pass."""
    counted = errors.groupingSets([[F.col("category")], [F.col("severity")], []], "category", "severity")
    return counted.agg(F.count("*").alias("n"), F.count_if("retryable").alias("retryable"), F.count_if(F.col("severity") == "Critical").alias("critical"))


def health(components: DataFrame) -> DataFrame:
    """Healthy if all are, unhealthy if any is, else degraded."""
    status = F.col("status")
    rolled = F.when(F.bool_and(status == "Healthy"), "Healthy").when(F.bool_or(status == "Unhealthy"), "Unhealthy").otherwise("Degraded")
    return components.agg(rolled.alias("health"), F.count("*").alias("components"))


def retried(attempts: DataFrame, max_retries: int = 3) -> DataFrame:
    """For each batch the attempt that ended it: the first success or the last of those allowed, with its wait in seconds.

    attempts: batch_id, attempt (from 0), ok.
    """
    allowed = attempts.where(F.col("attempt") <= max_retries)
    order = Window.partitionBy("batch_id").orderBy(F.desc(F.col("ok").cast("int")), F.when(F.col("ok"), F.col("attempt")).otherwise(-F.col("attempt")))
    return allowed.withColumn("n", F.row_number().over(order)).where("n = 1").select("batch_id", "attempt", "ok", (F.pow(F.lit(2.0), F.col("attempt")) - 1).cast("long").alias("waited_seconds"))


def translate_pages(spark: SparkSession, pages: DataFrame, translator: Callable[[Column], Column], config: BatchConfig = BatchConfig(), everywhere: bool = True, closed_references: bool = False) -> DataFrame:
    """(page_id, html, n_items, n_translated): pages with their texts and attributes translated.

    Collects, deduplicates, packs, and asks ``translator`` (a function of a
    request column) in the way each batch calls for: numbered lines in and
    numbered lines out for most, the plain text for a single item or the items
    of a small batch, and again plain text by text where an answer of numbered
    lines lacks too many.  The translations are written into the trees.
    ``everywhere``: equal items of a page are all translated, not the first
    alone.  ``closed_references`` is for ``parse_html``.
    """
    scratch = Scratch(spark, "translation")
    items = scratch.table(collect.collect_items(page_nodes(pages, closed_references=closed_references)), "items")
    ranked = collect.filter_and_sort(items)
    batched = create_batches(ranked, config)
    how = strategy(F.col("batch_type"), F.col("n_items"), config.small).alias("how")
    plan = batched.groupBy("page_id", "batch_id").agg(F.first("batch_type").alias("batch_type"), F.count("*").alias("n_items")).select("page_id", "batch_id", how)
    keyed = batched.select("page_id", "batch_id", "place", "ord").join(plan, ["page_id", "batch_id"]).join(ranked.select("page_id", "ord", "text", "text_type"), ["page_id", "ord"])
    keyed = scratch.table(keyed.withColumn("key", F.struct("page_id", "batch_id")), "batches")
    together = keyed.where("how = 'indexed'")
    answers = read_answers(framed(together, "key").select("key", translator(F.col("request")).alias("response")), "key")
    joined = scratch.table(joined_back(together, answers, "key"), "joined")
    failed = unmatched(joined, judged(joined, "key"), "key")
    single = keyed.where("how <> 'indexed'").unionByName(failed.select(keyed.columns))
    again = single.select("page_id", "ord", "text", "text_type", F.nullif(trimmed(translator(trimmed(F.col("text")))), F.lit("")).alias("translated"))
    done = joined.select(again.columns).unionByName(again).where("translated is not null")
    same = ["page_id", "text", "text_type"] if everywhere else ["page_id", "ord"]
    placed = items.join(done.select(*same, "translated"), same).select("page_id", "node_id", "attr_name", "translated")
    per_page = placed.groupBy("page_id").agg(F.collect_list(F.struct("node_id", "attr_name", "translated")).alias("changes"))
    counted = items.groupBy("page_id").agg(F.count("*").alias("n_items"))
    rows = pages.select("page_id", "html").join(per_page, "page_id", "left").join(counted, "page_id", "left")
    return rows.select("page_id", "html", F.coalesce("n_items", F.lit(0)).alias("n_items"), "changes").mapInArrow(partial(_apply, closed_references), TRANSLATED)


TRANSLATED = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("html", T.StringType()), T.StructField("n_items", T.LongType()), T.StructField("n_translated", T.LongType())])


def _apply(closed_references: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Write translations into the trees; a node is known by its place in document order."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return written(_applied(batches, closed_references), to_arrow_schema(TRANSLATED))


def _applied(batches: Iterator[pa.RecordBatch], closed_references: bool) -> Iterator[tuple[tuple, int]]:
    for r in each_row(batches):
        changes = r["changes"] or []
        html = r["html"]
        if changes:
            document = parse_html(html or "", closed_references)
            nodes = [n for n, _ in document.walk()]
            for c in changes:
                if c["attr_name"] is None:
                    nodes[c["node_id"]].text = c["translated"]
                else:
                    nodes[c["node_id"]].set(c["attr_name"], c["translated"])
            html = serialize(document)
            del nodes
            document.release()
        yield (r["page_id"], html, r["n_items"], len(changes)), len(html or "")
