"""A library of saved pages: filter, sort, page, count, preview, delete, suggest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions.url import host

SORT_FIELDS = ("url", "title", "domain", "file_size", "created_at", "status")
MOST_PER_PAGE = 100


def records(pages: DataFrame, now: Column, created: Column, target_lang: Column, ttl_days: int = 30) -> DataFrame:
    """Library records of pages: id, url, title, domain, languages, status, size, times, expiry and kind of cache.

    ``created`` and ``target_lang`` are the time and the language that a page
    was saved at and translated to.
    """
    title = F.regexp_extract("html", r"(?s)<title[^>]*>(.*?)</title>", 1)
    expires = created + F.make_dt_interval(days=F.lit(ttl_days))
    complete = F.col("html").rlike(r"</html>\s*$")
    return pages.select(
        F.col("page_id").cast("string").alias("id"),
        "url",
        title.alias("title"),
        host(F.col("url")).alias("domain"),
        F.regexp_extract("html", r'<html[^>]*\blang="([a-z]+)"', 1).alias("source_lang"),
        target_lang.alias("target_lang"),
        F.when(complete, "completed").otherwise("failed").alias("status"),
        F.octet_length("html").cast("long").alias("file_size"),
        created.alias("created_at"),
        created.alias("updated_at"),
        expires.alias("expires_at"),
        (expires < now).alias("is_expired"),
        F.when(F.octet_length("html") > 4096, "disk").otherwise("memory").alias("cache_type"),
    )


@dataclass(frozen=True)
class Search:
    """Optional conditions; None means any."""

    status: str | None = None
    source_lang: str | None = None
    domain: str | None = None
    keyword: str | None = None
    created_from: str | None = None
    created_to: str | None = None
    include_expired: bool = False


def search(library: DataFrame, s: Search) -> DataFrame:
    """The records that meet every given condition; expired ones only if asked for."""
    out = library
    for name in ("status", "source_lang", "domain"):
        if (value := getattr(s, name)) is not None:
            out = out.where(F.col(name) == value)
    if s.keyword is not None:
        word = s.keyword.lower()
        out = out.where(F.lower("title").contains(word) | F.lower("url").contains(word))
    if s.created_from is not None:
        out = out.where(F.col("created_at") >= F.lit(s.created_from).cast("timestamp"))
    if s.created_to is not None:
        out = out.where(F.col("created_at") <= F.lit(s.created_to).cast("timestamp"))
    return out if s.include_expired else out.where(~F.col("is_expired"))


def page_of(library: DataFrame, page: int, size: int, sort: str = "created_at", descending: bool = True) -> DataFrame:
    """One page of the sorted records, with the totals that go with it on every row.

    The sorted part is a top-k of page * size rows; the total is a count that
    is joined as one row.
    """
    if page < 1 or not 1 <= size <= MOST_PER_PAGE or sort not in SORT_FIELDS:
        raise ValueError("page from 1, size 1 to 100, sort by a known field")
    key = F.desc(sort) if descending else F.asc(sort)
    rows = library.orderBy(key, "id").offset((page - 1) * size).limit(size)
    totals = library.agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / size).cast("long").alias("total_pages"))
    totals = totals.withColumn("has_next", F.lit(page) < F.col("total_pages")).withColumn("has_prev", F.lit(page > 1))
    return rows.join(F.broadcast(totals))


def statistics(library: DataFrame) -> DataFrame:
    done = F.count_if(F.col("status") == "completed")
    return library.agg(
        F.count("*").alias("total"),
        done.alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if("is_expired").alias("expired"),
        F.sum("file_size").alias("total_size"),
        F.coalesce(F.try_divide(done.cast("double"), F.count("*")), F.lit(0.0)).alias("success_rate"),
    )


def by_language(library: DataFrame) -> DataFrame:
    return library.groupBy("source_lang").agg(F.count("*").alias("n"), F.sum("file_size").alias("total_size"))


def by_day(library: DataFrame) -> DataFrame:
    return library.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"), F.sum("file_size").alias("total_size"))


def by_domain(library: DataFrame) -> DataFrame:
    """Records, size, latest time and largest record of each domain."""
    return library.groupBy("domain").agg(F.count("*").alias("n"), F.sum("file_size").alias("total_size"), F.max("created_at").alias("latest"), F.max_by("id", F.struct("file_size", "id")).alias("largest_id"))


def top_domains(library: DataFrame, k: int = 10) -> DataFrame:
    return by_domain(library).orderBy(F.desc("n"), "domain").limit(k)


def largest(library: DataFrame, k: int = 10) -> DataFrame:
    return library.select("id", "url", "file_size").orderBy(F.desc("file_size"), "id").limit(k)


def preview(library: DataFrame, text: str = "title", most: int = 40) -> DataFrame:
    return library.select("id", F.substring(text, 1, most).alias("preview"), (F.char_length(text) > most).alias("truncated"))


def delete(library: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left, and what became of every id asked for."""
    asked = ids.select("id").distinct()
    left = library.join(asked, "id", "left_anti")
    there = library.select("id").distinct().withColumn("found", F.lit(True))
    return left, asked.join(there, "id", "left").select("id", F.when(F.col("found"), "deleted").otherwise("not found").alias("outcome"))


def suggestions(library: DataFrame, prefix: str, k: int = 10) -> DataFrame:
    """The words of titles that begin with a prefix, by how many records have them."""
    words = library.select("id", F.explode(F.array_distinct(F.split(F.lower("title"), r"[^\p{L}]+"))).alias("suggestion"))
    found = words.where(F.col("suggestion").startswith(prefix.lower()) & (F.col("suggestion") != ""))
    return found.groupBy("suggestion").agg(F.count("*").alias("match_count")).orderBy(F.desc("match_count"), "suggestion").limit(k)


def export(library: DataFrame, path: str, kind: str = "json") -> None:
    """Write records as JSON lines, CSV with a header, or Parquet; compressed."""
    out = library.write.mode("errorifexists").option("compression", "gzip" if kind != "parquet" else "zstd")
    {"json": out.json, "csv": out.option("header", True).csv, "parquet": out.parquet}[kind](path)


def responses(saved: DataFrame) -> DataFrame:
    """(id, response): the JSON that a caller gets for a page.

    saved: id, url, title, original_html, translated_html, target_lang; a page
    without any original is an error, one without a translation wasn't
    translated.
    """
    done, translated = F.col("original_html").isNotNull(), F.col("translated_html").isNotNull()
    body = F.struct(
        F.when(done, "success").otherwise("error").alias("status"),
        "original_html",
        "translated_html",
        "title",
        "url",
        translated.alias("translate_enabled"),
        F.when(translated, F.col("target_lang")).alias("target_lang"),
    )
    return saved.select("id", F.to_json(body).alias("response"))


def latest_of_domain(library: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` newest records of each domain."""
    order = Window.partitionBy("domain").orderBy(F.desc("created_at"), "id")
    return library.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("domain", "n", "id", "created_at")
