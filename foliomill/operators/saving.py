"""Saving pages: references, the lookup of assets, and self-contained documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill import __version__
from foliomill.functions import url as uf
from foliomill.functions.rewrite import MHTML_FOOT, MHTML_HEAD, Asset, Options, save_page, with_options
from foliomill.plans.scratch import Scratch
from foliomill.sources.rows import each_row, written

SAVED = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("asked", T.ArrayType(T.StructType([T.StructField("url_key", T.StringType()), T.StructField("kind", T.StringType())]))),
        T.StructField("error", T.StringType()),
    ]
)
#: How often what assets refer to is looked up in its turn.
ROUNDS = 3


def _save(options: Options):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        for r in each_row(batches):
            known = {a["url_key"]: Asset(a["bytes"], a["final_url"] or a["url_key"], a["media_type"] or "", a["charset"] or "") for a in r["assets"] or []}
            try:
                html, title, asked = save_page(r["html"] or "", r["url"], with_options(options, dict(r.get("options") or {})), known)
                row, size = (html, title, list(asked.items()), None), len(html) + sum(map(len, asked))
            except (ValueError, KeyError, AttributeError) as error:
                row, size = (None, None, [], f"{type(error).__name__}: {error}"[:300]), 0
            yield (r["page_id"], r["url"], *row), size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        return written(rows(batches), to_arrow_schema(SAVED))

    return run


def _rewritten(pages: DataFrame, options: Options) -> DataFrame:
    return pages.select("page_id", "url", "html", "assets", *_own_options(pages)).mapInArrow(_save(options), SAVED)


def _own_options(pages: DataFrame) -> list[str]:
    return ["options"] if "options" in pages.columns else []


def references(pages: DataFrame, options: Options = Options()) -> DataFrame:
    """(page_id, url_key, kind) of what pages refer to directly, without fragments."""
    none = pages.withColumn("assets", F.lit(None).cast("array<struct<url_key:string,final_url:string,bytes:binary,media_type:string,charset:string>>"))
    return _rewritten(none, options).select("page_id", F.inline("asked"))


def looked_up(refs: DataFrame, assets: DataFrame, domains: DataFrame | None = None, deny: bool = False) -> DataFrame:
    """References with their assets, nulls where there are none.

    Domain patterns (column ``pattern``) allow, or deny, before the lookup.
    Of several assets of one URL the one of the least final URL is taken, and
    of those the one of the least digest.
    """
    wanted = refs
    if domains is not None:
        wanted = refs.join(_within(refs, domains), "url_key", "left_anti" if deny else "left_semi")
    rest = [c for c in assets.columns if c != "url_key"]
    order = F.struct(F.coalesce("final_url", "url_key"), F.sha2("bytes", 256))
    one = assets.groupBy("url_key").agg(F.min_by(F.struct(*rest), order).alias("a")).select("url_key", "a.*")
    return wanted.join(one, "url_key", "left")


def _within(refs: DataFrame, domains: DataFrame) -> DataFrame:
    """The URLs whose host lies within a pattern: a join on the ends of hosts."""
    listed = domains.select("pattern").where("pattern <> ''").distinct().withColumn("end", uf.bare_pattern(F.col("pattern")))
    urls = refs.select("url_key").distinct().withColumn("host", uf.host(F.col("url_key")))
    met = urls.withColumn("end", F.explode(uf.domain_suffixes(F.col("host")))).join(listed, "end")
    return met.where(uf.within_domain(F.col("host"), F.col("pattern"))).select("url_key").distinct()


#: Assets of up to this many bytes are kept in memory by a cache, larger ones on disk.
MEMORY_BYTES = 10 * 1024


def cached_assets(cache: DataFrame, fetched: DataFrame, memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """The cache after a round of fetching: what came in replaces what was there, under the URL it came from in the end.

    Columns of assets (url_key, final_url, bytes, media_type, charset) and
    ``tier``: where the bytes belong by their size.
    """
    names = ["url_key", "final_url", "bytes", "media_type", "charset"]
    new = fetched.where(F.col("bytes").isNotNull()).withColumn("url_key", F.regexp_replace(F.coalesce("final_url", "url_key"), "#.*", "")).select(*names, F.lit(1).alias("age"))
    both = new.unionByName(cache.select(*names, F.lit(0).alias("age")))
    latest = F.max_by(F.struct(*names[1:]), F.struct("age", F.sha2("bytes", 256))).alias("a")
    kept = both.groupBy("url_key").agg(latest).select("url_key", "a.*")
    return kept.withColumn("tier", F.when(F.octet_length("bytes") <= memory_bytes, "memory").otherwise("disk"))


def kept(spark: SparkSession, frame: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared folder and read back, for results that several actions use."""
    return Scratch(spark, label).table(frame, label)


def saved_pages(spark: SparkSession, pages: DataFrame, assets: DataFrame, options: Options = Options(), domains: DataFrame | None = None, deny: bool = False, rounds: int = ROUNDS) -> DataFrame:
    """(page_id, url, html, title, error): pages with their assets inside.

    pages: page_id, url, html, and perhaps options (a map of texts that changes
    ``options`` for a page; an unknown name is that page's error).  assets: url_key (without fragment), final_url,
    bytes, media_type, charset; filter it before, e.g. by
    ``media.include_resource``.  Sheets and frames refer to more, so the lookup
    is repeated ``rounds`` times with what turned up, and what lies deeper
    stays a reference; each round is a join on the URL and a grouping of a
    page's own assets.  An asset that very many pages ask for makes a skewed
    key, which adaptive execution splits on the side of the references.
    """
    scratch = Scratch(spark, "saving")
    refs = scratch.table(references(pages, options).distinct(), "refs")
    packed = F.collect_list(F.struct("url_key", "final_url", "bytes", "media_type", "charset")).alias("assets")
    for k in range(rounds):
        found = looked_up(refs.select("page_id", "url_key").distinct(), assets, domains, deny).where(F.col("bytes").isNotNull())
        with_assets = pages.select("page_id", "url", "html", *_own_options(pages)).join(found.groupBy("page_id").agg(packed), "page_id", "left")
        out = _rewritten(with_assets, options)
        if k == rounds - 1:
            return out.drop("asked")
        done = scratch.table(out, "saved")
        more = done.select("page_id", F.inline("asked")).distinct()
        if more.select("page_id", "url_key").exceptAll(refs.select("page_id", "url_key")).isEmpty():
            return done.drop("asked")
        refs = scratch.table(more.unionByName(refs).distinct(), "refs")
    return out.drop("asked")


def provenance(url: Column, at: Column | None = None) -> Column:
    """A comment that tells where and when a page was saved, without fragment and credentials."""
    stamp = F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    shown = F.when(url.rlike("^https?:"), uf.referer_url(url)).otherwise("local source")
    return F.concat(F.lit("<!-- Saved from "), shown, F.lit(" at "), stamp, F.lit(f" using foliomill v{__version__} -->"))


def formatted(saved: DataFrame, mhtml: bool = False, metadata: bool = True, at: Column | None = None) -> DataFrame:
    """``content`` (bytes): the page, with its provenance if wanted, as HTML with a last newline or as MHTML."""
    body = F.concat(provenance(F.col("url"), at), F.lit("\n"), F.col("html")) if metadata else F.col("html")
    whole = F.concat(F.lit(MHTML_HEAD), body, F.lit(MHTML_FOOT)) if mhtml else F.when(body.endswith("\n"), body).otherwise(F.concat(body, F.lit("\n")))
    return saved.select("page_id", "url", "title", F.encode(whole, "UTF-8").alias("content"), "error")
