"""Page metadata: natively from regular markup, and from the node table for any markup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.functions import url as uf
from foliomill.functions.media import content_type, is_favicon
from foliomill.sources.pages import attribute

_ANCHOR = r'(?s)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'


def page_catalog(pages: DataFrame) -> DataFrame:
    """Title, language, charset and counts by patterns over the markup; columns only, so filters reach the scan."""
    html = F.col("html")
    return pages.select(
        "page_id",
        uf.host(F.col("url")).alias("domain"),
        F.nullif(F.regexp_extract(html, r"(?s)<title[^>]*>(.+?)</title>", 1), F.lit("")).alias("title"),
        F.nullif(F.regexp_extract(html, r'<html[^>]*\blang="([^"]*)"', 1), F.lit("")).alias("lang"),
        F.nullif(F.regexp_extract(html, r'<meta[^>]*\bcharset="([^"]*)"', 1), F.lit("")).alias("charset"),
        F.regexp_count(html, F.lit(r"<a\s")).cast("long").alias("n_anchors"),
        F.regexp_count(html, F.lit(r"<p[\s>]")).cast("long").alias("n_paragraphs"),
        F.octet_length(html).cast("long").alias("n_bytes"),
    )


def page_anchors(pages: DataFrame) -> DataFrame:
    """One row for each anchor: page_id, ord, href, label."""
    found = F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("ord", "whole"))
    return rows.select("page_id", "ord", F.regexp_extract("whole", _ANCHOR, 1).alias("href"), F.regexp_extract("whole", _ANCHOR, 2).alias("label"))


def absolute_anchors(anchors: DataFrame, pages: DataFrame) -> DataFrame:
    """Anchors with the link as a browser sees it and its path on a proxy; skipped links stay as they are."""
    rows = anchors.join(pages.select("page_id", "url"), "page_id")
    keep = uf.skips_link(F.col("href"))
    absolute = F.when(keep, F.col("href")).otherwise(uf.resolve_url("url", "href"))
    return rows.withColumn("absolute", absolute).withColumn("proxied", F.when(~keep, uf.proxy_link(F.col("absolute"))))


def node_metadata(nodes: DataFrame) -> DataFrame:
    """For each page by its tree: title, charset, base, robots and whether it has an icon.  First ones win."""
    in_head = F.array_contains("path", "head")
    meta = (F.col("tag") == "meta") & in_head
    typed = attribute(F.col("attrs"), "http-equiv")
    charset = F.coalesce(attribute(F.col("attrs"), "charset"), F.when(F.lower(typed) == "content-type", content_type(attribute(F.col("attrs"), "content"))["charset"]))
    title = (F.col("kind") == "text") & in_head & (F.try_element_at("path", F.lit(-1)) == "title") & (F.col("text") != "")
    robots = meta & (F.lower(attribute(F.col("attrs"), "name")) == "robots")
    icon = (F.col("tag") == "link") & in_head & is_favicon(F.trim(F.coalesce(attribute(F.col("attrs"), "rel"), F.lit(""))))
    first = lambda value, when: F.min_by(value, F.when(when, F.col("node_id")))
    return nodes.groupBy("page_id").agg(
        first(F.col("text"), title).alias("title"),
        first(charset, meta & charset.isNotNull()).alias("charset"),
        first(attribute(F.col("attrs"), "href"), (F.col("tag") == "base") & in_head).alias("base_url"),
        first(attribute(F.col("attrs"), "content"), robots).alias("robots"),
        F.coalesce(F.bool_or(icon), F.lit(False)).alias("has_favicon"),
    )


def descendants(nodes: DataFrame, *steps: str) -> DataFrame:
    """Elements reached by a path of descendant steps, by the names around them."""
    found = F.col("tag") == steps[-1]
    place = F.lit(0)
    for step in steps[:-1]:
        rest = F.slice("path", place + 1, F.greatest(F.size("path") - place, F.lit(0)))
        at = F.array_position(rest, step).cast("int")
        found = found & (at > 0)
        place = place + at
    return nodes.where(found)


def host_statistics(pages: DataFrame) -> DataFrame:
    per = page_catalog(pages)
    return per.groupBy("domain").agg(F.count("*").alias("pages"), F.sum("n_bytes").alias("bytes"), F.sum("n_anchors").alias("anchors"))
