"""Text collection: nodes to items, filtering, dedup, order, groups and counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions import text as tf
from foliomill.sources.pages import attribute

# Elements whose content isn't collected, and attributes that are.
SKIP_ELEMENTS = [
    "script",
    "style",
    "code",
    "pre",
    "noscript",
    "meta",
    "link",
    "head",
    "svg",
    "math",
    "canvas",
    "video",
    "audio",
    "embed",
    "object",
    "iframe",
    "map",
    "area",
    "base",
    "br",
    "hr",
    "img",
    "input",
    "source",
    "track",
    "wbr",
]
ATTRIBUTES = ["title", "alt", "placeholder", "aria-label", "aria-description"]
MAX_DEPTH = 50
MIN_BYTES = 2


def semantic_type(attr: Column, parent: Column) -> Column:
    """The type an item has by its attribute or by the element around it."""
    by_attr = F.when(attr == "title", "Tooltip").when(attr == "alt", "ImageAlt").when(attr.isin("aria-label", "aria-description"), "Tooltip").when(attr == "placeholder", "FormLabel")
    by_parent = F.when(parent.rlike(r"^(title|h[1-6])\z"), "Title").when(parent.isin("button", "input"), "Button").when(parent == "a", "Link").when(parent == "label", "FormLabel").otherwise("Content")
    return F.when(attr.isNotNull(), by_attr.otherwise(F.concat(F.lit("Attribute:"), attr))).otherwise(by_parent)


def collected_type(attr: Column) -> Column:
    """The type as collection assigns it: content, or attribute with its name."""
    return F.when(attr.isNull(), "Content").otherwise(F.concat(F.lit("Attribute:"), attr))


def collect_items(nodes: DataFrame, attributes: Sequence[str] = ATTRIBUTES, skip: Sequence[str] = SKIP_ELEMENTS, max_depth: int = MAX_DEPTH, skipped_attributes: bool = True) -> DataFrame:
    """Items of texts and attributes that should be translated: page_id, ord, text, attr_name, text_type, semantic_type, priority, depth, parent_tag.

    Nothing inside a skipped element is collected.  Its own attributes are,
    unless ``skipped_attributes`` is off.  One narrow pass over the nodes.
    """
    outside = nodes.where((F.col("depth") <= max_depth) & ~F.exists("path", lambda t: t.isin(*skip)))
    wanted = F.array(*[F.struct(F.lit(a).alias("attr_name"), attribute(F.col("attrs"), a).alias("text"), F.lit(i).alias("k")) for i, a in enumerate(attributes)])
    own = (F.col("kind") == "element") & (F.lit(skipped_attributes) | ~F.col("tag").isin(*skip))
    texts = F.array(F.struct(F.lit(None).cast("string").alias("attr_name"), F.col("text").alias("text"), F.lit(0).alias("k")))
    items = F.when(F.col("kind") == "text", texts).when(own & (F.size("attrs") > 0), wanted)
    parent = F.try_element_at("path", F.lit(-1))
    rows = outside.select("page_id", "node_id", "depth", parent.alias("parent_tag"), F.explode(items).alias("i")).select("*", "i.*").drop("i")
    rows = rows.where(F.col("text").isNotNull() & tf.should_translate(F.col("text")))
    kind = collected_type(F.col("attr_name"))
    return rows.select(
        "page_id",
        (F.col("node_id") * (len(attributes) + 1) + F.col("k")).cast("long").alias("ord"),
        "node_id",
        "text",
        "attr_name",
        kind.alias("text_type"),
        semantic_type(F.col("attr_name"), F.col("parent_tag")).alias("semantic_type"),
        tf.priority(kind, F.col("text")).alias("priority"),
        "depth",
        "parent_tag",
    )


def deduplicate(items: DataFrame, scope: str = "page_id") -> DataFrame:
    """One item for each text and type of a page: the one of highest priority, the first of equals.

    Aggregates before the shuffle, so a line repeated in a page costs one row.
    """
    rest = [c for c in items.columns if c not in (scope, "text", "text_type")]
    first = F.min_by(F.struct(*rest), F.struct((-F.col("priority")).alias("rank"), "ord"))
    best = items.groupBy(scope, "text", "text_type").agg(first.alias("_first"))
    return best.select(scope, "text", "text_type", "_first.*").select(*items.columns)


def sort_keys() -> list[Column]:
    """Priority falling, then characters, then depth, then place."""
    return [F.desc("priority"), F.asc(F.char_length("text")), F.asc("depth"), F.asc("ord")]


def ranked(items: DataFrame, scope: str = "page_id") -> DataFrame:
    """With ``rank``, the place of an item in its page's order (from 1)."""
    return items.withColumn("rank", F.row_number().over(Window.partitionBy(scope).orderBy(*sort_keys())))


def filter_and_sort(items: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    return ranked(deduplicate(items.where(F.octet_length("text") >= min_bytes)))


def grouped_by(items: DataFrame, key: str) -> DataFrame:
    """The texts of each page and type or priority, in order."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    return items.groupBy("page_id", key).agg(texts.alias("texts"))


def of_type(items: DataFrame, kind: str) -> DataFrame:
    return items.where(F.col("text_type") == kind)


def of_high_priority(items: DataFrame) -> DataFrame:
    return items.where(F.col("priority") >= 2)


def filtered(texts: DataFrame, column: str = "text", rules: Sequence[Callable[[Column], Column]] = ()) -> DataFrame:
    """The rows whose text should be translated and passes every further rule."""
    passed = reduce(lambda a, rule: a & rule(F.col(column)), rules, F.lit(True))
    return texts.where(F.when(tf.should_translate(F.col(column)), passed).otherwise(False))


def filter_statistics(texts: DataFrame, column: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """Rows, bytes and kept rows for each reason (null where a text is kept or no rule names one)."""
    keep = tf.should_translate(F.col(column))
    reason = F.when(~keep, tf.filter_reason(F.col(column)))
    counted = texts.groupBy(*by, reason.alias("reason"))
    return counted.agg(F.count("*").alias("n"), F.sum(F.octet_length(column).cast("long")).alias("n_bytes"), F.count_if(keep).alias("kept"))


def kept_rate(texts: DataFrame, column: str = "text") -> DataFrame:
    keep = tf.should_translate(F.col(column))
    rate = F.coalesce(F.try_divide(F.count_if(keep).cast("double"), F.count("*")), F.lit(0.0))
    return texts.agg(F.count("*").alias("total"), F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"), rate.alias("rate"))


def collection_statistics(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """For each page: nodes, texts, items, distinct items, and the rates between them."""
    seen = nodes.groupBy("page_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("kind") == "text").alias("texts"))
    got = items.groupBy("page_id").agg(F.count("*").alias("items"), F.count_distinct("text", "text_type").alias("distinct_items"))
    out = seen.join(got, "page_id", "left").fillna(0, ["items", "distinct_items"])
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return out.select("*", rate("items", "texts").alias("translatability_rate"), (F.lit(1.0) - rate("distinct_items", "items")).alias("dedup_rate"))


def post_processed(items: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The items after each of the user's steps, in the order they were registered."""
    return reduce(lambda frame, step: frame.transform(step), steps, items)
