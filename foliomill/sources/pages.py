"""Pages as tables: documents by target, and the nodes of their trees."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.functions.html import Node, parse_html
from foliomill.functions.media import is_plaintext
from foliomill.functions.url import parse_data_url
from foliomill.sources.rows import each_row, written

ATTRIBUTE = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])
NODES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("node_id", T.IntegerType()),
        T.StructField("parent_id", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("path", T.ArrayType(T.StringType())),
        T.StructField("attrs", T.ArrayType(ATTRIBUTE)),
        T.StructField("text", T.StringType()),
    ]
)
#: Names that a path holds at most.  A deeper node has those of the outermost elements and, last, its parent's.
PATH_NAMES = 128


def page_nodes(pages: DataFrame, key: str = "page_id", html: str = "html", closed_references: bool = False) -> DataFrame:
    """One row for each node of each page, in document order: node_id counts from 0 at the document.

    ``path`` names the elements around a node from the outside in; below
    ``PATH_NAMES`` elements it leaves out those between the outermost ones and
    the parent, so that a page costs no more than its nodes however deep it
    is nested.  The pages are parsed where they are read; nothing is shuffled.
    A null page is the empty document.  ``closed_references`` is for
    ``parse_html``.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        for page, text in map(dict.values, each_row(batches)):
            document = parse_html(text or "", closed_references)
            stack: list[tuple[Node, int, int | None, list[str]]] = [(document, 0, None, [])]
            i = 0
            while stack:
                n, depth, up, path = stack.pop()
                own = n.text if n.kind != "element" else None
                yield (page, i, up, depth, n.kind, n.tag or None, path, n.attrs, own), len(n.text) + sum(len(v) for _, v in n.attrs)
                if n.children:
                    inside = path[: PATH_NAMES - 1] + [n.tag] if n.kind == "element" else path
                    stack.extend((c, depth + 1, i, inside) for c in reversed(n.children))
                i += 1
            document.release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        return written(rows(batches), to_arrow_schema(NODES))

    return pages.select(F.col(key).cast("long"), F.col(html).cast("string")).mapInArrow(run, NODES)


def attribute(attrs: Column, name: str) -> Column:
    """The value of the first attribute of that name."""
    return F.try_element_at(F.filter(attrs, lambda a: a["name"] == name), F.lit(1))["value"]


def piped_document(spark: SparkSession, stream: BinaryIO | None = None) -> DataFrame:
    """One row (path ``-``, content) of what standard input holds, for ``scan_documents``; what came before an error stays."""
    source, parts = stream or sys.stdin.buffer, []
    try:
        while part := source.read(1 << 20):
            parts.append(part)
    except OSError:
        pass
    return spark.createDataFrame([("-", b"".join(parts))], "path string, content binary")


def scan_documents(targets: DataFrame, fetched: DataFrame, files: DataFrame) -> DataFrame:
    """target, html and error for each row of ``targets`` (a column ``target``).

    ``data:`` targets are decoded and must be text/html; http(s) ones are
    looked up in ``fetched`` (url, bytes, media_type) and must be plain text;
    anything else is a path looked up in ``files`` (path, content), as the
    binaryFile source gives them.  Failures are values of ``error``.
    """
    parsed = targets.withColumn("d", parse_data_url("target"))
    web = fetched.select(F.col("url").alias("target"), F.col("bytes").alias("web"), F.col("media_type").alias("web_type"))
    local = files.select(F.col("path").alias("target"), F.col("content").alias("local"))
    joined = parsed.join(web, "target", "left").join(local, "target", "left")
    is_data, is_web = F.col("target").startswith("data:"), F.col("target").rlike("^https?://")
    error = (
        F.when(is_data & (F.col("d.media_type") != "text/html"), "unsupported data URL media type")
        .when(is_web & F.col("web").isNull(), "could not retrieve target document")
        .when(is_web & ~is_plaintext(F.col("web_type")), "unsupported document media type")
        .when(~is_data & ~is_web & F.col("local").isNull(), "file not found")
    )
    content = F.when(is_data, F.col("d.data")).when(is_web, F.col("web")).otherwise(F.col("local"))
    return joined.select("target", F.when(error.isNull(), content).alias("html"), error.alias("error"))
