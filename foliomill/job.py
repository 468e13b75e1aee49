"""Saving as a job: targets and options in, one file for each page out.

    python -m foliomill.job --targets targets.txt --assets assets.parquet --output '/out/%title%.%extension%' --no-js
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator, Sequence
from dataclasses import fields

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions.encoding import decoded_page, encoded_page, encoding_error
from foliomill.functions.media import output_path
from foliomill.functions.rewrite import Options
from foliomill.operators import saving
from foliomill.session import configure, ship
from foliomill.sources.pages import piped_document, scan_documents

SWITCHES = [f.name for f in fields(Options) if f.type == "bool"]


def saved_targets(spark: SparkSession, targets: DataFrame, assets: DataFrame, files: DataFrame, options: Options = Options(), template: str = "%title%.%extension%", at: Column | None = None) -> DataFrame:
    """(target, path, content, error) of each target.

    ``targets`` has a column target; ``assets`` what was fetched (also the
    documents themselves); ``files`` (path, content) local documents.  MHTML
    never has scripts.  A target that can't be read, or an output encoding that
    isn't known, is an error on its row.
    """
    from dataclasses import replace

    options = replace(options, no_js=options.no_js or options.mhtml)
    fetched = assets.select(F.col("url_key").alias("url"), "bytes", "media_type")
    found = scan_documents(targets.select("target").distinct(), fetched, files)
    charset = found.join(assets.select(F.col("url_key").alias("target"), "charset"), "target", "left")
    page = decoded_page("html", F.nullif("charset", F.lit("")))
    pages = charset.select(F.xxhash64("target").alias("page_id"), F.col("target").alias("url"), F.when(F.col("error").isNull(), page["text"]).alias("html"), F.col("error").alias("failure"))
    saved = saving.formatted(saving.saved_pages(spark, pages.where("failure is null"), assets, options), options.mhtml, not options.no_metadata, at)
    out = output_path(F.lit(template), F.col("title"), F.lit(options.mhtml), at)
    content = F.col("content")
    if options.encoding:
        wrong = encoding_error(F.lit(options.encoding))
        content = F.when(wrong.isNull(), encoded_page(F.decode("content", "UTF-8"), F.lit(options.encoding)))
        saved = saved.withColumn("error", F.coalesce("error", wrong))
    done = saved.select(F.col("url").alias("target"), F.when(F.col("error").isNull(), out).alias("path"), content.alias("content"), "error")
    none = F.lit(None)
    return done.unionByName(pages.where("failure is not null").select(F.col("url").alias("target"), none.cast("string").alias("path"), none.cast("binary").alias("content"), F.col("failure").alias("error")))


def write_files(saved: DataFrame, folder: str) -> DataFrame:
    """Write each content below a folder that every executor can reach; (target, path, bytes) of what was written.

    Nothing happens before an action.  A repeated task writes the same files
    again; two pages of one path leave the last one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                whole = f"{root}/{path.lstrip('/')}"
                system.create_dir(whole.rpartition("/")[0], recursive=True)
                with system.open_output_stream(whole) as out:
                    out.write(content)
            sizes = pa.array([len(c) for c in batch.column("content").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("target"), batch.column("path"), sizes], ["target", "path", "bytes"])

    return saved.where("path is not null and content is not null").select("target", "path", "content").mapInArrow(run, "target string, path string, bytes bigint")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="foliomill", description="Save pages as self-contained documents.")
    out.add_argument("--targets", required=True, help="a text file with one target in a line; - is standard input")
    out.add_argument("--assets", required=True, help="Parquet of url_key, final_url, bytes, media_type, charset")
    out.add_argument("--files", help="a folder of local documents")
    out.add_argument("--folder", required=True, help="where to write, on storage that all executors share")
    out.add_argument("--output", default="%title%.%extension%", help="template of the path below the folder")
    out.add_argument("--base-url")
    out.add_argument("--encoding")
    for name in SWITCHES:
        out.add_argument("--" + name.replace("_", "-"), action="store_true")
    return out


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if every target was saved, 1 if any wasn't; errors go to stderr."""
    given = parser().parse_args(arguments)
    spark = ship(configure(spark or SparkSession.builder.appName("foliomill").getOrCreate()))
    options = Options(**{n: getattr(given, n) for n in SWITCHES}, base_url=given.base_url, encoding=given.encoding)
    targets = spark.read.text(given.targets).select(F.trim("value").alias("target")).where("target <> ''")
    files = spark.createDataFrame([], "path string, content binary")
    if given.files:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(given.files).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
    if not targets.where("target = '-'").isEmpty():
        files = files.unionByName(piped_document(spark))
    saved = saving.kept(spark, saved_targets(spark, targets, spark.read.parquet(given.assets), files, options, given.output), "job")
    written = write_files(saved, given.folder).count()
    failed = saved.where("error is not null").select("target", "error")
    for row in failed.limit(100).collect():
        print(f"{row['target']}: {row['error']}", file=sys.stderr)
    return 0 if written and failed.isEmpty() else 1


if __name__ == "__main__":
    sys.exit(main())
