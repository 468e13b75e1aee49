"""Intermediate tables in the shared folder of the cluster.

A plan that is used more than once, or that iterates, is cut by writing it as
Parquet below ``spark.checkpoint.dir``.  Unlike an executor-local checkpoint
the files outlive any executor.  Only a local session (tests) may do without
the setting and takes a folder of the machine; on a cluster that is an error,
as executors could not read each other's files.

Tables go as soon as nothing reads them: operators drop those of past steps,
``scope`` drops what a part of a job has left, and the end of the application
drops the rest.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by the session, or a local one if none is named and all runs on this machine."""
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if not named:
        named = spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="foliomill-")
        spark.conf.set(CHECKPOINT_KEY, named)
    return named.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


#: The folders that were made inside each open scope, the innermost last.
_SCOPES: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, every intermediate table that was made inside; its results must be written elsewhere by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for root in _SCOPES.pop():
            _delete(spark, root)


class Scratch:
    """A folder of intermediate tables that belongs to one call of one operator."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/foliomill/{label}-{uuid.uuid4().hex}"
        self._count = 0
        # The folder is made now: only one that exists can be marked to go with the application.
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.root)
        files = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        files.mkdirs(target)
        files.deleteOnExit(target)
        if _SCOPES:
            _SCOPES[-1].append(self.root)

    def table(self, frame: DataFrame, name: str) -> DataFrame:
        """Write ``frame`` and return a DataFrame that reads the files back."""
        self._count += 1
        path = f"{self.root}/{self._count:03d}-{name}"
        frame.write.parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, frame: DataFrame) -> None:
        """Delete the files behind a table that nothing reads any more."""
        path = getattr(frame, "_scratch_path", None)
        if path:
            _delete(self.spark, path)
