"""Session options the operators rely on."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

OPTIONS = {
    "spark.sql.chunkBase64String.enabled": "false",  # base64 in one line, as data URLs and digests need it
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the options on a running session; the ones about resources are the caller's."""
    for key, value in OPTIONS.items():
        spark.conf.set(key, value)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the workers, unless they find it by PYTHONPATH or in the folder the job was started in."""
    root = Path(__file__).resolve().parent.parent
    found = [os.path.realpath(p) for p in [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]]
    app = spark.sparkContext.applicationId
    if str(root) not in found and app not in _SHIPPED:
        made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="foliomill-"), "foliomill"), "zip", root, "foliomill")
        spark.sparkContext.addPyFile(made)
        _SHIPPED.add(app)
    return spark
