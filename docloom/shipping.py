"""Bring this package to the Python workers of a cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()

#: Rows can be long texts or vectors: Arrow batches are bounded by bytes unless the session says otherwise.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES, DEFAULT_BATCH = "4m", {"67108864b", "64m", "67108864"}


def ship(spark: SparkSession) -> None:
    """Prepare a session for Python on its workers: sources as Python files (once for each application), small batches.

    Functions given to mapInArrow and its kin are pickled by reference, so workers must be able to
    import the package even where it isn't installed on them.
    """
    if spark.conf.get(BATCH, "64m") in DEFAULT_BATCH:
        spark.conf.set(BATCH, BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _shipped or not _ROOT.is_dir():
        return
    path = os.path.join(tempfile.mkdtemp(prefix="docloom-src-"), f"{_ROOT.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(_ROOT.rglob("*.py")):
            z.write(f, f"{_ROOT.name}/{f.relative_to(_ROOT)}")
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
