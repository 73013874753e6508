"""Gets this package onto the executors and runs its batch functions there."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MARK = "_atomweave_shipped"
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def ensure_shipped(spark: SparkSession) -> None:
    """Adds the package's own files to the session once, so that tasks can import it."""
    context = spark.sparkContext
    if getattr(context, _MARK, False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    parent = os.path.dirname(package)
    archive = os.path.join(tempfile.mkdtemp(prefix="atomweave-"), "atomweave_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, parent))
    context.addPyFile(archive)
    setattr(context, _MARK, True)


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with the package present in the tasks; for ``df.transform``."""
    ensure_shipped(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, run: Callable, schema) -> DataFrame:
    """:func:`map_batches` for whole rows that pass through Python one by one; ``run`` must not depend on where batches end.

    Each task holds such a batch on both sides of the pipe, outside the heap. So the session's batches are bounded to
    :data:`BATCH_BYTES`, unless it has a bound of its own.
    """
    conf = df.sparkSession.conf
    if BATCH_LIMIT not in conf.getAll:
        conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    return map_batches(df, run, schema)
