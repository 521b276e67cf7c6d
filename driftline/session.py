"""Sessions, and the library's code on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Gives this library to the session's Python workers, once; they may run where it is not installed."""
    context = spark.sparkContext
    if getattr(context, "_driftline_shipped", False):
        return
    here = Path(__file__).resolve().parent
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp()), "driftline.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(here.rglob("*.py")):
            z.write(path, path.relative_to(here.parent))
    context.addPyFile(archive)
    context._driftline_shipped = True


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench: adaptive, UTC, Arrow batches of at most 2000 rows."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("driftline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
