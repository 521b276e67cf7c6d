"""Tables that later steps read again, written where every executor finds them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and written to the checkpoint folder: its lineage ends there, and a lost executor changes nothing.

    The folder is the session's (``spark.checkpoint.dir``). Without one, a
    session on a local master makes its own, and any other one raises.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
    return df.checkpoint()
