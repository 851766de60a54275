"""Cutting lineage: a frame is written by checkpoint() to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def by_page(df: DataFrame, page: str) -> DataFrame:
    """df dealt by page into the session's number of shuffle partitions: what is done with a page costs far more than its
    bytes tell, so partitions must not be merged for being small."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), page)


def settle(df: DataFrame) -> DataFrame:
    """df, computed once and read from spark.checkpoint.dir (a temporary folder in local mode if that is unset); survives
    lost executors."""
    session, context = df.sparkSession, df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        root = session.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not root:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="quire-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
        context.setCheckpointDir(root)
    return df.checkpoint()
