"""Cut points of long plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that the cluster shares, so later steps don't plan or compute it again.

    The folder is ``spark.checkpoint.dir``; where that is unset, a local master gets a temporary one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        given = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not given and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="panelwright-"))
    return df.checkpoint()
