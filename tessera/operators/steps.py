"""Intermediate results that are written once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the folder that spark.checkpoint.dir names; only a local session without one gets a folder of this machine."""
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return df.checkpoint()
