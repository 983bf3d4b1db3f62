"""Cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the shared folder that the cluster names; sets a local one only where none is named and the driver is the
    only executor (tests). On a cluster without one it raises, since executors share no local folder."""
    if spark.conf.get("spark.checkpoint.dir", None):
        return
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="helixframe-checkpoint-"))


def stash(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder, which outlives executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
