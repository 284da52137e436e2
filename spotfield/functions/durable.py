"""Cutting lineage so that a lost executor costs no more than the current step."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir`` or has set. Only where driver and executors are one
    process, as in tests, one of our own is made; on a cluster without a named folder this is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", "") or ""
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.conf.get("spark.checkpoint.dir", "") or sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
