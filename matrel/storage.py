"""The folder that the driver and all executors share, and ends of lineages in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, one temporary folder for the session if the master is local, as in tests.
    On a cluster an unset folder is an error, as every machine would have one of its own."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "") or getattr(spark, "_matrel_shared", "")
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark._matrel_shared = "file://" + tempfile.mkdtemp(prefix="matrel-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df computed once and checkpointed: what reads it neither computes it again nor plans it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
