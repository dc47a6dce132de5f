"""Lineage cuts in the shared checkpoint folder."""

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Only a local master may go without: it gets a folder of its own.

    Checkpoints of tables that are no longer used go where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir has to name a folder that all executors share (master {master})")
    return os.path.join(tempfile.gettempdir(), "weft-checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read back."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
