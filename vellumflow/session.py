"""Session helpers: tables by name, and the shared folder that lineage is cut to."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the data folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: ``spark.checkpoint.dir`` of the session.

    Where none is named, a local master gets a temporary folder of this machine,
    which goes with the process; a cluster has to name a shared one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    context = spark.sparkContext
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="vellumflow-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(own)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df``: survives the loss of executors, ends the lineage.

    Its files go with the last reference to it where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, which a session has
    to be built with.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all cores where its input comes in fewer pieces than there are cores; else as it is.

    Only for tables that are small (one file, one row group) but costly by row. keys
    are unique columns, so the pieces are even and a lost one is made again alike.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)
