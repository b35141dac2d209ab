"""Cutting lineage in the shared folder of the cluster."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir.

    Where it is unset, a local master (one machine: tests, benches) gets a folder of its own; on a cluster that is an
    error, as a folder of the driver is out of the executors' reach. Spark removes checkpoints that nothing refers to any
    more if spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir: a folder that driver and executors share is expected")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="samphire-"))
    return named or context.getCheckpointDir()


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor and computes ``frame`` once."""
    checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
