"""Session helpers: tables and durable lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession, folder: str | None = None) -> str:
    """The cluster's shared checkpoint folder, or ``folder`` where the session names none. Only on a local master without
    either (a single machine) a folder of our own is made."""
    set_to = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_to.isDefined():
        return set_to.get()
    where = spark.conf.get("spark.checkpoint.dir", None) or folder
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = os.path.join(tempfile.gettempdir(), "cotejo-checkpoints")
    spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame, before: DataFrame | None = None, folder: str | None = None) -> DataFrame:
    """Cut the lineage through reliable storage, so that a lost executor costs a read, not a recomputation. ``before``,
    an earlier cut that nothing else reads, is deleted when this one is written."""
    checkpoint_dir(df.sparkSession, folder)
    out = df.checkpoint(True)
    if before is not None:
        release(before)
    return out


def release(*cuts: DataFrame) -> None:
    """Deletes the files of cuts whose readers are done; frames that are no cuts are left alone."""
    for df in cuts:
        plan = df._jdf.queryExecution().logical()
        if plan.getClass().getSimpleName() != "LogicalRDD":
            continue
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def shuffle_width(spark: SparkSession) -> int:
    return max(parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
