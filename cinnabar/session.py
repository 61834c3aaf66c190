"""Session helpers: reading tables, and the shared folder for cut lineage."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package, wherever the driver was started: by path on this machine, as a file elsewhere."""
    sc = spark.sparkContext
    root = str(Path(__file__).resolve().parent.parent)
    have = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in have:
        return
    sc.environment["PYTHONPATH"] = os.pathsep.join([root, *have])
    if not sc.master.startswith("local"):
        made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="cinnabar-"), "cinnabar"), "zip", root, "cinnabar")
        sc.addPyFile(made)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` of the session, or, in local tests where it is unset, one of our own."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    now = spark.sparkContext.getCheckpointDir()
    if not now:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cinnabar-"))
        now = spark.sparkContext.getCheckpointDir()
    return now.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, of which nothing is left when the session ends."""
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Runs ``df`` now and returns its rows from a table in the shared folder, so nothing before it is ever computed again.

    A written table, unlike cached blocks, outlives the loss of any executor. ``done`` removes it before the session ends.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def done(*tables: DataFrame) -> None:
    """Removes tables that ``cut`` wrote and nothing reads any more: those of a round whose successor is written."""
    for t in tables:
        at = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t._cut)
        at.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of what nothing refers to any more, which it does when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def splits(df: DataFrame) -> int:
    """The number of tasks that will produce ``df``: the splits of a scan, or what the plan's last shuffle makes; nothing is run."""
    plan = df._jdf.queryExecution().executedPlan()
    known = plan.outputPartitioning().numPartitions()
    if known:
        return known
    if "Exchange" in plan.toString():
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, df.rdd.getNumPartitions())


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for work that costs far more than moving its rows.

    Only a table of few splits is moved at all; a large one has enough and stays where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if splits(df) < cores else df
