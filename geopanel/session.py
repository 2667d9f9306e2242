"""Session construction and durable scratch space."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """Single-JVM session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("geopanel")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # Recording the Python call site of every expression doubles the time to build a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Where none is set, a private one serves a local master; on a
    cluster executors could not read it, so the setting is asked for."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-geopanel-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, so concurrent runs never overwrite each other."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """Cut the lineage durably: later consumers re-read files instead of re-running the plan,
    also after an executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Have the files of shuffles deleted that nothing refers to any more. Spark deletes them once the driver has collected its
    garbage, which a driver with memory to spare rarely does; call it between the large steps of a long job."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Expanded rows that one task should take.
TASK_ROWS = 4_000_000


def spread(df: DataFrame, *cols: str, weight: int = 0) -> DataFrame:
    """Distribute rows evenly before work that multiplies each of them. Adaptive execution sizes
    partitions by the bytes going in, which says nothing about rows that grow a thousandfold. ``weight`` is the number of
    rows after growing, where it is known."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(2 * slots, -(-weight // TASK_ROWS)), *cols)
