"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR = "barloom.scratch.dir"


def build_session(app: str = "barloom", master: str | None = None, shuffle_partitions: int | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    """A session with adaptive execution on. On a cluster leave the arguments out."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        b = b.config("spark.driver.memory", driver_memory)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by `spark.checkpoint.dir`. Only a local master
    may fall back to a temporary folder: on a cluster a machine-local path would not be shared."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    # the setting itself cannot be changed in a running session, so the folder is kept beside it
    made = spark.conf.get(_OWN_DIR, None)
    if not made:
        made = tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set(_OWN_DIR, made)
    return made


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/barloom-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back, so that several consumers scan a
    columnar table instead of repeating the plan. Survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._scratch = path
    return made


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `materialize` made and that no later plan reads: the old state of a loop, for example."""
    for t in tables:
        path = getattr(t, "_scratch", None)
        if path:
            _delete(t.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Lets the cleaner delete the shuffle files of finished plans now. It acts on collected references, and a driver with
    little to do may not collect for half an hour."""
    for _ in range(2):      # what the first pass frees refers to more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)     # the cleaner works in the background


def clear_scratch(spark: SparkSession) -> None:
    """Deletes everything this application has materialized. Call it when the results that read it have been written."""
    _delete(spark, _scratch_root(spark))
