"""Running a stream into a table in the shared folder and reading the table back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.operators.panel import keep_last
from barloom.session import scratch_path


def tick_stream(spark: SparkSession, folder: str, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Event rows as a stream with an event-time column the engine can watermark."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return (r.parquet(folder).filter("value > 0")
            .select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), F.col("event_type").alias("ticker"),
                    "user_id", F.col("value").alias("px"), F.lit(1.0).alias("size")))


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Everything available now, appended to a file table with exactly-once commits."""
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession, name)
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", path)
         .option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def deal_files(events: DataFrame, path: str, files: int, arrival) -> None:
    """Rows as `files` files of equal spans of `arrival` (a number), written one after the other: the order in which a stream
    takes them. Rows without an arrival come first."""
    ends = events.agg(F.min(arrival).alias("a"), F.max(arrival).alias("b")).first()
    step = ((ends["b"] or 0) - (ends["a"] or 0)) // files + 1
    file = F.coalesce(F.floor((arrival - F.lit(ends["a"] or 0)) / step), F.lit(0))
    for i in range(files):
        events.filter(file == i).coalesce(1).write.mode("append").parquet(path)


def run_update(stream: DataFrame, name: str, keys: list[str], order: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """Changed groups of every micro-batch, one folder a batch (rewritten whole on a retry); the newest batch of
    a key (and in it the newest by `order`) is its value, so groups still open at the end are there too. With a `path`
    the results and the checkpoint stay there, and a later run goes on where the last one ended."""
    spark, path = stream.sparkSession, path or scratch_path(stream.sparkSession, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    q = (stream.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start())
    q.awaitTermination()
    return keep_last(spark.read.option("basePath", path).parquet(f"{path}/batch=*"), keys, ["batch", *order]).drop("batch")


def run_state(stream: DataFrame, name: str, keys: list[str], order: tuple[str, ...], path: str | None = None) -> DataFrame:
    """`run_update` for operators with state of their own, which need the store that has timers."""
    spark, before = stream.sparkSession, stream.sparkSession.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        return run_update(stream, name, keys, order, path)
    finally:
        spark.conf.set(STORE, before)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a table folder is there, asked of the file system that holds it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def run_upsert(stream: DataFrame, name: str, keys: list[str], order: list[str], day: str, path: str | None = None) -> DataFrame:
    """Keep-last ledger: each batch rewrites only the date partitions it touches. Merging the same batch twice
    gives the same rows, so a retry is harmless. With a `path` the ledger and its checkpoint stay there, and a later run
    or a restart goes on where the last one ended; without one they are scratch."""
    spark, path = stream.sparkSession, path or scratch_path(stream.sparkSession, name)

    def merge(batch: DataFrame, batch_id: int) -> None:
        fresh = keep_last(batch, keys, order)
        staged = scratch_path(spark, f"{name}-merge-{batch_id}")
        if _exists(spark, path):
            old = spark.read.parquet(path)
            touched = old.join(fresh.select(day).distinct(), day, "left_semi").select(*fresh.columns)
            fresh = keep_last(touched.unionByName(fresh), keys, order)
        fresh.write.parquet(staged)        # the table cannot be read and replaced in one job
        (spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(day).parquet(path))

    q = (stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}-state")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(path)
