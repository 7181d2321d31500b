"""Tables the library writes: snapshots, run outputs, the forecast ledger and the update log."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.operators.panel import keep_last


def snapshot_id(provider: str, tickers: list[str], start: str, end: str | None) -> str:
    return hashlib.sha1(json.dumps([provider, sorted(tickers), start, end]).encode()).hexdigest()[:16]


def write_snapshot(panel: DataFrame, root: str, key: str, at: str) -> None:
    """One immutable folder per snapshot and time; the committer makes it visible only when whole."""
    panel.write.mode("overwrite").parquet(f"{root}/snapshot_id={key}/ingested_at={at.replace(':', '-')}")


def read_snapshot(spark: SparkSession, root: str, key: str, now: str, max_age_hours: float) -> DataFrame | None:
    """Rows of the newest snapshot young enough, or None. Partition pruning opens only that folder."""
    try:
        d = spark.read.parquet(f"{root}/snapshot_id={key}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None     # nothing stored yet
    d = d.withColumn("_at", F.to_timestamp(F.col("ingested_at").cast("string"), "yyyy-MM-dd HH-mm-ss"))
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("_at")) / 3600
    newest = d.filter(age < max_age_hours).agg(F.max("ingested_at").alias("m")).first()["m"]
    return None if newest is None else d.filter(F.col("ingested_at") == newest).drop("ingested_at", "_at")


def panel_snapshot(spark: SparkSession, root: str, key: str, now: str, max_age_hours: float, fetch) -> DataFrame:
    hit = read_snapshot(spark, root, key, now, max_age_hours)
    if hit is None:
        write_snapshot(fetch(), root, key, now)
        hit = read_snapshot(spark, root, key, now, max_age_hours + 1)
    return hit


def save_run(root: str, run: str, tables: dict[str, DataFrame], small: dict[str, DataFrame], config: str) -> None:
    """Large outputs as parquet under the run, small ones as a single csv each, the settings as text."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/run={run}")
    spark = next(iter({**tables, **small}.values())).sparkSession
    for name, df in small.items():   # a few rows per model or fold
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{root}/{name}/run={run}")
    spark.createDataFrame([(config,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/config/run={run}")


def ledger_append(prior: DataFrame, preds: DataFrame, run: str, logged_at: str) -> DataFrame:
    """Only the newest forecast date is logged; of two rows of a name and date the later log wins."""
    newest = preds.groupBy().agg(F.max("date").alias("_d"))
    fresh = (preds.join(F.broadcast(newest), F.col("date") == F.col("_d")).drop("_d")
             .withColumn("run", F.lit(run)).withColumn("logged_at", F.lit(logged_at).cast("timestamp_ntz")))
    return keep_last(prior.unionByName(fresh), ["date", "ticker"], ["logged_at", "run"])


def update_log(log: DataFrame, n: int = 200, at: str = "at") -> DataFrame:
    """The last n entries, newest first. A sorted limit keeps n rows in each task."""
    return log.orderBy(F.col(at).desc(), F.col("run").desc()).limit(n)
