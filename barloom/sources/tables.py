"""Fixtures cut from the star-schema tables: bars, ticks, trades and listings."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.session import materialize, release

LINE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
              "l_quantity", "l_discount")


def week_of(day: Column) -> Column:
    """Monday of the week, in plain date arithmetic: no session time zone involved."""
    return F.date_sub(day, F.weekday(day))


def ticker_of(key: Column) -> Column:
    return F.concat(F.lit("S"), key.cast("string"))


class Tables:
    """Lazy readers over one scale folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._kept = spark, folder.rstrip("/"), {}

    def keep(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table several branches of one query read: written once to the shared folder."""
        if name not in self._kept:
            self._kept[name] = materialize(make(), name)
            release(self.spark)     # the shuffles that made it are not read again
        return self._kept[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def names_bound(self) -> int:
        """Upper bound on names in any cross-section, read from the parquet footers."""
        return self.table("supplier").count()

    @cached_property
    def bars_bound(self) -> int:
        """Upper bound on bars, from the parquet footers."""
        return self.table("lineitem").count()

    def weekly_bars(self) -> DataFrame:
        """One bar per supplier and week of `lineitem`. Partial aggregates run before the shuffle,
        so a supplier with very many lines does not become one long task."""
        li = self.table("lineitem").select(
            ticker_of(F.col("l_suppkey")).alias("ticker"),
            week_of(F.col("l_shipdate").cast("date")).alias("date"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
            F.col("l_quantity").alias("q"), F.struct(*LINE_ORDER).alias("o"))
        return li.groupBy("date", "ticker").agg(
            F.min_by("px", "o").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
            F.max_by("px", "o").alias("close"), F.sum("q").alias("volume"))

    def trades(self) -> DataFrame:
        """Buys and sells in time order; `seq` is the order key, not a row number."""
        return self.table("lineitem").select(
            ticker_of(F.col("l_suppkey")).alias("ticker"),
            F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("action"),
            F.col("l_quantity").alias("quantity"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_shipdate").cast("date").alias("at"), F.struct(*LINE_ORDER).alias("seq"))

    def ticks(self) -> DataFrame:
        return self.table("events").filter("value > 0").select(
            "ts", F.col("event_id").alias("id"), F.col("event_type").alias("ticker"),
            F.col("value").alias("px"), F.lit(1.0).alias("size"))

    def user_bars(self) -> DataFrame:
        """Daily bars per user of `events`."""
        e = self.table("events").filter("value > 0").select(
            F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"),
            F.col("ts").cast("date").alias("date"), "value", F.struct("ts", "event_id").alias("o"))
        return e.groupBy("date", "ticker").agg(
            F.min_by("value", "o").alias("open"), F.max("value").alias("high"),
            F.min("value").alias("low"), F.max_by("value", "o").alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"))
