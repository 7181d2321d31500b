"""Joins and counts that a hot key does not gather in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barloom.session import materialize

SALTS = 16


def salted_join(rows: DataFrame, table: DataFrame, on: list[str], spread: Column, how: str = "inner",
                salts: Column | int = SALTS) -> DataFrame:
    """`rows` joined with `table` (one row per key) on `on`; the rows of a key are dealt to `salts` tasks by the hash `spread`,
    and the table's row goes to each of them. A column of `salts` must have the same value for a key on both sides."""
    n = F.lit(salts) if isinstance(salts, int) else salts
    left = rows.withColumn("salt_", F.pmod(spread, n).cast("int"))
    right = table.withColumn("salt_", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    return left.join(right, [*on, "salt_"], how).drop("salt_")


def busy_keys(rows: DataFrame, on: list[str], each: int) -> DataFrame:
    """(on, salts): the keys that `each` rows or more have, and the number of tasks their rows are dealt to, one for each `each`.
    Stored: it is small as a rule, and Spark then joins it without a shuffle of the other side."""
    salts = (F.floor(F.col("n") / F.lit(each)) + 1).cast("int").alias("salts")
    return materialize(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= each).select(*on, salts), "busy")
