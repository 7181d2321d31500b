"""Skill and performance figures, one row per model."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions import ladder
from barloom.functions.nums import finite, ratio


def _running(*keys: str):
    return Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)


def equity_curve(daily: DataFrame, value: str = "pnl", keys: tuple[str, ...] = ("model",)) -> DataFrame:
    return daily.withColumn("equity", F.product(F.lit(1.0) + F.col(value)).over(_running(*keys)))


def drawdown(curve: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Fall from the highest equity so far; the starting level is not part of the maximum."""
    return curve.withColumn("drawdown", ratio(F.col("equity"), F.max("equity").over(_running(*keys))) - 1)


def _sharpe(mean: Column, sd: Column, ppy: int) -> Column:
    return F.when(sd > 0, mean / sd * math.sqrt(ppy))


def performance_metrics(daily: DataFrame, ppy: int, value: str = "pnl", keys: tuple[str, ...] = ("model",),
                        turnover: str | None = None) -> DataFrame:
    d = drawdown(equity_curve(daily.filter(F.col(value).isNotNull()), value, keys), keys)
    v = F.col(value)
    aggs = [F.count(F.lit(1)).alias("n_days"), F.product(F.lit(1.0) + v).alias("_eq"), F.avg(v).alias("_mean"),
            F.stddev_samp(v).alias("_sd"), F.stddev_samp(F.when(v < 0, v)).alias("_down"),
            F.min("drawdown").alias("max_drawdown"), F.avg((v > 0).cast("double")).alias("hit_rate")]
    if turnover:
        aggs.append(F.avg(turnover).alias("avg_turnover"))
    m = d.groupBy(*keys).agg(*aggs)
    years = F.col("n_days") / ppy
    m = m.withColumn("ann_return", F.when(F.col("_eq") > 0, F.pow("_eq", 1 / years) - 1))
    m = m.withColumn("sharpe", _sharpe(F.col("_mean"), F.col("_sd"), ppy))
    out = {"years": F.round(years, 2), "total_return": F.col("_eq") - 1, "ann_vol": F.col("_sd") * math.sqrt(ppy),
           "sortino": _sharpe(F.col("_mean"), F.col("_down"), ppy),
           "calmar": F.when(F.col("max_drawdown") < 0, F.col("ann_return") / F.abs("max_drawdown")),
           "t_stat": F.col("sharpe") * F.sqrt(years)}
    if turnover:
        out["ann_turnover"] = F.col("avg_turnover") * ppy
    return m.withColumns(out).drop("_eq", "_mean", "_sd", "_down")


def daily_ic(d: DataFrame, x: str, y: str, min_names: int = 20, bound: int | None = None,
             mask_first: bool = True, keys: tuple[str, ...] = ("date", "model")) -> DataFrame:
    """Rank correlation of x and y in each group. `mask_first` ranks only names that have both;
    otherwise each side is ranked over all its names and the pairs are taken after."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    if mask_first:
        d = d.filter(both)
    d = ladder.average_rank(d, list(keys), x, "_rx", "_nx", bound)
    d = ladder.average_rank(d, list(keys), y, "_ry", "_ny", bound).filter(both)
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("names"), finite(F.corr("_rx", "_ry")).alias("ic"))
    return g.filter((F.col("names") >= min_names) & F.col("ic").isNotNull())


def ic_summary(ic: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    m = ic.groupBy(*keys).agg(
        F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"),
        F.avg((F.col("ic") > 0).cast("double")).alias("ic_positive_rate"), F.count("ic").alias("ic_days"))
    r = F.when(F.col("ic_std") > 0, F.col("ic_mean") / F.col("ic_std"))
    return m.withColumn("icir", r).withColumn("ic_t_stat", F.col("icir") * F.sqrt("ic_days"))


def rolling_ic(ic: DataFrame, n: int = 21) -> DataFrame:
    w = Window.partitionBy("model").orderBy("date").rowsBetween(-(n - 1), 0)
    return ic.withColumn("ic_mean", F.when(F.count("ic").over(w) >= n, F.avg("ic").over(w)))
