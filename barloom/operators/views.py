"""Per-ticker views of a run: contributions, summaries, search and detail. `held` comes from the same
book the backtest uses, so these figures add up to its results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barloom.functions import ladder
from barloom.functions.nums import ratio

EPS = 1e-12
# Sort name -> (column, ascending).
SORTS = {"rank": ("latest_rank", False), "contribution": ("contribution", False), "worst": ("contribution", True),
         "ticker": ("ticker", True), "days_long": ("days_long", False), "days_short": ("days_short", False)}


def pick_model(models: list[str], wanted: str | None = None) -> str:
    if not models:
        raise ValueError("no models")
    return wanted if wanted in models else "ensemble" if "ensemble" in models else models[0]


def contributions(scores: DataFrame, held: DataFrame, bound: int | None = None) -> DataFrame:
    """(date, ticker, close, score, rank, weight, contribution) for one model: rows of scored names and of held
    ones. `scores` has one row per bar with score, close and ret_next_1d."""
    r = ladder.percent_rank(scores, ["date"], "score", "rank", bound, min_names=2)
    d = r.join(held.select("date", "ticker", F.col("held").alias("weight")), ["date", "ticker"], "full_outer")
    d = d.filter(F.col("close").isNotNull() | (F.abs("weight") > EPS))      # a day without a bar is no row for rounding dust
    return d.select("date", "ticker", "close", "score", (F.col("rank") * 100).alias("rank"),
                    F.coalesce("weight", F.lit(0.0)).alias("weight"),
                    (F.coalesce("weight", F.lit(0.0)) * F.coalesce("ret_next_1d", F.lit(0.0))).alias("contribution"))


def stock_summary(c: DataFrame) -> DataFrame:
    """One row a ticker over the scored dates. First and last date are the run's, not the ticker's."""
    ends = c.groupBy().agg(F.max("date").alias("_last"), F.min("date").alias("_first"))
    d = c.join(F.broadcast(ends), F.lit(True))
    at_end, at_start = F.col("date") == F.col("_last"), F.col("date") == F.col("_first")
    lng, sht = F.col("weight") > EPS, F.col("weight") < -EPS
    m = d.groupBy("ticker").agg(
        F.max(F.when(at_end, F.col("rank"))).alias("latest_rank"),
        F.coalesce(F.max(F.when(at_end, F.col("weight"))), F.lit(0.0)).alias("latest_weight"),
        F.avg("rank").alias("mean_rank"), F.sum("contribution").alias("contribution"), F.count("score").alias("days"),
        F.count_if(lng).alias("days_long"), F.count_if(sht).alias("days_short"),
        F.count_if((F.col("contribution") > 0) & (lng | sht)).alias("_wins"),
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("date"))).alias("last_price"),
        (ratio(F.max(F.when(at_end, F.col("close"))), F.max(F.when(at_start, F.col("close")))) - 1).alias("price_change"))
    return m.withColumn("hit_rate", ratio(F.col("_wins"), F.col("days_long") + F.col("days_short"))).drop("_wins")


def stock_search(summary: DataFrame, text: str = "", position: str = "all", sort: str = "rank", limit: int = 60) -> DataFrame:
    """Matching tickers in the named order with the honest number of matches. The count is a one-row
    aggregate and the sorted limit keeps `limit` rows in each task."""
    d = summary
    if text:
        d = d.filter(F.upper("ticker").contains(text.strip().upper()))
    w = F.col("latest_weight")
    pick = {"long": w > EPS, "short": w < -EPS, "held": F.abs(w) > EPS}.get(position)
    d = d if pick is None else d.filter(pick)
    col, up = SORTS.get(sort, SORTS["rank"])
    key = F.col(col).asc_nulls_last() if up else F.col(col).desc_nulls_last()
    total = d.groupBy().agg(F.count(F.lit(1)).alias("total_matches"))
    top = d.orderBy(key, "ticker").limit(limit)
    side = F.when(w > EPS, "long").when(w < -EPS, "short").otherwise("flat")
    return top.withColumn("position", side).join(F.broadcast(total), F.lit(True))


def stance_summary(summary: DataFrame) -> DataFrame:
    r, lng, sht = F.col("mean_rank"), F.col("days_long"), F.col("days_short")
    band = (F.when(r.isNull(), "mid-pack").when(r >= 70, "near the top").when(r >= 55, "upper half")
            .when(r >= 45, "middle").when(r >= 30, "lower half").otherwise("near the bottom"))
    side = F.when(lng > sht * 1.3, "mostly long").when(sht > lng * 1.3, "mostly short").otherwise("mixed")
    return summary.select("ticker", "mean_rank", band.alias("band"), side.alias("stance"))


def stock_detail(c: DataFrame, ticker: str) -> DataFrame:
    """One name's history with running contribution. One ticker's rows are bounded by the calendar."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = c.filter(F.upper("ticker") == ticker.upper()).filter("rank is not null or abs(weight) > 0")
    return d.withColumn("cum_contribution", F.sum("contribution").over(w))


def topk_rank_per_date(c: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("date").orderBy(F.col("rank").desc(), "ticker")
    return c.filter("rank is not null").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def watch_set(c: DataFrame, held: DataFrame, enter: float = 90.0, n: int = 25) -> DataFrame:
    """Held names and the first `n` names, by name, ranked `enter` or better on the last date."""
    last = c.groupBy().agg(F.max("date").alias("_l"))
    top = (c.join(F.broadcast(last), F.col("date") == F.col("_l")).filter(F.col("rank") >= enter)
           .select("ticker").orderBy("ticker").limit(n))
    return held.select("ticker").union(top).distinct()
