"""Quotes, ranges of bars and intraday figures from ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.nums import positive, ratio

# Range name -> (bar in minutes, what is shown up to the last bar: a number of days or calendar months, the
# bar's own day or year, or everything).
RANGES = {"1d": (1, "day"), "3d": (5, "3 days"), "5d": (5, "5 days"), "1mo": (60, "1 month"), "3mo": (1440, "3 months"),
          "6mo": (1440, "6 months"), "ytd": (1440, "year"), "1y": (1440, "12 months"), "max": (10080, "all")}


def quote_change(bars: DataFrame) -> DataFrame:
    """Last close and the one before of each ticker. The rank filter keeps two rows a ticker in each
    task before the shuffle."""
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    two = bars.filter("close is not null").withColumn("_i", F.row_number().over(w)).filter("_i <= 2")
    q = two.groupBy("ticker").agg(F.max(F.when(F.col("_i") == 1, F.col("close"))).alias("price"),
                                  F.max(F.when(F.col("_i") == 2, F.col("close"))).alias("prev_close"))
    return q.filter("prev_close is not null and prev_close <> 0").withColumns({
        "change": F.col("price") - F.col("prev_close"),
        "change_pct": (F.col("price") / F.col("prev_close") - 1) * 100})


def bar_start(ts: Column, minutes: int) -> Column:
    """Start of the bar a zone-less time falls in: day, week or minute grid of the day."""
    day = ts.cast("date")
    if minutes >= 10080:
        return F.date_sub(day, F.weekday(day)).cast("timestamp_ntz")
    if minutes >= 1440:
        return day.cast("timestamp_ntz")
    k = F.floor((F.hour(ts) * 60 + F.minute(ts)) / minutes) * minutes
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), (k / 60).cast("int"),
                                (k % 60).cast("int"), F.lit(0))


def tick_bars(ticks: DataFrame, minutes: int, key: str = "ticker") -> DataFrame:
    """Open, high, low, close and volume of each bar; partial aggregates, so a busy ticker is no hot task."""
    o = F.struct("ts", "id")
    return (ticks.withColumn("bar", bar_start(F.col("ts"), minutes)).groupBy(key, "bar").agg(
        F.min_by("px", o).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.max_by("px", o).alias("close"), F.sum("size").alias("volume")))


def range_slice(ticks: DataFrame, name: str) -> DataFrame:
    """Bars of one named range up to the ticker's last bar, with the range's change."""
    if name not in RANGES:
        raise ValueError(f"unknown range {name!r}, choose from {sorted(RANGES)}")
    minutes, shown = RANGES[name]
    bars = tick_bars(ticks, minutes)
    last = bars.groupBy("ticker").agg(F.max("bar").alias("_last"))
    d = bars.join(last, "ticker")
    if shown in ("day", "year"):
        d = d.filter(F.date_trunc(shown, "bar") == F.date_trunc(shown, "_last"))
    elif shown != "all":
        d = d.filter(F.col("bar") >= F.col("_last") - F.expr(f"interval {shown}"))
    ends = d.groupBy("ticker").agg(F.min_by("close", "bar").alias("_a"), F.max_by("close", "bar").alias("_b"),
                                   F.count(F.lit(1)).alias("points"))
    label = F.date_format("bar", "yyyy-MM-dd HH:mm" if minutes < 1440 else "yyyy-MM-dd")
    return d.join(ends, "ticker").select(
        "ticker", F.lit(name).alias("range"), label.alias("label"), "close", "points",
        F.when(F.col("points") > 1, (F.col("_b") / F.col("_a") - 1) * 100).alias("change_pct"))


def intraday_returns(bars: DataFrame) -> DataFrame:
    """Log returns from bar to bar without the largest half percent (overnight gaps); tickers with
    fewer than 30 bars give none. A ticker's bars are bounded by the clock."""
    d = bars.filter("close > 0")
    w = Window.partitionBy("ticker").orderBy("bar")
    d = d.withColumn("ret", F.ln(F.col("close") / F.lag("close").over(w)))
    cut = d.groupBy("ticker").agg(F.percentile(F.abs("ret"), F.lit(0.995)).alias("_cut"),
                                  F.count(F.lit(1)).alias("_n")).filter("_n >= 30")
    return d.join(cut, "ticker").filter(F.abs("ret") < F.col("_cut")).select("ticker", "bar", "ret")


def dip_profile(bars: DataFrame, dip: float, least: int = 20) -> DataFrame:
    """How often, and when, a session trades `dip` below its open after the first bar. `bars` has the
    session `day` and the clock minute `minute`."""
    s = bars.groupBy("ticker", "day").agg(F.min_by("open", "minute").alias("_o"), F.min("minute").alias("_m0"),
                                          F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    hit = F.when((F.col("minute") > F.col("_m0")) & (F.col("low") <= F.col("_o") * (1 - dip)), F.col("minute"))
    per_day = (bars.join(s, ["ticker", "day"]).groupBy("ticker", "day").agg(F.min(hit).alias("at")))
    return per_day.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("sessions"), F.avg(F.col("at").isNotNull().cast("double")).alias("hit_rate"),
        F.percentile("at", F.lit(0.5)).alias("median_minute"), F.percentile("at", F.lit(0.25)).alias("from_minute"),
        F.percentile("at", F.lit(0.75)).alias("to_minute"))


def freshness(panel: DataFrame, median: DataFrame) -> DataFrame:
    """How current a panel is; `median` is the one-row exact median traded value."""
    per = panel.groupBy("ticker").agg(F.max("date").alias("last"), F.min("date").alias("first"),
                                      F.count(F.lit(1)).alias("n"))
    top = per.groupBy().agg(F.max("last").alias("last_date"), F.min("first").alias("first_date"),
                            F.count(F.lit(1)).alias("tickers"), F.sum("n").alias("rows_"))
    stale = per.join(F.broadcast(top.select("last_date")), F.col("last") < F.col("last_date")).groupBy().agg(
        F.count(F.lit(1)).alias("stale_tickers"))
    return top.join(F.broadcast(stale), F.lit(True)).join(F.broadcast(median), F.lit(True))


def liquidity_value(panel: DataFrame) -> DataFrame:
    return panel.withColumn("dv", positive(F.col("close")) * F.col("volume"))


def log_change(a: Column, b: Column) -> Column:
    return F.ln(ratio(a, b))
