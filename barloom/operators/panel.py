"""The long panel: cleaning, calendar, grid, universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.config import DataConfig
from barloom.functions.nums import finite
from barloom.session import materialize

CANONICAL = ("date", "ticker", "open", "high", "low", "close", "volume")
PRICES = ("open", "high", "low", "close")
FIELDS = PRICES + ("volume",)


def typed(raw: DataFrame, date: Column, ticker: Column, *rest: str) -> DataFrame:
    """Rows with date, ticker and the fields as finite doubles; a bad cell is NULL. The generator keeps filters on the cells above
    it: pushed below, each of them would parse its cells again, several times a row."""
    d = raw.select(date.alias("date"), ticker.alias("ticker"), *[F.expr(f"try_cast({c} as double)").alias(c) for c in FIELDS], *rest)
    return d.select(F.inline(F.array(F.struct("date", "ticker", *[finite(F.col(c)).alias(c) for c in FIELDS], *rest))))


def clean_bars(raw: DataFrame, cfg: DataConfig) -> DataFrame:
    """Typed, positive, bounded bars of tickers with enough history. Bad values become NULL and drop."""
    d = typed(raw, F.expr("try_cast(date as date)"), F.col("ticker"))
    if cfg.start:
        d = d.filter(F.col("date") >= F.lit(cfg.start).cast("date"))
    if cfg.end:
        d = d.filter(F.col("date") <= F.lit(cfg.end).cast("date"))
    d = d.dropna(subset=["date", *FIELDS])
    for c in PRICES:
        d = d.filter(F.col(c) > 0)
    d = materialize(d, "clean")     # read for the counts and for the rows
    long_enough = (d.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
                   .filter(F.col("n") >= cfg.min_history).select("ticker"))
    return d.join(long_enough, "ticker", "left_semi").select(*CANONICAL)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row of every key by `order`. Partial aggregation first, so copies of one key do not
    have to meet in one task."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def clean_live(raw: DataFrame, order: str = "ord") -> DataFrame:
    """Feed rows: UTC time to plain date, upper ticker, numeric casts, positive prices, last copy wins."""
    d = typed(raw, F.expr("cast(try_to_timestamp(date) as date)"), F.upper("ticker"), order)
    d = d.dropna(subset=["date", *FIELDS])
    for c in PRICES:
        d = d.filter(F.col(c) > 0)
    return keep_last(d, ["date", "ticker"], [order]).select(*CANONICAL)


def calendar(panel: DataFrame) -> DataFrame:
    """Dense session ids. One row per DATE, and the type has fewer than four million values, so the
    numbering window and the broadcasts of this table are bounded whatever the panel's size."""
    w = Window.orderBy("date")
    return (panel.select("date").distinct()
            .select("date", (F.row_number().over(w) - 1).cast("int").alias("sid"),
                    F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
                    .cast("int").alias("n_sessions")))


def with_sessions(panel: DataFrame, cal: DataFrame | None = None) -> DataFrame:
    cal = calendar(panel) if cal is None else cal
    return panel.join(F.broadcast(cal), "date")


def fill_holes(bars: DataFrame, cal: DataFrame, lead_in: bool = False) -> DataFrame:
    """Rows for the sessions a ticker missed, fields NULL. One ticker window and a generator: each bar
    emits itself and the holes up to the next one. `lead_in` also fills before the first bar."""
    w = Window.partitionBy("ticker").orderBy("sid")
    stop = F.coalesce(F.lead("sid").over(w), F.col("n_sessions")) - 1
    begin = F.when(F.lag("sid").over(w).isNull(), F.lit(0)).otherwise(F.col("sid")) if lead_in else F.col("sid")
    d = bars.withColumn("_slots", F.sequence(begin, stop)).withColumn("_own", F.col("sid"))
    d = d.drop("date").withColumn("sid", F.explode("_slots"))
    here = F.col("sid") == F.col("_own")
    fields = [c for c in bars.columns if c not in ("date", "ticker", "sid", "n_sessions")]
    d = d.select("ticker", "sid", "n_sessions", *[F.when(here, F.col(c)).alias(c) for c in fields])
    return d.join(F.broadcast(cal.select("sid", "date")), "sid")


def dense_grid(panel: DataFrame) -> DataFrame:
    """Every session of every ticker; holes have NULL fields and are never tradable."""
    cal = calendar(panel)
    g = fill_holes(with_sessions(panel, cal), cal, lead_in=True)
    return g.withColumn("tradable", F.coalesce("tradable", F.lit(False))) if "tradable" in g.columns else g


def long_to_wide(panel: DataFrame, field: str, tickers: list[str]) -> DataFrame:
    """date x ticker export of one field for a named list of tickers."""
    return panel.groupBy("date").pivot("ticker", tickers).agg(F.first(field))


def universe_filter(panel: DataFrame, cfg: DataConfig) -> DataFrame:
    """`tradable`, judged from the ticker's own earlier bars only."""
    w = Window.partitionBy("ticker").orderBy("date")
    back = w.rowsBetween(-21, -1)
    rate = F.coalesce("usd_rate", F.lit(1.0)) if "usd_rate" in panel.columns else F.lit(1.0)
    d = panel.withColumn("_dv", F.col("close") * F.col("volume") * rate)
    d = d.withColumn("_past", F.sort_array(F.collect_list("_dv").over(back)))       # 21 values: sorting beats a map of counts a row
    n = F.size("_past")
    half = F.get("_past", ((n - 1) / 2).cast("int")) * 0.5 + F.get("_past", (n / 2).cast("int")) * 0.5
    dv = F.when(n >= 10, half)
    ok = ((F.lag("close").over(w) >= cfg.min_price) & (dv >= cfg.min_dollar_volume)
          & (F.row_number().over(w) - 1 >= cfg.min_history))
    return d.withColumn("tradable", F.coalesce(ok, F.lit(False))).drop("_dv", "_past")


def liquidity(panel: DataFrame) -> DataFrame:
    """Median traded value of each ticker; a ticker's bars are bounded by the calendar."""
    rate = F.coalesce("usd_rate", F.lit(1.0)) if "usd_rate" in panel.columns else F.lit(1.0)
    return panel.groupBy("ticker").agg(
        F.percentile(F.col("close") * F.col("volume") * rate, F.lit(0.5)).alias("liquidity"))


def top_liquid(panel: DataFrame, n: int) -> DataFrame:
    """The n most liquid tickers, ties by name. `limit` under a sort keeps n rows in each task."""
    return liquidity(panel).orderBy(F.col("liquidity").desc(), "ticker").limit(n)


def top_universe(panel: DataFrame, n: int) -> DataFrame:
    """Panel rows of the n most liquid tickers. The semi join's right side has at most n rows."""
    return panel.join(top_liquid(panel, n).select("ticker"), "ticker", "left_semi")


def load_panel(raw: DataFrame, cfg: DataConfig) -> DataFrame:
    """Clean bars of the `max_tickers` most liquid names."""
    return top_universe(clean_bars(raw, cfg), cfg.max_tickers)


def null_sanitize(df: DataFrame) -> DataFrame:
    return df.select(*[finite(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def thin(df: DataFrame, order: str, cap: int, keys: list[str]) -> DataFrame:
    """Every k-th row of each key's series, k = max(1, rows // cap)."""
    w = Window.partitionBy(*keys).orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    step = F.greatest(F.lit(1), F.floor(n / cap))
    return (df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_k", step)
            .filter(F.col("_i") % F.col("_k") == 0).drop("_i", "_k"))
