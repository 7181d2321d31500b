"""What is held, at what average price, and what it is worth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barloom.functions.nums import ratio


def average_cost(trades: DataFrame) -> DataFrame:
    """Quantity and average entry price after all trades (ticker, action, quantity, price, at, seq).

    A sale beyond the holding closes it. The holding is a running sum reflected at zero and the price
    is a chain of weighted means, so both compose: trades are summarised per (ticker, month) - a busy
    ticker is spread over its months - and only the month summaries of a ticker are folded."""
    chunk = F.trunc("at", "month")
    x = F.when(F.col("action") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    d = trades.select("ticker", chunk.alias("chunk"), "seq", "price", "quantity", F.col("action"), x.alias("x"))
    w = Window.partitionBy("ticker", "chunk").orderBy("seq")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("s", F.sum("x").over(run)).withColumn("low", F.min("s").over(run))
    parts = d.groupBy("ticker", "chunk").agg(F.sum("x").alias("a"), F.min("low").alias("m"))
    months = Window.partitionBy("ticker").orderBy("chunk")       # at most one row a month
    prior = F.collect_list(F.struct("a", "m")).over(months.rowsBetween(Window.unboundedPreceding, -1))
    start = F.aggregate(prior, F.lit(0.0), lambda q, p: p["a"] + F.greatest(q, -p["m"]))
    parts = parts.select("ticker", "chunk", start.alias("q0"), "m")
    d = d.join(parts.select("ticker", "chunk", "q0"), ["ticker", "chunk"])
    q = F.col("s") + F.greatest("q0", -F.col("low"))
    before = F.coalesce(F.lag("q").over(w), F.col("q0"))
    d = d.withColumn("q", F.when(q > 1e-9, q).otherwise(0.0)).withColumn("before", before)
    buy = F.col("action") == "buy"
    d = d.withColumns({"alpha": F.when(buy, F.col("before") / F.col("q")).otherwise(1.0),
                       "beta": F.when(buy, F.col("price") * F.col("quantity") / F.col("q")).otherwise(0.0)})
    after = F.coalesce(F.product("alpha").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(1.0))
    d = d.withColumn("_b", F.col("beta") * after)
    maps = d.groupBy("ticker", "chunk").agg(F.product("alpha").alias("al"), F.sum("_b").alias("be"), F.max_by("q", "seq").alias("q"))
    g = maps.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("chunk", "al", "be", "q"))).alias("_m"))
    price = F.aggregate("_m", F.lit(0.0), lambda c, p: p["al"] * c + p["be"])
    return g.select("ticker", F.element_at("_m", -1)["q"].alias("quantity"), price.alias("entry_price")).filter("quantity > 0")


def positions(trades: DataFrame) -> DataFrame:
    """Open positions after all trades: shares, average entry price (to four decimals, as statements show it), day of the first buy."""
    first = trades.filter("action = 'buy'").groupBy("ticker").agg(F.min("at").alias("entry_at"))
    d = average_cost(trades).join(first, "ticker")
    return d.select("ticker", F.col("quantity").alias("shares"), F.round("entry_price", 4).alias("entry_price"), "entry_at")


def mark_to_market(holdings: DataFrame, quotes: DataFrame) -> DataFrame:
    """Value and profit of each holding; NULL without a quote."""
    d = holdings.join(quotes.select("ticker", "price", "change_pct"), "ticker", "left")
    d = d.withColumns({"cost": F.col("quantity") * F.col("entry_price"), "value": F.col("quantity") * F.col("price")})
    return d.withColumns({"pnl": F.col("value") - F.col("cost"), "pnl_pct": (ratio(F.col("value"), F.col("cost")) - 1) * 100})


def portfolio_total(marks: DataFrame) -> DataFrame:
    """Totals over priced rows only: counting a cost without its value would invent a loss."""
    priced = F.col("value").isNotNull()
    t = marks.groupBy().agg(F.sum(F.when(priced, F.col("cost"))).alias("cost"), F.sum("value").alias("value"),
                            F.count(F.lit(1)).alias("positions"), F.count_if(priced).alias("priced"))
    return t.withColumns({"pnl": F.col("value") - F.col("cost"), "pnl_pct": (ratio(F.col("value"), F.col("cost")) - 1) * 100,
                          "unpriced": F.col("positions") - F.col("priced")})


def portfolio_concentration(marks: DataFrame) -> DataFrame:
    """Effective number of positions, largest weight, best and worst holding; sums only."""
    d = marks.filter("value is not null")
    key = F.struct("pnl_pct", "ticker")
    t = d.groupBy().agg(F.sum("value").alias("_v"), F.sum(F.col("value") * F.col("value")).alias("_v2"), F.max("value").alias("_top"),
                        F.count(F.lit(1)).alias("positions"), F.max_by("ticker", key).alias("best"), F.min_by("ticker", key).alias("worst"))
    hhi = F.col("_v2") / (F.col("_v") * F.col("_v"))
    return t.select("positions", hhi.alias("hhi"), (1 / hhi).alias("effective_positions"),
                    (F.col("_top") / F.col("_v") * 100).alias("largest_weight_pct"), "best", "worst")


def same_window(marks: DataFrame, bars: DataFrame, bench: DataFrame, start: str | None = None, context: int = 22) -> DataFrame:
    """Portfolio at today's weights and the benchmark over the same sessions, from `start` or else the earliest `entry_at` of
    the marks; with fewer than two sessions since then the last `context` ones are shown and flagged. `bench` is (date, level)."""
    first = marks.groupBy().agg(F.min("entry_at").alias("_s") if start is None else F.first(F.lit(start).cast("date")).alias("_s"))
    bench = bench.join(F.broadcast(first), F.lit(True))
    since = bench.filter(F.col("date") >= F.col("_s"))
    n = since.groupBy().agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("date").desc())       # one row a date
    d = bench.withColumn("_i", F.row_number().over(w)).join(n, F.lit(True))
    d = d.filter(F.when(F.col("_n") < 2, F.col("_i") <= context).otherwise(F.col("date") >= F.col("_s")))
    ends = d.groupBy().agg(F.min("date").alias("from_"), F.max("date").alias("to_"), F.min_by("level", "date").alias("_a"),
                           F.max_by("level", "date").alias("_b"), (F.count(F.lit(1)) - 1).alias("sessions"), F.max(F.col("_n") < 2).alias("context_only"))
    px = bars.join(F.broadcast(ends.select("from_", "to_")), F.lit(True)).groupBy("ticker").agg(
        F.max(F.when(F.col("date") == F.col("from_"), F.col("close"))).alias("a"), F.max(F.when(F.col("date") == F.col("to_"), F.col("close"))).alias("b"))
    priced = marks.filter("value is not null")
    total = priced.groupBy().agg(F.sum("value").alias("_t"))
    r = (priced.join(px.filter("a > 0 and b is not null"), "ticker").join(F.broadcast(total), F.lit(True)).groupBy()
         .agg(F.sum(F.col("value") / F.col("_t") * (F.col("b") / F.col("a") - 1) * 100).alias("portfolio_pct")))
    return ends.join(r, F.lit(True)).select("from_", "to_", "sessions", "context_only", "portfolio_pct",
                                            ((F.col("_b") / F.col("_a") - 1) * 100).alias("benchmark_pct"))


def allocate_balance(picks: DataFrame, balance: float, max_weight: float = 0.25, whole_shares: bool = True) -> DataFrame:
    """Shares of each priced pick: weights clipped at the cap, then scaled to one (so one may end above the cap);
    equal split without positive weights. Totals are one-row aggregates."""
    if balance <= 0:
        raise ValueError("balance must be positive")
    d = picks.filter("price > 0").withColumn("_w", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    t = d.groupBy().agg(F.sum("_w").alias("_t"), F.count(F.lit(1)).alias("_n"))
    d = d.join(F.broadcast(t), F.lit(True))
    d = d.withColumn("_c", F.least(F.when(F.col("_t") > 0, F.col("_w") / F.col("_t")).otherwise(1 / F.col("_n")), F.lit(max_weight)))
    norm = d.groupBy().agg(F.sum("_c").alias("_s"))
    d = d.join(F.broadcast(norm), F.lit(True)).withColumn("target", balance * F.col("_c") / F.col("_s"))
    shares = F.floor(F.col("target") / F.col("price")).cast("double") if whole_shares else F.round(F.col("target") / F.col("price"), 4)
    d = d.withColumn("shares", shares)
    return d.select("ticker", "price", (F.col("_c") / F.col("_s") * 100).alias("weight_pct"), "target", "shares",
                    (F.col("shares") * F.col("price")).alias("spend"))
