"""Trading-rule analytics on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.frames import at, extremes, roll_extreme
from barloom.functions.nums import ratio
from barloom.operators.forecast import Z80, left_bin


def with_grid(d: DataFrame, grid: list[dict]) -> DataFrame:
    """Every row with every parameter set: a generator over a literal list, no join."""
    sets = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in g.items()]) for g in grid])
    return d.withColumn("_g", F.explode(sets)).select(*d.columns, "_g.*")


def deadband_positions(ranks: DataFrame, enter: float | Column = 90.0, leave: float | Column = 30.0,
                       keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """`held` after each session: in at rank >= enter, out when the rank is under `leave` or missing, otherwise
    as before. The last event decides, so the state is one running window, not a loop."""
    event = F.when(F.col("rank") >= enter, 1).when(F.col("rank").isNull() | (F.col("rank") < leave), -1)
    w = Window.partitionBy(*keys).orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    return ranks.withColumn("held", F.coalesce(F.last(event, ignorenulls=True).over(w), F.lit(-1)) == 1)


def deadband_sweep(d: DataFrame, grid: list[dict], returns: str) -> DataFrame:
    """(enter, leave, yr, value, trades) of `deadband_positions` for each set of `grid`: mean return of held rows and changes of state.
    All sets run in one ticker window; rows are repeated for the sets only below the sums of a year, where nothing is shuffled."""
    w = Window.partitionBy("ticker").orderBy("sid")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    held = F.lit(0).cast("long")
    for i, g in enumerate(grid):
        event = F.when(F.col("rank") >= g["enter"], 1).when(F.col("rank").isNull() | (F.col("rank") < g["leave"]), -1)
        held = held.bitwiseOR(F.when(F.last(event, ignorenulls=True).over(upto) == 1, F.lit(1 << i).cast("long")).otherwise(0))
    d = d.select("ticker", "sid", F.year("date").alias("yr"), F.col(returns).alias("_r"), held.alias("_held"))
    d = d.select("yr", "_r", "_held", F.coalesce(F.lag("_held").over(w), F.lit(0)).alias("_was"))
    bit = F.expr("shiftleft(1L, _set)")
    d = with_grid(d, [dict(_set=i, enter=g["enter"], leave=g["leave"]) for i, g in enumerate(grid)])
    return d.groupBy("enter", "leave", "yr").agg(
        F.avg(F.when(F.col("_held").bitwiseAND(bit) != 0, F.col("_r"))).alias("value"),
        F.count_if(F.col("_held").bitwiseAND(bit) != F.col("_was").bitwiseAND(bit)).alias("trades"))


def planned_exits(holdings: DataFrame, ranks: DataFrame, prices: DataFrame, leave: float = 30.0) -> DataFrame:
    """Holdings the next session will sell: unscored or ranked under the exit."""
    d = holdings.join(ranks.select("ticker", "rank"), "ticker", "left").join(prices.select("ticker", "price"), "ticker", "left")
    d = d.filter(F.col("rank").isNull() | (F.col("rank") < leave))
    return d.select("ticker", "shares", "rank", "price", (F.col("shares") * F.col("price")).alias("value"),
                    (F.col("shares") * (F.col("price") - F.col("entry_price"))).alias("pnl"),
                    F.when(F.col("rank").isNull(), "not scored").otherwise("below exit").alias("reason"))


def peak_exit_flag(bars: DataFrame, lookback: int = 60) -> DataFrame:
    """`peaked`: the close reaches the highest close of the last sessions, given enough history."""
    w = Window.partitionBy("ticker").orderBy("date")
    d = bars.withColumns({"_at": F.row_number().over(w), "_seen": F.count("close").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    d = extremes(d, "close", lookback, "_at")
    known = F.col("_seen") - F.coalesce(F.lag("_seen", lookback).over(w), F.lit(0))
    d = d.withColumn("peak", F.when(known >= max(3, lookback // 2), roll_extreme(F.max, "close", lookback, "_at")))
    return d.select(*bars.columns, "peak", F.coalesce(F.col("close") >= F.col("peak"), F.lit(False)).alias("peaked"))


def band_exit_flag(entries: DataFrame, bars: DataFrame, cal: DataFrame, horizon: int, n_bins: int = 10) -> DataFrame:
    """First later session, within the horizon, whose high reaches the top of the entry's 80 % band. The
    horizon's sessions are opened into keys, so the bars meet them in an equi join."""
    d = entries.withColumn("bin", left_bin(F.col("rank"), n_bins)).join(F.broadcast(cal.select("bin", "mean", "std")), "bin")
    d = d.withColumn("target", F.col("entry_price") * (1 + F.col("mean") + Z80 * F.col("std")))
    d = d.withColumn("on", F.explode(F.sequence(F.col("sid") + 1, F.col("sid") + horizon)))
    b = bars.select("ticker", F.col("sid").alias("on"), F.col("date").alias("hit_date"), "high")
    hit = F.when(F.col("high") >= F.col("target"), F.col("hit_date"))
    return d.join(b, ["ticker", "on"], "left").groupBy("ticker", "date", "rank", "entry_price", "target").agg(F.min(hit).alias("hit_date"))


def with_trade_prices(bars: DataFrame, hold: int) -> DataFrame:
    """Prices an order placed after session t meets at t+1, and the close `hold` sessions later (or the last one)."""
    w = Window.partitionBy("ticker").orderBy("sid")
    last = F.when(F.last("sid").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
                  == F.col("n_sessions") - 1, F.last("close").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    out = F.when(F.col("sid") + 1 + hold <= F.col("n_sessions") - 1, at("close", 1 + hold)).otherwise(last)
    return bars.withColumns({"n_open": at("open", 1), "n_low": at("low", 1), "n_close": at("close", 1), "exit_px": out})


# Order rule -> (anchor, is a limit).
RULES = {"market": ("n_open", False), "open_limit": ("n_open", True), "prevclose_limit": ("close", True),
         "at_prevclose": ("close", True), "close": ("n_close", False)}


def limit_fill(d: DataFrame, rules: list[tuple[str, float]]) -> DataFrame:
    """Each order under each (rule, dip): `fill` price or NULL, and the return `ret` to the exit. A limit at or
    above the open fills at the open."""
    can = F.col("n_open").isNotNull() & (F.col("n_open") > 0) & F.col("exit_px").isNotNull()
    made = []
    for rule, dip in rules:
        anchor, limited = RULES[rule]
        limit = F.col(anchor) * (1 - dip)
        fill = (F.when(limit >= F.col("n_open"), F.col("n_open")).when(F.col("n_low") <= limit, limit) if limited
                else F.when(F.col(anchor) > 0, F.col(anchor)))
        made.append(F.struct(F.lit(rule).alias("rule"), F.lit(float(dip)).alias("dip"), F.when(can, fill).alias("fill")))
    x = d.withColumn("_r", F.explode(F.array(*made))).select(*d.columns, "_r.*")
    return x.withColumn("ret", ratio(F.col("exit_px"), F.col("fill")) - 1)


def fill_report(fills: DataFrame) -> DataFrame:
    return fills.groupBy("rule", "dip").agg(
        F.count(F.lit(1)).alias("offered"), F.count("ret").alias("fills"), (F.count("ret") / F.count(F.lit(1))).alias("fill_rate"),
        (F.avg("ret") * 100).alias("mean_pct"), (F.sum("ret") * 100).alias("total_pct"),
        (F.avg((F.col("ret") > 0).cast("double")) * 100).alias("win_pct"))


def slot_selection(fills: DataFrame, slots: int, pool: int) -> DataFrame:
    """The first `slots` filled orders among each date's `pool` best ranked names. Both rank filters keep a
    bounded number of rows a date in every task before the shuffle."""
    keys = ["rule", "dip", "date"]
    best = Window.partitionBy(*keys).orderBy(F.col("rank").desc(), "ticker")
    d = fills.filter("rank is not null").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= pool)
    d = d.filter("ret is not null").withColumn("slot", F.row_number().over(best)).filter(F.col("slot") <= slots)
    return d


def nonoverlap_compound(taken: DataFrame, hold: int, ppy: int) -> DataFrame:
    """Every hold-th signal date: mean return a hold, compounded and annualised, one row a rule."""
    per = (taken.filter(F.col("pos") % hold == 0).filter(F.col("pos") < F.col("n_dates") - hold - 1)
           .groupBy("rule", "dip", "date").agg(F.avg("ret").alias("r")))
    m = per.groupBy("rule", "dip").agg(F.count(F.lit(1)).alias("holds"), (F.avg("r") * 100).alias("mean_pct"),
                                       F.product(F.lit(1.0) + F.col("r")).alias("equity"),
                                       (F.avg((F.col("r") > 0).cast("double")) * 100).alias("win_pct"))
    years = F.col("holds") * hold / ppy
    return m.withColumn("ann_pct", F.when(F.col("equity") > 0, (F.pow("equity", 1 / years) - 1) * 100))


def parameter_sweep(scores: DataFrame, params: list[str], split_year: int) -> DataFrame:
    """`scores` has one value per parameter set and year. Chosen by the worst early year, then by the mean;
    the later years only report."""
    early = F.col("yr") <= split_year
    m = scores.groupBy(*params).agg(
        F.min(F.when(early, F.col("value"))).alias("worst"), F.avg(F.when(early, F.col("value"))).alias("mean"),
        F.avg(F.when(~early, F.col("value"))).alias("holdout"), F.sum("trades").alias("trades"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("worst").desc(), F.col("mean").desc(), *params)   # one row a set
    return m.withColumn("place", F.row_number().over(w))


def order_reprice(orders: DataFrame, closes: DataFrame, dip: float = 0.005) -> DataFrame:
    """Carried orders anchored again to the current close; without one they keep their old level."""
    d = orders.join(closes.select("ticker", F.col("price").alias("_p")), "ticker", "left")
    ref = F.coalesce("_p", F.col("reference"))
    return d.select("ticker", "budget", ref.alias("reference"),
                    F.when(F.col("_p").isNull(), F.col("limit")).otherwise(ref * (1 - dip)).alias("limit"))


def slot_sizing(cash: DataFrame, held: DataFrame, picks: DataFrame, max_positions: int, open_orders: int = 0,
                sizing: str = "equity") -> DataFrame:
    """Money for each pick and whether a share fits in it. `cash` is one row."""
    value = held.groupBy().agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("_v"))
    n = picks.groupBy().agg(F.count(F.lit(1)).alias("_n"))
    one = cash.join(value, F.lit(True)).join(n, F.lit(True))      # three one-row tables
    slot = (F.least((F.col("cash") + F.col("_v")) / max_positions, F.col("cash")) if sizing == "equity"
            else F.col("cash") / F.greatest(F.lit(1), F.col("_n") + open_orders))
    d = picks.join(F.broadcast(one.select(slot.alias("slot"))), F.lit(True))
    return d.withColumn("action", F.when(F.col("price") > F.col("slot"), "skip").otherwise("order"))


def plan_allocation(picks: DataFrame) -> DataFrame:
    """Positive weights scaled to one. The total is a one-row aggregate."""
    d = picks.filter("weight > 0")
    total = d.groupBy().agg(F.sum("weight").alias("_t"))
    return d.join(F.broadcast(total), F.lit(True)).withColumn("weight", F.col("weight") / F.col("_t")).drop("_t")


def fill_and_mark(plan: DataFrame, bars: DataFrame, budget: float, entry_sid: int, exit_sid: int) -> DataFrame:
    """Whole shares at the entry close, marked at the last session; `bars` has sid and n_sessions."""
    entry = bars.filter(F.col("sid") == entry_sid).select("ticker", F.col("close").alias("entry_price"))
    last = bars.filter(F.col("sid") == F.col("n_sessions") - 1).select("ticker", F.col("close").alias("price"))
    d = plan.join(entry, "ticker").filter("entry_price > 0")
    d = d.withColumn("shares", F.floor(budget * F.col("weight") / F.col("entry_price"))).filter("shares > 0")
    d = d.join(last, "ticker", "left").withColumns({"cost": F.col("shares") * F.col("entry_price"),
                                                    "value": F.col("shares") * F.col("price")})
    return d.withColumn("pnl", F.col("value") - F.col("cost")).withColumn("pnl_pct", (ratio(F.col("value"), F.col("cost")) - 1) * 100)


def fund_total(marks: DataFrame, bench: DataFrame, budget: float, exit_sid: int) -> DataFrame:
    """Value and profit of the plan, and of the same money in the benchmark (b_in, b_out, last_sid: one row)."""
    m = marks.groupBy().agg(F.sum("cost").alias("invested"), F.sum("value").alias("_v"))
    d = m.join(bench, F.lit(True))           # two one-row tables
    value = budget - F.col("invested") + F.col("_v")
    units = F.floor(budget / F.col("b_in"))
    b = units * F.col("b_out") + (budget - units * F.col("b_in"))
    return d.select("invested", (budget - F.col("invested")).alias("cash"), value.alias("value"), (value - budget).alias("pnl"),
                    b.alias("benchmark_value"), ((value - budget) - (b - budget)).alias("vs_benchmark"),
                    (F.col("last_sid") >= exit_sid).alias("closed"))


def watchlist_follow(picks: DataFrame, current: DataFrame, offered: DataFrame, cap: int = 100) -> DataFrame:
    """Names to add: not on the list, never offered before, as many as there is room for. `pos` orders them."""
    new = (picks.join(current.select("ticker"), "ticker", "left_anti").join(offered.select("ticker"), "ticker", "left_anti")
           .groupBy("ticker").agg(F.min("pos").alias("pos")))
    top = new.orderBy("pos", "ticker").limit(cap)
    have = current.select("ticker").distinct().groupBy().agg(F.count(F.lit(1)).alias("_h"))
    w = Window.partitionBy(F.lit(0)).orderBy("pos", "ticker")      # at most `cap` rows
    return (top.join(F.broadcast(have), F.lit(True)).withColumn("_i", F.row_number().over(w))
            .filter(F.col("_i") + F.col("_h") <= cap).select("ticker", "pos"))


def activity_feed(streams: dict[str, DataFrame], kind: str = "all", limit: int = 400) -> DataFrame:
    """All event streams (at_, action, ticker, detail) on one clock, newest first."""
    d = None
    for name, s in streams.items():
        if kind in ("all", name):
            s = s.select("at_", F.lit(name).alias("stream"), "action", "ticker", "detail")
            d = s if d is None else d.unionByName(s)
    return d.orderBy(F.col("at_").desc_nulls_last(), "stream", "action", "ticker", "detail").limit(limit)


def equity_from_flows(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """(date, cash, held, capital, value): money in hand and holdings at their last close, after the trades of each session.

    `trades` is (at_, action, ticker, quantity, price), `bars` (date, ticker, close). Every trade moves cash and a position; `capital`
    is the most that the trades had ever laid out, so cash never falls below zero and `value` is all of it. A holding without
    a bar keeps its last close. Only changes of a name's worth are summed over names and then over sessions, so no date x
    ticker grid is made. Names without any close are worth nothing; null quantities move nothing."""
    signed = F.coalesce(F.when(F.col("action") == "buy", F.col("quantity")).otherwise(-F.col("quantity")), F.lit(0.0))
    moves = trades.groupBy(F.col("at_").alias("date"), "ticker").agg(F.sum(signed).alias("_q"), F.sum(-signed * F.col("price")).alias("_cash"))
    w = Window.partitionBy("ticker").orderBy("date")             # at most one row a session
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = bars.select("date", "ticker", "close").join(moves, ["date", "ticker"], "full")
    worth = F.sum(F.coalesce("_q", F.lit(0.0))).over(run) * F.coalesce(F.last("close", ignorenulls=True).over(run), F.lit(0.0))
    d = d.withColumn("_w", worth).withColumn("_d", F.col("_w") - F.coalesce(F.lag("_w").over(w), F.lit(0.0)))
    day = d.groupBy("date").agg(F.sum(F.coalesce("_cash", F.lit(0.0))).alias("_c"), F.sum("_d").alias("_d"))
    whole = Window.partitionBy(F.lit(0))                         # one row a date
    upto = whole.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    day = day.select("date", F.sum("_c").over(upto).alias("cash"), F.sum("_d").over(upto).alias("held"))
    day = day.withColumn("capital", F.greatest(-F.min("cash").over(whole), F.lit(0.0)))
    return day.withColumn("cash", F.col("capital") + F.col("cash")).withColumn("value", F.col("cash") + F.col("held"))


def replay_summary(trades: DataFrame, curve: DataFrame, universe: DataFrame) -> DataFrame:
    """Trades, wins and realised profit; the curve's capital, end and deepest fall; buy-and-hold of names priced at both ends."""
    sells = F.col("action") == "sell"
    t = trades.groupBy().agg(F.count_if(F.col("action") == "buy").alias("buys"), F.count_if(sells).alias("sells"),
                             F.sum(F.when(sells, F.col("pnl"))).alias("realised"),
                             F.avg(F.when(sells, (F.col("pnl") > 0).cast("double"))).alias("win_rate"))
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)    # one row a date
    c = curve.withColumn("_d", ratio(F.col("value"), F.max("value").over(w)) - 1).groupBy().agg(
        F.least(F.min("_d"), F.lit(0.0)).alias("max_drawdown"), F.count(F.lit(1)).alias("sessions"),
        F.max("capital").alias("capital"), F.max_by("value", "date").alias("equity"))
    ends = universe.groupBy().agg(F.min("date").alias("_f"), F.max("date").alias("_l"))
    u = universe.join(F.broadcast(ends), F.lit(True)).groupBy("ticker").agg(
        F.max(F.when(F.col("date") == F.col("_f"), F.col("close"))).alias("a"), F.max(F.when(F.col("date") == F.col("_l"), F.col("close"))).alias("b"))
    b = u.filter("a is not null and b is not null").groupBy().agg(F.avg(F.col("b") / F.col("a") - 1).alias("benchmark"), F.count(F.lit(1)).alias("universe"))
    return t.join(c, F.lit(True)).join(b, F.lit(True))      # three one-row tables
