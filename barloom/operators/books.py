"""From scores to held weights and daily results.

A book is sparse: only non-zero positions are rows. Averaging target books over the holding period,
the execution lag and the turnover are sums over those rows, so no date x ticker grid is built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.config import BookConfig
from barloom.functions import ladder
from barloom.functions.nums import ratio
from barloom.operators.metrics import _sharpe
from barloom.operators.panel import calendar
from barloom.session import materialize

LEG = ["date", "model", "side"]


def positions_of(signal: DataFrame) -> DataFrame:
    """Dense position of every date that has a score: (date, pos, n_dates)."""
    return (calendar(signal.filter("score is not null"))
            .select("date", F.col("sid").alias("pos"), F.col("n_sessions").alias("n_dates")))


def quantile_legs(signal: DataFrame, cfg: BookConfig, bound: int | None = None) -> DataFrame:
    """Names in the top and bottom quantile with their unscaled size `raw` > 0 and `side`."""
    d = ladder.average_rank(signal.filter("score is not null"), ["date", "model"], "score", "_r", "_n", bound)
    pr, enough = F.col("_r") / F.col("_n"), F.col("_n") >= cfg.min_names
    top, low = (pr >= 1 - cfg.quantile) & enough, (pr <= cfg.quantile) & enough
    if cfg.signal_weighted:
        raw = F.when(top | low, pr - 0.5).otherwise(F.lit(0.0))
    else:
        raw = top.cast("double") - (low.cast("double") if cfg.long_short else F.lit(0.0))
    d = d.withColumn("_raw", raw).filter(F.col("_raw") != 0 if cfg.long_short else F.col("_raw") > 0)
    return d.select("date", "model", "ticker", F.when(F.col("_raw") > 0, "long").otherwise("short").alias("side"),
                    F.abs("_raw").alias("raw"))


def waterfill(legs: DataFrame, target: float, cap: float | None) -> DataFrame:
    """Scales each leg to `target` with no name above `cap`; what a capped name cannot take goes to the
    others. At most target / cap names can be capped, so only that many of each leg's largest names
    are looked at (the engine keeps just those rows in every task before the shuffle)."""
    total = legs.groupBy(*LEG).agg(F.sum("raw").alias("_total"), F.count(F.lit(1)).alias("_n"))
    if cap is None:
        return (legs.join(total, LEG).withColumn("w", F.col("raw") / F.col("_total") * target)
                .drop("_total", "_n"))
    most = int(target / cap + 1e-9)
    order = Window.partitionBy(*LEG).orderBy(F.col("raw").desc(), "ticker")
    head = legs.withColumn("_i", F.row_number().over(order)).filter(F.col("_i") <= most)
    head = head.withColumn("_mass", F.coalesce(F.sum("raw").over(
        order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    hit = (target - (F.col("_i") - 1) * cap) * F.col("raw") > cap * (F.col("_total") - F.col("_mass"))
    capped = (head.join(total, LEG).filter(hit).groupBy(*LEG)
              .agg(F.count(F.lit(1)).alias("_c"), F.sum("raw").alias("_cm")))
    limits = total.join(capped, LEG, "left").select(
        *LEG, F.when(F.coalesce("_c", F.lit(0)) < F.col("_n"),
                     (target - F.coalesce("_c", F.lit(0)) * cap) / (F.col("_total") - F.coalesce("_cm", F.lit(0.0))))
        .alias("_scale"))
    w = F.when(F.col("_scale").isNull(), F.lit(cap)).otherwise(F.least(F.lit(cap), F.col("raw") * F.col("_scale")))
    return legs.join(limits, LEG).withColumn("w", w).drop("_scale")


def dollar_neutral(sized: DataFrame) -> DataFrame:
    """Both legs cut to the smaller gross; signed weight `w`."""
    is_long = F.col("side") == "long"
    # a date's legs are added up in one task: partial sums would round differently with every layout of the files
    sized = sized.repartition("date", "model")
    g = sized.groupBy("date", "model").agg(
        F.coalesce(F.sum(F.when(is_long, F.col("w"))), F.lit(0.0)).alias("_l"),
        F.coalesce(F.sum(F.when(~is_long, F.col("w"))), F.lit(0.0)).alias("_s"))
    can = F.least("_l", "_s")
    w = F.when(is_long, ratio(F.col("w") * can, F.col("_l"))).otherwise(ratio(-F.col("w") * can, F.col("_s")))
    return sized.join(g, ["date", "model"]).select("date", "model", "ticker", w.alias("w"))


def target_book(signal: DataFrame, cfg: BookConfig, bound: int | None = None) -> DataFrame:
    """Signed target weights of each date (date, model, ticker, w)."""
    legs = materialize(quantile_legs(signal, cfg, bound), "legs")    # read for totals, limits and weights
    cap = cfg.max_weight * cfg.gross if cfg.max_weight else None
    if cfg.long_short:
        return dollar_neutral(waterfill(legs, cfg.gross / 2, cap))
    return waterfill(legs, cfg.gross, cap).select("date", "model", "ticker", "w")


def sleeves(target: DataFrame, pos: DataFrame, holding: int, lag: int = 0, least: float = 1e-12) -> DataFrame:
    """Mean of the last `holding` target books, `lag` sessions later (date, model, ticker, pos, held). Opposite books that
    cancel leave rounding dust: means up to `least` are no rows. With 0 the dust stays; it is that of a sum in date order."""
    d = target.join(F.broadcast(pos), "date")
    part = F.struct((F.col("pos") + F.col("j") + lag).alias("pos"), (-F.col("j")).alias("book"),
                    F.least(F.lit(holding), F.col("pos") + F.col("j") + 1).alias("books"), "w")
    d = d.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(holding - 1))))
    d = d.select("model", "ticker", "n_dates", part.alias("_p")).select("model", "ticker", "n_dates", "_p.*")
    # at most `holding` books a row
    total = (F.sum("w") if least else
             F.aggregate(F.sort_array(F.collect_list(F.struct("book", "w"))), F.lit(0.0), lambda s, b: s + b["w"]))
    held = d.filter("pos < n_dates").groupBy("model", "ticker", "pos").agg(total.alias("held"), F.max("books").alias("_n"))
    held = held.withColumn("held", F.col("held") / F.col("_n")).drop("_n").filter(F.abs("held") > least)
    return held.join(F.broadcast(pos.select("pos", "date")), "pos")


def frame(signal: DataFrame, pos: DataFrame) -> DataFrame:
    """One row per model and scored date, so that flat days count too."""
    models = signal.select("model").distinct()
    n = pos.groupBy().agg(F.max("n_dates").alias("n"))
    rows = models.join(F.broadcast(n), F.lit(True)).withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return rows.join(F.broadcast(pos.select("pos", "date")), "pos").select("model", "date", "pos")


def gross_pnl(held: DataFrame, returns: DataFrame) -> DataFrame:
    """Held weight times next return, summed; a missing return earns nothing."""
    r = returns.select("date", "ticker", "ret_next_1d")
    d = held.join(r, ["date", "ticker"], "left")
    return d.groupBy("model", "date").agg(
        F.sum(F.col("held") * F.coalesce("ret_next_1d", F.lit(0.0))).alias("gross_pnl"))


def turnover(held: DataFrame, pos: DataFrame) -> DataFrame:
    """Sum of absolute changes of the book; the first date counts as no trade."""
    end = F.array(F.struct(F.col("pos"), F.col("held").alias("x")),
                  F.struct((F.col("pos") + 1).alias("pos"), (-F.col("held")).alias("x")))
    moves = (held.select("model", "ticker", F.explode(end).alias("_m")).select("model", "ticker", "_m.*")
             .groupBy("model", "ticker", "pos").agg(F.sum("x").alias("dx")))
    t = moves.filter("pos > 0").groupBy("model", "pos").agg(F.sum(F.abs("dx")).alias("turnover"))
    return t.join(F.broadcast(pos.select("pos", "date")), "pos").select("model", "date", "turnover")


def benchmark(returns: DataFrame, pos: DataFrame) -> DataFrame:
    """Equal-weight mean next return of all names on the scored dates."""
    b = returns.groupBy("date").agg(F.coalesce(F.avg("ret_next_1d"), F.lit(0.0)).alias("benchmark"))
    return b.join(F.broadcast(pos.select("date")), "date", "left_semi")


def run_backtest(signal: DataFrame, returns: DataFrame, cfg: BookConfig, holding: int,
                 bound: int | None = None, held: DataFrame | None = None) -> DataFrame:
    """Daily gross, costs, net, turnover and benchmark for every model of `signal` in one plan."""
    pos = positions_of(signal)
    if held is None:   # read by the results and by the turnover: written once
        held = materialize(sleeves(target_book(signal, cfg, bound), pos, holding, cfg.lag), "held")
    zero = F.lit(0.0)
    d = (frame(signal, pos).join(gross_pnl(held, returns), ["model", "date"], "left")
         .join(turnover(held, pos), ["model", "date"], "left")
         .join(F.broadcast(benchmark(returns, pos)), "date", "left"))
    d = d.withColumns({"gross_pnl": F.coalesce("gross_pnl", zero), "turnover": F.coalesce("turnover", zero),
                       "benchmark": F.coalesce("benchmark", zero)})
    return d.withColumn("costs", F.col("turnover") * (cfg.cost_bps / 1e4)).withColumn(
        "pnl", F.col("gross_pnl") - F.col("costs"))


def score_bin(pr: Column, n_bins: int) -> Column:
    """1-based bin of a percentile, right-closed; the first bin takes everything up to 1/n."""
    return 1 + sum(((pr > b / n_bins).cast("int") for b in range(1, n_bins)), F.lit(0))


def quantile_returns(signal: DataFrame, returns: DataFrame, cfg: BookConfig, bound: int | None = None) -> DataFrame:
    """Mean, annualised return and Sharpe of holding each score bin equally weighted."""
    pos = positions_of(signal)
    d = ladder.percent_rank(signal.filter("score is not null"), ["date", "model"], "score", "pr", bound)
    d = d.select("date", "ticker", "model", score_bin(F.col("pr"), cfg.n_bins).alias("bin"))
    d = d.join(F.broadcast(pos), "date").withColumn("pos", F.col("pos") + cfg.lag).drop("date", "n_dates")
    d = d.join(F.broadcast(pos.select("pos", "date")), "pos")
    r = d.join(returns.select("date", "ticker", "ret_next_1d"), ["date", "ticker"], "left")
    r = r.groupBy("model", "bin", "date").agg(
        (F.sum(F.coalesce("ret_next_1d", F.lit(0.0))) / F.count(F.lit(1))).alias("r"))
    full = frame(signal, pos).withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(cfg.n_bins))))
    r = full.join(r, ["model", "bin", "date"], "left").withColumn("r", F.coalesce("r", F.lit(0.0)))
    m = r.groupBy("model", "bin").agg(F.avg("r").alias("_m"), F.stddev_samp("r").alias("_s"),
                                      F.product(F.lit(1.0) + F.col("r")).alias("_p"), F.count("r").alias("_n"))
    return m.select("model", "bin", (F.col("_m") * 1e4).alias("mean_bps"),
                    (F.pow("_p", cfg.periods_per_year / F.col("_n")) - 1).alias("ann_return"),
                    _sharpe(F.col("_m"), F.col("_s"), cfg.periods_per_year).alias("sharpe"))
