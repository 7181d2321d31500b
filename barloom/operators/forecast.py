"""Scores to forward values with their spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions import ladder
from barloom.functions.frames import at
from barloom.functions.nums import finite, ratio
from barloom.operators.books import score_bin
from barloom.operators.labels import demean

Z80 = 1.2816      # fixed value: half-width of an 80 % normal interval


def ranked_excess(d: DataFrame, bound: int | None = None) -> DataFrame:
    """Rows (date, sid, model, ticker, score, fwd_ret) with percentile `pr` and `excess` over the date's mean."""
    keys = ("date", "model")
    d = ladder.percent_rank(d, list(keys), "score", "pr", bound)
    return demean(d, "fwd_ret", "excess", keys).filter("pr is not null and excess is not null")


def calibration_bins(d: DataFrame, n_bins: int = 10, least: int = 20) -> DataFrame:
    """n, mean, std and hit share of each score bin, with the model's totals on every row. Thin bins fall back
    to a zero mean and the pooled population spread. Everything is a partial aggregate."""
    b = d.withColumn("bin", score_bin(F.col("pr"), n_bins))
    m = b.groupBy("model", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("excess").alias("mean"), F.stddev_samp("excess").alias("std"),
        F.avg((F.col("excess") > 0).cast("double")).alias("hit"))
    pooled = d.groupBy("model").agg(F.count(F.lit(1)).alias("observations"), F.stddev_samp("excess").alias("pooled_std"),
                                    F.stddev_pop("excess").alias("_pop"))
    full = pooled.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(n_bins))))
    m = full.join(m, ["model", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    thin = F.col("n") < least
    return m.select("model", "bin", "n", F.when(thin, 0.0).otherwise(F.col("mean")).alias("mean"),
                    F.when(thin, F.col("_pop")).otherwise(F.col("std")).alias("std"),
                    F.when(~thin, F.col("hit")).alias("hit"), "observations", "pooled_std")


def check_enough(cal: DataFrame, least: int = 500) -> DataFrame:
    """Fails the query, at run time, for a model with too few observations."""
    return cal.withColumn("n", F.when(F.col("observations") >= least, F.col("n")).otherwise(
        F.raise_error(F.lit("not enough out-of-sample observations to calibrate")).cast("bigint")))


def monotonicity(cal: DataFrame) -> DataFrame:
    """Rank correlation of bin and mean, and top mean less bottom mean; a handful of rows a model."""
    r = ladder.average_rank(cal, ["model"], "mean", "_r", "_n", bound=1000)
    return r.groupBy("model").agg(finite(F.corr("bin", "_r")).alias("monotonicity"),
                                  (F.max_by("mean", "bin") - F.min_by("mean", "bin")).alias("spread"))


def left_bin(rank: Column, n_bins: int) -> Column:
    """1-based bin of a 0-100 rank, left-closed."""
    return F.least(F.greatest(F.floor(rank / 100 * n_bins), F.lit(0)), F.lit(n_bins - 1)).cast("int") + 1


def project_targets(latest: DataFrame, cal: DataFrame, n_bins: int = 10) -> DataFrame:
    """Target and 80 % band for each (model, ticker, rank, price); bad prices are left out. `cal` has
    n_bins rows a model."""
    good = latest.filter("rank is not null and price is not null and price > 0")
    d = good.withColumn("bin", left_bin(F.col("rank"), n_bins)).join(F.broadcast(cal), ["model", "bin"])
    lo, hi = F.col("mean") - Z80 * F.col("std"), F.col("mean") + Z80 * F.col("std")
    return d.select("model", "ticker", "price", "bin", "rank", F.col("mean").alias("expected_return"),
                    F.col("std").alias("uncertainty"), (F.col("price") * (1 + F.col("mean"))).alias("target"),
                    (F.col("price") * (1 + lo)).alias("target_low"), (F.col("price") * (1 + hi)).alias("target_high"),
                    "hit", F.col("n").alias("sample"),
                    F.when(F.col("std") > 0, F.abs("mean") / F.col("std")).alias("signal_to_noise"))


def horizon_rescale(cal: DataFrame, old: int, new: int) -> DataFrame:
    k = new / old
    return cal.withColumns({"mean": F.col("mean") * k, "std": F.col("std") * k ** 0.5})


def cone_path(d: DataFrame, horizon: int, steps: int = 12) -> DataFrame:
    """Steps of a cone from `price`, `mean`, `std`: linear middle, width with the root of time."""
    f = F.col("step") / steps
    w = Z80 * F.col("std") * F.sqrt(f)
    return (d.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
            .withColumns({"day": f * horizon, "mid": F.col("price") * (1 + F.col("mean") * f),
                          "low": F.col("price") * (1 + F.col("mean") * f - w),
                          "high": F.col("price") * (1 + F.col("mean") * f + w)}))


def cone_truncate(cone: DataFrame, keys: list[str], keep_days: float, values: list[str]) -> DataFrame:
    """The leading part of each curve, ending exactly at the cut by linear reading; curves that end
    before the cut come back whole."""
    w = Window.partitionBy(*keys).orderBy("day")
    d = cone.withColumn("_next", F.lead("day").over(w)).withColumns({f"_n_{v}": F.lead(v).over(w) for v in values})
    d = d.filter(F.col("day") <= keep_days + 1e-9)
    cut = (F.col("_next") > keep_days + 1e-9) & (F.col("day") < keep_days - 1e-9)
    share = (keep_days - F.col("day")) / (F.col("_next") - F.col("day"))
    here = F.struct("day", *values)
    end = F.struct(F.lit(float(keep_days)).alias("day"), *[
        (F.col(v) + share * (F.col(f"_n_{v}") - F.col(v))).alias(v) for v in values])
    return d.select(*keys, F.explode(F.when(cut, F.array(here, end)).otherwise(F.array(here))).alias("_p")).select(*keys, "_p.*")


def last_rows(bars: DataFrame, n: int, order: str = "date") -> DataFrame:
    """The n latest rows of each ticker with `i` counting up from 0."""
    w = Window.partitionBy("ticker").orderBy(F.col(order).desc())
    d = bars.withColumn("_b", F.row_number().over(w)).filter(F.col("_b") <= n)
    return d.withColumn("i", F.max("_b").over(Window.partitionBy("ticker")) - F.col("_b")).drop("_b")


def trend_fit(bars: DataFrame, horizon: int, lookback: int = 60) -> DataFrame:
    """Log-linear fit through each ticker's last closes and its continuation; short histories give NULL."""
    d = last_rows(bars.filter("close > 0"), lookback).withColumn("_y", F.ln("close"))
    m = d.groupBy("ticker").agg(F.regr_slope("_y", "i").alias("slope"), F.regr_r2("_y", "i").alias("_r2"),
                                F.regr_syy("_y", "i").alias("_syy"), F.count(F.lit(1)).alias("n"), F.max_by("close", "i").alias("price"))
    ok = F.col("n") >= max(10, lookback // 3)
    end = F.col("price") * F.exp(F.col("slope") * horizon)
    return m.select("ticker", "n", F.when(ok, F.expm1("slope") * 100).alias("slope_pct"),
                    F.when(ok, F.when(F.col("_syy") > 0, F.col("_r2")).otherwise(0.0)).alias("r2"),
                    F.when(ok, end).alias("end_price"))


def trend_skill(bars: DataFrame, horizon: int, lookback: int = 60, slices: int | None = None) -> DataFrame:
    """Pooled rank correlation of trailing slope and forward return, over all rows. Both ranks come from
    the distributed ladder: the pool is never in one task."""
    y = F.when(F.col("close") > 0, F.ln("close"))
    d = bars.withColumn("_y", y)
    d = d.select("ticker", "date", ((F.col("_y") - at("_y", -lookback)) / lookback).alias("slope"),
                 (ratio(at("close", horizon), F.col("close")) - 1).alias("fwd"))
    d = d.filter("slope is not null and fwd is not null")
    r = ladder.average_rank(d, [], "slope", "_rs", "_n1", slices=slices)
    r = ladder.average_rank(r, [], "fwd", "_rf", "_n2", slices=slices)
    m = r.groupBy().agg(F.count(F.lit(1)).alias("observations"), finite(F.corr("_rs", "_rf")).alias("ic"),
                        F.avg(((F.col("slope") > 0) == (F.col("fwd") > 0)).cast("double")).alias("direction_accuracy"),
                        F.avg((F.col("fwd") > 0).cast("double")).alias("base_rate_up"))
    ok = F.col("observations") >= 500
    return m.select("observations", *[F.when(ok, F.col(c)).alias(c) for c in ("ic", "direction_accuracy", "base_rate_up")])


def realised_vol(bars: DataFrame, lookback: int = 60, default: float = 0.02) -> DataFrame:
    d = last_rows(bars.filter("close > 0"), lookback + 1)
    w = Window.partitionBy("ticker").orderBy("i")
    d = d.withColumn("_r", F.ln(F.col("close") / F.lag("close").over(w)))
    m = d.groupBy("ticker").agg(F.stddev_samp("_r").alias("_s"), F.count(F.lit(1)).alias("n"))
    return m.select("ticker", "n", F.when((F.col("n") >= 10) & (F.col("_s") > 0), F.col("_s")).otherwise(default).alias("vol"))


def swing_points(bars: DataFrame, window: int = 10) -> DataFrame:
    """Bars that are the lowest (else highest) close of a full centred window of the ticker's own bars."""
    w = Window.partitionBy("ticker").orderBy("date")
    c = w.rowsBetween(-window, window)
    d = bars.withColumns({"_lo": F.min("close").over(c), "_hi": F.max("close").over(c), "_n": F.count(F.lit(1)).over(c)})
    kind = F.when(F.col("close") == F.col("_lo"), "low").when(F.col("close") == F.col("_hi"), "high")
    return d.filter(F.col("_n") == 2 * window + 1).withColumn("kind", kind).filter("kind is not null").drop("_lo", "_hi", "_n")


def expanding_calibration(d: DataFrame, horizon: int, step: int = 63, n_bins: int = 10, least: int = 500,
                          thin: int = 20) -> DataFrame:
    """Bin means that were knowable at each boundary session: one pass of sums per (session, bin), then running
    sums over that small table. `d` carries `pos` and `n_dates` of the scored sessions."""
    cells = (d.withColumn("bin", score_bin(F.col("pr"), n_bins)).groupBy("model", "bin", "pos")
             .agg(F.sum("excess").alias("s"), F.count(F.lit(1)).alias("n")))
    top = d.groupBy("model").agg(F.max("n_dates").alias("n_dates"))
    grid = top.withColumn("boundary", F.explode(F.filter(
        F.sequence(F.lit(0), F.col("n_dates") - 1), lambda p: (p > 0) & (p % step == 0))))
    grid = grid.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(n_bins)))).select(
        "model", "bin", (F.col("boundary") - horizon - 1).alias("pos"), "boundary", F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("n"))
    w = Window.partitionBy("model", "bin").orderBy("pos").rangeBetween(Window.unboundedPreceding, 0)
    both = cells.withColumn("boundary", F.lit(None).cast("int")).unionByName(grid)
    run = both.withColumns({"cs": F.sum("s").over(w), "cn": F.sum("n").over(w)}).filter("boundary is not null")
    enough = run.groupBy("model", "boundary").agg(F.sum("cn").alias("total")).filter(F.col("total") >= least)
    mean = F.when(F.col("cn") >= thin, F.col("cs") / F.col("cn")).otherwise(0.0)
    return run.join(enough, ["model", "boundary"]).select("model", "boundary", "bin", mean.alias("mean"), "cn", "total")


def forecast_track(d: DataFrame, expanding: DataFrame, step: int = 63, n_bins: int = 10) -> DataFrame:
    """Past calls (date, pos, model, ticker, pr, close, later) against the price that came: the calibration in
    force is that of the last boundary, so the lookup is an equi join on the boundary number."""
    latest = expanding.groupBy("model").agg(F.min("boundary").alias("_first"))
    calls = d.filter("pr is not null and later is not null").withColumns({
        "bin": left_bin(F.col("pr") * 100, n_bins), "boundary": (F.floor(F.col("pos") / step) * step).cast("int")})
    calls = calls.join(F.broadcast(latest), "model").filter(F.col("boundary") >= F.col("_first"))
    t = calls.join(expanding.select("model", "boundary", "bin", "mean"), ["model", "boundary", "bin"])
    return t.withColumns({"predicted": F.col("close") * (1 + F.col("mean")), "predicted_pct": F.col("mean") * 100,
                          "actual_pct": (F.col("later") / F.col("close") - 1) * 100})


def track_summary(track: DataFrame) -> DataFrame:
    called = F.when(F.round("predicted_pct", 4) != 0, ((F.col("actual_pct") > 0) == (F.col("predicted_pct") > 0)).cast("double"))
    return track.groupBy("model", "ticker").agg(
        F.count(F.lit(1)).alias("points"), F.avg(called).alias("hit_rate"),
        F.avg(F.abs(F.col("actual_pct") - F.col("predicted_pct"))).alias("mae_pct"))


def forecast_error(rows: DataFrame) -> DataFrame:
    """MAE, RMSE and direction share of each `forecaster` from relative `predicted` and `actual` moves."""
    e = F.col("predicted") - F.col("actual")
    return rows.groupBy("forecaster").agg(
        F.count(F.lit(1)).alias("n"), (F.avg(F.abs(e)) * 100).alias("mae_pct"), (F.sqrt(F.avg(e * e)) * 100).alias("rmse_pct"),
        (F.avg(((F.col("predicted") > 0) == (F.col("actual") > 0)).cast("double")) * 100).alias("direction_pct"))


def forecast_race(d: DataFrame, cal: DataFrame, horizon: int, lookback: int = 60, n_bins: int = 10) -> DataFrame:
    """No change, trend and calibrated score on the same rows. `d` has sid, close, fwd_ret, pr."""
    y = F.ln("close")
    d = d.withColumn("trend", F.exp((y - at(y, -lookback)) / lookback * horizon) - 1)
    d = d.filter("pr is not null and fwd_ret is not null and trend is not null")
    b = F.least(F.greatest(F.col("pr") * n_bins - 1e-9, F.lit(0.0)), F.lit(n_bins - 1.0)).cast("int") + 1
    d = d.withColumn("bin", b).join(F.broadcast(cal.select("bin", "mean")), "bin")
    three = F.array(*[F.struct(F.lit(n).alias("forecaster"), c.alias("predicted")) for n, c in (
        ("flat", F.lit(0.0)), ("trend", F.col("trend")), ("model", F.col("mean")))])
    return d.select(F.col("fwd_ret").alias("actual"), F.explode(three).alias("_f")).select("actual", "_f.*")


def block_bootstrap(bars: DataFrame, mean: float, horizon: int, draws: int = 201, block: int = 3, seed: int = 0,
                    least: int = 120) -> DataFrame:
    """Futures of each ticker from contiguous blocks of its own returns, recentred to `mean`: median end and
    the 10th and 90th percentiles of the lowest and highest point. Block starts are hashes, so a rerun
    or a lost task gives the same draws. A ticker's history is an array bounded by the calendar."""
    w = Window.partitionBy("ticker").orderBy("date")
    d = bars.filter("close > 0").withColumn("_r", F.ln(F.col("close") / F.lag("close").over(w)))
    h = d.groupBy("ticker").agg(F.sort_array(F.collect_list(F.when(F.col("_r").isNotNull(), F.struct("date", "_r")))).alias("_h"),
                                F.avg("_r").alias("_m"), F.max_by("close", "date").alias("price"), F.count(F.lit(1)).alias("n"))
    h = h.filter(F.col("n") >= least).withColumn("_h", F.col("_h._r"))
    blocks = -(-horizon // block)
    h = h.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    starts = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.pmod(
        F.xxhash64("ticker", "draw", k, F.lit(seed)), F.size("_h") - block).cast("int"))
    steps = F.slice(F.flatten(F.transform(starts, lambda s: F.slice("_h", s + 1, block))), 1, horizon)
    path = F.aggregate(steps, F.array(F.lit(0.0)), lambda acc, r: F.concat(
        acc, F.array(F.element_at(acc, -1) + r - F.col("_m") + mean / horizon)))
    p = h.select("ticker", "price", path.alias("_p"))
    p = p.select("ticker", (F.col("price") * F.exp(F.element_at("_p", -1))).alias("end"),
                 (F.col("price") * F.exp(F.array_min("_p"))).alias("low"), (F.col("price") * F.exp(F.array_max("_p"))).alias("high"))
    q = lambda c, x: F.percentile(c, F.lit(x))    # noqa: E731  (`draws` values a ticker)
    return p.groupBy("ticker").agg(q("end", 0.5).alias("end_median"), q("low", 0.1).alias("low_p10"), q("low", 0.9).alias("low_p90"),
                                   q("high", 0.1).alias("high_p10"), q("high", 0.9).alias("high_p90"), F.count(F.lit(1)).alias("draws"))
