"""Causal features of a long panel: everything at session t uses sessions up to t.

All per-ticker work shares one shuffle on `ticker`; the market series is one row per date and is
broadcast; the cross-sectional ranks share one shuffle on `date`."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from barloom.config import FeatureConfig
from barloom.functions import ladder
from barloom.functions.frames import by_ticker, extremes, guarded, prefix, roll_count, roll_extreme, roll_mean, roll_std
from barloom.functions.nums import finite, ratio
from barloom.functions.smoothing import smooth, span_alpha
from barloom.operators.feature_kernel import INPUTS, all_features, ticker_features
from barloom.operators.panel import calendar, fill_holes, with_sessions
from barloom.session import materialize, release


KEYS = ("date", "ticker")
MANY_NAMES = 20_000             # bound of names from which on rows are counted
PART_BYTES = 10_000_000_000     # unranked features that are dealt by date at a time


def names(cfg: FeatureConfig) -> list[str]:
    out = [f"ret_{n}d" for n in cfg.momentum_windows]
    out += ["mom_12_1", "close_over_sma50", "close_over_sma200", "sma20_over_sma50",
            "dist_52w_high", "dist_52w_low"]
    out += [f"vol_{n}d" for n in cfg.vol_windows]
    out += ["vol_ratio"] if len(cfg.vol_windows) >= 2 else []
    return out + ["atr_pct", "range_5d", "rev_1d", "rev_5d", "rsi", "macd_hist", "bollinger_pctb",
                  "dollar_vol_z", "dollar_vol_log", "vol_trend", "amihud", "gap", "intraday_ret",
                  "close_loc", "beta", "idio_mom_21d", "idio_vol_63d"]


def back(c: str, n: int) -> Column:
    return F.lag(c, n).over(by_ticker())


def grid(panel: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Bars on every session from a ticker's first bar on, with returns and traded value. Sessions
    before the first bar can hold no feature value, so they are not generated."""
    cal = calendar(panel)
    g = fill_holes(with_sessions(panel, cal), cal)
    px = F.last("close", ignorenulls=True).over(by_ticker()) if cfg.pad_gaps else F.col("close")
    return (g.withColumn("px", px)
            .withColumn("ret1", ratio(F.col("px"), back("px", 1)) - 1)
            .withColumn("dv", F.col("close") * F.col("volume"))
            .withColumns({"ldv": F.ln(F.nullif(F.col("dv"), F.lit(0.0))), "impact": ratio(F.abs("ret1"), F.col("dv")),
                          "rng": ratio(F.col("high") - F.col("low"), F.col("close"))}))


def change(n: int) -> Column:
    return ratio(F.col("px"), back("px", n)) - 1


def stage(*needs: str, blocks: tuple[tuple[str, int], ...] = ()):
    """A stage made of expressions over the grid, the running sums of `needs` and the block extremes of `blocks`. Alone it adds
    its columns; `raw_features` adds those of all such stages in one window pass."""
    def wrap(fn):
        def run(d: DataFrame, cfg: FeatureConfig) -> DataFrame:
            for c, n in blocks:
                d = extremes(d, c, n)
            return prefix(d, *needs).withColumns(fn(cfg))
        run.exprs, run.needs, run.blocks, run.__name__ = fn, needs, blocks, fn.__name__
        return run
    return wrap


@stage()
def momentum(cfg):
    return {f"ret_{n}d": change(n) for n in cfg.momentum_windows}


@stage()
def mom_12_1(cfg):
    return {"mom_12_1": ratio(back("close", 21), back("close", 252)) - 1}


@stage("close")
def moving_averages(cfg):
    s20, s50, s200 = (roll_mean("close", n, m) for n, m in ((20, 15), (50, 35), (200, 150)))
    c = F.col("close")
    return {"close_over_sma50": ratio(c, s50) - 1, "close_over_sma200": ratio(c, s200) - 1,
            "sma20_over_sma50": ratio(s20, s50) - 1}


YEAR = 252


@stage("close", blocks=(("close", YEAR),))
def year_extremes(cfg):
    c, known = F.col("close"), roll_count("close", YEAR) >= 180
    return {"dist_52w_high": ratio(c, F.when(known, roll_extreme(F.max, "close", YEAR))) - 1,
            "dist_52w_low": ratio(c, F.when(known, roll_extreme(F.min, "close", YEAR))) - 1}


def _vol(n: int) -> Column:
    return roll_std("ret1", n, max(5, n // 2))


@stage("ret1")
def volatility(cfg):
    out = {f"vol_{n}d": _vol(n) for n in cfg.vol_windows}
    if len(cfg.vol_windows) >= 2:
        out["vol_ratio"] = ratio(_vol(cfg.vol_windows[0]), _vol(cfg.vol_windows[-1])) - 1
    return out


@stage()
def range_5d(cfg):
    # many names have no range at all: the short direct frame keeps their zeros, and so their ties, exact
    return {"range_5d": guarded(F.avg, "rng", 5, 3)}


@stage("ret1")
def reversal(cfg):
    v = _vol(cfg.vol_windows[0])
    return {"rev_1d": ratio(-F.col("ret1"), v), "rev_5d": ratio(-change(5), v * math.sqrt(5))}


@stage("close")
def bollinger(cfg):
    n = cfg.bollinger_window
    mid, sd = roll_mean("close", n, n // 2), roll_std("close", n, n // 2)
    return {"bollinger_pctb": ratio(F.col("close") - mid, sd * 2)}


@stage("ldv")
def dollar_volume(cfg):
    return {"dollar_vol_z": ratio(F.col("ldv") - roll_mean("ldv", 63, 30), roll_std("ldv", 63, 30)),
            "dollar_vol_log": F.col("ldv")}


@stage("dv")
def volume_trend(cfg):
    return {"vol_trend": ratio(roll_mean("dv", 5, 3), roll_mean("dv", 63, 30)) - 1}


@stage("impact")
def amihud(cfg):
    return {"amihud": F.ln(roll_mean("impact", 21, 10) + 1e-15)}


@stage("ret1")
def intraday_shape(cfg):
    v = _vol(cfg.vol_windows[0])
    return {"gap": ratio(ratio(F.col("open"), back("close", 1)) - 1, v),
            "intraday_ret": ratio(ratio(F.col("close"), F.col("open")) - 1, v),
            "close_loc": ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low"))}


def market(d: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Equal-weight market return and its rolling figures: one row per date."""
    w = Window.orderBy("sid")     # calendar rows only
    n = cfg.beta_window
    m = d.groupBy("date", "sid").agg(F.avg("ret1").alias("mkt"))
    return m.select("date", "mkt", guarded(F.avg, "mkt", n, n // 2, w).alias("mkt_mean"),
                    guarded(F.var_samp, "mkt", n, n // 2, w).alias("mkt_var"),
                    guarded(F.sum, "mkt", 21, 15, w).alias("mkt_21"))


def with_market(d: DataFrame, cfg: FeatureConfig) -> DataFrame:
    return d if "mkt" in d.columns else d.join(F.broadcast(market(d, cfg)), "date")


def beta(d: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Population covariance over sample variance, each mean over its own non-null rows."""
    if "beta" in d.columns:
        return d
    d, n = with_market(d, cfg), cfg.beta_window
    d = prefix(d.withColumn("rm", F.col("ret1") * F.col("mkt")), "ret1", "rm")
    xm, x = roll_mean("rm", n, n // 2), roll_mean("ret1", n, n // 2)
    return d.withColumn("beta", ratio(xm - x * F.col("mkt_mean"), F.col("mkt_var")))


def idio_momentum(d: DataFrame, cfg: FeatureConfig) -> DataFrame:
    chg = F.col("_chg21") if "_chg21" in d.columns else change(21)
    return beta(d, cfg).withColumn("idio_mom_21d", chg - F.col("beta") * F.col("mkt_21"))


def idio_volatility(d: DataFrame, cfg: FeatureConfig) -> DataFrame:
    d = beta(d, cfg).withColumn("resid", F.col("ret1") - F.col("beta") * F.col("mkt"))
    return prefix(d, "resid").withColumn("idio_vol_63d", roll_std("resid", 63, 30))


def smoothed(d: DataFrame, cfg: FeatureConfig, want: tuple[str, ...] = ("atr_pct", "rsi", "macd_hist")) -> DataFrame:
    """The recursive features."""
    pc, delta = back("close", 1), F.col("close") - back("close", 1)
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))
    d = d.withColumns({"_tr": true_range, "_up": F.greatest(delta, F.lit(0.0) * delta),
                       "_dn": F.greatest(-delta, F.lit(0.0) * delta)})
    series = {}
    if "atr_pct" in want:
        series["_atr"] = ("_tr", 1 / cfg.atr_window, cfg.atr_window)
    if "rsi" in want:
        series["_gain"] = ("_up", 1 / cfg.rsi_window, cfg.rsi_window)
        series["_loss"] = ("_dn", 1 / cfg.rsi_window, cfg.rsi_window)
    if "macd_hist" in want:
        series["_e12"] = ("close", span_alpha(12), 12)
        series["_e26"] = ("close", span_alpha(26), 26)
    d = smooth(d, series)
    if "atr_pct" in want:
        d = d.withColumn("atr_pct", ratio(F.col("_atr"), F.col("close")))
    if "rsi" in want:
        d = d.withColumn("rsi", 100 - 100 / (1 + ratio(F.col("_gain"), F.col("_loss"))))
    if "macd_hist" in want:
        d = smooth(d.withColumn("_macd", F.col("_e12") - F.col("_e26")), {"_sig": ("_macd", span_alpha(9), 9)})
        d = d.withColumn("macd_hist", ratio(F.col("_macd") - F.col("_sig"), F.col("close"))).drop("_macd", "_sig")
    return d.drop("_tr", "_up", "_dn", *series)


STAGES = (momentum, mom_12_1, moving_averages, year_extremes, volatility, range_5d, reversal, bollinger,
          dollar_volume, volume_trend, amihud, intraday_shape, beta, idio_momentum, idio_volatility, smoothed)


def raw_features(panel: DataFrame, cfg: FeatureConfig, cols: list[str] | None = None, stages=STAGES, series: DataFrame | None = None,
                 days: tuple | None = None) -> DataFrame:
    """Unranked features on the grid: all of them in one pass over the arrays of each ticker, which has at most a row a
    session, or the columns `cols` of some stages. `series` is a stored `market` of the panel; `days` limits the rows of all features,
    from a day up to before another (None: no bound), and takes many tickers at a time."""
    if stages is STAGES:
        cols = cols or names(cfg)
        d = grid(panel, cfg)
        d = with_market(d, cfg) if series is None else d.join(F.broadcast(series), "date")
        schema = d.select("date", "ticker", *[F.lit(None).cast("double").alias(c) for c in cols]).schema
        d = d.select("date", "ticker", "sid", *[F.col(c).cast("double").alias(c) for c in INPUTS])
        if days is None:
            return d.groupBy("ticker").applyInArrow(lambda t: ticker_features(t, cfg, cols), schema)
        # the grid's last window left each ticker whole and in order, and what came after it moves no row
        return d.mapInArrow(lambda batches: all_features(batches, cfg, cols, days), schema)
    plain = [s for s in stages if hasattr(s, "exprs")]
    needs = sorted({"ret1", *(c for s in plain for c in s.needs)})
    d = grid(panel, cfg)
    if smoothed in stages:      # sorts by block, so it goes first, while rows are narrow
        d = smoothed(d, cfg)
    blocks = sorted({b for s in plain for b in s.blocks})
    for c, n in blocks:
        d = extremes(d, c, n)
    d = prefix(d, *needs)
    made = {k: c for s in plain for k, c in s.exprs(cfg).items()}
    d = d.withColumns(made | {"_chg21": change(21)})
    d = d.drop(*[f"_{k}_{c}_{n}" for k in ("x", "pmax", "pmin", "smax", "smin") for c, n in blocks])
    d = d.drop(*[f"_{k}_{c}" for k in "kcs" for c in needs if c != "ret1"], "ldv", "impact", "rng", "dv", "volume", "open", "high", "low")
    for s in stages:
        if s not in plain and s is not smoothed:
            d = s(d, cfg)
    cols = cols or names(cfg)
    return d.select("date", "ticker", *[finite(F.col(c)).alias(c) for c in cols])


def _rank_in_dates(d: DataFrame, cols: list[str], min_names: int) -> DataFrame:
    """One sort of narrow rows (date, feature, value) ranks every column: rows are dealt by date, opened into a row per feature
    there, ranked, and put together again under the same dealing. Rows that agree in all other columns are one."""
    keep = [c for c in d.columns if c not in cols]
    long = d.repartition("date").select(*keep, F.posexplode(F.array(*[F.col(c).cast("double") for c in cols])).alias("_f", "_v"))
    r, n = ladder.rank_expr(["date", "_f"], "_v")
    long = long.withColumn("_p", F.when(F.col("_v").isNotNull() & (n >= min_names), r / n - 0.5))
    wide = long.groupBy(*keep).agg(*[F.max(F.when(F.col("_f") == i, F.col("_p"))).alias(c) for i, c in enumerate(cols)])
    return wide.select(*d.columns)


CELLS = 20_000_000      # values of a date that one task ranks in memory (160 MB)


def _percentile(x: pa.ChunkedArray, min_names: int) -> pa.Array:
    """Average rank over count, less one half, of the known values; null for thin groups. NaN is the largest value."""
    known = x.is_valid().to_numpy()
    v = x.to_numpy()[known]
    out = np.zeros(len(known))
    if len(v) < min_names:
        return pa.nulls(len(known), pa.float64())
    if len(v):
        order = np.argsort(v, kind="stable")
        s = v[order]
        first = np.concatenate([[True], (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))])
        edge = np.concatenate([np.flatnonzero(first), [len(s)]])
        rank = np.empty(len(s))
        rank[order] = np.repeat((edge[:-1] + 1 + edge[1:]) / 2, np.diff(edge))
        out[known] = rank / len(s) - 0.5
    return pa.array(out, mask=~known)


def _rank_dates_in_memory(d: DataFrame, cols: list[str], min_names: int, beside: DataFrame | None = None) -> DataFrame:
    """Rows are dealt by date, and a task ranks one date's columns after the other; the rows of `beside` are dealt so too and joined there."""
    d = d.withColumns({c: F.col(c).cast("double") for c in cols})

    def run(t: pa.Table) -> pa.Table:
        return pa.table([_percentile(t[c], min_names) if c in cols else t[c] for c in t.column_names], t.column_names)
    if beside is None:
        return d.groupBy("date").applyInArrow(run, d.schema)
    more = [f for f in beside.schema.fields if f.name not in KEYS]
    order = [*d.columns, *(f.name for f in more)]

    def meet(t: pa.Table, other: pa.Table) -> pa.Table:
        if not t.num_rows or not other.num_rows:
            return pa.table({c: pa.array([], (t if c in d_names else other)[c].type) for c in order})
        return run(t).join(other.drop_columns(["date"]), "ticker", join_type="inner", use_threads=False).select(order)
    d_names = set(d.columns)
    return (d.groupBy("date").cogroup(beside.filter("date is not null and ticker is not null").groupBy("date"))
            .applyInArrow(meet, StructType([*d.schema.fields, *more])))


def rank_features(d: DataFrame, cols: list[str], min_names: int, bound: int | None = None, beside: DataFrame | None = None) -> DataFrame:
    """Every column to its percentile in the date less one half, NULL on thin dates. The ranks run
    over all names of the date, held or not: in the memory of a task or in one sort of narrow rows where the caller can bound
    the names of a date, else with the ladder; all give the same numbers. A table `beside` is joined by (date, ticker)."""
    if bound is not None and bound * len(d.columns) <= CELLS:
        return _rank_dates_in_memory(d, cols, min_names, beside)
    if beside is not None:
        return rank_features(d, cols, min_names, bound).join(beside, list(KEYS))
    if bound is not None and bound <= ladder.WINDOW_LIMIT:
        return _rank_in_dates(d, cols, min_names)
    keep = [c for c in d.columns if c not in cols]
    long = d.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in cols])).alias("_f"))
    long = long.select(*keep, "_f.feature", "_f.value")
    ranked = ladder.percent_rank(long, ["date", "feature"], "value", "rank", bound, min_names, -0.5)
    return ranked.groupBy(*keep).pivot("feature", cols).agg(F.first("rank"))


def _date_parts(panel: DataFrame, width: int, bound: int | None) -> list[tuple | None]:
    """Stretches of dates whose unranked features, dealt by date, take about PART_BYTES. One row a DATE comes to the driver."""
    if bound is not None and bound < MANY_NAMES:
        return [None]
    counts = panel.groupBy("date").agg(F.count(F.lit(1)).alias("n")).filter("date is not null").orderBy("date").collect()
    parts = min(max(1, -(-sum(r["n"] for r in counts) * width * 8 // PART_BYTES)), max(1, len(counts)))
    if parts == 1:
        return [None]
    upto = np.cumsum([r["n"] for r in counts])
    cuts = sorted({counts[int(i)]["date"] for i in np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts)})
    return list(zip([None, *cuts], [*cuts, None]))


def compute_features(panel: DataFrame, cfg: FeatureConfig, bound: int | None = None, beside: DataFrame | None = None) -> DataFrame:
    """Features of a panel, ranked if the settings say so. A table `beside` is joined by (date, ticker), where the rows of a date are
    anyway. Of a large panel (which should be a stored table, as `beside` should) one stretch of dates is made after the other and
    stored, so that only one of them is dealt by date and on disk unranked."""
    cols = names(cfg)
    if not cfg.rank:
        d = raw_features(panel, cfg)
        return d if beside is None else d.join(beside, list(KEYS))
    parts = _date_parts(panel, len(cols), bound)
    if len(parts) == 1:
        return rank_features(raw_features(panel, cfg, days=(None, None)), cols, cfg.min_names, bound, beside)
    series, made = materialize(market(grid(panel, cfg), cfg), "market"), None
    for low, high in parts:
        def inside(d: DataFrame) -> DataFrame:
            day = F.col("date")
            return d.filter((F.lit(True) if low is None else day >= F.lit(low)) & (F.lit(True) if high is None else day < F.lit(high)))
        raw = raw_features(panel, cfg, series=series, days=(low, high))
        part = materialize(rank_features(raw, cols, cfg.min_names, bound, None if beside is None else inside(beside)), "ranked")
        del raw
        release(panel.sparkSession)
        made = part if made is None else made.unionByName(part)
    made._stored = True     # readers need not store it again
    return made
