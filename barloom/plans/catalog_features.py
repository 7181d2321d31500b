"""Feature, label and split queries on the weekly panel."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from barloom.config import FeatureConfig, LabelConfig, weekly
from barloom.functions.frames import at
from barloom.functions.smoothing import halflife_alpha, smooth
from barloom.operators import features as ft, labels as lb, splits as sp
from barloom.operators.panel import calendar, fill_holes, with_sessions
from barloom.plans.registry import query
from barloom.plans.sqlparts import (BARS, CAL, GRID, MKT, RET, VOL, avg_rank, ewm, guard, pct, with_)

CFG = FeatureConfig()
WEEK = weekly()


def _live(cols: str) -> str:
    return " and ".join(["1=1"]) if not cols else "(" + " or ".join(f"{c} is not null" for c in cols.split()) + ")"


def feature(name: str, cols: str, stage, parts: str, exprs: str, recursive: bool = False, src: str = "ret"):
    """Registers one feature group: rows of the grid where any of its columns has a value."""
    sql = with_(parts, f"select * from (select date, ticker, {exprs} from {src}) as x_ where {_live(cols)}", recursive)

    @query(name, "date:d ticker:s " + " ".join(f"{c}:f" for c in cols.split()), sql)
    def run(t):
        d = stage(ft.grid(t.weekly_bars(), CFG), CFG)
        return d.filter(" or ".join(f"{c} is not null" for c in cols.split()))


MOM = CFG.momentum_windows
feature("feat_momentum", " ".join(f"ret_{n}d" for n in MOM), ft.momentum, GRID, ", ".join(
    f"close / lag(close, {n}) over (partition by ticker order by sid) - 1 as ret_{n}d" for n in MOM), src="grid")
feature("feat_mom_12_1", "mom_12_1", ft.mom_12_1, GRID,
        "lag(close, 21) over (partition by ticker order by sid) / lag(close, 252) over "
        "(partition by ticker order by sid) - 1 as mom_12_1", src="grid")
feature("feat_sma", "close_over_sma50 close_over_sma200 sma20_over_sma50", ft.moving_averages, GRID,
        f"close / ({guard('avg', 'close', 50, 35)}) - 1 as close_over_sma50, "
        f"close / ({guard('avg', 'close', 200, 150)}) - 1 as close_over_sma200, "
        f"({guard('avg', 'close', 20, 15)}) / ({guard('avg', 'close', 50, 35)}) - 1 as sma20_over_sma50", src="grid")
feature("feat_52w", "dist_52w_high dist_52w_low", ft.year_extremes, GRID,
        f"close / ({guard('max', 'close', 252, 180)}) - 1 as dist_52w_high, "
        f"close / ({guard('min', 'close', 252, 180)}) - 1 as dist_52w_low", src="grid")
feature("feat_vol", "vol_21d vol_63d vol_ratio", ft.volatility, VOL,
        "vol_21d, vol_63d, vol_21d / nullif(vol_63d, 0) - 1 as vol_ratio", src="vol")
feature("feat_range_5d", "range_5d", ft.range_5d, GRID.replace("b.volume", "b.volume, (b.high - b.low) / b.close as rg"),
        f"{guard('avg', 'rg', 5, 3)} as range_5d", src="grid")
feature("feat_reversal", "rev_1d rev_5d", ft.reversal, VOL,
        f"-ret1 / bv as rev_1d, -ret5 / (bv * {math.sqrt(5)!r}) as rev_5d", src="vol")
feature("feat_bollinger", "bollinger_pctb", ft.bollinger, GRID,
        f"(close - ({guard('avg', 'close', 20, 10)})) / (2 * nullif({guard('stddev_samp', 'close', 20, 10)}, 0)) "
        "as bollinger_pctb", src="grid")
feature("feat_dollar_vol", "dollar_vol_z dollar_vol_log", ft.dollar_volume, RET,
        f"(ldv - ({guard('avg', 'ldv', 63, 30)})) / nullif({guard('stddev_samp', 'ldv', 63, 30)}, 0) as dollar_vol_z, "
        "ldv as dollar_vol_log")
feature("feat_vol_trend", "vol_trend", ft.volume_trend, RET,
        f"({guard('avg', 'dv', 5, 3)}) / nullif({guard('avg', 'dv', 63, 30)}, 0) - 1 as vol_trend")
feature("feat_amihud", "amihud", ft.amihud, RET + ", imp as (select *, abs(ret1) / nullif(dv, 0) as impact from ret)",
        f"ln({guard('avg', 'impact', 21, 10)} + 1e-15) as amihud", src="imp")
feature("feat_intraday", "gap intraday_ret close_loc", ft.intraday_shape, VOL,
        "(open / pc - 1) / bv as gap, (close / open - 1) / bv as intraday_ret, "
        "(close - low) / nullif(high - low, 0) as close_loc", src="vol")
feature("feat_beta", "beta", ft.beta, MKT, "beta", src="bet")
feature("feat_idio_mom", "idio_mom_21d", ft.idio_momentum, MKT, "ret21 - beta * mkt_21 as idio_mom_21d", src="bet")
feature("feat_idio_vol", "idio_vol_63d", ft.idio_volatility, MKT,
        f"{guard('stddev_samp', 'resid', 63, 30)} as idio_vol_63d", src="res")

EWSRC = RET + """,
ews as (select *, case when pc is null or high is null then high - low
                       else greatest(high - low, abs(high - pc), abs(low - pc)) end as tr,
               case when close > pc then close - pc when close <= pc then 0.0 end as up,
               case when close < pc then pc - close when close >= pc then 0.0 end as dn from ret)"""


def _when(x: str, n: int) -> str:
    return f"case when {x}_n >= {n} then {x} end"


ATR = EWSRC + ", " + ewm("e", "ews", [("atr", "tr", 1 / 14)])
feature("feat_atr", "atr_pct", lambda d, c: ft.smoothed(d, c, ("atr_pct",)), ATR + """,
  j as (select w.date, w.ticker, w.close, e.* exclude (ticker, sid) from e join ews w on e.ticker = w.ticker and e.sid = w.sid)""",
        f"{_when('atr', 14)} / close as atr_pct", True, "j")
RSI = EWSRC + ", " + ewm("e", "ews", [("g", "up", 1 / 14), ("l", "dn", 1 / 14)])
feature("feat_rsi", "rsi", lambda d, c: ft.smoothed(d, c, ("rsi",)), RSI + """,
  j as (select w.date, w.ticker, e.* exclude (ticker, sid) from e join ews w on e.ticker = w.ticker and e.sid = w.sid)""",
        f"100 - 100 / (1 + ({_when('g', 14)}) / nullif({_when('l', 14)}, 0)) as rsi", True, "j")
MACD = (EWSRC + ", " + ewm("e", "ews", [("a", "close", 2 / 13), ("b", "close", 2 / 27)])
        + f", md as (select ticker, sid, ({_when('a', 12)}) - ({_when('b', 26)}) as m from e), "
        + ewm("e2", "md", [("s", "m", 2 / 10)]))
feature("feat_macd", "macd_hist", lambda d, c: ft.smoothed(d, c, ("macd_hist",)), MACD + """,
  j as (select w.date, w.ticker, w.close, md.m, e2.* exclude (ticker, sid) from e2
        join md on md.ticker = e2.ticker and md.sid = e2.sid
        join ews w on e2.ticker = w.ticker and e2.sid = w.sid)""",
        f"(m - ({_when('s', 9)})) / close as macd_hist", True, "j")

# ewm primitives on the market's weekly closes
EWM = GRID + ", " + ewm("e", "grid", [("y", "close", 0.2)])


@query("ewm_recursive", "date:d ticker:s smooth:f", with_(EWM, """select c.date, e.ticker,
  case when y_n >= 3 then y end as smooth from e join cal c on c.sid = e.sid where y_n >= 3""", True))
def _(t):
    cal = calendar(t.weekly_bars())
    g = fill_holes(with_sessions(t.weekly_bars(), cal), cal)
    d = smooth(g, {"smooth": ("close", 0.2, 3)})
    return d.filter("smooth is not null")


HALF = halflife_alpha(10)
EWA = GRID + ", " + ewm("e", "grid", [("y", "close", HALF)], adjust=True)


@query("ewm_adjusted", "date:d ticker:s smooth:f", with_(EWA, """select c.date, e.ticker, y as smooth
  from e join cal c on c.sid = e.sid where y_n >= 5""", True))
def _(t):
    cal = calendar(t.weekly_bars())
    g = fill_holes(with_sessions(t.weekly_bars(), cal), cal)
    d = smooth(g, {"smooth": ("close", HALF, 5)}, adjust=True)
    return d.filter("smooth is not null")


RANKED = ("ret_21d", "vol_63d", "close_loc")


@query("rank_cross_section", "date:d ticker:s ret_21d:f vol_63d:f close_loc:f", with_(
    VOL + ", raw as (select date, ticker, ret21 as ret_21d, vol_63d, (close - low) / nullif(high - low, 0) as close_loc from vol)",
    f"""select * from (select date, ticker, {', '.join(f"{pct('date', c, 20, ' - 0.5')} as {c}" for c in RANKED)} from raw) as x_
    where {_live(' '.join(RANKED))}"""))
def _(t):
    d = ft.grid(t.weekly_bars(), CFG)
    d = ft.intraday_shape(ft.volatility(ft.momentum(d, CFG), CFG), CFG)
    d = d.select("date", "ticker", *RANKED)
    d = ft.rank_features(d, list(RANKED), 20, t.names_bound)
    return d.filter(_live(" ".join(RANKED)))


@query("market_return", "date:d mkt:f names:i", with_(RET, "select date, avg(ret1) as mkt, count(ret1) as names from ret group by date"))
def _(t):
    d = ft.grid(t.weekly_bars(), CFG)
    return d.groupBy("date").agg(F.avg("ret1").alias("mkt"), F.count("ret1").alias("names"))


# ---- the whole feature frame -------------------------------------------------------------------
ALL = ft.names(CFG)
_E = [("atr", "tr", 1 / 14), ("g", "up", 1 / 14), ("l", "dn", 1 / 14), ("a", "close", 2 / 13), ("b", "close", 2 / 27)]
FEATS = MKT + EWSRC[len(RET):] + ", " + ewm("e", "ews", _E) + f""",
md as (select ticker, sid, ({_when('a', 12)}) - ({_when('b', 26)}) as m from e), """ + ewm("e2", "md", [("s", "m", 2 / 10)]) + f""",
wide as (
  select r.*, e.* exclude (ticker, sid), md.m, e2.s, e2.s_n, abs(r.ret1) / nullif(r.dv, 0) as impact, (r.high - r.low) / r.close as rg
  from res r join e on e.ticker = r.ticker and e.sid = r.sid join md on md.ticker = r.ticker and md.sid = r.sid
  join e2 on e2.ticker = r.ticker and e2.sid = r.sid),
feats as (
  select date, sid, ticker, {', '.join(f"close / lag(close, {n}) over (partition by ticker order by sid) - 1 as ret_{n}d" for n in MOM)},
    lag(close, 21) over (partition by ticker order by sid) / lag(close, 252) over (partition by ticker order by sid) - 1 as mom_12_1,
    close / ({guard('avg', 'close', 50, 35)}) - 1 as close_over_sma50,
    close / ({guard('avg', 'close', 200, 150)}) - 1 as close_over_sma200,
    ({guard('avg', 'close', 20, 15)}) / ({guard('avg', 'close', 50, 35)}) - 1 as sma20_over_sma50,
    close / ({guard('max', 'close', 252, 180)}) - 1 as dist_52w_high,
    close / ({guard('min', 'close', 252, 180)}) - 1 as dist_52w_low,
    vol_21d, vol_63d, vol_21d / nullif(vol_63d, 0) - 1 as vol_ratio, {_when('atr', 14)} / close as atr_pct,
    {guard('avg', 'rg', 5, 3)} as range_5d, -ret1 / bv as rev_1d, -ret5 / (bv * {math.sqrt(5)!r}) as rev_5d,
    100 - 100 / (1 + ({_when('g', 14)}) / nullif({_when('l', 14)}, 0)) as rsi,
    (m - ({_when('s', 9)})) / close as macd_hist,
    (close - ({guard('avg', 'close', 20, 10)})) / (2 * nullif({guard('stddev_samp', 'close', 20, 10)}, 0)) as bollinger_pctb,
    (ldv - ({guard('avg', 'ldv', 63, 30)})) / nullif({guard('stddev_samp', 'ldv', 63, 30)}, 0) as dollar_vol_z,
    ldv as dollar_vol_log, ({guard('avg', 'dv', 5, 3)}) / nullif({guard('avg', 'dv', 63, 30)}, 0) - 1 as vol_trend,
    ln({guard('avg', 'impact', 21, 10)} + 1e-15) as amihud, (open / pc - 1) / bv as gap,
    (close / open - 1) / bv as intraday_ret, (close - low) / nullif(high - low, 0) as close_loc, beta,
    ret21 - beta * mkt_21 as idio_mom_21d, {guard('stddev_samp', 'resid', 63, 30)} as idio_vol_63d
  from wide),
ranked as (select date, sid, ticker, {', '.join(f"{pct('date', c, 20, ' - 0.5')} as {c}" for c in ALL)} from feats)"""


@query("feature_frame", "date:d ticker:s " + " ".join(f"{c}:f" for c in ALL),
       with_(FEATS, f"select * from ranked where {_live(' '.join(ALL))}", True))
def _(t):
    bars = t.keep("bars", t.weekly_bars)      # read for the calendar, the grid and the market
    return ft.compute_features(bars, CFG, t.names_bound).filter(_live(" ".join(ALL)))


# ---- labels ------------------------------------------------------------------------------------
H = WEEK.labels.horizon
FWD = GRID + f""",
fwd as (select date, sid, ticker, open, high, low, close, volume,
  lead(close, {H}) over (partition by ticker order by sid) / close - 1 as fwd_ret,
  lead(close, 1) over (partition by ticker order by sid) / close - 1 as ret_next_1d from grid)"""


@query("forward_return", "date:d ticker:s fwd_ret:f ret_next_1d:f", with_(
    FWD, "select date, ticker, fwd_ret, ret_next_1d from fwd where close is not null"))
def _(t):
    return lb.forward_returns(with_sessions(t.weekly_bars()), H)


@query("excess_target", "date:d ticker:s target:f", with_(
    FWD, "select date, ticker, fwd_ret - avg(fwd_ret) over (partition by date) as target from fwd where close is not null"))
def _(t):
    return lb.demean(lb.forward_returns(with_sessions(t.weekly_bars()), H), "fwd_ret", "target")


LABELS = FWD + f""",
exc as (select *, fwd_ret - avg(fwd_ret) over (partition by date) as ex from fwd),
labels_w as (select date, ticker, fwd_ret, {pct('date', 'ex', 20, ' - 0.5')} as target, ret_next_1d from exc where close is not null)"""


@query("rank_target", "date:d ticker:s fwd_ret:f target:f ret_next_1d:f", with_(LABELS, "select * from labels_w"))
def _(t):
    return lb.build_labels(t.weekly_bars(), LabelConfig(horizon=H), t.names_bound)


LOWH = 5
LOWDAY = GRID + """,
ah as (select date, sid, ticker, close, """ + ", ".join(
    f"lead(close, {k}) over (partition by ticker order by sid) as c{k}" for k in range(1, LOWH + 1)) + """ from grid),
low as (select *, case when """ + " and ".join(f"c{k} is not null" for k in range(1, LOWH + 1)) + " then case " + " ".join(
    f"when c{k} = least({', '.join(f'c{j}' for j in range(1, LOWH + 1))}) then {k - 1}" for k in range(1, LOWH + 1)) + """ end end as low_day,
  lag(close) over (partition by ticker order by sid) as pc from ah where true)"""
# the guess of the rule test: buy at once after a fall, at the end of the window after a rise
GUESS = "case when pc is null then null when close < pc then 0 else 4 end"


def _low(t):
    d = lb.low_day(with_sessions(t.weekly_bars()), LOWH).withColumn("pc", at("close", -1))
    return d.withColumn("guess", F.expr(GUESS))


@query("low_day_label", "date:d ticker:s low_day:i", with_(LOWDAY, "select date, ticker, low_day from low where close is not null"))
def _(t):
    return lb.low_day(with_sessions(t.weekly_bars()), LOWH)


@query("buy_at_offset", "rule:s mean_ret:f n:i", with_(LOWDAY, f"""
  select rule, avg(ret) as mean_ret, count(ret) as n from (
    select 'day 1' as rule, c5 / c1 - 1 as ret from low where low_day is not null
    union all select 'day 2', c5 / c2 - 1 from low where low_day is not null
    union all select 'day 3', c5 / c3 - 1 from low where low_day is not null
    union all select 'day 4', c5 / c4 - 1 from low where low_day is not null
    union all select 'day 5', c5 / c5 - 1 from low where low_day is not null
    union all select 'guessed', case {GUESS} when 0 then c5 / c1 - 1 when 4 then 0.0 end from low where low_day is not null and close is not null) u_
  group by rule""".replace("where low_day is not null", "where low_day is not null and close is not null")))
def _(t):
    return lb.buy_at_offset(_low(t).filter("low_day is not null"), LOWH, "guess")


@query("low_day_distribution", "low_day:i share:f", with_(LOWDAY, """
  select low_day, count(*) * 1.0 / sum(count(*)) over () as share from low
  where low_day is not null and close is not null group by low_day"""))
def _(t):
    return lb.class_shares(_low(t).filter("low_day is not null"), "low_day", "share")


@query("confusion_rownorm", "guess:i d0:f d1:f d2:f d3:f d4:f", with_(LOWDAY, f"""
  select {GUESS} as guess, {', '.join(f"avg(case when low_day = {k} then 1.0 else 0.0 end) as d{k}" for k in range(5))}
  from low where low_day is not null and close is not null and pc is not null group by 1"""))
def _(t):
    d = _low(t).filter("low_day is not null and guess is not null")
    return lb.confusion(d, "guess", "low_day", list(range(LOWH)))


@query("classifier_accuracy", "accuracy:f base_rate:f lift:f n:i", with_(LOWDAY, f"""
  , g as (select {GUESS} as guess, low_day from low where low_day is not null and close is not null and pc is not null),
  b as (select max(s) as base_rate from (select count(*) * 1.0 / sum(count(*)) over () as s from g group by low_day) x_)
  select accuracy, base_rate, accuracy - base_rate as lift, n from
  (select avg(case when guess = low_day then 1.0 else 0.0 end) as accuracy, count(*) as n from g) a_, b"""))
def _(t):
    return lb.accuracy(_low(t).filter("low_day is not null and guess is not null"), "guess", "low_day")


# ---- splits ------------------------------------------------------------------------------------
SPLITS = CAL + f""",
nn as (select count(*) as n from cal),
tests as (select k, n - 40 * (k + 1) as start, n - 40 * k as stop from nn, range(4) t_(k)
          where n - 40 * (k + 1) - 4 >= 120),
folds as (select (select max(k) from tests) - k as fold, start, stop, 0 as train_from, start - 4 as train_to from tests)"""


@query("walk_forward_splits", "fold:i role:s sid_from:i sid_to:i date_from:d date_to:d", with_(SPLITS, """, roles as (
  select fold, 'train' as role, train_from as a, train_to as b from folds
  union all select fold, 'test', start, stop from folds)
  select fold, role, a as sid_from, b as sid_to, c.date as date_from, d.date as date_to
  from roles join cal c on c.sid = a join cal d on d.sid = b - 1"""))
def _(t):
    return sp.walk_forward_splits(calendar(t.weekly_bars()), WEEK.splits, H)


@query("train_val_split", "fold:i role:s sid_from:i sid_to:i", with_(SPLITS, """, v as (
  select *, cast(floor((train_to - train_from) * 0.15) as int) as nv, train_to - train_from as n from folds),
  w as (select *, nv < 20 or n - nv - 4 < 50 as none from v)
  select fold, 'fit' as role, train_from as sid_from, case when none then train_to else train_to - nv - 4 end as sid_to from w
  union all select fold, 'val', train_to - nv, train_to from w where not none"""))
def _(t):
    folds = sp.walk_forward_splits(calendar(t.weekly_bars()), WEEK.splits, H)
    return sp.train_val_split(folds, 0.15, H, WEEK.splits.embargo)


@query("check_no_overlap", "fold:i gap:i needed:i ok:b", with_(SPLITS, """
  select fold, start - (train_to - 1) as gap, 4 as needed, start - (train_to - 1) >= 4 as ok from folds"""))
def _(t):
    folds = sp.walk_forward_splits(calendar(t.weekly_bars()), WEEK.splits, H)
    return sp.check_no_overlap(folds, H, WEEK.splits.embargo)


@query("range_fold_join", "fold:i role:s rows_:i tickers:i close_sum:f", with_(SPLITS + BARS[len(CAL):], """, roles as (
  select fold, 'train' as role, train_from as a, train_to as b from folds
  union all select fold, 'test', start, stop from folds)
  select fold, role, count(*) as rows_, count(distinct ticker) as tickers, sum(close) as close_sum
  from bars join roles on sid >= a and sid < b group by fold, role"""))
def _(t):
    cal = calendar(t.weekly_bars())
    d = sp.range_fold_join(with_sessions(t.weekly_bars(), cal), sp.walk_forward_splits(cal, WEEK.splits, H), cal)
    return d.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("rows_"),
                                         F.count_distinct("ticker").alias("tickers"),
                                         F.sum("close").alias("close_sum"))


@query("fold_block", "date:d ticker:s fold:i ret_21d:f vol_63d:f target:f", with_(
    SPLITS + BARS[len(CAL):] + GRID[len(BARS):] + RET[len(GRID):] + VOL[len(RET):] + LABELS[len(GRID):] + f""",
  fr as (select v.date, v.sid, v.ticker, {pct('v.date', 'ret21', 20, ' - 0.5')} as ret_21d, {pct('v.date', 'vol_63d', 20, ' - 0.5')} as vol_63d from vol v)""",
    """select f.date, f.ticker, fo.fold, coalesce(f.ret_21d, 0.0) as ret_21d, coalesce(f.vol_63d, 0.0) as vol_63d, l.target
  from fr f join labels_w l on l.date = f.date and l.ticker = f.ticker
  join folds fo on f.sid >= fo.train_from and f.sid < fo.train_to where l.target is not null"""))
def _(t):
    cal = calendar(t.weekly_bars())
    d = ft.grid(t.weekly_bars(), CFG)
    d = ft.volatility(ft.momentum(d, CFG), CFG).select("date", "sid", "ticker", "ret_21d", "vol_63d")
    d = ft.rank_features(d, ["ret_21d", "vol_63d"], 20, t.names_bound)
    lab = lb.build_labels(t.weekly_bars(), LabelConfig(horizon=H), t.names_bound)
    folds = sp.walk_forward_splits(cal, WEEK.splits, H).filter("role = 'train'")
    d = d.join(lab, ["date", "ticker"])
    return sp.fold_block(sp.range_fold_join(d, folds, cal), ["ret_21d", "vol_63d"])
