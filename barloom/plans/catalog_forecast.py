"""Calibration and forecast queries on the weekly score models."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import ladder
from barloom.functions.frames import at
from barloom.operators import books as bk, forecast as fc, panel as pn
from barloom.plans.catalog_books import H, SIG, signal
from barloom.plans.registry import query
from barloom.plans.sqlparts import GRID, PANEL, pct, with_
from barloom.sources.signals import kept_scores, long_scores

Z = fc.Z80
_BINS = "1 " + " ".join(f"+ case when pr > {b / 10!r} then 1 else 0 end" for b in range(1, 10))
CAL = SIG + f""",
ex0 as (select *, fwd_ret - avg(fwd_ret) over (partition by date, model) as ex from (select * from sig where ret_next_1d is not null or close is not null) k_),
ex as (select *, {_BINS} as bin from ex0 where pr is not null and ex is not null),
pool as (select model, count(*) as observations, stddev_samp(ex) as pooled_std, stddev_pop(ex) as pop from ex group by model),
cal0 as (select model, bin, count(*) as n, avg(ex) as m, stddev_samp(ex) as s, avg(case when ex > 0 then 1.0 else 0.0 end) as h from ex group by model, bin),
cb as (select p.model, b.bin, coalesce(n, 0) as n, case when coalesce(n, 0) < 20 then 0.0 else m end as mean, case when coalesce(n, 0) < 20 then pop else s end as std,
  case when n >= 20 then h end as hit, observations, pooled_std from pool p cross join range(1, 11) b(bin) left join cal0 c on c.model = p.model and c.bin = b.bin)"""


def ranked(t):
    return fc.ranked_excess(long_scores(kept_scores(t, H)), t.names_bound)


def cal(t):
    return t.keep("cal", lambda: fc.check_enough(fc.calibration_bins(ranked(t))))


CB = "model:s bin:i n:i mean:f std:f hit:f observations:i pooled_std:f"


@query("calibration_bins", CB, with_(CAL, "select * from cb"))
def _(t):
    return cal(t)


@query("monotonicity", "model:s monotonicity:f spread:f", with_(CAL, """, r as (select model, bin, mean, rank() over (partition by model order by mean) +
    (count(*) over (partition by model, mean) - 1) / 2.0 as rk from cb) select model, corr(bin, rk) as monotonicity, arg_max(mean, bin) - arg_min(mean, bin) as spread from r group by model"""))
def _(t):
    return fc.monotonicity(cal(t))


@query("horizon_rescale", "model:s bin:i mean:f std:f", with_(CAL, f"select model, bin, mean * {10 / H} as mean, std * {(10 / H) ** 0.5!r} as std from cb"))
def _(t):
    return fc.horizon_rescale(cal(t), H, 10)


LATEST = CAL + """,
lastp as (select ticker, arg_max(close, date) as price from panel group by ticker),
lat as (select s.model, s.ticker, s.pr * 100 as rank, s.close as price from sig s where s.sid = (select max(sid) from cal) and s.close is not null),
pj as (select l.*, 1 + least(9, greatest(0, cast(floor(rank / 100 * 10) as int))) as bin from lat l where rank is not null and price > 0),
pt as (select p.model, p.ticker, p.price, p.bin, p.rank, c.mean, c.std, c.hit, c.n from pj p join cb c on c.model = p.model and c.bin = p.bin)"""


def latest(t):
    d = long_scores(kept_scores(t, H))
    d = d.filter(F.col("sid") == F.col("n_sessions") - 1)
    d = ladder.percent_rank(d, ["date", "model"], "score", "pr", t.names_bound)
    return d.select("model", "ticker", (F.col("pr") * 100).alias("rank"), F.col("close").alias("price"))


@query("project_targets", "model:s ticker:s price:f bin:i rank:f expected_return:f uncertainty:f target:f target_low:f target_high:f hit:f sample:i signal_to_noise:f",
       with_(LATEST, f"""select model, ticker, price, bin, rank, mean as expected_return, std as uncertainty, price * (1 + mean) as target,
  price * (1 + mean - {Z} * std) as target_low, price * (1 + mean + {Z} * std) as target_high, hit, n as sample, case when std > 0 then abs(mean) / std end as signal_to_noise from pt"""))
def _(t):
    return fc.project_targets(latest(t), cal(t))


@query("bin_lookup", "date:d model:s ticker:s bin:i mean:f std:f", with_(CAL, """select x.date, x.model, x.ticker, x.bin, c.mean, c.std from ex x join cb c on c.model = x.model and c.bin = x.bin"""))
def _(t):
    d = ranked(t).withColumn("bin", bk.score_bin(F.col("pr"), 10))
    return d.join(F.broadcast(cal(t).select("model", "bin", "mean", "std")), ["model", "bin"])


CONE = LATEST + f""",
cone as (select model, ticker, i as step, i / 12.0 * 5 as day, price * (1 + mean * i / 12.0) as mid, price * (1 + mean * i / 12.0 - {Z} * std * sqrt(i / 12.0)) as low,
  price * (1 + mean * i / 12.0 + {Z} * std * sqrt(i / 12.0)) as high from pt cross join range(0, 13) r(i))"""


def cone(t):
    d = latest(t).withColumn("bin", fc.left_bin(F.col("rank"), 10)).filter("rank is not null and price > 0")
    return fc.cone_path(d.join(F.broadcast(cal(t).select("model", "bin", "mean", "std")), ["model", "bin"]), 5)


@query("cone_path", "model:s ticker:s step:i day:f mid:f low:f high:f", with_(CONE, "select * from cone"))
def _(t):
    return cone(t)


@query("udtf_path", "model:s ticker:s points:i last_day:f", with_(CONE, "select model, ticker, count(*) as points, max(day) as last_day from cone group by model, ticker"))
def _(t):
    return cone(t).groupBy("model", "ticker").agg(F.count(F.lit(1)).alias("points"), F.max("day").alias("last_day"))


@query("cone_truncate", "model:s ticker:s day:f mid:f low:f high:f", with_(CONE, """select model, ticker, day, mid, low, high from cone where day <= 3.0
  union all select a.model, a.ticker, 3.0, a.mid + (3.0 - a.day) / (b.day - a.day) * (b.mid - a.mid), a.low + (3.0 - a.day) / (b.day - a.day) * (b.low - a.low),
    a.high + (3.0 - a.day) / (b.day - a.day) * (b.high - a.high) from cone a join cone b on b.model = a.model and b.ticker = a.ticker and b.step = a.step + 1
    where a.day < 3.0 and b.day > 3.0"""))
def _(t):
    return fc.cone_truncate(cone(t), ["model", "ticker"], 3.0, ["mid", "low", "high"])


LAST60 = PANEL + """, l60 as (select *, row_number() over (partition by ticker order by date desc) as b from panel),
l as (select *, max(b) over (partition by ticker) - b as i from l60 where b <= 60)"""


@query("trend_fit", "ticker:s n:i slope_pct:f r2:f end_price:f", with_(LAST60, """, m as (select ticker, regr_slope(ln(close), i) as sl, regr_r2(ln(close), i) as r2, count(*) as n,
    arg_max(close, i) as price from l group by ticker)
  select ticker, n, case when n >= 20 then (exp(sl) - 1) * 100 end as slope_pct, case when n >= 20 then r2 end as r2, case when n >= 20 then price * exp(sl * 5) end as end_price from m"""))
def _(t):
    return fc.trend_fit(t.weekly_bars(), 5)


@query("trend_skill", "observations:i ic:f direction_accuracy:f base_rate_up:f", with_(GRID, f"""
  , s as (select date, ticker, (ln(close) - lag(ln(close), 60) over w) / 60 as slope, lead(close, {H}) over w / close - 1 as fwd from grid window w as (partition by ticker order by sid)),
  k as (select * from s where slope is not null and fwd is not null),
  r as (select *, rank() over (order by slope) + (count(*) over (partition by slope) - 1) / 2.0 as rs, rank() over (order by fwd) + (count(*) over (partition by fwd) - 1) / 2.0 as rf from k)
  select count(*) as observations, corr(rs, rf) as ic, avg(case when (slope > 0) = (fwd > 0) then 1.0 else 0.0 end) as direction_accuracy, avg(case when fwd > 0 then 1.0 else 0.0 end) as base_rate_up from r"""))
def _(t):
    return fc.trend_skill(pn.with_sessions(t.weekly_bars()), H)


@query("realised_vol", "ticker:s n:i vol:f", with_(PANEL, """, b as (select *, row_number() over (partition by ticker order by date desc) as b from panel),
  r as (select *, ln(close / lag(close) over (partition by ticker order by date)) as r from b where b <= 61)
  select ticker, count(*) as n, case when count(*) >= 10 and stddev_samp(r) > 0 then stddev_samp(r) else 0.02 end as vol from r group by ticker"""))
def _(t):
    return fc.realised_vol(t.weekly_bars())


@query("last_n_rows", "ticker:s date:d close:f i:i", with_(LAST60, "select ticker, date, close, i from l"))
def _(t):
    return fc.last_rows(t.weekly_bars(), 60)


@query("swing_points", "ticker:s date:d close:f kind:s", with_(PANEL, """, c as (select *, min(close) over w as lo, max(close) over w as hi, count(*) over w as n from panel
    window w as (partition by ticker order by date rows between 10 preceding and 10 following))
  select ticker, date, close, case when close = lo then 'low' else 'high' end as kind from c where n = 21 and (close = lo or close = hi)"""))
def _(t):
    return fc.swing_points(t.weekly_bars())


EXPAND = CAL + f""",
bd as (select model, nd, b * 63 as boundary from (select distinct model, nd from ex) cross join range(1, 100) r(b) where b * 63 < nd),
eb as (select d.model, d.boundary, k.bin, coalesce(sum(e.ex), 0.0) as cs, count(e.ex) as cn from bd d cross join range(1, 11) k(bin)
  left join ex e on e.model = d.model and e.bin = k.bin and e.pos < greatest(0, d.boundary - {H}) group by d.model, d.boundary, k.bin),
et as (select *, sum(cn) over (partition by model, boundary) as total from eb),
xb as (select model, boundary, bin, case when cn >= 20 then cs / cn else 0.0 end as mean, cn, total from et where total >= 500)"""


def positioned(t):
    """Ranked scores with the position of their session among scored sessions."""
    pos = bk.positions_of(long_scores(kept_scores(t, H)))
    return ranked(t).join(F.broadcast(pos), "date")


@query("expanding_calibration", "model:s boundary:i bin:i mean:f cn:i total:i", with_(EXPAND, "select * from xb"))
def _(t):
    return fc.expanding_calibration(positioned(t), H)


TRACK = EXPAND + f""",
later as (select date, ticker, lead(close, {H}) over (partition by ticker order by sid) as later from grid),
tr0 as (select s.date, s.pos, s.model, s.ticker, s.pr, s.close, l.later, 1 + least(9, greatest(0, cast(floor(s.pr * 100 / 100 * 10) as int))) as bin
  from sig s join later l on l.date = s.date and l.ticker = s.ticker where s.pr is not null and l.later is not null and s.close is not null),
tr as (select a.*, x.mean, a.close * (1 + x.mean) as predicted, x.mean * 100 as predicted_pct, (a.later / a.close - 1) * 100 as actual_pct
  from tr0 a join xb x on x.model = a.model and x.bin = a.bin and x.boundary = (select max(boundary) from xb y where y.model = a.model and y.boundary <= a.pos))"""


def track(t):
    d = long_scores(kept_scores(t, H).withColumn("later", at("close", H)))
    pos = bk.positions_of(d)
    d = ladder.percent_rank(d, ["date", "model"], "score", "pr", t.names_bound).join(F.broadcast(pos), "date")
    return fc.forecast_track(d, fc.expanding_calibration(positioned(t), H))


@query("forecast_track", "date:d model:s ticker:s bin:i predicted:f later:f predicted_pct:f actual_pct:f", with_(TRACK, "select * from tr"))
def _(t):
    return track(t)


@query("track_summary", "model:s ticker:s points:i hit_rate:f mae_pct:f", with_(TRACK, """select model, ticker, count(*) as points,
  avg(case when round(predicted_pct, 4) <> 0 then case when (actual_pct > 0) = (predicted_pct > 0) then 1.0 else 0.0 end end) as hit_rate, avg(abs(actual_pct - predicted_pct)) as mae_pct from tr group by model, ticker"""))
def _(t):
    return fc.track_summary(track(t))


RACE = CAL + f""",
trd as (select date, ticker, exp((ln(close) - lag(ln(close), 60) over w) / 60 * {H}) - 1 as trend from grid window w as (partition by ticker order by sid)),
rc0 as (select s.fwd_ret as actual, t.trend, 1 + cast(floor(least(9.0, greatest(0.0, s.pr * 10 - 1e-9))) as int) as bin from sig s join trd t on t.date = s.date and t.ticker = s.ticker
  where s.model = 'mom' and s.pr is not null and s.fwd_ret is not null and t.trend is not null),
rc as (select actual, 'flat' as forecaster, 0.0 as predicted from rc0 union all select actual, 'trend', trend from rc0
  union all select actual, 'model', c.mean from rc0 join cb c on c.bin = rc0.bin and c.model = 'mom')"""


def race(t):
    d = kept_scores(t, H).withColumn("score", F.col("mom"))
    d = ladder.percent_rank(d, ["date"], "score", "pr", t.names_bound)
    return fc.forecast_race(d, cal(t).filter("model = 'mom'"), H)


@query("forecast_race", "forecaster:s n:i actual_sum:f predicted_sum:l", with_(RACE, "select forecaster, count(*) as n, sum(actual) as actual_sum, sum(predicted) as predicted_sum from rc group by forecaster"))
def _(t):
    return race(t).groupBy("forecaster").agg(F.count(F.lit(1)).alias("n"), F.sum("actual").alias("actual_sum"), F.sum("predicted").alias("predicted_sum"))


@query("forecast_error", "forecaster:s n:i mae_pct:f rmse_pct:f direction_pct:f", with_(RACE, """select forecaster, count(*) as n, avg(abs(predicted - actual)) * 100 as mae_pct,
  sqrt(avg((predicted - actual) * (predicted - actual))) * 100 as rmse_pct, avg(case when (predicted > 0) = (actual > 0) then 1.0 else 0.0 end) * 100 as direction_pct from rc group by forecaster"""))
def _(t):
    return fc.forecast_error(race(t))


@query("block_bootstrap", "ticker:s end_median:f low_p10:f low_p90:f high_p10:f high_p90:f draws:i")
def _(t):
    return fc.block_bootstrap(t.weekly_bars(), 0.01, 5)
