"""Book construction, results and skill queries on the two weekly score models."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import functions as F

from barloom.config import weekly
from barloom.operators import books as bk, metrics as mt, report as rp
from barloom.plans.registry import query
from barloom.plans.sqlparts import GRID, pct, with_
from barloom.sources.signals import kept_scores, long_scores

WEEK = weekly()
BOOK, H = WEEK.book, WEEK.labels.horizon
PPY, SQ = BOOK.periods_per_year, math.sqrt(BOOK.periods_per_year)

SIG = GRID + f""",
sc as (select date, sid, ticker, open, high, low, close, volume,
  close / lag(close, 21) over (partition by ticker order by sid) - 1 as mom,
  -(close / lag(close, 1) over (partition by ticker order by sid) - 1) as rev,
  lead(close, {H}) over (partition by ticker order by sid) / close - 1 as fwd_ret,
  lead(close, 1) over (partition by ticker order by sid) / close - 1 as ret_next_1d from grid),
sig0 as (select *, 'mom' as model, mom as score from sc union all select *, 'rev', rev from sc),
oos as (select date, row_number() over (order by date) - 1 as pos, count(*) over () as nd
        from (select distinct date from sig0 where score is not null) d_),
sig as (select s.*, o.pos, o.nd, {pct('s.date, s.model', 's.score')} as pr,
        count(s.score) over (partition by s.date, s.model) as n
        from sig0 s join oos o on o.date = s.date)"""


def legs_sql(cfg) -> str:
    lo, hi = repr(cfg.quantile), repr(1 - cfg.quantile)
    if cfg.signal_weighted:
        raw = f"case when n >= {cfg.min_names} and (pr >= {hi} or pr <= {lo}) then pr - 0.5 else 0.0 end"
    else:
        short = f"case when pr <= {lo} and n >= {cfg.min_names} then 1.0 else 0.0 end" if cfg.long_short else "0.0"
        raw = f"case when pr >= {hi} and n >= {cfg.min_names} then 1.0 else 0.0 end - {short}"
    return f""",
leg0 as (select date, pos, nd, ticker, model, ret_next_1d, fwd_ret, pr, score, cast({raw} as double) as sraw from sig),
leg as (select *, case when sraw > 0 then 'long' when sraw < 0 then 'short' end as side, abs(sraw) as raw from leg0)"""


def fill_sql(cfg) -> str:
    T, cap = (cfg.gross / 2 if cfg.long_short else cfg.gross), cfg.max_weight * cfg.gross
    keep = "sraw <> 0" if cfg.long_short else "sraw > 0"
    g = "partition by date, model, side"
    return f""",
wf0 as (select *, row_number() over ({g} order by raw desc, ticker) as i, count(*) over ({g}) as nl,
        sum(raw) over ({g} order by raw desc, ticker rows between current row and unbounded following) as suf
        from leg where {keep}),
wf1 as (select *, case when ({T} - (i - 1) * {cap}) * raw > {cap} * suf then 1 else 0 end as hit from wf0),
wf2 as (select *, sum(hit) over ({g}) as c, sum(case when hit = 0 then raw end) over ({g}) as free from wf1),
wf as (select date, model, ticker, side, raw, case when hit = 1 then {cap} else ({T} - c * {cap}) * raw / free end as w from wf2)"""


NEUTRAL = """,
gr as (select date, model, coalesce(sum(case when side = 'long' then w end), 0) as lg,
       coalesce(sum(case when side = 'short' then w end), 0) as sh from wf group by date, model),
tgt0 as (select wf.date, wf.model, wf.ticker,
  case when side = 'long' then w * least(lg, sh) / nullif(lg, 0) else -w * least(lg, sh) / nullif(sh, 0) end as w
  from wf join gr on gr.date = wf.date and gr.model = wf.model)"""
LONGONLY = """,
tgt0 as (select date, model, ticker, w from wf)"""
BOOKS = f""",
tgt as (select s.date, s.pos, s.nd, s.model, s.ticker, s.ret_next_1d, s.pr, s.score, coalesce(t.w, 0.0) as w
        from sig s left join tgt0 t on t.date = s.date and t.model = s.model and t.ticker = s.ticker),
slv as (select *, avg(w) over (partition by model, ticker order by pos rows between {H - 1} preceding and current row) as sleeve from tgt),
held as (select *, lag(sleeve, {BOOK.lag}, 0.0) over (partition by model, ticker order by pos) as held from slv),
chg as (select *, coalesce(abs(held - lag(held) over (partition by model, ticker order by pos)), 0.0) as chg from held),
daily as (select model, date, pos, sum(held * coalesce(ret_next_1d, 0.0)) as gross_pnl, sum(chg) as turnover,
          coalesce(avg(ret_next_1d), 0.0) as benchmark, sum(chg) * {BOOK.cost_bps / 1e4} as costs,
          sum(held * coalesce(ret_next_1d, 0.0)) - sum(chg) * {BOOK.cost_bps / 1e4} as pnl from chg group by model, date, pos)"""
BT = SIG + legs_sql(BOOK) + fill_sql(BOOK) + NEUTRAL + BOOKS


def signal(t):
    return long_scores(kept_scores(t, H))


WEIGHTED = replace(BOOK, signal_weighted=True, max_weight=0.06)
LONG = replace(BOOK, long_short=False, max_weight=0.2)


@query("quantile_legs", "date:d model:s ticker:s side:s raw:f", with_(
    SIG + legs_sql(WEIGHTED), "select date, model, ticker, side, raw from leg where side is not null"))
def _(t):
    return bk.quantile_legs(signal(t), WEIGHTED, t.names_bound)


@query("waterfill_cap", "date:d model:s ticker:s side:s w:f", with_(
    SIG + legs_sql(WEIGHTED) + fill_sql(WEIGHTED), "select * from wf"))
def _(t):
    return bk.waterfill(bk.quantile_legs(signal(t), WEIGHTED, t.names_bound), 0.5, 0.06)


@query("dollar_neutral_trim", "date:d model:s ticker:s w:f", with_(
    SIG + legs_sql(WEIGHTED) + fill_sql(WEIGHTED) + NEUTRAL, "select * from tgt0"))
def _(t):
    return bk.target_book(signal(t), WEIGHTED, t.names_bound)


@query("long_only_book", "date:d model:s ticker:s w:f", with_(
    SIG + legs_sql(LONG) + fill_sql(LONG) + LONGONLY, "select * from tgt0"))
def _(t):
    return bk.target_book(signal(t), LONG, t.names_bound)


def _held(t, lag: int):
    s = signal(t)
    return bk.sleeves(bk.target_book(s, BOOK, t.names_bound), bk.positions_of(s), H, lag)


@query("overlapping_sleeves", "date:d model:s ticker:s held:f", with_(
    BT, "select date, model, ticker, sleeve as held from slv where abs(sleeve) > 1e-12"))
def _(t):
    return _held(t, 0).filter("abs(held) > 1e-12")


@query("execution_lag", "date:d model:s ticker:s held:f", with_(
    BT, "select date, model, ticker, held from held where abs(held) > 1e-12"))
def _(t):
    return _held(t, BOOK.lag).filter("abs(held) > 1e-12")


def daily(t):
    s = signal(t)
    return bk.run_backtest(s, kept_scores(t, H), BOOK, H, t.names_bound)


@query("gross_pnl", "date:d model:s gross_pnl:f", with_(BT, "select * from daily where pos > 0"))
def _(t):
    s = signal(t)
    pos = bk.positions_of(s)
    held = bk.sleeves(bk.target_book(s, BOOK, t.names_bound), pos, H, BOOK.lag)
    d = bk.frame(s, pos).filter("pos > 0").join(bk.gross_pnl(held, kept_scores(t, H)), ["model", "date"], "left")
    return d.withColumn("gross_pnl", F.coalesce("gross_pnl", F.lit(0.0)))


@query("turnover_costs", "date:d model:s turnover:f costs_bps:f net:f", with_(
    BT, "select date, model, turnover, costs * 1e4 as costs_bps, gross_pnl - costs as net from daily"))
def _(t):
    return daily(t).withColumns({"net": F.col("pnl"), "costs_bps": F.col("costs") * 1e4})


@query("benchmark_equal_weight", "date:d benchmark:f", with_(
    SIG, "select date, coalesce(avg(ret_next_1d), 0.0) as benchmark from sig where model = 'mom' group by date"))
def _(t):
    return bk.benchmark(kept_scores(t, H), bk.positions_of(signal(t)))


@query("run_backtest", "date:d model:s gross_pnl:f pnl:f turnover:f benchmark:f", with_(BT, "select * from daily"))
def _(t):
    return daily(t)


CURVE = BT + """,
eq as (select *, product(1 + pnl) over (partition by model order by date rows unbounded preceding) as equity from daily),
dd as (select *, equity / max(equity) over (partition by model order by date rows unbounded preceding) - 1 as drawdown from eq)"""


@query("equity_curve", "date:d model:s equity:l", with_(CURVE, "select * from eq"))
def _(t):
    return mt.equity_curve(daily(t))


@query("drawdown", "date:d model:s equity:l drawdown:l", with_(CURVE, "select * from dd"))
def _(t):
    return mt.drawdown(mt.equity_curve(daily(t)))


def perf_sql(value: str, src: str, keys: str = "model") -> str:
    return f"""select {keys}, n_days, round(years, 2) as years, eq - 1 as total_return, power(eq, 1 / years) - 1 as ann_return,
  sd * {SQ!r} as ann_vol, m / sd * {SQ!r} as sharpe, m / down * {SQ!r} as sortino, mdd as max_drawdown,
  case when mdd < 0 then (power(eq, 1 / years) - 1) / abs(mdd) end as calmar, hit as hit_rate,
  m / sd * {SQ!r} * sqrt(years) as t_stat, tov as avg_turnover, tov * {PPY} as ann_turnover from (
  select {keys}, count(*) as n_days, count(*) / {PPY}.0 as years, product(1 + {value}) as eq, avg({value}) as m,
    stddev_samp({value}) as sd, stddev_samp(case when {value} < 0 then {value} end) as down, min(dd_) as mdd,
    avg(case when {value} > 0 then 1.0 else 0.0 end) as hit, avg(turnover) as tov
  from (select *, e_ / max(e_) over (partition by {keys} order by date rows unbounded preceding) - 1 as dd_ from (
    select *, product(1 + {value}) over (partition by {keys} order by date rows unbounded preceding) as e_ from {src}) a_) b_
  group by {keys}) c_"""


PERF = ("model:s n_days:i years:f total_return:l ann_return:f ann_vol:f sharpe:f sortino:f max_drawdown:f calmar:f "
        "hit_rate:f t_stat:f avg_turnover:f ann_turnover:f")


@query("performance_metrics", PERF + " sharpe_before_costs:f ann_return_before_costs:f", with_(
    BT, f"""select n.*, g.sharpe as sharpe_before_costs, g.ann_return as ann_return_before_costs
    from ({perf_sql('pnl', 'daily')}) n join ({perf_sql('gross_pnl', 'daily')}) g on g.model = n.model"""))
def _(t):
    return rp.net_and_gross(daily(t), PPY)


IC = SIG + f""",
rk as (select *, rank() over (partition by date, model order by score nulls last) + (count(*) over (partition by date, model, score) - 1) / 2.0 as rs,
       rank() over (partition by date, model order by fwd_ret nulls last) + (count(*) over (partition by date, model, fwd_ret) - 1) / 2.0 as rf from sig),
ic as (select date, model, count(*) as names, corr(rs, rf) as ic from rk where score is not null and fwd_ret is not null
       group by date, model having count(*) >= {BOOK.min_names}),
ics as (select model, avg(ic) as ic_mean, stddev_samp(ic) as ic_std, avg(ic) / stddev_samp(ic) as icir,
        avg(case when ic > 0 then 1.0 else 0.0 end) as ic_positive_rate, count(ic) as ic_days,
        avg(ic) / stddev_samp(ic) * sqrt(count(ic)) as ic_t_stat from ic group by model)"""


def ic(t):
    return mt.daily_ic(signal(t), "score", "fwd_ret", BOOK.min_names, t.names_bound, mask_first=False)


@query("information_coefficient", "model:s ic_mean:f ic_std:f icir:f ic_positive_rate:f ic_days:i ic_t_stat:f",
       with_(IC, "select * from ics"))
def _(t):
    return mt.ic_summary(ic(t))


MASKED = SIG + f""",
bo as (select * from sig where score is not null and fwd_ret is not null),
rkm as (select *, rank() over (partition by date, model order by score) + (count(*) over (partition by date, model, score) - 1) / 2.0 as rs,
       rank() over (partition by date, model order by fwd_ret) + (count(*) over (partition by date, model, fwd_ret) - 1) / 2.0 as rf from bo),
icm as (select date, model, count(*) as names, corr(rs, rf) as ic from rkm group by date, model having count(*) >= {BOOK.min_names})"""


@query("daily_model_ic", "date:d model:s names:i ic:f", with_(MASKED, "select * from icm"))
def _(t):
    return mt.daily_ic(signal(t), "score", "fwd_ret", BOOK.min_names, t.names_bound)


@query("udaf_spearman", "date:d model:s names:i ic:f", with_(
    MASKED.replace(f"having count(*) >= {BOOK.min_names}", "having count(*) >= 3"), "select * from icm"))
def _(t):
    return mt.daily_ic(signal(t), "score", "fwd_ret", 3, t.names_bound)


@query("rolling_ic", "date:d model:s ic_mean:f", with_(IC, """select date, model, case when count(ic) over w >= 21 then avg(ic) over w end as ic_mean
  from ic window w as (partition by model order by date rows between 20 preceding and current row)"""))
def _(t):
    return mt.rolling_ic(ic(t))


QR = SIG + f""",
bn as (select *, case when pr is null then null else least({BOOK.n_bins}, 1 {' '.join(f'+ case when pr > {b / BOOK.n_bins!r} then 1 else 0 end' for b in range(1, BOOK.n_bins))}) end as bin from sig),
lg as (select model, pos, ret_next_1d, lag(bin, {BOOK.lag}) over (partition by model, ticker order by pos) as bin from bn),
dr as (select model, pos, bin, sum(coalesce(ret_next_1d, 0.0)) / count(*) as r from lg where bin is not null group by model, pos, bin),
fr as (select m.model, o.pos, b.bin from (select distinct model from sig) m, oos o, range(1, {BOOK.n_bins + 1}) b(bin)),
qr as (select fr.model, fr.bin, avg(coalesce(r, 0.0)) as m, stddev_samp(coalesce(r, 0.0)) as s, product(1 + coalesce(r, 0.0)) as p, count(*) as n
       from fr left join dr on dr.model = fr.model and dr.pos = fr.pos and dr.bin = fr.bin group by fr.model, fr.bin)"""


@query("quantile_returns", "model:s bin:i mean_bps:f ann_return:l sharpe:f", with_(
    QR, f"select model, bin, m * 1e4 as mean_bps, power(p, {PPY}.0 / n) - 1 as ann_return, m / s * {SQ!r} as sharpe from qr"))
def _(t):
    return bk.quantile_returns(signal(t), kept_scores(t, H), BOOK, t.names_bound)


EVAL = BT + IC[len(SIG):]
EVAL_COLS = ("model:s sharpe:f sharpe_before_costs:f ann_return:l ann_vol:f max_drawdown:f hit_rate:f t_stat:f ic_mean:f "
             "icir:f ic_t_stat:f ic_positive_rate:f avg_turnover:f n_days:i")
EVAL_SQL = f"""select n.model, n.sharpe, g.sharpe as sharpe_before_costs, n.ann_return, n.ann_vol, n.max_drawdown, n.hit_rate,
  n.t_stat, i.ic_mean, i.icir, i.ic_t_stat, i.ic_positive_rate, n.avg_turnover, n.n_days
  from ({perf_sql('pnl', 'daily')}) n join ({perf_sql('gross_pnl', 'daily')}) g on g.model = n.model
  left join ics i on i.model = n.model"""


@query("evaluate_models", EVAL_COLS, with_(EVAL, EVAL_SQL))
def _(t):
    return rp.evaluate_models(signal(t), kept_scores(t, H), BOOK, H, t.names_bound)


BENCH = f"""select 'buy and hold' as model, sharpe, null as sharpe_before_costs, ann_return, ann_vol, max_drawdown, hit_rate,
  t_stat, null as ic_mean, null as icir, null as ic_t_stat, null as ic_positive_rate, null as avg_turnover, n_days
  from ({perf_sql('benchmark', "(select * from daily where model = 'mom') z_")}) b"""


@query("summary_table", EVAL_COLS + " best:b", with_(
    EVAL, f"""select s.*, s.model = (select max_by(model, sharpe) from ({EVAL_SQL}) e_) as best
    from ({EVAL_SQL} union all {BENCH}) s"""))
def _(t):
    s, r = signal(t), kept_scores(t, H)
    return rp.summary_table(s, r, BOOK, H, t.names_bound)


@query("verdict", "model:s label:s", with_(EVAL, f"""
  select s.model, case when s.ic_mean is null or s.ic_t_stat is null then 'not enough data'
    when abs(s.ic_mean) > 0.15 then 'suspect' when abs(s.ic_t_stat) < 2 then 'no signal'
    when s.ic_t_stat < 0 then 'negative' when s.sharpe <= b.sharpe then 'loses to holding'
    when s.sharpe > b.sharpe then 'good' else 'signal' end as label
  from ({EVAL_SQL}) s, ({BENCH}) b"""))
def _(t):
    return rp.verdict(rp.summary_table(signal(t), kept_scores(t, H), BOOK, H, t.names_bound))
