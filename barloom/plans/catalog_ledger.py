"""Ledger and model-combination queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.smoothing import halflife_alpha
from barloom.operators import ledger as ld, metrics as mt
from barloom.plans.catalog_books import BOOK, H, IC, MASKED, SIG, ic, signal
from barloom.plans.registry import query
from barloom.plans.sqlparts import ewm, with_
from barloom.session import scratch_path
from barloom.sources import store as st
from barloom.sources.cycles import Cycles
from barloom.sources.signals import kept_scores, long_scores

# every date was logged at 18:00; names of nation-like even volume were logged again at 19:00 with other scores
LED = SIG + """,
preds as (select date, ticker, mom, rev from sc where mom is not null or rev is not null),
prior as (select date, ticker, mom * 0.5 as mom, rev, 'first' as run, cast(date as timestamp) + interval 18 hour as logged_at from preds),
fresh as (select date, ticker, mom, rev, 'second' as run, timestamp '2002-01-01 00:00:00' as logged_at from preds where date = (select max(date) from preds)),
led0 as (select *, row_number() over (partition by date, ticker order by logged_at desc, run desc) as i from (select * from prior union all select * from fresh) u_),
led as (select date, ticker, mom, rev, run, logged_at from led0 where i = 1)"""


def predictions(t):
    return kept_scores(t, H).filter("mom is not null or rev is not null").select("date", "ticker", "mom", "rev")


def prior_log(t):
    """Every date's forecasts as logged at 18:00."""
    return predictions(t).select("date", "ticker", (F.col("mom") * 0.5).alias("mom"), "rev", F.lit("first").alias("run"),
                                 (F.col("date").cast("timestamp_ntz") + F.expr("interval 18 hours")).alias("logged_at"))


def ledger(t):
    return st.ledger_append(prior_log(t), predictions(t), "second", "2002-01-01 00:00:00")


@query("ledger_append", "date:d ticker:s mom:f rev:f run:s logged_at:t", with_(LED, "select * from led"))
def _(t):
    return ledger(t)


@query("resolve_ledger", "date:d ticker:s run:s mom:f realised:f", with_(LED, "select l.*, s.fwd_ret as realised from led l left join sc s on s.date = l.date and s.ticker = l.ticker"))
def _(t):
    return ld.resolve_ledger(ledger(t), kept_scores(t, H))


SCORECARD = with_(LED, """, rs as (select l.*, s.fwd_ret as realised from led l left join sc s on s.date = l.date and s.ticker = l.ticker),
  lg as (select date, 'mom' as model, mom as score, realised from rs union all select date, 'rev', rev, realised from rs),
  dn as (select * from lg where realised is not null and score is not null),
  rk as (select *, rank() over (partition by date, model order by score) + (count(*) over (partition by date, model, score) - 1) / 2.0 as a,
    rank() over (partition by date, model order by realised) + (count(*) over (partition by date, model, realised) - 1) / 2.0 as b from dn),
  di as (select date, model, corr(a, b) as ic from rk group by date, model having count(*) >= 2)
  select n.model, n.n, (select count(*) from rs) as logged, (select count(realised) from rs) as resolved, (select count(*) - count(realised) from rs) as pending,
    d.days, d.ic, d.ic_t from (select model, count(*) as n from dn group by model) n
    join (select model, count(*) as days, avg(ic) as ic, avg(ic) / stddev_samp(ic) * sqrt(count(*)) as ic_t from di group by model) d on d.model = n.model""")


@query("ledger_scorecard", "model:s n:i logged:i resolved:i pending:i days:i ic:f ic_t:f", SCORECARD)
def _(t):
    return ld.ledger_scorecard(ld.resolve_ledger(ledger(t), kept_scores(t, H)), ["mom", "rev"], t.names_bound)


HALF = 20.0
AW = MASKED + f""",
idate as (select date, row_number() over (order by date) - 1 as sid from (select distinct date from icm) d_),
ifr as (select d.date, d.sid, m.model, i.ic from idate d cross join (select 'mom' as model union all select 'rev') m left join icm i on i.date = d.date and i.model = m.model),
ilag as (select date, sid, model, lag(ic, {H}) over (partition by model order by sid) as known from ifr),
""" + ewm("ew", "ilag", [("y", "known", halflife_alpha(HALF))], adjust=True, keys="model") + f""",
araw as (select model, sid, case when y_n >= 10 then greatest(y, 0.0) end as raw from ew),
atot as (select *, sum(raw) over (partition by sid) as tot from araw),
aw as (select d.date, a.sid, a.model, case when tot is null or tot <= 0 then 0.5 when raw is null then 0.5 else raw / tot end as weight from atot a join idate d on d.sid = a.sid)"""


def weights(t):
    i = mt.daily_ic(signal(t), "score", "fwd_ret", BOOK.min_names, t.names_bound)
    return ld.adaptive_weights(i, ["mom", "rev"], H, HALF, 0.0, 10)


@query("adaptive_weights", "date:d model:s weight:f", with_(AW, "select * from aw", True))
def _(t):
    return weights(t)


@query("weight_summary", "model:s mean:f min:f max:f mean_abs_change:f", with_(AW, """, c as (select date, sum(abs(c0)) as c from (
    select date, weight - lag(weight) over (partition by model order by date) as c0 from aw) x_ group by date)
  select model, avg(weight) as mean, min(weight) as min, max(weight) as max, (select avg(coalesce(c, 0.0)) from c) as mean_abs_change from aw group by model""", True))
def _(t):
    return ld.weight_summary(weights(t))


ZS = """,
zs as (select date, ticker, model, (score - avg(score) over (partition by date, model)) / nullif(stddev_samp(score) over (partition by date, model), 0) as z
  from sig where score is not null)"""


@query("ensemble_zscore", "date:d ticker:s score:f", with_(SIG + ZS, "select date, ticker, avg(z) as score from zs where z is not null group by date, ticker"))
def _(t):
    return ld.ensemble_zscore(long_scores(kept_scores(t, H)).filter("score is not null"))


@query("blend", "date:d ticker:s score:f", with_(AW + ZS, """select z.date, z.ticker, sum(z * coalesce(weight, 0.5)) as score from zs z
  left join aw on aw.date = z.date and aw.model = z.model where z is not null group by z.date, z.ticker""", True))
def _(t):
    return ld.blend(long_scores(kept_scores(t, H)).filter("score is not null"), weights(t), 2)


@query("combiner_compare", "combiner:s ic_mean:f ic_t_stat:f sharpe:f sharpe_before_costs:f")
def _(t):
    from barloom.operators.report import evaluate_models
    base = kept_scores(t, H)
    wide = base.select("date", "sid", "n_sessions", "ticker", "fwd_ret", "ret_next_1d", "mom", "rev")
    full = t.keep("combined", lambda: ld.combined_scores(wide, ["mom", "rev"], weights(t)))
    return evaluate_models(full, base, BOOK, H, t.names_bound).withColumnRenamed("model", "combiner")


@query("update_log", "at_:d run:s rows_:i", """with u as (select cast(o_orderdate as date) as at_, o_orderpriority as run, count(*) as rows_ from orders group by 1, 2)
  select * from u order by at_ desc, run desc limit 200""")
def _(t):
    o = t.table("orders").groupBy(F.col("o_orderdate").cast("date").alias("at_"), F.col("o_orderpriority").alias("run")).agg(F.count(F.lit(1)).alias("rows_"))
    return st.update_log(o, 200, "at_")


CYCLE = SCORECARD.replace("select n.model, n.n,", """select 'second' as run, (select max(date) from panel) as last_bar,
    (select count(distinct ticker) from panel) as tickers, (select count(*) from fresh) as forecasts, n.model, n.n,""", 1)
HISTORY = "run string, last_bar date, tickers long, forecasts long, model string, n long, resolved long, pending long, ic double"


@query("daily_update", "run:s last_bar:d tickers:i forecasts:i model:s n:i resolved:i pending:i ic:f", CYCLE)
def _(t):
    """The nightly cycle on the score models, after a ledger of all earlier nights; a second run of the night changes nothing."""
    c, scores = Cycles(t.spark, scratch_path(t.spark, "cycles")), kept_scores(t, H)
    c.run("first", [("ledger", lambda c, key: prior_log(t)), ("history", lambda c, key: t.spark.createDataFrame([], HISTORY))])
    for _ in range(2):
        c.run("second", ld.nightly_steps(scores, predictions(t), ["mom", "rev"], "2002-01-01 00:00:00", t.names_bound))
    return c.table("history")
