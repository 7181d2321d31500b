"""Trading-rule and holdings queries on the weekly momentum ranks."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from barloom.functions import ladder
from barloom.functions.currency import currency_of
from barloom.operators import books as bk, forecast as fc, holdings as hd, quotes as qt, rules as ru, runs as rn
from barloom.operators.panel import with_sessions
from barloom.plans.catalog_books import H, PPY, SIG
from barloom.plans.catalog_forecast import CAL, cal
from barloom.plans.catalog_panel import QUOTES
from barloom.plans.registry import query
from barloom.plans.sqlparts import BARS, PANEL, with_
from barloom.sources.signals import kept_scores, long_scores

Z = fc.Z80
RK = SIG + """,
rk as (select s.date, s.sid, s.ticker, s.open, s.high, s.low, s.close, s.volume, g.pr * 100 as rank, g.pos, g.nd, c.n_sessions
  from sc s join cal c on c.sid = s.sid left join sig g on g.date = s.date and g.ticker = s.ticker and g.model = 'mom' where s.close is not null)"""


def ranks(t):
    """Bars with the momentum rank 0-100 of their session."""
    def make():
        d = ladder.percent_rank(kept_scores(t, H), ["date"], "mom", "rank", t.names_bound)
        return d.withColumn("rank", F.col("rank") * 100)
    return t.keep("ranks", make)


DB = RK + """,
ev as (select *, case when rank >= 90 then 1 when rank is null or rank < 30 then -1 end as e from rk),
db as (select *, coalesce(last_value(e ignore nulls) over (partition by ticker order by sid rows unbounded preceding), -1) = 1 as held from ev)"""


@query("deadband_positions", "date:d ticker:s rank:f held:b", with_(DB, "select * from db"))
def _(t):
    return ru.deadband_positions(ranks(t))


# holdings: what all trades of the lines leave, trade by trade
POSITIONS = """
ht as materialized (select concat('S', l_suppkey) as ticker, case when l_returnflag = 'R' then 'sell' else 'buy' end as action, l_quantity as q, l_extendedprice / l_quantity as p,
  cast(l_shipdate as date) as at_, row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount) as i from lineitem),
hc as (select ticker, i, case when action = 'buy' then q else 0.0 end as qty, case when action = 'buy' then p else 0.0 end as cost from ht where i = 1
  union all select t.ticker, t.i, case when t.action = 'buy' then a.qty + t.q else greatest(a.qty - t.q, 0.0) end,
    case when t.action = 'buy' then (a.cost * a.qty + t.p * t.q) / (a.qty + t.q) else a.cost end from hc a join ht t on t.ticker = a.ticker and t.i = a.i + 1),
hold as materialized (select h.ticker, qty as shares, round(cost, 4) as entry_price, entry_at from (select ticker, arg_max(qty, i) as qty, arg_max(cost, i) as cost from hc group by ticker) h
  join (select ticker, min(at_) as entry_at from ht where action = 'buy' group by ticker) f on f.ticker = h.ticker where qty > 0)"""
HOLD = "," + POSITIONS + """,
lastq as (select ticker, arg_max(close, date) as price from panel group by ticker),
lastr as (select ticker, rank from rk where sid = (select max(sid) from cal))"""


def holdings(t):
    return t.keep("positions", lambda: hd.positions(t.trades()))


def last_price(t):
    return ranks(t).groupBy("ticker").agg(F.max_by("close", "date").alias("price"))


def last_rank(t):
    return ranks(t).filter("sid = n_sessions - 1").select("ticker", "rank", F.col("close").alias("px"))


@query("planned_exits", "ticker:s shares:f rank:f price:f value:f pnl:f reason:s", with_(RK + HOLD, """select h.ticker, h.shares, r.rank, q.price, h.shares * q.price as value,
  h.shares * (q.price - h.entry_price) as pnl, case when r.rank is null then 'not scored' else 'below exit' end as reason
  from hold h left join lastr r on r.ticker = h.ticker left join lastq q on q.ticker = h.ticker where r.rank is null or r.rank < 30""", True))
def _(t):
    return ru.planned_exits(holdings(t), last_rank(t), last_price(t))


@query("peak_exit_flag", "date:d ticker:s peak:f peaked:b", with_(PANEL, """, p as (select *, case when count(close) over w >= 30 then max(close) over w end as peak from panel
  window w as (partition by ticker order by date rows between 59 preceding and current row)) select date, ticker, peak, coalesce(close >= peak, false) as peaked from p"""))
def _(t):
    return ru.peak_exit_flag(t.weekly_bars())


@query("band_exit_flag", "date:d ticker:s entry_price:f target:f hit_date:d", with_(CAL + RK[len(SIG):], f"""
  , en as (select date, sid, ticker, rank, close as entry_price, 1 + least(9, greatest(0, cast(floor(rank / 100 * 10) as int))) as bin from rk where rank >= 90),
  tg as (select en.*, entry_price * (1 + mean + {Z} * std) as target from en join cb on cb.bin = en.bin and cb.model = 'mom')
  select g.date, g.ticker, g.entry_price, g.target, min(case when b.high >= g.target then b.date end) as hit_date from tg g
  left join bars b on b.ticker = g.ticker and b.sid > g.sid and b.sid <= g.sid + 20 group by all"""))
def _(t):
    e = ranks(t).filter("rank >= 90").select("date", "sid", "ticker", "rank", F.col("close").alias("entry_price"))
    return ru.band_exit_flag(e, ranks(t), cal(t).filter("model = 'mom'"), 20)


HOLDN = 5
RULES = [("market", 0.0), ("open_limit", 0.01), ("prevclose_limit", 0.01), ("prevclose_limit", 0.02), ("at_prevclose", 0.0), ("close", 0.0)]
_ANCHOR = {"market": "n_open", "open_limit": "n_open", "prevclose_limit": "close", "at_prevclose": "close", "close": "n_close"}


def _fill(rule: str, dip: float) -> str:
    a = _ANCHOR[rule]
    if rule in ("market", "close"):
        return f"case when {a} > 0 then {a} end"
    return f"case when {a} * {1 - dip!r} >= n_open then n_open when n_low <= {a} * {1 - dip!r} then {a} * {1 - dip!r} end"


TP = RK + f""",
nx as (select b.*, n.open as n_open, n.low as n_low, n.close as n_close, x.close as exit_px from rk b
  left join bars n on n.ticker = b.ticker and n.sid = b.sid + 1 left join bars x on x.ticker = b.ticker and x.sid = least(b.sid + 1 + {HOLDN}, b.n_sessions - 1)),
fl0 as ({' union all '.join(f"select *, '{r}' as rule, cast({d} as double) as dip, case when n_open > 0 and exit_px is not null then {_fill(r, d)} end as fill from nx" for r, d in RULES)}),
fl as (select *, exit_px / fill - 1 as ret from fl0)"""


def fills(t):
    return ru.limit_fill(ru.with_trade_prices(ranks(t), HOLDN), RULES)


@query("limit_fill", "rule:s dip:f offered:i fills:i fill_rate:f mean_pct:f total_pct:f win_pct:f", with_(TP, """select rule, dip, count(*) as offered, count(ret) as fills, count(ret) * 1.0 / count(*) as fill_rate,
  avg(ret) * 100 as mean_pct, sum(ret) * 100 as total_pct, avg(case when ret > 0 then 1.0 when ret is not null then 0.0 end) * 100 as win_pct from fl group by rule, dip"""))
def _(t):
    return ru.fill_report(fills(t))


SEL = TP + """,
pl as (select *, row_number() over (partition by rule, dip, date order by rank desc, ticker) as place from fl where rank is not null),
sl as (select * from (select *, row_number() over (partition by rule, dip, date order by rank desc, ticker) as slot from pl where place <= 20 and ret is not null) x_ where slot <= 5)"""


@query("slot_selection", "rule:s dip:f date:d ticker:s place:i slot:i ret:f", with_(SEL, "select * from sl"))
def _(t):
    return ru.slot_selection(fills(t), 5, 20)


@query("nonoverlap_compound", "rule:s dip:f holds:i mean_pct:f equity:l win_pct:f ann_pct:l", with_(SEL, f"""
  , pr as (select rule, dip, date, avg(ret) as r from sl where pos % {HOLDN} = 0 and pos < nd - {HOLDN + 1} group by rule, dip, date)
  select rule, dip, count(*) as holds, avg(r) * 100 as mean_pct, product(1 + r) as equity, avg(case when r > 0 then 1.0 else 0.0 end) * 100 as win_pct,
    (power(product(1 + r), 1 / (count(*) * {HOLDN} / {PPY}.0)) - 1) * 100 as ann_pct from pr group by rule, dip"""))
def _(t):
    pos = bk.positions_of(long_scores(kept_scores(t, H), ("mom", "rev")))
    return ru.nonoverlap_compound(ru.slot_selection(fills(t), 5, 20).join(F.broadcast(pos), "date"), HOLDN, PPY)


GRID4 = [dict(enter=e, leave=x) for e in (95.0, 90.0, 85.0, 80.0) for x in (50.0, 60.0, 70.0, 78.0) if x < e]
SWEEP = RK + f""",
gr as (select * from (values {', '.join(f"({g['enter']}, {g['leave']})" for g in GRID4)}) v(enter, leave)),
se as (select rk.*, enter, leave, case when rank >= enter then 1 when rank is null or rank < leave then -1 end as e from rk cross join gr),
sh as (select *, coalesce(last_value(e ignore nulls) over (partition by enter, leave, ticker order by sid rows unbounded preceding), -1) = 1 as held from se),
sp as (select *, coalesce(lag(held) over (partition by enter, leave, ticker order by sid), false) as was from sh),
sn as (select sp.*, s.ret_next_1d from sp join sc s on s.date = sp.date and s.ticker = sp.ticker),
sy as (select enter, leave, extract(year from date) as yr, avg(case when held then ret_next_1d end) as value, count(case when held <> was then 1 end) as trades from sn group by enter, leave, yr),
sw as (select enter, leave, min(case when yr <= 1999 then value end) as worst, avg(case when yr <= 1999 then value end) as mean, avg(case when yr > 1999 then value end) as holdout, sum(trades) as trades from sy group by enter, leave)"""


@query("parameter_sweep", "enter:f leave:f worst:f mean:f holdout:f trades:i place:i", with_(
    SWEEP, "select *, row_number() over (order by worst desc, mean desc, enter, leave) as place from sw"))
def _(t):
    y = ru.deadband_sweep(ranks(t).select("date", "sid", "ticker", "rank", "ret_next_1d"), GRID4, "ret_next_1d")
    return ru.parameter_sweep(y, ["enter", "leave"], 1999)


@query("order_reprice", "ticker:s reference:f limit_:f budget:f", with_(RK + HOLD, """, o as (select ticker, entry_price as reference, entry_price * 0.99 as lim, shares * 10 as budget from hold),
  px as (select ticker, close as price from rk where sid = (select max(sid) from cal))
  select o.ticker, coalesce(price, reference) as reference, case when price is null then lim else price * 0.995 end as limit_, budget from o left join px on px.ticker = o.ticker""", True))
def _(t):
    o = holdings(t).select("ticker", F.col("entry_price").alias("reference"), (F.col("entry_price") * 0.99).alias("limit"), (F.col("shares") * 10).alias("budget"))
    px = last_rank(t).select("ticker", F.col("px").alias("price"))
    return ru.order_reprice(o, px).withColumnRenamed("limit", "limit_")


@query("slot_sizing", "ticker:s price:f slot:f action:s", with_(RK + HOLD, """, v as (select coalesce(sum(shares * price), 0.0) as v from hold h join lastq q on q.ticker = h.ticker),
  p as (select r.ticker, b.close as price from lastr r join rk b on b.ticker = r.ticker and b.sid = (select max(sid) from cal) where r.rank >= 50)
  select ticker, price, least((6000.0 + v) / 5, 6000.0) as slot, case when price > least((6000.0 + v) / 5, 6000.0) then 'skip' else 'order' end as action from p, v""", True))
def _(t):
    held = holdings(t).join(last_price(t), "ticker").withColumn("value", F.col("shares") * F.col("price"))
    picks = last_rank(t).filter("rank >= 50").select("ticker", F.col("px").alias("price"))
    cash = t.spark.range(1).select(F.lit(6000.0).alias("cash"))
    return ru.slot_sizing(cash, held, picks, 5)


PLAN = RK + """,
pk as (select ticker, rank - 50 as weight from rk where sid = 300),
plan as (select ticker, weight / sum(weight) over () as weight from pk where weight > 0)"""
ENTRY, EXIT, BUDGET = 300, 340, 1_000_000.0


def plan(t):
    return ru.plan_allocation(ranks(t).filter(F.col("sid") == ENTRY).select("ticker", (F.col("rank") - 50).alias("weight")))


@query("plan_allocation", "ticker:s weight:f", with_(PLAN, "select * from plan"))
def _(t):
    return plan(t)


MARK = PLAN + f""",
fm0 as (select p.ticker, p.weight, e.close as entry_price, floor({BUDGET} * p.weight / e.close) as shares from plan p join bars e on e.ticker = p.ticker and e.sid = {ENTRY}),
fm as (select f.*, l.close as price, shares * entry_price as cost, shares * l.close as value from fm0 f left join bars l on l.ticker = f.ticker and l.sid = l.n_sessions - 1 where shares > 0)"""


def marks(t):
    return ru.fill_and_mark(plan(t), ranks(t), BUDGET, ENTRY, EXIT)


@query("fill_and_mark", "ticker:s shares:f entry_price:f cost:f price:f value:f pnl:f pnl_pct:f", with_(
    MARK, "select *, value - cost as pnl, (value / cost - 1) * 100 as pnl_pct from fm"))
def _(t):
    return marks(t)


LEVEL = ", lv as (select date, avg(close) as level from panel group by date)"


def level(t):
    return ranks(t).groupBy("date").agg(F.avg("close").alias("level"))


@query("fund_total", "invested:f cash:f value:f pnl:f benchmark_value:f vs_benchmark:f closed:b", with_(MARK + LEVEL, f"""
  , b as (select max(case when sid = {ENTRY} then level end) as b_in, max(case when sid = n_sessions - 1 then level end) as b_out, max(sid) as last_sid from lv join cal on cal.date = lv.date),
  m as (select sum(cost) as invested, sum(value) as v from fm), r as (select *, {BUDGET} - invested + v as value,
    floor({BUDGET} / b_in) * b_out + ({BUDGET} - floor({BUDGET} / b_in) * b_in) as benchmark_value from m, b)
  select invested, {BUDGET} - invested as cash, value, value - {BUDGET} as pnl, benchmark_value, (value - {BUDGET}) - (benchmark_value - {BUDGET}) as vs_benchmark, last_sid >= {EXIT} as closed from r"""))
def _(t):
    sess = ranks(t).groupBy("date").agg(F.max("sid").alias("sid"), F.max("n_sessions").alias("n"))
    b = level(t).join(sess, "date").groupBy().agg(F.max(F.when(F.col("sid") == ENTRY, F.col("level"))).alias("b_in"),
                                                  F.max(F.when(F.col("sid") == F.col("n") - 1, F.col("level"))).alias("b_out"), F.max("sid").alias("last_sid"))
    return ru.fund_total(marks(t), b, BUDGET, EXIT)


@query("benchmark_since_inception", "ticker:s entry_at:d units:f value:f pnl_pct:f", with_(RK + HOLD + LEVEL, """, a as (select h.ticker, h.entry_at, h.shares * h.entry_price as budget, lv.level as a
    from hold h asof join lv on h.entry_at >= lv.date), z as (select arg_max(level, date) as b from lv)
  select ticker, entry_at, budget / a as units, round(budget / a * b, 2) as value, (b / a - 1) * 100 as pnl_pct from a, z where a > 0""", True))
def _(t):
    d = rn.asof(holdings(t), level(t), "entry_at", "level")
    last = level(t).groupBy().agg(F.max_by("level", "date").alias("b"))
    d = d.filter("level_asof > 0").join(F.broadcast(last), F.lit(True))
    units = F.col("shares") * F.col("entry_price") / F.col("level_asof")
    return d.select("ticker", "entry_at", units.alias("units"), F.round(units * F.col("b"), 2).alias("value"), ((F.col("b") / F.col("level_asof") - 1) * 100).alias("pnl_pct"))


TRD = DB + """,
tr0 as (select *, coalesce(lag(held) over (partition by ticker order by sid), false) as was from db),
tr1 as (select date, sid, ticker, close, held, was, max(case when held and not was then sid end) over (partition by ticker order by sid rows between unbounded preceding and current row) as esid from tr0),
trd as (select t.date as at_, case when t.held then 'buy' else 'sell' end as action, t.ticker, t.close as price, case when not t.held then t.close - e.close end as pnl
  from tr1 t left join bars e on e.ticker = t.ticker and e.sid = t.esid where t.held <> t.was)"""


def rule_trades(t):
    """One unit bought when the rule takes a name and sold when it lets it go."""
    d = ru.deadband_positions(ranks(t))
    w = Window.partitionBy("ticker").orderBy("sid")
    d = d.withColumn("was", F.coalesce(F.lag("held").over(w), F.lit(False)))
    entry = F.last(F.when(F.col("held") & ~F.col("was"), F.col("close")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("entry", entry).filter("held <> was")
    return d.select(F.col("date").alias("at_"), F.when(F.col("held"), "buy").otherwise("sell").alias("action"), "ticker",
                    F.col("close").alias("price"), F.when(~F.col("held"), F.col("close") - F.col("entry")).alias("pnl"))


@query("hit_holdings_curve", "buys:i sells:i realised:f win_rate:f max_drawdown:f sessions:i capital:f equity:f benchmark:f universe:i", with_(TRD, """
  , fl as (select at_, sum(case when action = 'buy' then -price else price end) as cash from trd group by at_),
  mv as (select at_, ticker, sum(case when action = 'buy' then 1 else -1 end) as q from trd group by at_, ticker),
  dn as (select c.date, c.sid, k.ticker, p.close, coalesce(m.q, 0) as q from cal c cross join (select distinct ticker from panel) k
    left join panel p on p.date = c.date and p.ticker = k.ticker left join mv m on m.at_ = c.date and m.ticker = k.ticker),
  hw as (select date, sum(q) over w * coalesce(last_value(close ignore nulls) over w, 0) as worth from dn window w as (partition by ticker order by sid rows unbounded preceding)),
  cs as (select v.date, held, sum(coalesce(cash, 0)) over (order by v.date) as cash from (select date, sum(worth) as held from hw group by date) v left join fl on fl.at_ = v.date),
  cv as (select date, held + cash - least(0, min(cash) over ()) as value, -least(0, min(cash) over ()) as capital from cs),
  cd as (select value / max(value) over (order by date rows unbounded preceding) - 1 as d from cv),
  ub as (select ticker, max(case when date = (select min(date) from panel) then close end) as a, max(case when date = (select max(date) from panel) then close end) as b from panel group by ticker)
  select (select count(*) from trd where action = 'buy') as buys, (select count(*) from trd where action = 'sell') as sells, (select sum(pnl) from trd where action = 'sell') as realised,
    (select avg(case when pnl > 0 then 1.0 else 0.0 end) from trd where action = 'sell') as win_rate, (select least(min(d), 0.0) from cd) as max_drawdown, (select count(*) from cd) as sessions, (select max(capital) from cv) as capital, (select arg_max(value, date) from cv) as equity,
    (select avg(b / a - 1) from ub where a is not null and b is not null) as benchmark, (select count(*) from ub where a is not null and b is not null) as universe"""))
def _(t):
    trades = rule_trades(t)
    return ru.replay_summary(trades, ru.equity_from_flows(trades.withColumn("quantity", F.lit(1.0)), ranks(t)), ranks(t))


FOLLOW = """with p as (select concat('S', l_suppkey) as ticker, min(l_orderkey) as pos from lineitem where l_returnflag = 'A' group by 1),
  cur as (select distinct concat('S', l_suppkey) as ticker from lineitem where l_returnflag = 'R' and l_discount = 0.1 and l_tax = 0.08 and l_quantity >= 45),
  off as (select distinct concat('S', l_suppkey) as ticker from lineitem where l_returnflag = 'N' and l_discount = 0.1 and l_tax = 0.08 and l_quantity >= 45)
  select ticker, pos from (select *, row_number() over (order by pos, ticker) as i from p where ticker not in (select ticker from cur) and ticker not in (select ticker from off)) x_
  where i + (select count(*) from cur) <= 60"""


@query("watchlist_follow", "ticker:s pos:i", FOLLOW)
def _(t):
    li = t.table("lineitem").withColumn("ticker", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))
    picks = li.filter("l_returnflag = 'A'").select("ticker", F.col("l_orderkey").alias("pos"))
    some = li.filter("l_discount = 0.1D and l_tax = 0.08D and l_quantity >= 45")
    return ru.watchlist_follow(picks, some.filter("l_returnflag = 'R'"), some.filter("l_returnflag = 'N'"), 60)


FEED = TRD + """,
feed as (select at_, 'trade' as stream, action, ticker, concat(action, ' ', ticker) as detail from trd
  union all select cast(o_orderdate as date), 'learning', 'retrain', null, concat('retrained on ', count(*), ' names') from orders group by cast(o_orderdate as date)
  union all select cast(l_shipdate as date), 'watchlist', 'follow', concat('S', l_suppkey), 'follow' from lineitem group by all)"""


def feed(t):
    tr = rule_trades(t).select("at_", "action", "ticker", F.concat_ws(" ", "action", "ticker").alias("detail"))
    le = t.table("orders").groupBy(F.col("o_orderdate").cast("date").alias("at_")).agg(F.count(F.lit(1)).alias("n")).select(
        "at_", F.lit("retrain").alias("action"), F.lit(None).cast("string").alias("ticker"), F.format_string("retrained on %d names", "n").alias("detail"))
    wl = t.table("lineitem").groupBy(F.col("l_shipdate").cast("date").alias("at_"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker")).agg(
        F.lit("follow").alias("action"), F.lit("follow").alias("detail"))
    return {"trade": tr, "learning": le, "watchlist": wl}


@query("activity_feed", "at_:d stream:s action:s ticker:s detail:s", with_(FEED, "select * from feed order by at_ desc, stream, action, ticker nulls first, detail limit 400"))
def _(t):
    return ru.activity_feed(feed(t))


@query("activity_counts", "action:s n:i", with_(FEED, "select action, count(*) as n from feed group by action"))
def _(t):
    from functools import reduce
    d = reduce(lambda a, b: a.unionByName(b), [s.select("action") for s in feed(t).values()])
    return d.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


# ---- holdings ------------------------------------------------------------------------------------
AC = """with recursive tr as (select concat('S', l_suppkey) as ticker, case when l_returnflag = 'R' then 'sell' else 'buy' end as action, l_quantity as q, l_extendedprice / l_quantity as p,
  row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount) as i from lineitem),
ac as (select ticker, i, case when action = 'buy' then q else 0.0 end as qty, case when action = 'buy' then p else 0.0 end as cost from tr where i = 1
  union all select t.ticker, t.i, case when t.action = 'buy' then a.qty + t.q else greatest(a.qty - t.q, 0.0) end,
    case when t.action = 'buy' then (a.cost * a.qty + t.p * t.q) / (a.qty + t.q) else a.cost end from ac a join tr t on t.ticker = a.ticker and t.i = a.i + 1)
select ticker, qty as quantity, cost as entry_price from (select *, row_number() over (partition by ticker order by i desc) as b from ac) x_ where b = 1 and qty > 0"""


@query("average_cost", "ticker:s quantity:f entry_price:f", AC)
def _(t):
    return hd.average_cost(t.trades())


MTM = PANEL + QUOTES + """,
""" + POSITIONS + """,
book as (select ticker, shares as quantity, entry_price, entry_at from hold union all select concat('X', n_nationkey), 10.0, 100.0, null from nation),
mtm as (select h.*, h.quantity * h.entry_price as cost, q.price, h.quantity * q.price as value, (q.price / q.prev_close - 1) * 100 as change_pct from book h left join quotes q on q.ticker = h.ticker),
mtp as (select *, value - cost as pnl, (value / cost - 1) * 100 as pnl_pct from mtm)"""


def kept_bars(t):
    """The weekly bars, stored for plans that read them several times."""
    return t.keep("weekly", t.weekly_bars)


def book_marks(t):
    h = holdings(t).select("ticker", F.col("shares").alias("quantity"), "entry_price", "entry_at")
    extra = t.table("nation").select(F.concat(F.lit("X"), F.col("n_nationkey").cast("string")).alias("ticker"), F.lit(10.0).alias("quantity"), F.lit(100.0).alias("entry_price"),
                                     F.lit(None).cast("date").alias("entry_at"))
    return hd.mark_to_market(h.unionByName(extra), qt.quote_change(kept_bars(t)))


@query("mark_to_market", "ticker:s currency:s quantity:f cost:f price:f value:f pnl:f pnl_pct:f change_pct:f", with_(MTM, "select *, 'USD' as currency from mtp", True))
def _(t):
    return book_marks(t).withColumn("currency", currency_of(F.col("ticker")))


@query("portfolio_total", "cost:f value:f pnl:f pnl_pct:f positions:i priced:i unpriced:i", with_(MTM, """select round(sum(case when value is not null then cost end), 2) as cost, round(sum(value), 2) as value,
  round(sum(value) - sum(case when value is not null then cost end), 2) as pnl, (sum(value) / sum(case when value is not null then cost end) - 1) * 100 as pnl_pct, count(*) as positions, count(value) as priced, count(*) - count(value) as unpriced from mtp""", True))
def _(t):
    d = hd.portfolio_total(book_marks(t))
    return d.withColumns({c: F.round(c, 2) for c in ("cost", "value", "pnl")})      # totals to the cent


@query("portfolio_concentration", "positions:i hhi:f effective_positions:f largest_weight_pct:f best:s worst:s", with_(MTM, """, v as (select *, value / sum(value) over () as w from mtp where value is not null)
  select count(*) as positions, sum(w * w) as hhi, 1 / sum(w * w) as effective_positions, max(w) * 100 as largest_weight_pct,
    arg_max(ticker, (pnl_pct, ticker)) as best, arg_min(ticker, (pnl_pct, ticker)) as worst from v""", True))
def _(t):
    return hd.portfolio_concentration(book_marks(t))


@query("same_window_comparison", "from_:d to_:d sessions:i context_only:b portfolio_pct:f benchmark_pct:f", with_(MTM + LEVEL, """, sw as (select * from lv where date >= (select min(entry_at) from hold)),
  e as (select min(date) as f, max(date) as l, count(*) - 1 as sessions from sw),
  px as (select ticker, max(case when date = f then close end) as a, max(case when date = l then close end) as b from panel, e group by ticker)
  select e.f as from_, e.l as to_, e.sessions, false as context_only, (select sum(value / (select sum(value) from mtp) * (b / a - 1) * 100) from mtp join px on px.ticker = mtp.ticker where a > 0 and b is not null and value is not null) as portfolio_pct,
    ((select arg_max(level, date) from sw) / (select arg_min(level, date) from sw) - 1) * 100 as benchmark_pct from e""", True))
def _(t):
    b = kept_bars(t)
    return hd.same_window(t.keep("marks", lambda: book_marks(t)), b, b.groupBy("date").agg(F.avg("close").alias("level")))


@query("allocate_balance", "ticker:s price:f weight_pct:f target:f shares:f spend:f", with_(RK, """, p as (select ticker, close as price, greatest(rank - 90, 0) as w from rk where sid = 300 and close > 0),
  c as (select *, least(w / sum(w) over (), 0.25) as c from (select ticker, price, coalesce(w, 0.0) as w from p) x_),
  z as (select *, c / sum(c) over () as k from c)
  select ticker, price, k * 100 as weight_pct, 1000000.0 * k as target, floor(1000000.0 * k / price) as shares, floor(1000000.0 * k / price) * price as spend from z"""))
def _(t):
    p = ranks(t).filter("sid = 300").select("ticker", F.col("close").alias("price"), F.greatest(F.col("rank") - 90, F.lit(0.0)).alias("weight"))
    return hd.allocate_balance(p, 1000000.0)
