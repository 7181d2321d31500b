"""SQL building blocks of the check statements. They state the semantics the long way round (dense
grids, row frames, recursion), independently of how the Spark plans compute them."""

from __future__ import annotations

LI = """li as (
  select concat('S', l_suppkey) as ticker, cast(date_trunc('week', l_shipdate) as date) as date,
         l_extendedprice / l_quantity as px, l_quantity as q,
         row_number() over (partition by l_suppkey, date_trunc('week', l_shipdate) order by l_shipdate,
           l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount) as rn,
         count(*) over (partition by l_suppkey, date_trunc('week', l_shipdate)) as n
  from lineitem)"""
PANEL = LI + """,
panel as (
  select date, ticker, max(case when rn = 1 then px end) as open, max(px) as high, min(px) as low,
         max(case when rn = n then px end) as close, sum(q) as volume
  from li group by date, ticker)"""
CAL = PANEL + """,
cal as (select date, row_number() over (order by date) - 1 as sid, count(*) over () as n_sessions
        from (select distinct date from panel) as d_)"""
BARS = CAL + """,
bars as (select p.*, c.sid, c.n_sessions from panel p join cal c on p.date = c.date)"""
GRID = BARS + """,
grid as (
  select c.date, c.sid, t.ticker, b.open, b.high, b.low, b.close, b.volume
  from cal c cross join (select distinct ticker from panel) t
  left join bars b on b.sid = c.sid and b.ticker = t.ticker)"""
RET = GRID + """,
ret as (
  select *, close / lag(close) over w - 1 as ret1, lag(close) over w as pc, close * volume as dv,
         ln(nullif(close * volume, 0)) as ldv, close / lag(close, 5) over w - 1 as ret5,
         close / lag(close, 21) over w - 1 as ret21
  from grid window w as (partition by ticker order by sid))"""
VOL = None  # set below


def over(n: int, part: str = "partition by ticker") -> str:
    return f"over ({part} order by sid rows between {n - 1} preceding and current row)"


def guard(agg: str, x: str, n: int, least: int, part: str = "partition by ticker") -> str:
    return f"case when count({x}) {over(n, part)} >= {least} then {agg}({x}) {over(n, part)} end"


VOL = RET + f""",
vol as (select *, nullif({guard('stddev_samp', 'ret1', 21, 10)}, 0) as bv,
        {guard('stddev_samp', 'ret1', 21, 10)} as vol_21d,
        {guard('stddev_samp', 'ret1', 63, 31)} as vol_63d from ret)"""
MKT = VOL + f""",
mkt0 as (select date, sid, avg(ret1) as mkt from ret group by date, sid),
mkt as (select date, mkt, {guard('avg', 'mkt', 63, 31, '')} as mkt_mean,
        {guard('var_samp', 'mkt', 63, 31, '')} as mkt_var, {guard('sum', 'mkt', 21, 15, '')} as mkt_21 from mkt0),
bet0 as (select v.*, m.mkt, m.mkt_mean, m.mkt_var, m.mkt_21, v.ret1 * m.mkt as rm from vol v join mkt m on v.date = m.date),
bet as (select *, ({guard('avg', 'rm', 63, 31)} - ({guard('avg', 'ret1', 63, 31)}) * mkt_mean) / nullif(mkt_var, 0) as beta
        from bet0),
res as (select *, ret1 - beta * mkt as resid from bet)"""


def with_(parts: str, body: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{parts} {body}"


def ewm(name: str, src: str, items: list[tuple[str, str, float]], adjust: bool = False, keys: str = "ticker") -> str:
    """Recursive CTE `name` over dense rows of `src`: for each (out, x, alpha) the value `out`, its
    weight `out_w` and its count `out_n`; needs `with recursive`."""
    init, step = [], []
    for out, x, a in items:
        new = "1.0" if adjust else repr(a)
        old = f"(r.{out}_w * {1 - a!r})"
        init += [f"cast({x} as double) as {out}", f"cast(1.0 as double) as {out}_w",
                 f"case when {x} is null then 0 else 1 end as {out}_n"]
        keep = f"{old} + {new}" if adjust else "1.0"
        step += [f"case when s.{x} is null then r.{out} when r.{out} is null then s.{x} "
                 f"else ({old} * r.{out} + {new} * s.{x}) / ({old} + {new}) end",
                 f"case when r.{out} is null then 1.0 when s.{x} is null then {old} else {keep} end",
                 f"r.{out}_n + case when s.{x} is null then 0 else 1 end"]
    return f"""{name} as (
  select {keys}, sid, {', '.join(init)} from {src} where sid = 0
  union all
  select {', '.join('r.' + k.strip() for k in keys.split(','))}, s.sid, {', '.join(step)}
  from {name} r join {src} s on {' and '.join(f's.{k.strip()} = r.{k.strip()}' for k in keys.split(','))} and s.sid = r.sid + 1)"""


def avg_rank(part: str, x: str) -> str:
    """Average rank over the rows where x is not null (partition list `part`)."""
    return (f"(rank() over (partition by {part} order by {x}) + "
            f"(count(*) over (partition by {part}, {x}) - 1) / 2.0)")


def pct(part: str, x: str, least: int = 1, shift: str = "") -> str:
    """Percentile rank expression over rows of any nullness: NULL stays NULL, thin groups are NULL."""
    return (f"case when {x} is not null and count({x}) over (partition by {part}) >= {least} then "
            f"(rank() over (partition by {part} order by {x} nulls last) + "
            f"(count(*) over (partition by {part}, {x}) - 1) / 2.0) / count({x}) over (partition by {part}){shift} end")
