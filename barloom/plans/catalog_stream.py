"""Streaming queries: the stream runs over everything available and must equal the batch statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.plans.catalog_panel import ET, EV
from barloom.plans.registry import query
from barloom.plans.sqlparts import with_
from barloom.session import scratch_path
from barloom.streaming import ops, quotes as sq, tables as tb

OHLC = "ticker:s bar:t open:f high:f low:f close:f volume:f"
AGG = "arg_min(px, (ts, event_id)) as open, max(px) as high, min(px) as low, arg_max(px, (ts, event_id)) as close, sum(size) as volume"


FILES = 4
DAYS = 2              # rows arrive up to two days after their time: the lateness that this source guarantees
LATE = f"{DAYS} days"


def ticks(t, closed: bool = False):
    """Events as a stream of several files, one a micro-batch, each row up to DAYS late. A `closed` stream ends with a mark of
    each type far ahead, of no user's, which closes every open day."""
    kept = "closed_files" if closed else "event_files"
    if kept not in t._kept:
        path, events = scratch_path(t.spark, kept), t.table("events")
        if closed:
            far = (F.max("ts") + F.expr(f"interval {DAYS + 3} days")).alias("ts")
            marks = events.filter("value > 0").groupBy("event_type").agg(F.lit(None).cast("bigint").alias("event_id"), F.lit(-1).cast("bigint").alias("user_id"),
                                                       F.lit(1.0).alias("value"), F.lit(None).cast("string").alias("props"))
            events = events.unionByName(marks.join(F.broadcast(events.groupBy().agg(far)), F.lit(True)))
        delay = F.pmod(F.xxhash64("event_id"), F.lit(DAYS * 86_400)) * 1_000_000
        tb.deal_files(events, path, FILES, F.unix_micros(F.col("ts").cast("timestamp")) + delay)
        t._kept[kept] = path
    return tb.tick_stream(t.spark, t._kept[kept], files_per_batch=1)


def quotes(t):
    return tb.run_state(sq.quote_state(ticks(t), DAYS * 86_400), "quotes", ["ticker"], ("step",))


@query("stream_tick_bars", OHLC, with_(EV, f"select ticker, date_trunc('hour', ts) as bar, {AGG} from ev group by 1, 2"))
def _(t):
    return tb.run_update(ops.bars(ticks(t), "1 hour", late=LATE), "bars", ["ticker", "bar"])


@query("stream_sliding_bars", OHLC, with_(EV, f"""select ticker, bar, {AGG} from (select *, date_trunc('hour', ts) as bar from ev
  union all select *, date_trunc('hour', ts) - interval 1 hour from ev) x_ group by 1, 2"""))
def _(t):
    return tb.run_update(ops.bars(ticks(t), "2 hours", "1 hour", LATE), "sliding", ["ticker", "bar"])


@query("stream_dedupe", "user_id:i ticker:s day:d", "select distinct user_id, event_type as ticker, cast(ts as date) as day from events where value > 0")
def _(t):
    d = ticks(t).withColumn("day", ops.plain(F.col("ts")).cast("date"))
    return tb.run_append(ops.dedupe(d, ["user_id", "ticker", "day"], LATE).select("user_id", "ticker", "day"), "dedupe")


@query("stream_last_quote", "ticker:s price:f prev_close:f change_pct:f", with_(EV, """, q as (select ticker, close, row_number() over (partition by ticker order by date desc) as i from eday)
  select ticker, a as price, b as prev_close, (a / b - 1) * 100 as change_pct from (select ticker, max(case when i = 1 then close end) as a, max(case when i = 2 then close end) as b from q group by ticker) x_ where b is not null"""))
def _(t):
    d = quotes(t).filter("prev_close <> 0")
    return d.withColumn("change_pct", (F.col("price") / F.col("prev_close") - 1) * 100)


@query("stream_limit_touch", "ticker:s date:d touched:t px:f", with_(EV, """, o as (select ticker, avg(px) * 0.2 as lim from ev group by ticker)
  select ticker, date, min(ts) as touched, arg_min(px, (ts, event_id)) as px from ev join o using (ticker) where px <= lim group by ticker, date"""))
def _(t):
    orders = t.ticks().groupBy("ticker").agg((F.avg("px") * 0.2).alias("limit"))
    return tb.run_update(ops.limit_touches(ticks(t), orders, LATE), "touch", ["ticker", "date"])


@query("stream_resolve_forecasts", "user_id:i day:d due:d forecast:f outcome:f", """with e as (select user_id, event_type, cast(ts as date) as day, arg_min(value, (ts, event_id)) as px
    from events where value > 0 group by 1, 2, 3)
  select f.user_id, f.day, o.day as due, f.px as forecast, o.px as outcome from e f join e o on o.user_id = f.user_id and o.day = f.day + 1
  where f.event_type = 'view' and o.event_type = 'purchase'""")
def _(t):
    first = lambda kind: ops.first_of_day(ticks(t, closed=True).filter(F.col("ticker") == kind), LATE)
    return tb.run_append(ops.resolve_forecasts(first("view"), first("purchase"), 1), "resolved")


@query("stream_ledger_upsert", "user_id:i day:d id:i px:f", """select user_id, cast(ts as date) as day, arg_max(event_id, (ts, event_id)) as id, arg_max(value, (ts, event_id)) as px
  from events where value > 0 group by 1, 2""")
def _(t):
    d = ticks(t).select("user_id", ops.plain(F.col("ts")).cast("date").alias("day"), "id", "px", "ts")
    return tb.run_upsert(d, "ledger", ["user_id", "day"], ["ts", "id"], "day")


@query("stream_session_gate", "id:i ticker:s px:f", with_(f"e as (select *, {ET} as et from events where value > 0)", """select event_id as id, event_type as ticker, value as px from e
  where isodow(et) < 6 and extract(hour from et) * 60 + extract(minute from et) >= 570 and extract(hour from et) * 60 + extract(minute from et) < 960"""))
def _(t):
    return tb.run_append(ops.session_gate(ticks(t)).select("id", "ticker", "px"), "gate")


@query("stream_staleness", "ticker:s n:i lag_seconds:i", with_(EV, """select ticker, count(*) as n, cast(epoch(date_trunc('second', (select max(ts) from ev))) - epoch(date_trunc('second', max(ts))) as bigint) as lag_seconds from ev group by ticker"""))
def _(t):
    return quotes(t)


@query("stream_daily_update", "session:d attempts:i done:b done_at:t", with_(f"e as (select *, {ET} as et from events where value > 0)", """, k as (select *, cast(et as date) as session, row_number() over (partition by cast(et as date) order by ts, event_id) as i from e
    where isodow(et) < 6 and extract(hour from et) * 60 + extract(minute from et) >= 980),
  d as (select session, min(case when event_type <> 'error' then i end) as ok, max(i) as n, arg_min(ts, case when event_type <> 'error' then i end) as done_at from k where i <= 3 group by session)
  select session, coalesce(ok, n) as attempts, ok is not null as done, done_at from d"""))
def _(t):
    checks = tb.run_append(ops.update_checks(ticks(t)), "checks")
    return ops.update_marks(checks, F.col("ticker") == "error")
