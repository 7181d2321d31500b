"""Scalar functions the library relies on, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.nums import clamp
from barloom.plans.registry import query
from barloom.plans.sqlparts import PANEL, with_


@query("scalar_math", "l_orderkey:i l_linenumber:i l_partkey:i n:i a:f b:f c:f d:f e:f", """select l_orderkey, l_linenumber, l_partkey, count(*) as n,
  sum(ln(l_extendedprice)) as a, sum(exp(l_discount) - 1) as b, sum(sqrt(l_quantity)) as c, sum(floor(l_extendedprice / l_quantity)) as d,
  sum(least(greatest(abs(l_discount - l_tax), 0.01), 0.05)) as e from lineitem group by 1, 2, 3""")
def _(t):
    return t.table("lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.ln("l_extendedprice")).alias("a"), F.sum(F.expm1("l_discount")).alias("b"),
        F.sum(F.sqrt("l_quantity")).alias("c"), F.sum(F.floor(F.col("l_extendedprice") / F.col("l_quantity"))).alias("d"),
        F.sum(clamp(F.abs(F.col("l_discount") - F.col("l_tax")), 0.01, 0.05)).alias("e"))


@query("scalar_string", "p_partkey:i up:s first:s last:s dashed:s has_ring:b alnum:b", """select p_partkey, upper(trim(p_name)) as up, split_part(p_name, ' ', 1) as first,
  split_part(p_name, ' ', -1) as last, replace(p_brand, '#', '-') as dashed, contains(p_name, 'ring') as has_ring, regexp_full_match(replace(p_name, ' ', ''), '[A-Za-z0-9]+') as alnum from part""")
def _(t):
    return t.table("part").select(
        "p_partkey", F.upper(F.trim("p_name")).alias("up"), F.split("p_name", " ")[0].alias("first"),
        F.substring_index("p_name", " ", -1).alias("last"), F.regexp_replace("p_brand", "#", "-").alias("dashed"),
        F.col("p_name").contains("ring").alias("has_ring"), F.regexp_replace("p_name", " ", "").rlike("^[A-Za-z0-9]+$").alias("alnum"))


@query("scalar_date", "o_orderkey:i day:d month:d later:d wd:i label:s parsed:d bad:d", """select o_orderkey, cast(o_orderdate as date) as day, date_trunc('month', o_orderdate) as month,
  cast(o_orderdate as date) + interval 3 month as later, isodow(o_orderdate) - 1 as wd, strftime(o_orderdate, '%Y-%m-%d %H:%M') as label,
  try_cast(strftime(o_orderdate, '%Y-%m-%d') as date) as parsed, try_cast(o_orderpriority as date) as bad from orders""")
def _(t):
    day = F.col("o_orderdate").cast("date")
    return t.table("orders").select(
        "o_orderkey", day.alias("day"), F.trunc(day, "month").alias("month"), F.add_months(day, 3).alias("later"),
        F.weekday(day).alias("wd"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("label"),
        F.expr("try_cast(date_format(o_orderdate, 'yyyy-MM-dd') as date)").alias("parsed"),
        F.expr("try_cast(o_orderpriority as date)").alias("bad"))


@query("scalar_json", "event_id:i k:i k2:i packed:s", """select event_id, cast(props ->> '$.k' as bigint) as k, cast(props ->> '$.k' as bigint) * 2 as k2,
  concat('{"id":', event_id, ',"type":"', event_type, '"}') as packed from events""")
def _(t):
    r = F.from_json("props", "k bigint")
    return t.table("events").select(
        "event_id", r["k"].alias("k"), (F.get_json_object("props", "$.k").cast("bigint") * 2).alias("k2"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("packed"))


@query("scalar_percentile", "ticker:s med:f p10:f p99:f", with_(PANEL, """select ticker, median(close) as med, quantile_cont(close, 0.1) as p10, quantile_cont(close, 0.995) as p99
  from panel group by ticker"""))
def _(t):
    return t.weekly_bars().groupBy("ticker").agg(F.median("close").alias("med"), F.percentile("close", F.lit(0.1)).alias("p10"),
                                                 F.percentile("close", F.lit(0.995)).alias("p99"))


@query("scalar_hash", "c_custkey:i key:s", "select c_custkey, substr(sha1(concat(c_name, '|', c_mktsegment)), 1, 16) as key from customer")
def _(t):
    return t.table("customer").select("c_custkey", F.substring(F.sha1(F.concat_ws("|", "c_name", "c_mktsegment")), 1, 16).alias("key"))


@query("scalar_map", "c_custkey:i code:s", """select c_custkey, coalesce(case c_mktsegment when 'BUILDING' then 'B1' when 'FURNITURE' then 'F1' when 'MACHINERY' then 'M1' end, 'other') as code from customer""")
def _(t):
    m = F.create_map(*[F.lit(x) for x in ("BUILDING", "B1", "FURNITURE", "F1", "MACHINERY", "M1")])
    return t.table("customer").select("c_custkey", F.coalesce(F.try_element_at(m, F.col("c_mktsegment")), F.lit("other")).alias("code"))


@query("scalar_array", "vec_id:i low:f at_low:i tail_sum:f n:i", """select vec_id, list_min(embedding) as low, list_position(embedding, list_min(embedding)) as at_low,
  list_sum(list_transform(embedding[3:5], lambda x: cast(x as double))) as tail_sum, len(embedding) as n from embeddings""")
def _(t):
    e = F.col("embedding")
    return t.table("embeddings").select(
        "vec_id", F.array_min(e).cast("double").alias("low"), F.array_position(e, F.array_min(e)).alias("at_low"),
        F.aggregate(F.slice(e, 3, 3), F.lit(0.0), lambda a, x: a + x.cast("double")).alias("tail_sum"), F.size(e).alias("n"))
