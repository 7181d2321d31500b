"""Streaming operators. Each is a plain streaming DataFrame; the caller picks trigger and sink.

`late` is the lateness that the source guarantees: rows that come later than that after the newest row of an earlier
micro-batch are dropped by the engine, so files in no time order need the whole span of what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.functions.dates import exchange_time, market_session, minutes_of

LEARN_FROM = 16 * 60 + 20       # fixed value: the daily update may start at 16:20 exchange time
TRIES = 3                       # fixed value: a session's update is tried three times at most


def plain(ts):
    """Event time without a zone."""
    return ts.cast("timestamp_ntz")


def bars(ticks: DataFrame, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling (or sliding) bars. Partial aggregates run before the shuffle, so a busy ticker is spread."""
    o = F.struct("ts", "id")
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (ticks.withWatermark("ts", late).groupBy(w, "ticker").agg(
        F.min_by("px", o).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", o).alias("close"),
        F.sum("size").alias("volume")).withColumn("bar", plain(F.col("window.start"))).drop("window"))


def dedupe(ticks: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """First row of each key within the watermark."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def limit_touches(ticks: DataFrame, orders: DataFrame, late: str = "1 day") -> DataFrame:
    """First tick at or under the limit of each resting order and day."""
    hit = ticks.withWatermark("ts", late).join(orders, "ticker").filter(F.col("px") <= F.col("limit"))
    first = F.struct("ts", "id")
    d = hit.groupBy(F.window("ts", "1 day"), "ticker").agg(F.min("ts").alias("ts"), F.min_by("px", first).alias("px"))
    return d.select("ticker", plain(F.col("window.start")).cast("date").alias("date"), plain(F.col("ts")).alias("touched"), "px")


def first_of_day(ticks: DataFrame, late: str = "1 hour") -> DataFrame:
    """First price (by time, then id) of each user and day, whatever the order of arrival; `at` is the event time of the row."""
    d = ticks.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "user_id").agg(F.min_by("px", F.struct("ts", "id")).alias("px"))
    return d.select("user_id", F.window_time("window").alias("at"), plain(F.col("window.start")).cast("date").alias("day"), "px")


def resolve_forecasts(forecasts: DataFrame, outcomes: DataFrame, days: int) -> DataFrame:
    """Forecasts meet the outcome of their name on the due day. Both sides are streams of one row a user and day (results of
    `first_of_day`). The time bound lets the engine drop a forecast once its due day has closed, and an outcome once no
    open forecast can be due on it; the day is part of the key, so a busy user is spread over days."""
    f = forecasts.select(F.col("user_id").alias("_u"), "day", F.date_add("day", days).alias("_due"), F.col("at").alias("_made"), F.col("px").alias("forecast"))
    o = outcomes.select("user_id", F.col("day").alias("due"), F.col("at").alias("_seen"), F.col("px").alias("outcome"))
    span = F.expr(f"interval {int(days)} days")
    same = (F.col("_u") == F.col("user_id")) & (F.col("_due") == F.col("due"))
    timely = (F.col("_seen") >= F.col("_made") + span) & (F.col("_seen") <= F.col("_made") + span)
    return f.join(o, same & timely).select("user_id", "day", "due", "forecast", "outcome")


def session_gate(ticks: DataFrame) -> DataFrame:
    """Ticks while the exchange is open."""
    return ticks.filter(market_session(plain(F.col("ts"))) == "open")


def update_checks(ticks: DataFrame) -> DataFrame:
    """Moments at which the daily update may run, with their session."""
    et = exchange_time(plain(F.col("ts")))
    return ticks.filter((F.weekday(et) < 5) & (minutes_of(et) >= LEARN_FROM)).select(
        et.cast("date").alias("session"), plain(F.col("ts")).alias("at_"), "id", "ticker")


def update_marks(checks: DataFrame, failed) -> DataFrame:
    """Per session: attempts until the first success, at most three. The rank filter keeps three rows a session
    in each task."""
    from pyspark.sql import Window
    w = Window.partitionBy("session").orderBy("at_", "id")
    d = checks.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= TRIES).withColumn("_f", failed)
    done = d.groupBy("session").agg(F.min(F.when(~F.col("_f"), F.col("_i"))).alias("first_ok"), F.max("_i").alias("n"),
                                    F.min_by("at_", F.when(~F.col("_f"), F.col("_i"))).alias("done_at"))
    return done.select("session", F.coalesce("first_ok", "n").alias("attempts"), F.col("first_ok").isNotNull().alias("done"), "done_at")
