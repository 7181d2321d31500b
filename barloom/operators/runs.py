"""Questions about which model run covers which names. A run is rows of (run, horizon, created, date, ticker)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def run_universe(rows: DataFrame) -> DataFrame:
    """Size and last date of each run, and when it was made; the ticker sets stay rows, not arrays."""
    per = rows.groupBy("run", "horizon", "ticker").agg(F.max("date").alias("d"), F.max("created").alias("c"))
    return per.groupBy("run", "horizon").agg(F.count(F.lit(1)).alias("universe"), F.max("d").alias("as_of"),
                                             F.max("c").alias("created"))


def newest_first():
    return [F.col("created").desc(), F.col("run").desc()]


def runs_catalog(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy(F.lit(0)).orderBy(*newest_first())    # one row per run
    return run_universe(rows).withColumn("place", F.row_number().over(w))


def run_tickers(rows: DataFrame) -> DataFrame:
    return rows.select("run", "ticker").distinct()


def coverage_select(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The source with most of the wanted names."""
    hit = run_tickers(rows).join(wanted.select("ticker").distinct(), "ticker", "left_semi")
    return hit.groupBy("run").agg(F.count(F.lit(1)).alias("covered")).orderBy(F.col("covered").desc(), "run").limit(1)


def superset_run(rows: DataFrame, held: DataFrame, horizon: int) -> DataFrame:
    """Newest run of the horizon that scores every held name (relational division)."""
    names = held.select("ticker").distinct()
    need = names.groupBy().agg(F.count(F.lit(1)).alias("_need"))
    hit = (run_tickers(rows.filter(F.col("horizon") == horizon)).join(names, "ticker", "left_semi")
           .groupBy("run").agg(F.count(F.lit(1)).alias("_has")))
    full = hit.join(F.broadcast(need), F.col("_has") == F.col("_need")).select("run")
    return (run_universe(rows).join(full, "run").orderBy(*newest_first()).limit(1)
            .select("run", "horizon", "universe", "as_of"))


def latest_covering_run(ranks: DataFrame, runs: DataFrame, last: int = 5) -> DataFrame:
    """For each ticker the newest of the `last` runs with a rank on that run's final date."""
    recent = runs.orderBy(*newest_first()).limit(last).select("run", "created", "as_of")
    d = ranks.filter("rank is not null").join(F.broadcast(recent), "run").filter(F.col("date") == F.col("as_of"))
    pick = d.groupBy("ticker").agg(F.max_by(F.struct("run", "rank", "as_of"), F.struct("created", "run")).alias("_p"))
    return pick.select("ticker", "_p.*")


PAGE, MATCHES = 5, 12       # fixed values: runs and tickers that a page shows


def find_runs(rows: DataFrame, ticker: str, limit: int = PAGE) -> DataFrame:
    """The newest `limit` of the runs that cover a ticker, broadest first."""
    u = run_universe(rows)
    has = run_tickers(rows.filter(F.col("ticker") == ticker.strip().upper()))
    hit = u.join(has, "run", "left_semi").orderBy(*newest_first()).limit(limit)
    return hit.orderBy(F.col("universe").desc(), "run").select("run", "universe", "as_of")


def search_runs(rows: DataFrame, text: str, exclude: str | None, limit: int = MATCHES) -> DataFrame:
    """Tickers containing `text`, each with the broadest run that has it; short names first. All runs are searched, the page is
    cut last."""
    u = run_universe(rows)
    if exclude:
        u = u.filter(F.col("run") != exclude)
    hit = run_tickers(rows).filter(F.col("ticker").contains(text.strip().upper())).join(
        u.select("run", "universe", "as_of", "created"), "run")
    best = hit.groupBy("ticker").agg(F.max_by(F.struct("run", "universe", "as_of"),
                                              F.struct("universe", "created", "run")).alias("_b"))
    return best.select("ticker", "_b.*").orderBy(F.length("ticker"), "ticker").limit(limit)


def asof(keys: DataFrame, series: DataFrame, on: str, value: str) -> DataFrame:
    """Last value of a dated series on or before each key date. Every gap of the series is opened into
    one row per day, which the date type bounds, so the lookup is an equi join that is broadcast."""
    w = Window.orderBy("date")
    days = series.select("date", value).withColumn("_to", F.lead("date").over(w))
    inner = days.filter("_to is not null").select(
        F.explode(F.sequence("date", F.date_sub("_to", 1))).alias(on), F.col(value).alias(f"{value}_asof"))
    tail = days.filter("_to is null").select(F.col("date").alias("_from"), F.col(value).alias("_tail"))
    d = keys.join(F.broadcast(inner), on, "left").join(F.broadcast(tail), F.lit(True), "left")
    v = F.when(F.col(on) >= F.col("_from"), F.col("_tail")).otherwise(F.col(f"{value}_asof"))
    return d.withColumn(f"{value}_asof", v).drop("_from", "_tail")
