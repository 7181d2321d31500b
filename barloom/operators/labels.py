"""Forward-looking targets. Shifts count calendar sessions; a missing session gives NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barloom.config import LabelConfig
from barloom.functions import ladder
from barloom.functions.frames import at
from barloom.functions.nums import ratio
from barloom.operators.panel import with_sessions


def forward_returns(bars: DataFrame, horizon: int) -> DataFrame:
    """`fwd_ret` over the horizon and `ret_next_1d`; bars need `sid`."""
    c = F.col("close")
    return bars.withColumns({"fwd_ret": ratio(at("close", horizon), c) - 1,
                             "ret_next_1d": ratio(at("close", 1), c) - 1})


def demean(d: DataFrame, value: str, out: str, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """Less the mean of the date. The mean is a partial aggregate joined back, not a date window."""
    mean = d.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    side = F.broadcast(mean) if keys == ("date",) else mean
    return d.join(side, list(keys)).withColumn(out, F.col(value) - F.col("_mean")).drop("_mean")


def build_labels(panel: DataFrame, cfg: LabelConfig, bound: int | None = None) -> DataFrame:
    d = forward_returns(with_sessions(panel), cfg.horizon)
    d = demean(d, "fwd_ret", "target") if cfg.excess else d.withColumn("target", F.col("fwd_ret"))
    if cfg.rank_target:
        d = ladder.percent_rank(d, ["date"], "target", "target_rank", bound, cfg.min_names, -0.5)
        d = d.withColumn("target", F.when(F.col("target").isNotNull(), F.col("target_rank")))
    return d.select("date", "ticker", "fwd_ret", "target", "ret_next_1d")


def low_day(bars: DataFrame, horizon: int) -> DataFrame:
    """`low_day`: which of the next sessions closes lowest, first on ties, 0-based; NULL if any is
    missing. `ahead` holds those closes."""
    ahead = F.array(*[at("close", k) for k in range(1, horizon + 1)])
    full = ~F.exists("ahead", lambda x: x.isNull())
    return bars.withColumn("ahead", ahead).withColumn(
        "low_day", F.when(full, F.array_position("ahead", F.array_min("ahead")).cast("int") - 1))


def buy_at_offset(d: DataFrame, horizon: int, guess: str) -> DataFrame:
    """Mean return from buying k sessions ahead and holding to the end, for each fixed k and for the
    guessed k (0-based column `guess`)."""
    end = F.element_at("ahead", horizon)
    fixed = F.array(*[F.struct(F.lit(f"day {k}").alias("rule"),
                               (ratio(end, F.element_at("ahead", k)) - 1).alias("ret"))
                      for k in range(1, horizon + 1)],
                    F.struct(F.lit("guessed").alias("rule"),
                             (ratio(end, F.try_element_at("ahead", F.col(guess) + 1)) - 1).alias("ret")))
    return (d.select(F.explode(fixed).alias("_x")).select("_x.rule", "_x.ret")
            .groupBy("rule").agg(F.avg("ret").alias("mean_ret"), F.count("ret").alias("n")))


def class_shares(d: DataFrame, label: str, out: str) -> DataFrame:
    """Normalised counts. The total runs over the class rows, of which there are a handful."""
    n = d.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn(out, F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def confusion(d: DataFrame, guess: str, actual: str, classes: list[int]) -> DataFrame:
    return d.groupBy(guess).agg(*[
        F.avg((F.col(actual) == k).cast("double")).alias(f"d{k}") for k in classes])


def accuracy(d: DataFrame, guess: str, actual: str) -> DataFrame:
    """Out-of-sample accuracy against always guessing the most common class."""
    cells = d.groupBy(guess, actual).agg(F.count(F.lit(1)).alias("n"))
    by_class = cells.groupBy(actual).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col(guess) == F.col(actual), F.col("n")).otherwise(0)).alias("hit"))
    r = by_class.agg((F.sum("hit") / F.sum("n")).alias("accuracy"), (F.max("n") / F.sum("n")).alias("base_rate"),
                     F.sum("n").alias("n"))
    return r.withColumn("lift", F.col("accuracy") - F.col("base_rate"))
