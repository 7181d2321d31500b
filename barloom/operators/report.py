"""Model comparison tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.config import BookConfig
from barloom.operators import books as bk, metrics as mt
from barloom.operators.metrics import performance_metrics
from barloom.session import materialize

HOLD = "buy and hold"
COLUMNS = ("model", "sharpe", "sharpe_before_costs", "ann_return", "ann_vol", "max_drawdown", "hit_rate", "t_stat",
           "ic_mean", "icir", "ic_t_stat", "ic_positive_rate", "avg_turnover", "n_days")


def net_and_gross(daily: DataFrame, ppy: int) -> DataFrame:
    net = performance_metrics(daily, ppy, "pnl", turnover="turnover")
    gross = performance_metrics(daily, ppy, "gross_pnl").select(
        "model", F.col("sharpe").alias("sharpe_before_costs"), F.col("ann_return").alias("ann_return_before_costs"))
    return net.join(gross, "model")


def evaluate_models(signal: DataFrame, returns: DataFrame, cfg: BookConfig, holding: int,
                    bound: int | None = None, daily: DataFrame | None = None) -> DataFrame:
    """Results and skill of every model, on scored dates only: flat days before the first score
    would water down volatility and hit rate."""
    if daily is None:
        daily = materialize(bk.run_backtest(signal, returns, cfg, holding, bound), "daily")
    inside = signal.join(F.broadcast(bk.positions_of(signal).select("date")), "date", "left_semi")
    ic = mt.ic_summary(mt.daily_ic(inside, "score", "fwd_ret", cfg.min_names, bound, mask_first=False))
    return net_and_gross(daily, cfg.periods_per_year).join(ic, "model", "left").select(*COLUMNS)


def summary_table(signal: DataFrame, returns: DataFrame, cfg: BookConfig, holding: int,
                  bound: int | None = None) -> DataFrame:
    """Every model, the equal-weight holding of the universe, and which model is best by Sharpe."""
    daily = materialize(bk.run_backtest(signal, returns, cfg, holding, bound), "daily")
    models = evaluate_models(signal, returns, cfg, holding, bound, daily)
    one = daily.groupBy("date").agg(F.max("benchmark").alias("benchmark")).withColumn("model", F.lit(HOLD))
    hold = performance_metrics(one, cfg.periods_per_year, "benchmark")
    rows = models.unionByName(hold.select("model", *[c for c in COLUMNS if c in hold.columns and c != "model"]),
                              allowMissingColumns=True)
    best = models.groupBy().agg(F.max_by("model", "sharpe").alias("_best"))
    return (rows.join(F.broadcast(best), F.lit(True))
            .withColumn("best", F.col("model") == F.col("_best")).drop("_best"))


def verdict(summary: DataFrame) -> DataFrame:
    """A label for each model from its skill and its result against holding everything."""
    hold = summary.filter(F.col("model") == HOLD).groupBy().agg(F.max("sharpe").alias("_hold"))
    d = summary.filter(F.col("model") != HOLD).join(F.broadcast(hold), F.lit(True))
    ic, t = F.col("ic_mean"), F.col("ic_t_stat")
    label = (F.when(ic.isNull() | t.isNull(), "not enough data").when(F.abs(ic) > 0.15, "suspect")
             .when(F.abs(t) < 2, "no signal").when(t < 0, "negative")
             .when(F.col("sharpe") <= F.col("_hold"), "loses to holding")
             .when(F.col("sharpe") > F.col("_hold"), "good").otherwise("signal"))
    return d.select("model", label.alias("label"))
