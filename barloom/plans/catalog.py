"""Imports every group of registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.operators import metrics
from barloom.operators.features import change, grid
from barloom.operators.labels import forward_returns
from barloom.operators.panel import with_sessions
from barloom.config import FeatureConfig
from barloom.plans import (catalog_books, catalog_features, catalog_forecast,  # noqa: F401
                           catalog_ledger, catalog_models, catalog_panel, catalog_rules,
                           catalog_scalars, catalog_stream, catalog_views)
from barloom.sources.tables import Tables


def momentum_ic(spark: SparkSession, folder: str, min_names: int) -> DataFrame:
    t = Tables(spark, folder)
    bars = t.weekly_bars()
    score = grid(bars, FeatureConfig()).select("date", "ticker", change(21).alias("score"))
    fwd = forward_returns(with_sessions(bars), 5).select("date", "ticker", "fwd_ret")
    both = score.join(fwd, ["date", "ticker"]).withColumn("model", F.lit("mom"))
    return metrics.daily_ic(both, "score", "fwd_ret", min_names=min_names, bound=t.names_bound, mask_first=False)
