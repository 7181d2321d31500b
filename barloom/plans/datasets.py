"""The modelling frame: features, labels and the tradable flag, and what of it goes into a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from barloom.config import RunConfig
from barloom.operators import features as ft, panel as pn
from barloom.operators.labels import build_labels
from barloom.session import materialize, release

KEYS = ("date", "ticker", "sid", "fold", "role")
NOT_FEATURES = ("target", "fwd_ret", "ret_next_1d", "close")


def join_features_labels(feats: DataFrame | Callable[[DataFrame], DataFrame], labels: DataFrame, panel: DataFrame, keep: str = "true") -> DataFrame:
    """Rows that satisfy `keep`, an expression over the columns of labels and panel. `feats` is a table, or a function that joins a
    stored table to the features: then neither is dealt by (date, ticker) beside the other."""
    keys = ["date", "ticker"]
    own = panel.select(*keys, "tradable", "close")
    if isinstance(feats, DataFrame):
        return feats.join(labels, keys).join(own, keys, "left").filter(keep)
    side = materialize(labels.join(own, keys, "left").filter(keep), "labels")
    release(side.sparkSession)
    return feats(side)


def feature_list(d: DataFrame) -> list[str]:
    return [c for c in d.columns if c not in NOT_FEATURES and c not in KEYS and not c.startswith("_")]


def coverage_filter(d: DataFrame, cols: list[str], least: float) -> DataFrame:
    """Rows with at least this share of known features."""
    known = sum((F.col(c).isNotNull().cast("double") for c in cols), F.lit(0.0))
    return d.withColumn("share", known / len(cols)).filter(F.col("share") >= least)


def prepare_dataset(panel: DataFrame, cfg: RunConfig, bound: int | None = None) -> DataFrame:
    panel = pn.universe_filter(panel, cfg.data)

    def feats(side: DataFrame) -> DataFrame:
        return ft.compute_features(panel.drop("tradable"), cfg.features, bound, side)
    d = join_features_labels(feats, build_labels(panel, cfg.labels, bound), panel, "tradable")
    return coverage_filter(d, ft.names(cfg.features), 0.5).drop("share", "tradable")
