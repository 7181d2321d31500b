"""Every setting that changes a result, as plain dataclasses that serialise to one JSON string."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace


@dataclass(frozen=True)
class DataConfig:
    start: str | None = None
    end: str | None = None
    max_tickers: int = 500
    min_price: float = 5.0
    min_dollar_volume: float = 2_000_000.0
    min_history: int = 300


@dataclass(frozen=True)
class FeatureConfig:
    momentum_windows: tuple[int, ...] = (1, 5, 10, 21, 63, 126, 252)
    vol_windows: tuple[int, ...] = (21, 63)
    rsi_window: int = 14
    bollinger_window: int = 20
    atr_window: int = 14
    beta_window: int = 63
    rank: bool = True
    min_names: int = 20
    pad_gaps: bool = False


@dataclass(frozen=True)
class LabelConfig:
    horizon: int = 5
    excess: bool = True
    rank_target: bool = True
    min_names: int = 20


@dataclass(frozen=True)
class SplitConfig:
    n_splits: int = 6
    test_size: int = 252
    min_train: int = 756
    embargo: int = 5
    expanding: bool = True


@dataclass(frozen=True)
class ModelConfig:
    models: tuple[str, ...] = ("ridge", "gbt")
    ridge_alpha: float = 10.0
    gbt_trees: int = 600
    gbt_step: float = 0.02
    gbt_depth: int = 6
    gbt_min_child: int = 200
    gbt_leaves: int = 31
    gbt_l2: float = 5.0
    gbt_bins: int = 255
    gbt_patience: int = 50
    gbt_subsample: float = 0.8
    gbt_feature_share: float = 0.7
    val_fraction: float = 0.15
    seed: int = 7


@dataclass(frozen=True)
class BookConfig:
    quantile: float = 0.1
    long_short: bool = True
    gross: float = 1.0
    cost_bps: float = 10.0
    max_weight: float | None = 0.02
    signal_weighted: bool = False
    lag: int = 1
    n_bins: int = 5
    min_names: int = 20
    periods_per_year: int = 252


@dataclass(frozen=True)
class RunConfig:
    data: DataConfig = field(default_factory=DataConfig)
    features: FeatureConfig = field(default_factory=FeatureConfig)
    labels: LabelConfig = field(default_factory=LabelConfig)
    splits: SplitConfig = field(default_factory=SplitConfig)
    model: ModelConfig = field(default_factory=ModelConfig)
    book: BookConfig = field(default_factory=BookConfig)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "RunConfig":
        raw = json.loads(text)
        parts = {"data": DataConfig, "features": FeatureConfig, "labels": LabelConfig,
                 "splits": SplitConfig, "model": ModelConfig, "book": BookConfig}
        made = {}
        for name, cls in parts.items():
            values = {k: tuple(v) if isinstance(v, list) else v for k, v in raw[name].items()}
            made[name] = cls(**values)
        return RunConfig(**made)


def weekly(cfg: RunConfig | None = None) -> RunConfig:
    """Settings for the weekly supplier panel: shorter history, 52 periods a year."""
    cfg = cfg or RunConfig()
    return replace(
        cfg,
        data=replace(cfg.data, min_history=60, min_dollar_volume=1000.0),
        labels=replace(cfg.labels, horizon=2),
        splits=replace(cfg.splits, n_splits=4, test_size=40, min_train=120, embargo=2),
        book=replace(cfg.book, periods_per_year=52, max_weight=0.1),
    )
