"""Panel analytics on Spark: long panels of dated, per-entity bars in, point-in-time features,
labels, models, books, metrics and forecasts out. Everything is a lazy DataFrame plan."""

__version__ = "0.1.0"
