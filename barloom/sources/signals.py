"""Two hand-made score models on the weekly panel, with the returns that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.functions.frames import at
from barloom.functions.nums import ratio
from barloom.operators.labels import forward_returns
from barloom.operators.panel import with_sessions
from barloom.sources.tables import Tables


def scored_bars(t: Tables, horizon: int) -> DataFrame:
    """Bars with `mom`, `rev`, `fwd_ret`, `ret_next_1d`; all windows share one ticker shuffle."""
    d = forward_returns(with_sessions(t.weekly_bars()), horizon)
    return d.withColumns({"mom": ratio(F.col("close"), at("close", -21)) - 1,
                          "rev": -(ratio(F.col("close"), at("close", -1)) - 1)})


def kept_scores(t: Tables, horizon: int) -> DataFrame:
    """`scored_bars` materialised, for plans that read it several times."""
    return t.keep(f"scored-{horizon}", lambda: scored_bars(t, horizon))


def long_scores(d: DataFrame, models: tuple[str, ...] = ("mom", "rev")) -> DataFrame:
    """One row per model, NULL scores kept."""
    keep = [c for c in d.columns if c not in models]
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in models])
    return d.select(*keep, F.explode(rows).alias("_m")).select(*keep, "_m.model", "_m.score")
