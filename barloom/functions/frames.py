"""Window frames over one entity's sessions.

`sid` is a dense session number. On a grid without holes row frames count sessions; on bare bars use
`at`, whose range frame does. An entity has at most one bar a session, so one window partition never
holds more rows than the calendar has sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec, Window, functions as F


def by_ticker(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("ticker",))).orderBy("sid")


def trailing(n: int, *keys: str) -> WindowSpec:
    return by_ticker(*keys).rowsBetween(-(n - 1), 0)


def guarded(agg: Callable[[Column], Column], x: Column | str, n: int, least: int,
            window: WindowSpec | None = None) -> Column:
    """`agg` over the last n rows, NULL with fewer than `least` non-null values."""
    w = trailing(n) if window is None else window.rowsBetween(-(n - 1), 0)
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.count(x).over(w) >= least, agg(x).over(w))


def at(x: Column | str, k: int, *keys: str) -> Column:
    """Value exactly k sessions away; NULL when that session has no row."""
    x = F.col(x) if isinstance(x, str) else x
    return F.max(x).over(by_ticker(*keys).rangeBetween(k, k))


# ---- rolling figures from running sums ---------------------------------------------------------
# A sliding frame visits every row of the frame for every row. Running sums visit each row once, and a
# rolling figure is the difference of two of them. Values are taken relative to the entity's first
# one, which keeps the sums small. Spreads are not taken from sums, where a small one would be lost in rounding: their windows
# are short, so their sliding frames are cheap and exact.


def prefix(d: DataFrame, *cols: str) -> DataFrame:
    """Adds running count and sum of columns of a grid without holes."""
    need = [c for c in cols if f"_c_{c}" not in d.columns]
    if not need:
        return d
    w = by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"_k_{c}": F.first(c, ignorenulls=True).over(w) for c in need})
    made = {}
    for c in need:
        x = F.col(c) - F.col(f"_k_{c}")
        made[f"_c_{c}"] = F.count(c).over(w)
        made[f"_s_{c}"] = F.coalesce(F.sum(x).over(w), F.lit(0.0))
    return d.withColumns(made)


def _part(kind: str, c: str, n: int) -> Column:
    x = F.col(f"_{kind}_{c}")
    return x - F.coalesce(F.lag(x, n).over(by_ticker()), F.lit(0))


def roll_mean(c: str, n: int, least: int) -> Column:
    m = _part("c", c, n)
    return F.when(m >= least, F.col(f"_k_{c}") + _part("s", c, n) / m)


def roll_std(c: str, n: int, least: int) -> Column:
    """Sample standard deviation of the last n rows."""
    w = by_ticker().rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(w) >= max(least, 2), F.stddev_samp(c).over(w))


# ---- rolling extremes from blocks ---------------------------------------------------------------
# The last n rows reach into two blocks of n rows at most: the largest value is that of the running maximum of the row's own
# block and of the reversed running maximum of the block before, n - 1 rows back.


def extremes(d: DataFrame, c: str, n: int, at: str = "sid", keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Adds the running extremes of `c` in blocks of n rows, for `roll_extreme`; `at` numbers an entity's rows without gaps."""
    block = f"_x_{c}_{n}"
    if block in d.columns:
        return d
    d = d.withColumn(block, F.floor(F.col(at) / n))
    w = Window.partitionBy(*keys, block).orderBy(at)
    upto, onward = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return d.withColumns({f"_{k}{f.__name__}_{c}_{n}": f(c).over(frame) for k, frame in (("p", upto), ("s", onward)) for f in (F.max, F.min)})


def roll_extreme(agg: Callable[[Column], Column], c: str, n: int, at: str = "sid", keys: tuple[str, ...] = ("ticker",)) -> Column:
    """F.max or F.min of the last n rows of `c`, missing values left out."""
    w, block = Window.partitionBy(*keys).orderBy(at), F.col(f"_x_{c}_{n}")
    behind = f"_s{agg.__name__}_{c}_{n}"
    first = w.rowsBetween(Window.unboundedPreceding, 0)
    # a row with fewer rows before it looks back to the entity's first one, if that stands in an earlier block
    start = F.when(F.first(block).over(first) < block, F.first(behind).over(first))
    early = F.row_number().over(w) < n
    back = F.when(early, start).otherwise(F.lag(behind, n - 1).over(w))
    pick = F.greatest if agg is F.max else F.least
    return pick(F.col(f"_p{agg.__name__}_{c}_{n}"), back)


def roll_count(c: str, n: int) -> Column:
    """Values among the last n rows of a column that `prefix` has seen."""
    return _part("c", c, n)
