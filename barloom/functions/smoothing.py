"""Recursive means as an associative scan of affine maps, in window functions alone.

A step of a recursion is a map y -> a * y + b, and maps compose. Sessions are cut into blocks; in a block the running product of
the a and the running sum of b over that product give every row's map from the block's start (blocks are short, so the product
stays far from zero). The blocks' maps, a few a ticker, are folded in order, and each row applies its own map to the value
its block starts with. Everything runs under the one partitioning and order (entity, block, session)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 64          # sessions of a block
LEAST = 1e-150      # a smaller factor forgets the past as well, and products must not vanish


def halflife_alpha(halflife: float) -> float:
    return 1.0 - 0.5 ** (1.0 / halflife)


def span_alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


def _windows(keys: tuple[str, ...], at: str):
    """(whole entity, block), both running and in one order."""
    whole = Window.partitionBy(*keys).orderBy("_block", at)
    return whole, Window.partitionBy(*keys, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)


def _blocked(d: DataFrame, at: str) -> DataFrame:
    return d if "_block" in d.columns else d.withColumn("_block", F.floor(F.col(at) / BLOCK))


def affine_scan(d: DataFrame, maps: dict[str, tuple[Column, Column]], keys: tuple[str, ...] = ("ticker",), at: str = "sid") -> DataFrame:
    """Adds a column y for each map (a, b): y(t) = a(t) * y(t-1) + b(t) along `at`, from 0 before an entity's first row. `a` is not
    negative and `b` is not null. A row needs only rows up to its own."""
    d = _blocked(d, at)
    whole, block = _windows(keys, at)
    names = list(maps)
    d = d.withColumns({f"_a_{n}": F.greatest(maps[n][0], F.lit(LEAST)) for n in names} | {f"_b_{n}": maps[n][1] for n in names})
    d = d.withColumns({f"_p_{n}": F.product(f"_a_{n}").over(block) for n in names})
    d = d.withColumns({f"_q_{n}": F.col(f"_p_{n}") * F.sum(F.col(f"_b_{n}") / F.col(f"_p_{n}")).over(block) for n in names})
    last = F.lead("_block").over(whole)     # the last row of a block has the map of all of it
    d = d.withColumns({"_ends": last.isNotNull() & (last != F.col("_block")),
                       "_starts": F.coalesce(F.lag("_block").over(whole) != F.col("_block"), F.lit(True))})
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    made = {}
    for n in names:
        done = F.collect_list(F.when(F.col("_ends"), F.struct(F.col(f"_p_{n}").alias("p"), F.col(f"_q_{n}").alias("q")))).over(before)
        made[f"_in_{n}"] = F.when(F.col("_starts"), F.aggregate(done, F.lit(0.0), lambda y, m: m["p"] * y + m["q"]))
    d = d.withColumns(made)
    d = d.withColumns({n: F.col(f"_p_{n}") * F.first(f"_in_{n}").over(block) + F.col(f"_q_{n}") for n in names})
    return d.drop("_ends", "_starts", *[f"_{k}_{n}" for n in names for k in ("a", "b", "p", "q", "in")])


def smooth(d: DataFrame, series: dict[str, tuple[str, float, int]], adjust: bool = False, keys: tuple[str, ...] = ("ticker",),
           at: str = "sid") -> DataFrame:
    """Adds exponentially weighted means: name -> (column, alpha, least number of values). `at` counts an entity's rows without gaps.
    A missing value carries the mean on while the weight of the past decays; `adjust` divides by the sum of the weights instead
    of starting from the first value."""
    d = _blocked(d, at)
    whole, _ = _windows(keys, at)
    columns = sorted({c for c, _, _ in series.values()})
    upto, before = whole.rowsBetween(Window.unboundedPreceding, 0), whole.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({f"_n_{c}": F.count(c).over(upto) for c in columns} | {
        f"_at_{c}": F.last(F.when(F.col(c).isNotNull(), F.col(at)), ignorenulls=True).over(before) for c in columns})
    maps = {}
    for name, (c, alpha, _) in series.items():
        x, keep = F.col(c).cast("double"), 1.0 - alpha
        if adjust:
            maps[f"_num_{name}"] = (F.lit(keep), F.coalesce(x, F.lit(0.0)))
            maps[f"_den_{name}"] = (F.lit(keep), F.when(x.isNull(), 0.0).otherwise(1.0))
            continue
        old = F.pow(F.lit(keep), F.col(at) - F.col(f"_at_{c}"))
        first = F.col(f"_at_{c}").isNull()
        maps[name] = (F.when(x.isNull() | first, 1.0).otherwise(old / (old + alpha)),
                      F.when(x.isNull(), 0.0).when(first, x).otherwise(alpha * x / (old + alpha)))
    d = affine_scan(d, maps, keys, at)
    out = {n: F.try_divide(F.col(f"_num_{n}"), F.col(f"_den_{n}")) if adjust else F.col(n) for n in series}
    d = d.withColumns({n: F.when(F.col(f"_n_{c}") >= max(least, 1), out[n]) for n, (c, _, least) in series.items()})
    return d.drop("_block", *[f"_{k}_{c}" for c in columns for k in ("n", "at")], *[f"_{k}_{n}" for n in series for k in ("num", "den") if adjust])
