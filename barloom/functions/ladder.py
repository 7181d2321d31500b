"""Average ranks and exact order statistics that do not put a whole group into one task.

Two plans give the same numbers:

* a window per group, when the caller can bound the group size (`bound`);
* otherwise a *ladder*: equal values are counted first, quantile sketches cut every group into
  slices of values, running counts are taken inside a slice and the slice totals are added. A hot
  group is spread over many tasks, and no row is dropped. Its inputs are written to the shared folder,
  since they are read more than once and ladders may be stacked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.session import materialize

WINDOW_LIMIT = 2_000_000
SLICE_ROWS = 500_000


def _peers(by: list[str], value: str):
    return Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())


def rank_expr(by: list[str], value: str) -> tuple[Column, Column]:
    """(average rank, group count) as window expressions, NULL values unranked."""
    w = _peers(by, value)
    upto = F.count(value).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.count(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.when(F.col(value).isNotNull(), (F.rank().over(w) + upto) / 2), total


def ladder(df: DataFrame, by: list[str], value: str, slices: int | None = None) -> DataFrame:
    """One row per (group, distinct value): `cnt`, `below` (rows with a smaller value), `total`. Without `slices` the largest
    group's distinct values are counted and cut so that a slice holds about SLICE_ROWS of them, however many there are."""
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*by, value)
              .agg(F.count(F.lit(1)).alias("cnt")))
    counts = materialize(counts, "values")      # read for the cuts and for the slices
    if slices is None:
        largest = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("_d")).agg(F.max("_d")).first()[0] or 0
        slices = max(2, -(-largest // SLICE_ROWS))
    probs = [i / slices for i in range(1, slices)]
    cuts = counts.groupBy(*by).agg(
        F.percentile_approx(value, probs, F.lit(max(1000, 20 * slices))).alias("_cuts"))
    # two-step search: every k-th cut first, then the k cuts after the last one below the value
    k = max(2, int(slices ** 0.5))
    cuts = cuts.withColumn("_coarse", F.when(F.size("_cuts") >= k, F.transform(
        F.sequence(F.lit(k), F.greatest(F.size("_cuts"), F.lit(k)), F.lit(k)), lambda i: F.get("_cuts", i - 1)))
        .otherwise(F.slice("_cuts", 1, 0)))
    # without keys the cuts are exactly one row, the result of an aggregate
    cut = counts.join(cuts, by) if by else counts.join(F.broadcast(cuts), F.lit(True))
    below = lambda a: F.size(F.filter(a, lambda c: c < F.col(value)))
    cut = cut.withColumn("_j", below(F.col("_coarse")) * k)
    cut = cut.withColumn("_slice", F.col("_j") + below(F.slice("_cuts", F.col("_j") + 1, F.lit(k)))).drop("_cuts", "_coarse", "_j")
    cut = materialize(cut, "slices")            # read for the totals and for the running counts
    inside = Window.partitionBy(*by, "_slice").orderBy(value)
    totals = cut.groupBy(*by, "_slice").agg(F.sum("cnt").alias("_n"))
    # at most `slices` rows for each group
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_slice")
    totals = totals.select(
        *by, "_slice",
        (F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1))).alias("_before"),
        F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        .alias("total"))
    run = F.sum("cnt").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cnt")
    return (cut.withColumn("_inner", run).join(totals, [*by, "_slice"])
            .select(*by, value, "cnt", (F.col("_inner") + F.coalesce("_before", F.lit(0))).alias("below"), "total"))


def average_rank(df: DataFrame, by: list[str], value: str, out: str, count_out: str,
                 bound: int | None = None, slices: int | None = None) -> DataFrame:
    """Adds the average rank of `value` in its group (ties share it) and the non-null group size."""
    if slices is None and bound is not None and bound <= WINDOW_LIMIT:
        r, n = rank_expr(by, value)
        return df.withColumn(out, r).withColumn(count_out, n)
    df = materialize(df, "unranked")            # read for the values and for the result
    steps = ladder(df, by, value, slices)
    look = steps.select(*[F.col(b).alias(f"_{b}") for b in by], F.col(value).alias("_v"),
                        (F.col("below") + (F.col("cnt") + 1) / 2).alias(out))
    cond = F.col(value) == F.col("_v")
    for b in by:
        cond = cond & (F.col(b) == F.col(f"_{b}"))
    ranked = df.join(look, cond, "left").drop("_v", *[f"_{b}" for b in by])
    sizes = steps.groupBy(*by).agg(F.max("total").alias(count_out))
    ranked = ranked.join(sizes, by, "left") if by else ranked.join(F.broadcast(sizes), F.lit(True))    # one row
    return ranked.withColumn(count_out, F.coalesce(count_out, F.lit(0)))


def percent_rank(df: DataFrame, by: list[str], value: str, out: str, bound: int | None = None,
                 min_names: int = 1, shift: float = 0.0, slices: int | None = None) -> DataFrame:
    """Average rank / count + shift, NULL where the group has fewer than `min_names` values."""
    d = average_rank(df, by, value, "_r", "_n", bound, slices)
    return (d.withColumn(out, F.when(F.col("_n") >= min_names, F.col("_r") / F.col("_n") + shift))
            .drop("_r", "_n"))


def exact_quantile(df: DataFrame, by: list[str], value: str, q: float, out: str,
                   slices: int | None = None) -> DataFrame:
    """Linear-interpolated quantile of each group, exact, without gathering the group."""
    pos = F.lit(q) * (F.col("total") - 1)
    steps = ladder(df, by, value, slices).withColumn("_p", pos)
    lo, hi = F.floor("_p"), F.ceil("_p")
    holds = lambda k: (F.col("below") <= k) & (F.col("below") + F.col("cnt") > k)
    return (steps.groupBy(*by).agg(
        F.max(F.when(holds(lo), F.col(value))).alias("_a"),
        F.max(F.when(holds(hi), F.col(value))).alias("_b"),
        F.max(F.col("_p") - lo).alias("_f"))
        .select(*by, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias(out)))
