"""Purged, embargoed walk-forward folds as a small table (fold, role, sid_from, sid_to), end exclusive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.config import SplitConfig


def fold_bounds(n: int, cfg: SplitConfig, horizon: int) -> list[dict]:
    """Test blocks laid backwards from the end of n sessions, each with a purged training block."""
    purge, size = horizon + cfg.embargo, cfg.test_size
    if n < cfg.min_train + purge + size:
        size = max(20, (n - cfg.min_train - purge) // max(1, cfg.n_splits))
        if n < cfg.min_train + purge + size:
            raise ValueError(f"need at least {cfg.min_train + purge + 20} sessions for one fold, got {n}")
    starts = [n - size * (k + 1) for k in range(cfg.n_splits)]
    starts = sorted(s for s in starts if s - purge >= cfg.min_train)
    rows = []
    for i, s in enumerate(starts):
        end = s - purge
        begin = 0 if cfg.expanding else max(0, end - cfg.min_train)
        rows += [dict(fold=i, role="train", sid_from=begin, sid_to=end),
                 dict(fold=i, role="test", sid_from=s, sid_to=s + size)]
    return rows


def walk_forward_splits(cal: DataFrame, cfg: SplitConfig, horizon: int) -> DataFrame:
    """The fold table with its dates. The driver only sees the number of sessions."""
    n = cal.agg(F.max("n_sessions")).first()[0] or 0
    rows = cal.sparkSession.createDataFrame(
        [(r["fold"], r["role"], r["sid_from"], r["sid_to"]) for r in fold_bounds(n, cfg, horizon)],
        "fold int, role string, sid_from int, sid_to int")
    first = cal.select(F.col("sid").alias("sid_from"), F.col("date").alias("date_from"))
    last = cal.select((F.col("sid") + 1).alias("sid_to"), F.col("date").alias("date_to"))
    return first.join(F.broadcast(rows), "sid_from").join(last, "sid_to")


def train_val_split(folds: DataFrame, fraction: float, horizon: int, embargo: int) -> DataFrame:
    """The purged tail of each training block as validation; none when either part would be short."""
    t = folds.filter("role = 'train'").withColumn("n", F.col("sid_to") - F.col("sid_from"))
    t = t.withColumn("n_val", F.floor(F.col("n") * fraction).cast("int"))
    keep = F.col("n") - F.col("n_val") - (horizon + embargo)
    none = (F.col("n_val") < 20) | (keep < 50)
    fit = F.struct(F.lit("fit").alias("role"), F.col("sid_from"),
                   F.when(none, F.col("sid_to")).otherwise(F.col("sid_from") + keep).alias("sid_to"))
    val = F.struct(F.lit("val").alias("role"), (F.col("sid_to") - F.col("n_val")).alias("sid_from"), F.col("sid_to"))
    parts = F.when(none, F.array(fit)).otherwise(F.array(fit, val))
    return t.select("fold", F.explode(parts).alias("_p")).select("fold", "_p.*")


def check_no_overlap(folds: DataFrame, horizon: int, embargo: int) -> DataFrame:
    """Sessions from the last training session to the first test session, and whether they suffice."""
    need = horizon + embargo
    g = folds.groupBy("fold").agg(
        (F.max(F.when(F.col("role") == "test", F.col("sid_from")))
         - (F.max(F.when(F.col("role") == "train", F.col("sid_to"))) - 1)).alias("gap"))
    return g.select("fold", "gap", F.lit(need).alias("needed"), (F.col("gap") >= need).alias("ok"))


def range_fold_join(d: DataFrame, folds: DataFrame, cal: DataFrame) -> DataFrame:
    """Rows with every fold and role their session falls in. The ranges are first opened into one row
    per session and fold (bounded by calendar x folds), so the panel meets them in an equi join."""
    opened = (folds.select("fold", "role", F.explode(F.sequence("sid_from", F.col("sid_to") - 1)).alias("sid"))
              .groupBy("sid").agg(F.collect_list(F.struct("fold", "role")).alias("_in")))
    return (d.join(F.broadcast(opened), "sid").withColumn("_f", F.explode("_in"))
            .select(*d.columns, "_f.fold", "_f.role"))


def fold_block(d: DataFrame, features: list[str], target: str = "target") -> DataFrame:
    """Training rows: known target, missing features neutral."""
    return d.filter(F.col(target).isNotNull()).fillna(0.0, subset=features)
