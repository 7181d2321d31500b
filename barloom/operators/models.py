"""Models behind one call: `fit(train, val, features, cfg)` gives scores and importances.

Fits run on the executors (sums of products and tree statistics are aggregates); the driver
holds coefficients and fold bounds only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window, functions as F

from barloom.config import ModelConfig, SplitConfig
from barloom.operators import metrics as mt
from barloom.operators.boosting import fit_blocks, score_rows
from barloom.operators.features import rank_features
from barloom.operators.linear import Moments, moments, ridge_blocks, ridge_weights
from barloom.operators.panel import calendar
from barloom.operators.splits import check_no_overlap, train_val_split, walk_forward_splits
from barloom.session import materialize, release

COMPARED = 11       # columns that the causality check compares at a time


@dataclass
class Fitted:
    score: Callable[[DataFrame], DataFrame]
    importance: dict[str, float]


def _vectors(d: DataFrame, features: list[str]) -> DataFrame:
    """Missing ranks are neutral."""
    return VectorAssembler(inputCols=features, outputCol="x").transform(d.fillna(0.0, subset=features))


def fit_ridge(train: DataFrame, val: DataFrame | None, features: list[str], cfg: ModelConfig) -> Fitted:
    """Least squares with an L2 penalty on standardised inputs, in closed form from one scan's sums of products."""
    total = np.zeros((2 + len(features),) * 2)
    for r in moments(train, features, ["target"], F.lit(0)).toLocalIterator():
        total[r["i"], r["j"]] = total[r["j"], r["i"]] = r["value"]
    if not total[0, 0]:
        raise ValueError("no row with a target")
    w, add, imp = ridge_weights(Moments(len(features), total), cfg.ridge_alpha)

    def score(d: DataFrame) -> DataFrame:
        return d.withColumn("score", sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * float(v) for c, v in zip(features, w[:, 0])),
                                         F.lit(float(add[0]))))
    return Fitted(score, dict(zip(features, imp[:, 0].tolist())))


def fit_gbt(train: DataFrame, val: DataFrame | None, features: list[str], cfg: ModelConfig) -> Fitted:
    """Boosted trees, stopped early on the purged tail. Rows need `ticker` and `date`, which decide about sampling."""
    cols = ["ticker", "date", "target", *features]
    d = train.select(*cols, F.lit(0).alias("sid"))
    if val is not None:
        d = d.unionByName(val.select(*cols, F.lit(1).alias("sid")))
    made = fit_blocks(d, features, {0: (0, 1)}, {} if val is None else {0: (1, 2)}, cfg)

    def score(rows: DataFrame) -> DataFrame:
        return score_rows(rows.withColumn("fold_of_model", F.lit(0)), made, "fold_of_model").drop("fold_of_model")
    return Fitted(score, dict(zip(features, made.importance(0).tolist())))


def gbt_blocks(d: DataFrame, features: list[str], blocks: dict[str, dict[int, tuple[int, int]]], cfg: ModelConfig
               ) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """Boosted trees of all folds, grown together: (date, ticker, fold, score) of the test rows and each fold's importances."""
    made = fit_blocks(d, features, blocks["fit"], blocks["val"], cfg)
    fold = F.coalesce(*[F.when((F.col("sid") >= a) & (F.col("sid") < b), k) for k, (a, b) in blocks["test"].items() if k in made.base])
    scores = score_rows(d.withColumn("fold", fold).filter("fold is not null").select("date", "ticker", "fold", *features), made)
    return scores.select("date", "ticker", "fold", "score"), {k: made.importance(k) for k in made.base}


REGISTRY: dict[str, Callable[..., Fitted]] = {"ridge": fit_ridge, "gbt": fit_gbt}


def build_model(name: str) -> Callable[..., Fitted]:
    if name not in REGISTRY:
        raise ValueError(f"unknown model {name!r}, choose from {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


def fold_blocks(d: DataFrame, splits: SplitConfig, cfg: ModelConfig, horizon: int
                ) -> tuple[DataFrame, dict[str, dict[int, tuple[int, int]]]]:
    """`d` with `sid`, and {role: {fold: (sid_from, sid_to)}} of the roles fit, val and test, checked for overlap."""
    cal = calendar(d).select("date", "sid", "n_sessions")
    folds = walk_forward_splits(cal, splits, horizon)
    if folds.filter("role = 'train'").count() == 0:
        raise ValueError("no fold fits the sample")
    bad = check_no_overlap(folds, horizon, splits.embargo).filter("not ok").limit(1).count()
    if bad:
        raise AssertionError("a training block reaches into its test block")
    blocks: dict[str, dict[int, tuple[int, int]]] = {"fit": {}, "val": {}, "test": {}}
    for r in (train_val_split(folds, cfg.val_fraction, horizon, splits.embargo).select("fold", "role", "sid_from", "sid_to")
              .union(folds.filter("role = 'test'").select("fold", "role", "sid_from", "sid_to")).toLocalIterator()):
        blocks[r["role"]][r["fold"]] = (r["sid_from"], r["sid_to"])
    return d.drop("sid", "n_sessions").join(F.broadcast(cal.select("date", "sid")), "date"), blocks


def walk_forward(d: DataFrame, features: list[str], splits: SplitConfig, cfg: ModelConfig, horizon: int
                 ) -> tuple[DataFrame, DataFrame]:
    """Out-of-sample scores (date, ticker, model, score) and importances (model, fold, feature, importance).
    `d` should be a stored table. Ridge fits all folds from one scan (`linear.block_moments`), trees of all folds grow together
    (`boosting.fit_blocks`); other models filter the table by session for every fold."""
    d, blocks = fold_blocks(d, splits, cfg, horizon)

    def part(fold: int, role: str) -> DataFrame | None:
        if fold not in blocks[role]:
            return None
        a, b = blocks[role][fold]
        return d.filter((F.col("sid") >= a) & (F.col("sid") < b))

    made, imps = [], []
    for name in cfg.models:
        if build_model(name) is fit_ridge:
            s, weights = ridge_blocks(d, features, ["target"], blocks["fit"], blocks["test"], cfg)
            made.append(s.select("date", "ticker", F.lit(name).alias("model"), F.col("score_target").alias("score")))
            imps += [(name, fold, c, float(v)) for fold, w in weights.items() for c, v in zip(features, w[:, 0])]
            continue
        if build_model(name) is fit_gbt:
            s, weights = gbt_blocks(d, features, blocks, cfg)
            made.append(s.select("date", "ticker", F.lit(name).alias("model"), "score"))
            imps += [(name, fold, c, float(v)) for fold, w in weights.items() for c, v in zip(features, w)]
            continue
        known = F.col("target").isNotNull()
        for fold in sorted(blocks["test"]):
            fit, val, test = part(fold, "fit"), part(fold, "val"), part(fold, "test")
            f = build_model(name)(fit.filter(known), None if val is None else val.filter(known), features, cfg)
            made.append(f.score(test).select("date", "ticker", F.lit(name).alias("model"), "score"))
            imps += [(name, fold, c, v) for c, v in f.importance.items()]
    scores = made[0]
    for s in made[1:]:
        scores = scores.unionByName(s)
    return scores, d.sparkSession.createDataFrame(imps, "model string, fold int, feature string, importance double")


def importance_average(imps: DataFrame) -> DataFrame:
    """Mean over folds, scaled to one within a model; models x features rows."""
    m = imps.groupBy("model", "feature").agg(F.avg("importance").alias("importance"))
    return m.withColumn("importance", F.try_divide("importance", F.sum("importance").over(Window.partitionBy("model"))))


def topk_importance(avg: DataFrame, model: str, k: int = 18) -> DataFrame:
    return avg.filter(F.col("model") == model).orderBy(F.col("importance").desc(), "feature").limit(k)


def sequence_windows(d: DataFrame, features: list[str], length: int = 20) -> DataFrame:
    """The last `length` feature vectors of each row's ticker, oldest first; rows with a shorter history are left
    out (their score is neutral). Missing values are 0, values are clipped at 5."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-(length - 1), 0)
    clip = [F.least(F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(-5.0)), F.lit(5.0)) for c in features]
    s = d.withColumn("window", F.collect_list(F.array(*clip)).over(w))
    return s.filter(F.size("window") == length)


def low_day_classifier(d: DataFrame, features: list[str], split_sid: int, gap: int, trees: int = 20, depth: int = 5,
                       seed: int = 7) -> DataFrame:
    """Guesses the low day of sessions from `split_sid` on, trained on sessions that ended `gap` before."""
    rf = RandomForestClassifier(featuresCol="x", labelCol="low_day", numTrees=trees, maxDepth=depth, seed=seed)
    known = d.filter("low_day is not null").withColumn("low_day", F.col("low_day").cast("double"))
    model = rf.fit(_vectors(known.filter(F.col("sid") < split_sid - gap), features))
    out = model.transform(_vectors(known.filter(F.col("sid") >= split_sid), features))
    return out.select("date", "ticker", F.col("low_day").cast("int").alias("low_day"), F.col("prediction").cast("int").alias("guess"))


def permuted_targets(d: DataFrame, seeds: int, bound: int | None = None) -> tuple[DataFrame, list[str]]:
    """`d` with a column for each seed: the rank targets of a date's names in a random order (the ranks of a hash of ticker, date
    and seed, among the names with a target)."""
    names = [f"null_{s}" for s in range(seeds)]
    draws = {n: F.when(F.col("target").isNotNull(), F.xxhash64("ticker", F.col("date").cast("string"), F.lit(s)).cast("double"))
             for s, n in enumerate(names)}
    return rank_features(d.withColumns(draws), names, 1, bound), names


def permutation_null_test(d: DataFrame, features: list[str], splits: SplitConfig, cfg: ModelConfig, horizon: int, seeds: int,
                          min_names: int = 20, bound: int | None = None) -> DataFrame:
    """Skill of ridge refitted on targets that no feature can know: `seeds` permutations of each date's targets, fitted on
    every fold and scored out of sample against the permuted targets. All share the features' products, so they cost one scan."""
    d, targets = permuted_targets(d, seeds, bound)
    d = materialize(d.select("date", "ticker", *features, *targets), "null-targets")
    d, blocks = fold_blocks(d, splits, cfg, horizon)
    scores, _ = ridge_blocks(d, features, targets, blocks["fit"], blocks["test"], cfg)
    both = scores.join(d.select("date", "ticker", *targets), ["date", "ticker"])
    long = both.select("date", "ticker", F.explode(F.array(*[
        F.struct(F.lit(i).alias("seed"), F.col(f"score_{t}").alias("score"), F.col(t).alias("outcome")) for i, t in enumerate(targets)])).alias("_r"))
    ic = mt.daily_ic(long.select("date", "ticker", "_r.*"), "score", "outcome", min_names, bound, keys=("date", "seed"))
    return mt.ic_summary(ic, ("seed",))


def add_leak(d: DataFrame, target: str, noise: float, seed: int, out: str = "leak") -> DataFrame:
    """The target with uniform hash noise, as a feature a guard must notice."""
    u = F.xxhash64("ticker", F.col("date").cast("string"), F.lit(seed)).cast("double") / 2.0 ** 63
    return d.withColumn(out, F.col(target) + u * noise)


def causality_check(panel: DataFrame, make: Callable[[DataFrame], DataFrame], cut: str, cols: list[str]) -> DataFrame:
    """Features up to `cut` from the whole panel and from the panel that ends there: rows and differences. Both are stored, and some
    columns are compared after others, so that not all of them are dealt at once. The driver gets two numbers a column."""
    spark, day = panel.sparkSession, F.lit(cut).cast("date")
    sides = []
    for d in (panel, panel.filter(F.col("date") <= day)):
        made = make(d)
        upto = made.filter(F.col("date") <= day).select("date", "ticker", *cols)
        sides.append(upto if getattr(made, "_stored", False) else materialize(upto, "checked"))
        release(spark)
    found = []
    for at in range(0, len(cols), COMPARED):
        some = cols[at:at + COMPARED]
        full, part = (d.select("date", "ticker", *some) for d in sides)
        j = full.join(part.select("date", "ticker", *[F.col(c).alias(f"_{c}") for c in some]), ["date", "ticker"], "full_outer")
        n = j.agg(*[F.struct(F.count(c).alias("rows_"), F.count_if(~F.col(c).eqNullSafe(F.col(f"_{c}"))).alias("changed")).alias(c) for c in some]).first()
        found += [(c, n[c]["rows_"], n[c]["changed"]) for c in some]
        release(spark)
    return spark.createDataFrame(found, "feature string, rows_ long, changed long")
