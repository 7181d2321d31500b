"""Boosted trees against a plain leaf-wise grower, early stopping, and independence of the partitioning."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.config import ModelConfig
from barloom.operators import boosting, models

CFG = ModelConfig(gbt_trees=4, gbt_step=0.3, gbt_depth=4, gbt_min_child=15, gbt_leaves=6, gbt_subsample=1.0, gbt_feature_share=1.0)
NAMES = ["a", "b", "c"]


def made_rows(n=700, seed=3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 12, n), rng.integers(0, 5, n), rng.integers(0, 40, n)], 1).astype(float)
    x[rng.random((n, 3)) < 0.12] = np.nan
    y = np.where(np.isnan(x[:, 0]), 2.0, np.nan_to_num(x[:, 0]) > 6) + 0.3 * np.nan_to_num(x[:, 1]) + rng.normal(size=n) * 0.2
    return x, y, np.arange(n) % 50


def table(spark, x, y, sid, parts=4):
    rows = [(int(s), f"T{i}", *(None if np.isnan(v) else float(v) for v in r), None if np.isnan(t) else float(t)) for i, (s, r, t) in enumerate(zip(sid, x, y))]
    d = spark.createDataFrame(rows, "sid int, ticker string, a double, b double, c double, target double")
    return d.withColumn("date", F.date_add(F.lit("2001-01-01").cast("date"), F.col("sid"))).repartition(parts)


def plain(x, y, every, cfg):
    """Scores of all rows `every` by trees that split, one leaf at a time, the leaf of the largest gain."""
    def worth(g):
        return g.sum() ** 2 / (len(g) + cfg.gbt_l2)

    def best(rows, g, depth):
        top = None
        for f in range(x.shape[1]) if depth < cfg.gbt_depth else ():
            v = x[rows, f]
            for cut in np.unique(v[~np.isnan(v)]):
                for none_left in (False, True):
                    left = (v <= cut) | (np.isnan(v) & none_left)
                    if min(left.sum(), (~left).sum()) < cfg.gbt_min_child:
                        continue
                    gain = worth(g[rows][left]) + worth(g[rows][~left]) - worth(g[rows])
                    if gain > 1e-12 and (top is None or gain > top[0] + 1e-9):
                        goes = none_left if np.isnan(v).any() else left.sum() >= (~left).sum()
                        top = (gain, f, cut, goes)
        return top

    s, out = np.full(len(y), y.mean()), np.full(len(every), y.mean())
    for _ in range(cfg.gbt_trees):
        g = y - s
        leaves = [(np.arange(len(y)), np.arange(len(every)), 0)]
        for _ in range(cfg.gbt_leaves - 1):
            found = [(best(r, g, d), i) for i, (r, _, d) in enumerate(leaves)]
            found = [(b, i) for b, i in found if b]
            if not found:
                break
            (_, f, cut, goes), i = max(found, key=lambda t: t[0][0])
            r, e, d = leaves.pop(i)
            for side in (True, False):
                pick = [((m[q, f] <= cut) | (np.isnan(m[q, f]) & goes)) == side for m, q in ((x, r), (every, e))]
                leaves.append((r[pick[0]], e[pick[1]], d + 1))
        for r, e, _ in leaves:
            v = cfg.gbt_step * g[r].sum() / (len(r) + cfg.gbt_l2)
            s[r] += v
            out[e] += v
    return out


def test_trees_equal_the_plain_grower(spark):
    """Two folds with overlapping blocks, missing features, rows without a target."""
    x, y, sid = made_rows()
    y[::17] = np.nan
    d = table(spark, x, y, sid)
    fits, tests = {0: (0, 25), 1: (0, 40)}, {0: (28, 40), 1: (42, 50)}
    scores, gains = models.gbt_blocks(d, NAMES, {"fit": fits, "val": {}, "test": tests}, CFG)
    got = {(r.fold, r.ticker): r.score for r in scores.collect()}
    want = {}
    for k in fits:
        m = (sid >= fits[k][0]) & (sid < fits[k][1]) & ~np.isnan(y)
        at = np.flatnonzero((sid >= tests[k][0]) & (sid < tests[k][1]))
        want |= {(k, f"T{i}"): v for i, v in zip(at, plain(x[m], y[m], x[at], CFG))}
        assert gains[k][0] > gains[k][2]
    assert set(got) == set(want)
    np.testing.assert_allclose([got[k] for k in sorted(want)], [want[k] for k in sorted(want)], atol=1e-5)


def test_early_stop_keeps_the_best_round_whatever_the_partitions(spark):
    from dataclasses import replace
    x, y, sid = made_rows(400, 5)
    y = np.random.default_rng(1).normal(size=len(y))        # nothing to learn: the loss on the tail soon rises
    cfg = replace(CFG, gbt_trees=14, gbt_patience=3, gbt_subsample=0.7, gbt_feature_share=0.67, gbt_depth=3)
    one, two = (boosting.fit_blocks(table(spark, x, y, sid, parts), NAMES, {0: (0, 30)}, {0: (34, 50)}, cfg) for parts in (1, 7))
    assert one.losses == two.losses and len(one.losses[0]) > 3
    assert len(one.trees[0]) == 1 + int(np.argmin(one.losses[0][1:]))
    assert [t.value.tolist() for t in one.trees[0]] == [t.value.tolist() for t in two.trees[0]]


def test_all_rounds_are_run_without_a_tail_and_stored_scores_change_nothing(spark, monkeypatch):
    from dataclasses import replace
    x, y, sid = made_rows(300, 8)
    d, cfg = table(spark, x, y, sid), replace(CFG, gbt_depth=2)
    whole = boosting.fit_blocks(d, NAMES, {0: (0, 50)}, {}, cfg)
    monkeypatch.setattr(boosting, "STORE_EVERY", 1)
    often = boosting.fit_blocks(d, NAMES, {0: (0, 50)}, {}, cfg)
    assert len(whole.trees[0]) == len(often.trees[0]) == 4
    assert [t.value.tolist() for t in whole.trees[0]] == [t.value.tolist() for t in often.trees[0]]


def test_one_fold_call_and_tables_without_targets(spark):
    x, y, sid = made_rows(200, 4)
    d = table(spark, x, y, sid).withColumn("extra", F.lit("kept"))
    f = models.fit_gbt(d.filter("sid < 30"), d.filter("sid >= 35"), NAMES, CFG)
    r = f.score(d.filter("sid >= 30"))
    assert r.columns == [*d.columns, "score"] and r.filter("score is null or extra <> 'kept'").count() == 0
    assert set(f.importance) == set(NAMES)
    with pytest.raises(ValueError):
        models.fit_gbt(d.withColumn("target", F.lit(None).cast("double")), None, NAMES, CFG)


def trees_of(made):
    return {k: [(t.feature.tolist(), t.cut.tolist(), t.missing_left.tolist(), t.value.tolist(), t.gain.tolist()) for t in v] for k, v in made.trees.items()}


def test_whole_folds_a_task_meeting_tasks_and_a_job_a_level_grow_the_same_trees(spark, monkeypatch):
    """Three folds, one without a tail, one that stops early; rows drawn by hash, missing values, blocks smaller than a task's rows."""
    from dataclasses import replace
    x, y, sid = made_rows(900, 11)
    y[::13] = np.nan
    cfg = replace(CFG, gbt_trees=12, gbt_patience=2, gbt_subsample=0.7, gbt_feature_share=0.67, gbt_step=0.9)
    fits, vals = {0: (0, 20), 1: (0, 28), 2: (3, 41)}, {1: (31, 38), 2: (43, 50)}
    d = table(spark, x, y, sid)
    alone = boosting.fit_blocks(d, NAMES, fits, vals, cfg)
    monkeypatch.setattr(boosting, "ALONE", 0)
    monkeypatch.setattr(boosting, "SHARE", 300)
    met = boosting.fit_blocks(d, NAMES, fits, vals, cfg)
    monkeypatch.setattr(boosting, "_places", lambda spark, meet: 0)
    levels = boosting.fit_blocks(d, NAMES, fits, vals, cfg)
    assert len(alone.trees[0]) == 12 and min(len(alone.trees[k]) for k in vals) < 12
    assert trees_of(alone) == trees_of(met) == trees_of(levels)
    assert alone.losses == met.losses == levels.losses


def test_rows_of_a_task_are_worked_on_in_blocks(spark, monkeypatch):
    from barloom.operators import boosting_tasks
    import pyarrow as pa
    x, y, sid = made_rows(800, 12)
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 30, (800, 3)).astype(np.uint8)
    job = boosting.Job([0], 3, {0: (5, 30)}, {0: (35, 50)}, 2.0 ** 28 / 5, CFG, {0: 0.25})
    batches = [pa.RecordBatch.from_arrays([pa.array(sid[i:i + 100].astype(np.int32)), pa.array(rng.integers(0, 9, len(sid[i:i + 100]))), pa.array(y[i:i + 100]),
                                           boosting._bytes(bins[i:i + 100])], names=["sid", "u", "y", "x"]) for i in range(0, 800, 100)]
    one = boosting_tasks.Rows(iter(batches), [0], job)
    monkeypatch.setattr(boosting_tasks, "BLOCK", 150)
    many = boosting_tasks.Rows(iter(batches), [0], job)
    assert len(one.blocks) == 1 and len(many.blocks) == 4
    for rows in (one, many):
        rows.draw(0, 1)
    every, fit = np.arange(3), (sid >= 5) & (sid < 30)
    assert (one.sums(0, [1], every) == many.sums(0, [1], every)).all() and one.losses(0) == many.losses(0)
    assert [int(v) for v in one.sums(0, [1], every)[1, 1, 0, :30]] == np.bincount(bins[fit, 1], minlength=30).tolist()


def test_registered_model_queries_fit_all_trees_of_the_settings(monkeypatch):
    from barloom.plans import catalog, catalog_models
    seen = []
    monkeypatch.setattr(catalog_models.md, "walk_forward", lambda d, features, splits, cfg, horizon: seen.append(cfg))
    catalog_models.walk(None, d="rows")
    assert (seen[0].gbt_trees, seen[0].gbt_step, seen[0].gbt_depth) == (ModelConfig().gbt_trees, ModelConfig().gbt_step, ModelConfig().gbt_depth) == (600, 0.02, 6)
