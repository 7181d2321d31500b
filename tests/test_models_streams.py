"""Ridge against its closed form, and streams in several micro-batches against the batch result."""
import numpy as np
from pyspark.sql import functions as F

from barloom.config import ModelConfig, SplitConfig
from barloom.operators import linear, metrics as mt, models
from barloom.operators.models import build_model, fit_ridge
from barloom.streaming import ops, quotes as sq, tables as tb

import pytest

from folders import SMALL as FOLDER


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)) * [1, 5, 0.2]
    y = x @ [0.5, -0.1, 2.0] + rng.normal(size=400)
    d = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, target double")
    got = np.array([r.score for r in fit_ridge(d, None, ["a", "b", "c"], ModelConfig()).score(d).select("score").collect()])
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 10.0 * np.eye(3), z.T @ (y - y.mean()))
    np.testing.assert_allclose(got, z @ w + y.mean(), atol=1e-6)


def test_ridge_of_all_folds_equals_closed_form(spark):
    """Overlapping training blocks, several targets, missing features and targets, a constant feature, an empty test block."""
    rng = np.random.default_rng(5)
    n = 900
    x = rng.normal(size=(n, 4)) * [1, 3, 0.2, 0] + [2, -1, 0, 4]
    y = np.stack([x @ [0.5, -0.1, 2.0, 1.0] + rng.normal(size=n), rng.normal(size=n)], 1)
    sid = np.arange(n) % 60
    hole = rng.random((n, 4)) < 0.1
    rows = [(int(s), f"T{i}", *(None if h else float(v) for v, h in zip(r, m)), float(t[0]), None if i % 7 == 0 else float(t[1]), i)
            for i, (s, r, m, t) in enumerate(zip(sid, x, hole, y))]
    d = spark.createDataFrame(rows, "sid int, ticker string, a double, b double, c double, k double, up double, noise double, at int")
    d = d.withColumn("date", F.date_add(F.lit("2001-01-01").cast("date"), F.col("sid"))).repartition(5)
    fits, tests = {0: (0, 20), 1: (0, 40), 2: (15, 40)}, {0: (22, 40), 1: (44, 60), 2: (60, 70)}
    got, imp = linear.ridge_blocks(d, ["a", "b", "c", "k"], ["up", "noise"], fits, tests, ModelConfig())
    found = {(r.fold, r.ticker): (r.score_up, r.score_noise) for r in got.collect()}
    z = np.where(hole, 0.0, x)
    known = np.arange(n) % 7 != 0
    want = {}
    for k, (a, b) in fits.items():
        m = known & (sid >= a) & (sid < b)
        sd = z[m].std(0)
        s = (z - z[m].mean(0)) / np.where(sd > 1e-9, sd, 1)
        w = np.linalg.solve(s[m].T @ s[m] + 10.0 * np.eye(4), s[m].T @ (y[m] - y[m].mean(0)))
        np.testing.assert_allclose(imp[k], np.abs(w) * (sd > 1e-9)[:, None], atol=1e-9)
        for i in np.flatnonzero((sid >= tests[k][0]) & (sid < tests[k][1])):
            want[k, f"T{i}"] = tuple(s[i] @ w + y[m].mean(0))
    assert set(found) == set(want)
    np.testing.assert_allclose([found[k] for k in sorted(found)], [want[k] for k in sorted(found)], atol=1e-9)


def test_null_test_refits_and_the_leak_fires(spark):
    rng = np.random.default_rng(9)
    rows = [(d, f"T{i}", float(rng.normal()), float(rng.normal()), float(i / 40 - 0.5)) for d in range(260) for i in rng.permutation(40).tolist()]
    d = spark.createDataFrame(rows, "day int, ticker string, a double, b double, target double")
    d = d.withColumn("date", F.date_add(F.lit("2001-01-01").cast("date"), F.col("day"))).drop("day")
    splits, cfg = SplitConfig(n_splits=3, test_size=40, min_train=100, embargo=2), ModelConfig(models=("ridge",))
    t, names = models.permuted_targets(d, 3)
    assert all(t.groupBy("date").agg(F.count_distinct(n).alias("n"), F.sum(n).alias("s")).filter(f"n <> 40 or abs(s - 0.5) > 1e-9").count() == 0 for n in names)
    null = models.permutation_null_test(d, ["a", "b"], splits, cfg, 2, seeds=12).collect()
    assert len(null) == 12 and max(abs(r.ic_t_stat) for r in null) < 4 and {r.ic_days for r in null} == {120}
    leaky = models.add_leak(d, "target", 0.5, 3)
    scores = models.walk_forward(leaky, ["a", "b", "leak"], splits, cfg, 2)[0].join(d.select("date", "ticker", "target"), ["date", "ticker"])
    assert mt.ic_summary(mt.daily_ic(scores, "score", "target")).first().ic_t_stat > 20


def test_unknown_model():
    with pytest.raises(ValueError):
        build_model("oracle")


@pytest.fixture(scope="module")
def split(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ev") / "events")
    spark.read.parquet(f"{FOLDER}/events.parquet").repartition(4, F.xxhash64("event_id")).write.parquet(path)
    return path


def test_bars_over_several_batches(spark, split):
    s = tb.tick_stream(spark, split, files_per_batch=1)
    got = tb.run_update(ops.bars(s, "1 hour", late="60 days"), "t", ["ticker", "bar"])
    one = tb.run_update(ops.bars(tb.tick_stream(spark, FOLDER, "events.parquet"), "1 hour"), "u", ["ticker", "bar"])
    assert got.exceptAll(one.select(*got.columns)).count() == 0 and got.count() == one.count()


def test_upsert_over_several_batches(spark, split):
    def led(s):
        return s.select("user_id", ops.plain(F.col("ts")).cast("date").alias("day"), "id", "px", "ts")
    got = tb.run_upsert(led(tb.tick_stream(spark, split, files_per_batch=1)), "l", ["user_id", "day"], ["ts", "id"], "day")
    one = tb.run_upsert(led(tb.tick_stream(spark, FOLDER, "events.parquet")), "m", ["user_id", "day"], ["ts", "id"], "day")
    assert got.count() == one.count() and got.exceptAll(one.select(*got.columns)).count() == 0


def test_upsert_goes_on_after_a_restart(spark, tmp_path):
    def led(s):
        return s.select("user_id", ops.plain(F.col("ts")).cast("date").alias("day"), "id", "px", "ts")

    def upsert():
        return tb.run_upsert(led(tb.tick_stream(spark, str(tmp_path / "in"), files_per_batch=1)), "r", ["user_id", "day"], ["ts", "id"],
                             "day", str(tmp_path / "ledger"))
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    for part in range(3):       # each run sees files that the one before did not
        events.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = upsert()
    one = tb.run_upsert(led(tb.tick_stream(spark, FOLDER, "events.parquet")), "m", ["user_id", "day"], ["ts", "id"], "day")
    assert got.count() == one.count() and got.select(*one.columns).exceptAll(one).count() == 0


def test_quotes_leave_the_state_in_any_order_and_over_a_restart(spark, tmp_path):
    """Two runs over the same checkpoint, files in no order, a name that stops early, a name with one day only, repeated rows."""
    rows = [("A", d, h) for d in (1, 2, 3) for h in (9, 15)] + [("B", 1, 10), ("B", 1, 10), ("C", 3, 11), ("D", 2, 9), ("D", 3, 16)]
    rows = [(f"2024-01-0{d} {h:02d}:00:00", i, n, i % 3, 10.0 + i) for i, (n, d, h) in enumerate(rows)]
    events = spark.createDataFrame(rows, "ts string, event_id long, event_type string, user_id long, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for part in ([10, 0, 5], [7, 3, 8, 9]), ([1, 6, 4], [2]):
        for ids in part:
            events.filter(F.col("event_id").isin(ids)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = sq.quote_state(tb.tick_stream(spark, str(tmp_path / "in"), files_per_batch=1), 10 * 86_400, 3_600)
        got = tb.run_state(s, "q", ["ticker"], ("step",), str(tmp_path / "out")).collect()
    by = {r.ticker: r for r in got}
    assert {k: (r.n, r.price, r.prev_close) for k, r in by.items()} == {
        "A": (6, 15.0, 13.0), "B": (2, 17.0, None), "C": (1, 18.0, None), "D": (2, 20.0, 19.0)}
    # D is the newest and behind by nothing, so no timer of its own has fired; A is one hour behind, which is the limit
    assert {k: r.lag_seconds for k, r in by.items()} == {"A": 3_600, "B": 2 * 86_400 + 6 * 3_600, "C": 5 * 3_600, "D": None}


def test_forecasts_meet_outcomes_of_the_due_day_only(spark, tmp_path):
    rows = [("2024-01-01 09:00:00", 1, "view", 1, 5.0), ("2024-01-01 08:00:00", 2, "view", 1, 4.0), ("2024-01-02 10:00:00", 3, "purchase", 1, 7.0),
            ("2024-01-02 09:00:00", 4, "purchase", 1, 6.0), ("2024-01-03 09:00:00", 5, "purchase", 1, 8.0), ("2024-01-01 09:00:00", 6, "view", 2, 1.0),
            ("2024-01-03 09:00:00", 7, "view", 2, 2.0), ("2024-01-04 09:00:00", 8, "purchase", 2, 3.0),
            ("2024-01-20 00:00:00", 9, "view", -1, 1.0), ("2024-01-20 00:00:00", 10, "purchase", -1, 1.0)]
    events = spark.createDataFrame(rows, "ts string, event_id long, event_type string, user_id long, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    tb.deal_files(events, str(tmp_path / "in"), 3, F.unix_micros(F.col("ts").cast("timestamp")))
    side = lambda kind: ops.first_of_day(tb.tick_stream(spark, str(tmp_path / "in"), files_per_batch=1).filter(F.col("ticker") == kind), "2 days")
    got = tb.run_append(ops.resolve_forecasts(side("view"), side("purchase"), 1), "r").collect()
    assert {(r.user_id, str(r.day), str(r.due), r.forecast, r.outcome) for r in got} == {
        (1, "2024-01-01", "2024-01-02", 4.0, 6.0), (2, "2024-01-03", "2024-01-04", 2.0, 3.0)}
