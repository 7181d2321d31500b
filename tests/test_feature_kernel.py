"""The pass over a ticker's arrays gives the stages' features, the ranks in memory the windows' ranks."""
import numpy as np
import pandas as pd

from barloom.config import FeatureConfig
from barloom.operators import features as ft


def test_array_pass_equals_the_stages(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(6):
        px = 50 * np.exp(np.cumsum(rng.normal(0, 0.03, 330)))
        if k == 1:
            px[40:200] = 7.0        # no change at all for a while
        for i in range(0 if k else 25, 330 if k != 2 else 9):
            if rng.random() < 0.1 or (k == 3 and 60 < i < 140):
                continue            # holes
            hi, lo = px[i] * (1 if k == 1 else 1.01), px[i] * (1 if k == 1 else 0.98)
            rows.append((pd.Timestamp("2020-01-01") + pd.Timedelta(days=i), f"t{k}", px[i], hi, lo, px[i], float(rng.integers(0, 50))))
    panel = spark.createDataFrame(pd.DataFrame(rows, columns=["date", "ticker", "open", "high", "low", "close", "volume"])).withColumn(
        "date", ft.F.col("date").cast("date")).localCheckpoint()
    cfg, keys = FeatureConfig(), ["date", "ticker"]
    plan = ft.raw_features(panel, cfg)
    assert "FlatMapGroupsInArrow" in plan._jdf.queryExecution().toString()
    got, want = (d.toPandas().sort_values(keys).reset_index(drop=True) for d in (plan, ft.raw_features(panel, cfg, stages=list(ft.STAGES))))
    pd.testing.assert_frame_equal(got, want, rtol=1e-8, atol=1e-12)


def test_ranks_in_memory_equal_the_windows(spark):
    rng = np.random.default_rng(6)
    rows = [(f"d{i % 7}", f"t{i}", None if i % 11 == 0 else float(rng.integers(0, 9)), float("nan") if i % 5 == 0 else float(i % 4),
             1.0 if i == 3 else None) for i in range(210)]
    d = spark.createDataFrame(rows, "date string, ticker string, a double, b double, c double")
    cols = ["a", "b", "c"]
    assert sorted(map(str, ft.rank_features(d, cols, 2, 100).collect())) == sorted(map(str, ft._rank_in_dates(d, cols, 2).collect()))


def made_panel(spark, names=9, days=70):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(names):
        for i in range(5 * k, days):
            if rng.random() < 0.15:
                continue
            o, c = rng.uniform(5, 50, 2)
            rows.append((pd.Timestamp("2020-01-01") + pd.Timedelta(days=i), None if k == 4 else f"t{k}", o, max(o, c) + 1, min(o, c) - 1, c, float(rng.integers(0, 9))))
    rows += [(pd.Timestamp("2020-02-01"), "t2", 3.0, 5.0, 2.0, float(v), 4.0) for v in (4, 5)]      # a date twice
    return spark.createDataFrame(pd.DataFrame(rows, columns=["date", "ticker", "open", "high", "low", "close", "volume"])).withColumn(
        "date", ft.F.col("date").cast("date")).localCheckpoint()


def text(d, *cols):
    return sorted(str(r) for r in d.select(*cols).collect())


def test_many_tickers_at_a_time_equal_one_after_the_other(spark, monkeypatch):
    """Nulls among the tickers, dates that come twice, tickers of other lengths, and batches that end within a ticker."""
    from barloom.operators import feature_kernel as fk
    panel, cfg = made_panel(spark), FeatureConfig()
    cols = ["date", "ticker", *ft.names(cfg)]
    dates = panel.filter("date <> '2020-02-01'")
    one = ft.raw_features(dates, cfg)
    many = ft.raw_features(dates, cfg, days=(None, None))
    assert "MapInArrow" in many._jdf.queryExecution().toString() and text(one, *cols) == text(many, *cols)
    inner = ft.raw_features(dates, cfg, days=(np.datetime64("2020-01-20").item(), np.datetime64("2020-02-20").item()))
    assert text(one.filter("date >= '2020-01-20' and date < '2020-02-20'"), *cols) == text(inner, *cols)
    grid = ft.with_market(ft.grid(panel, cfg), cfg).select("date", "ticker", "sid", *[ft.F.col(c).cast("double").alias(c) for c in fk.INPUTS])
    batches = grid.orderBy("ticker", "sid", "close").toArrow().combine_chunks().to_batches(max_chunksize=37)
    whole = list(fk.all_features(iter(batches), cfg, ft.names(cfg)))
    monkeypatch.setattr(fk, "ROWS", 50)
    cut = list(fk.all_features(iter(batches), cfg, ft.names(cfg)))
    rows = lambda made: sorted(str(r) for b in made for r in b.to_pylist())     # noqa: E731
    assert len(cut) > len(whole) and rows(whole) == rows(cut) and len(rows(cut)) == grid.count()


def test_stretches_of_dates_and_tables_joined_within_dates_change_nothing(spark, monkeypatch):
    from dataclasses import replace
    panel, cfg = made_panel(spark).filter("date <> '2020-02-01'"), replace(FeatureConfig(), min_names=2)
    cols = ft.names(cfg)
    side = panel.filter("volume > 2").select("date", "ticker", (ft.F.col("close") * 2).alias("twice"), (ft.F.col("volume") > 5).alias("busy"))
    plain = ft.compute_features(panel, cfg, 100)
    assert len(ft._date_parts(panel, len(cols), 100)) == 1
    joined = text(plain.join(side, ["date", "ticker"]), "date", "ticker", *cols, "twice", "busy")
    beside = ft.compute_features(panel, cfg, 100, side)
    assert beside.columns == ["date", "ticker", *cols, "twice", "busy"] and text(beside, *beside.columns) == joined
    assert text(ft.compute_features(panel, cfg, None, side), *beside.columns) == joined      # with the ladder
    monkeypatch.setattr(ft, "MANY_NAMES", 1)
    monkeypatch.setattr(ft, "PART_BYTES", 30_000)
    parts = ft._date_parts(panel, len(cols), 100)
    assert len(parts) > 2 and parts[0][0] is None and parts[-1][1] is None and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert text(ft.compute_features(panel, cfg, 100), "date", "ticker", *cols) == text(plain, "date", "ticker", *cols)
    assert text(ft.compute_features(panel, cfg, 100, side), *beside.columns) == joined


def test_features_and_labels_meet_in_one_deal_by_date(spark):
    """The plan of the modelling rows deals the features once; they were dealt by date and by (date, ticker)."""
    from dataclasses import replace
    from barloom.config import weekly
    from barloom.plans.datasets import prepare_dataset
    run = weekly()
    run = replace(run, data=replace(run.data, min_history=5, min_price=0.0, min_dollar_volume=0.0), features=replace(run.features, min_names=2),
                  labels=replace(run.labels, min_names=2))
    d = prepare_dataset(made_panel(spark).filter("date <> '2020-02-01'"), run, 100)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "SortMergeJoin" not in plan
    assert d.columns[:2] == ["date", "ticker"] and d.columns[-4:] == ["fwd_ret", "target", "ret_next_1d", "close"]
    assert d.count() == d.filter("ticker is not null").count() > 0


def test_shuffles_of_a_kept_table_are_let_go(spark, tmp_path, monkeypatch):
    from barloom.sources import tables
    seen = []
    monkeypatch.setattr(tables, "release", seen.append)
    t = tables.Tables(spark, str(tmp_path))
    for _ in range(2):
        assert t.keep("some", lambda: spark.range(9).repartition(3)).count() == 9
    assert seen == [spark]


def test_causality_check_compares_columns_in_turn(spark, monkeypatch):
    """One column looks ahead; null tickers never meet, so their values count as changed."""
    from barloom.operators import models as md
    panel = made_panel(spark)
    n = panel.filter("date <= '2020-02-10'").select(ft.F.count("close"), ft.F.count("open"), ft.F.count_if(ft.F.col("ticker").isNull())).first()

    def make(p):
        return p.crossJoin(p.agg(ft.F.max("date").alias("last"))).select("date", "ticker", "close", "open", ft.F.datediff("last", "date").alias("ahead"))
    monkeypatch.setattr(md, "COMPARED", 2)
    once = panel.filter("date <> '2020-02-01'")
    got = {r.feature: (r.rows_, r.changed) for r in md.causality_check(once, make, "2020-02-10", ["close", "open", "ahead"]).collect()}
    rows = once.filter("date <= '2020-02-10'").count()
    none = once.filter("date <= '2020-02-10' and ticker is null").count()
    assert got == {"close": (rows, 2 * none), "open": (rows, 2 * none), "ahead": (rows, rows + none)} and n[0] > rows
