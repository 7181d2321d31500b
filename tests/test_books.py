"""Invariants of books and results."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.config import BookConfig
from barloom.operators import books as bk, ledger as ld, rules as ru
from barloom.sources.signals import long_scores


def _fill_by_rounds(raw, target, cap):
    w, locked = np.array(raw, dtype=float), np.zeros(len(raw), dtype=bool)
    while True:
        free = w[~locked].sum()
        if free > 0:
            w[~locked] *= max(target - w[locked].sum(), 0) / free
        over = ~locked & (w > cap + 1e-12)
        if not over.any():
            return w
        w[over], locked = cap, locked | over


def test_waterfill_equals_the_rounds(spark):
    rng = np.random.default_rng(3)
    rows = [(f"d{d}", "m", "long", f"t{i:03d}", float(v)) for d in range(25)
            for i, v in enumerate(rng.exponential(size=int(rng.integers(2, 40))) + 0.01)]
    legs = spark.createDataFrame(rows, "date string, model string, side string, ticker string, raw double")
    got = bk.waterfill(legs, 0.5, 0.04).toPandas()
    for _, g in got.groupby("date"):
        np.testing.assert_allclose(g["w"].to_numpy(), _fill_by_rounds(g["raw"], 0.5, 0.04), atol=1e-9)
        assert (g["w"] <= 0.04 + 1e-9).all()


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(0)
    n, k = 30, 40
    p = pd.DataFrame([(f"2024-01-{d + 1:02d}", f"t{i:02d}", float(rng.normal()), float(rng.normal() / 100))
                      for d in range(n) for i in range(k)], columns=["date", "ticker", "score", "ret_next_1d"])
    return spark.createDataFrame(p).withColumn("date", F.col("date").cast("date")).withColumn("model", F.lit("m"))


def test_book_is_neutral_and_capped(signal):
    w = bk.target_book(signal, BookConfig(), 100).groupBy("date").agg(
        F.sum("w").alias("net"), F.max(F.abs("w")).alias("top"), F.sum(F.abs("w")).alias("gross")).toPandas()
    assert w["net"].abs().max() < 1e-12 and w["top"].max() <= 0.02 + 1e-12 and w["gross"].max() <= 1 + 1e-9


def test_lag_takes_away_same_day_foresight(signal):
    cheat = signal.withColumn("score", F.col("ret_next_1d"))
    cfg = BookConfig(max_weight=None)
    total = lambda lag: bk.run_backtest(cheat, signal, BookConfig(max_weight=None, lag=lag), 1, 100).agg(
        F.sum("gross_pnl")).first()[0]
    assert total(0) > 5 * abs(total(1)) and cfg.lag == 1


def test_sparse_results_equal_dense_pandas(signal):
    cfg, h = BookConfig(), 3
    got = bk.run_backtest(signal, signal, cfg, h, 100).toPandas().sort_values("date")
    t = bk.target_book(signal, cfg, 100).toPandas()
    s = signal.toPandas()
    wide = lambda d, v: d.pivot(index="date", columns="ticker", values=v)
    ret = wide(s, "ret_next_1d")
    w = wide(t, "w").reindex(index=ret.index, columns=ret.columns).fillna(0.0)
    held = w.rolling(h, min_periods=1).mean().shift(1).fillna(0.0)
    np.testing.assert_allclose(got["gross_pnl"], (held * ret).sum(axis=1), atol=1e-12)
    np.testing.assert_allclose(got["turnover"], held.diff().abs().sum(axis=1), atol=1e-12)


def test_equity_is_cash_and_marked_holdings(spark):
    """A gap in a name's bars, a trade on a day without a bar, two trades a day, a name without any bar."""
    from barloom.operators.rules import equity_from_flows
    bars = spark.createDataFrame([(1, "A", 10.0), (2, "A", 12.0), (4, "A", 15.0), (1, "B", 5.0), (2, "B", 4.0), (3, "B", 6.0), (4, "B", 6.0)], "d int, ticker string, close double")
    trades = spark.createDataFrame([(1, "buy", "A", 2.0, 10.0), (2, "buy", "B", 3.0, 4.0), (3, "sell", "A", 1.0, 13.0), (4, "sell", "B", 3.0, 6.0),
                                    (4, "buy", "B", 1.0, 6.0), (2, "buy", "N", 1.0, 8.0)], "d int, action string, ticker string, quantity double, price double")
    day = lambda c: F.date_add(F.lit("2001-01-01").cast("date"), F.col("d")).alias(c)
    got = equity_from_flows(trades.select(day("at_"), "action", "ticker", "quantity", "price"), bars.select(day("date"), "ticker", "close")).orderBy("date").collect()
    # cash 20, 0, 13, 25 of a capital of 40; A is held at 12 on day 3, which has no bar of it; N is worth nothing
    assert [(r.cash, r.held, r.value, r.capital) for r in got] == [(20.0, 20.0, 40.0, 40.0), (0.0, 36.0, 36.0, 40.0), (13.0, 30.0, 43.0, 40.0), (25.0, 21.0, 46.0, 40.0)]


def test_same_window_starts_at_the_earliest_entry(spark):
    from barloom.operators.holdings import same_window
    d = spark.sql("select date_add(date '2001-01-01', cast(id as int)) as date, 'A' as ticker, 10.0D + id as close from range(10)")
    marks = spark.sql("select 'A' as ticker, 50.0D as value, date '2001-01-03' as entry_at union all select 'X', null, null")
    r = same_window(marks, d, d.select("date", F.col("close").alias("level"))).first()
    assert (str(r.from_), r.sessions, r.context_only) == ("2001-01-03", 7, False) and abs(r.portfolio_pct - r.benchmark_pct) < 1e-9
    late = marks.withColumn("entry_at", F.lit("2001-01-10").cast("date"))
    assert same_window(late, d, d.select("date", F.col("close").alias("level"))).first().context_only


def test_combined_scores_without_a_shuffle_by_ticker(spark):
    """Scores of a row were taken apart, dealt by (date, ticker) twice and joined again."""
    wide = spark.createDataFrame([(f"d{i % 6}", f"t{i}", None if i % 5 == 0 else i * i % 17 / 4, None if i % 7 < 2 else i % 11 / 2) for i in range(90)]
                                 + [("e", "t1", 1.0, None), ("e", "t2", 1.0, None)], "date string, ticker string, mom double, rev double")
    weights = spark.createDataFrame([(f"d{i}", m, i / 10 + (m == "mom") / 2) for i in range(5) for m in ("mom", "rev")], "date string, model string, weight double")
    p = long_scores(wide).filter("score is not null")
    want = [p.select("date", "ticker", "model", "score")] + [d.select("date", "ticker", F.lit(n).alias("model"), "score") for n, d in (
        ("flat", ld.ensemble_zscore(p)), ("adaptive", ld.blend(p, weights, 2)))]
    got = ld.combined_scores(wide, ["mom", "rev"], weights)
    rows = lambda d: sorted((r.date, r.ticker, r.model, round(r.score, 9) + 0.0) for r in d.collect())
    assert rows(got) == rows(want[0].unionByName(want[1]).unionByName(want[2]))
    assert "hashpartitioning(date" in got._jdf.queryExecution().executedPlan().toString() and "ticker" not in "".join(
        x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x)


def test_sweep_runs_all_sets_in_one_ticker_window(spark):
    """Every bar used to be dealt once for each parameter set."""
    grid = [dict(enter=e, leave=x) for e in (90.0, 70.0) for x in (20.0, 50.0)]
    bars = spark.createDataFrame([(f"{1999 + i % 3}-01-{i // 8 + 1:02d}", i, f"t{k}", None if (i + k) % 9 == 0 else float((i * 37 + k * 11) % 101), i / 100)
                                  for i in range(60) for k in range(4)], "date string, sid int, ticker string, rank double, r double").withColumn("date", F.col("date").cast("date"))
    got = ru.deadband_sweep(bars, grid, "r")
    want = []
    rows = {k: sorted((r.sid, r) for r in bars.collect() if r.ticker == k) for k in ("t0", "t1", "t2", "t3")}
    for g in grid:
        years = {}
        for one in rows.values():
            held = False
            for _, r in one:
                was = held
                held = r.rank is not None and (r.rank >= g["enter"] or held and r.rank >= g["leave"])
                y = years.setdefault(r.date.year, [[], 0])
                y[1] += held != was
                if held:
                    y[0].append(r.r)
        want += [(g["enter"], g["leave"], y, round(sum(v) / len(v), 9), n) for y, (v, n) in years.items()]
    assert sorted((r.enter, r.leave, r.yr, round(r.value, 9), r.trades) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Window")      # the sets are above the window
