"""Landed files, payloads, snapshots and the ledger."""
from pyspark.sql import functions as F

from barloom.config import DataConfig, RunConfig
from barloom.functions.currency import currency_of
from barloom.operators.panel import clean_bars, clean_live
from barloom.operators.splits import fold_bounds
from barloom.config import SplitConfig
from barloom.sources import files as fl, store as st

import pytest


def test_plain_files_take_the_ticker_from_the_name(spark, tmp_path):
    d = tmp_path / "Stocks"
    d.mkdir()
    (d / "aapl.us.txt").write_text("Date,Open,High,Low,Close,Volume,OpenInt\n2020-01-02,1,2,0.5,1.5,100,0\n2020-01-03,bad,2,1,1,5,0\n")
    (d / "empty.us.txt").write_text("")
    raw = fl.layout_select(spark, str(tmp_path))
    rows = clean_bars(raw, DataConfig(min_history=1)).collect()
    assert [(r.ticker, str(r.date), r.close) for r in rows] == [("AAPL", "2020-01-02", 1.5)]


def test_adjusted_files_rescale_prices(spark, tmp_path):
    d = tmp_path / "stocks"
    d.mkdir()
    (d / "ABC.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n2020-01-02,10,12,8,10,5,100\n2020-01-03,1,1,1,0,5,7\n")
    rows = fl.layout_select(spark, str(tmp_path)).orderBy("date").collect()
    assert (rows[0].ticker, rows[0].open, rows[0].close, rows[0].volume) == ("ABC", 5.0, 5.0, 100.0)
    assert rows[1].open is None and rows[1].volume == 7.0


def test_packed_members_give_what_single_files_give(spark, tmp_path):
    text = {"Stocks/aapl.us.txt": "Date,Open,High,Low,Close,Volume,OpenInt\n2020-01-02,1,2,0.5,1.5,100,0\n2020-01-03,bad,2,1,,5,0\n",
            "Stocks/b.us.txt": "Date,Open,High,Low,Close,Volume,OpenInt\r\n2020-01-02,1,2,0.5,7,3,0\r\n", "Stocks/empty.us.txt": "", "Stocks/head.us.txt": "Date,Open\n",
            "Stocks/readme.md": "Date,Open\n2020-01-02,1\n"}
    single, packed = tmp_path / "single", tmp_path / "packed"
    (single / "Stocks").mkdir(parents=True)
    packed.mkdir()
    for name, lines in text.items():
        (single / name).write_bytes(lines.encode())
    (packed / "part-0").write_bytes(fl.MEMBER_END.join(f"{name}\n{lines}" for name, lines in text.items()).encode())
    got = [sorted(map(str, fl.layout_select(spark, str(d), packed=p).collect())) for d, p in ((single, False), (packed, True))]
    assert got[0] == got[1] and len(got[0]) == 3
    (packed / "part-1").write_text("Stocks/c.us.txt\nClose,Extra,Date\n7,x,2020-01-02")
    assert [r.close for r in fl.scan_ticker_files(spark, str(packed), packed=True).filter("ticker = 'C'").collect()] == [7.0]


def test_files_do_not_grow_with_tickers(spark, tmp_path):
    """One folder a ticker made as many files as tickers, each opened and listed."""
    bars = spark.range(6000).selectExpr("concat('S', id div 2) as ticker", "concat('2020-01-0', 1 + id % 2) as Date", "id / 7 as Close")
    fl.pack_members(bars, ["Date", "Close"], F.concat(F.lit("ticker="), "ticker", F.lit("/bars.csv")), str(tmp_path / "p"))
    assert len(list((tmp_path / "p").glob("part-*"))) <= 8
    back = fl.scan_ticker_files(spark, str(tmp_path / "p"), "*.csv", fl.FROM_FOLDER, True).select("ticker", "date", "close")
    assert back.exceptAll(bars).count() == bars.exceptAll(back).count() == 0


def test_feed_cells_are_parsed_once(spark):
    """Filters pushed below the parsing repeated it some thirty times a row."""
    feed = spark.createDataFrame([("2020-01-02", "a", "1", "2", "0.5", "1.5", "9", 1), ("2020-01-02", "a", "1", "2", "1", "NaN", "9", 2)],
                                 "date string, ticker string, open string, high string, low string, close string, volume string, ord int")
    d = clean_live(feed)
    assert d._jdf.queryExecution().optimizedPlan().toString().count("as double)") == 5
    assert [tuple(map(str, r)) for r in d.collect()] == [("2020-01-02", "A", "1.0", "2.0", "0.5", "1.5", "9.0")]
    kept = clean_bars(feed, DataConfig(start="2020-01-01", min_history=1))
    assert "as double)" not in kept._jdf.queryExecution().optimizedPlan().toString() and kept.count() == 1


def test_flat_payload_and_missing_fields(spark):
    wide = spark.createDataFrame([("2020-01-02", 1.0, 2.0, 0.5, 1.5, 9.0)], "Date string, Open double, High double, Low double, Close double, Volume double")
    assert fl.wide_to_long(wide, [], "X").first().ticker == "X"
    with pytest.raises(ValueError):
        fl.wide_to_long(wide.drop("Low"), [], "X")


def test_snapshot_is_reused_until_it_is_old(spark, tmp_path):
    calls = []

    def fetch():
        calls.append(1)
        return spark.range(3)
    for now in ("2024-01-01 08:00:00", "2024-01-01 15:00:00", "2024-01-02 09:00:00"):
        assert st.panel_snapshot(spark, str(tmp_path / "s"), "k", now, 12.0, fetch).count() == 3
    assert len(calls) == 2


def test_unknown_names_raise(spark):
    for call in (lambda: fl.provider("x"), lambda: fl.layout_select(spark, "/tmp", "x")):
        with pytest.raises(ValueError):
            call()


def test_currency_suffixes(spark):
    d = spark.createDataFrame([("AAPL",), ("VOD.L",), ("7203.T",), ("A.B.SA",), ("Q.ZZ",)], "t string")
    assert [r[0] for r in d.select(currency_of(F.col("t"))).collect()] == ["USD", "GBp", "JPY", "BRL", "USD"]


def test_config_round_trip():
    assert RunConfig.from_json(RunConfig().to_json()) == RunConfig()


def test_folds_are_purged():
    rows = fold_bounds(400, SplitConfig(n_splits=4, test_size=40, min_train=120, embargo=2), 5)
    train = {r["fold"]: r for r in rows if r["role"] == "train"}
    for r in rows:
        if r["role"] == "test":
            assert r["sid_from"] - (train[r["fold"]]["sid_to"] - 1) > 7 and train[r["fold"]]["sid_to"] >= 120
    with pytest.raises(ValueError):
        fold_bounds(100, SplitConfig(min_train=120), 5)


def test_lines_of_a_task_do_not_grow(spark):
    """The partitions of the join were as many as the setting says, whatever the tables hold."""
    from barloom.plans import catalog_panel as cp
    from barloom.plans.registry import QUERIES
    from barloom.sources.tables import Tables
    from folders import LARGER
    kept, cp.LINES_A_TASK = cp.LINES_A_TASK, 1000
    try:
        t = Tables(spark, LARGER)
        assert QUERIES["business_days_between"][0](t).rdd.getNumPartitions() >= t.bars_bound // 1000
    finally:
        cp.LINES_A_TASK = kept


def test_same_window_reads_stored_bars(spark):
    """The weekly bars were made three times from all lines."""
    import __spark_entry__  # noqa: F401  (registers the queries)
    from barloom.plans.registry import QUERIES
    from barloom.sources.tables import Tables
    from folders import LARGER
    files = QUERIES["same_window_comparison"][0](Tables(spark, LARGER)).inputFiles()
    assert not [f for f in files if "lineitem" in f]
