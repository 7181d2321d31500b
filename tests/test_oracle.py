"""A spread of registered queries against their SQL, and the whole registry's shape."""
import pytest

import __spark_entry__ as entry
from tools.check import compare, duck

from folders import LARGER as FOLDER     # a session needs enough names for ranks and books

PICKS = ["feat_momentum", "feat_macd", "rank_target", "waterfill_cap", "run_backtest", "quantile_returns", "clean_bars",
         "symbol_directory", "search_runs", "asof_benchmark", "business_days_between", "next_market_open", "range_slice",
         "trend_fit", "average_cost", "allocate_balance", "activity_feed", "sequence_windows", "stream_tick_bars",
         "stream_ledger_upsert", "stream_daily_update"]


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", PICKS)
def test_matches_sql(spark, con, name):
    state, n, _, _, note = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert state == "ok", note or "no rows"


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 199


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["date", "model", "names", "ic"] and df.limit(1).count() == 1
