"""Per-ticker views: rows that only the rounding of a book's mean leaves."""
from pyspark.sql import functions as F

from barloom.operators import books as bk, views as vw


def test_detail_keeps_means_that_are_not_exactly_zero(spark):
    days = [f"2024-01-0{d}" for d in range(1, 6)]
    books = spark.createDataFrame([(days[0], "m", "a", 0.1), (days[1], "m", "a", 0.2), (days[2], "m", "a", -0.3),
                                   (days[0], "m", "b", 0.1), (days[1], "m", "b", 0.2), (days[2], "m", "b", -0.3)],
                                  "date string, model string, ticker string, w double")
    pos = spark.createDataFrame([(d, i, 5) for i, d in enumerate(days)], "date string, pos int, n_dates int")
    held = bk.sleeves(books, pos, 3, 1, least=0.0)
    dust = held.filter("pos = 3").collect()
    assert len(dust) == 2 and all(r.held == (0.0 + 0.1 + 0.2 - 0.3) / 3 for r in dust)
    assert bk.sleeves(books, pos, 3, 1).filter("pos = 3").count() == 0
    # a has a bar and no score on the day of the dust, b has no bar
    bars = spark.createDataFrame([(days[3], "a", 10.0, None, 0.5)], "date string, ticker string, close double, score double, ret_next_1d double")
    c = vw.contributions(bars, held, 10)
    assert [r.date for r in vw.stock_detail(c, "a").collect() if r.rank is None and abs(r.weight) < 1e-12] == [days[3]]
    assert vw.stock_detail(c, "b").filter(F.abs("weight") < 1e-12).count() == 0
    assert vw.stock_summary(c).filter("ticker = 'a'").first().hit_rate == 0.0     # dust is no winning day
