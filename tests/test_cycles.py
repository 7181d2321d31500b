"""The nightly cycle, broken off after each of its steps and run again."""
import pytest
from pyspark.sql import functions as F

from barloom.operators.ledger import nightly_steps
from barloom.sources.cycles import Cycles


class Broken(Exception):
    pass


def nights(spark):
    bars = spark.sql("""select date_add(date '2001-01-01', cast(d as int)) as date, concat('T', k) as ticker, 10.0D + k + d as close,
        case when d < 4 then (k * 7 + d * 3) % 11 / 10.0D end as fwd_ret from (select explode(sequence(0, 5)) as d), (select explode(sequence(1, 6)) as k)""")
    preds = bars.selectExpr("date", "ticker", "cast(hash(ticker, date) % 100 as double) as a", "close as b")
    upto = lambda d, n: d.filter(F.col("date") <= F.date_add(F.lit("2001-01-01").cast("date"), n))
    return [(f"night-{n}", nightly_steps(upto(bars, n), upto(preds, n), ["a", "b"], f"2001-01-0{n + 1} 18:00:00")) for n in (2, 3, 4)]


def rows(c, name):
    d = c.table(name)
    return None if d is None else sorted(map(str, d.collect()))


def test_a_broken_cycle_shows_nothing_and_a_rerun_gives_the_same(spark, tmp_path):
    first, second = nights(spark)[:2]
    plain = Cycles(spark, str(tmp_path / "plain"))
    assert plain.table("history") is None and plain.run(*first) and plain.run(*second)
    names = [name for name, _ in second[1]]
    want = {name: rows(plain, name) for name in names}
    assert len(want["history"]) == 4 and len(want["ledger"]) == 12 and len(want["forecasts"]) == 6

    broken = Cycles(spark, str(tmp_path / "broken"))
    broken.run(*first)
    before = {name: rows(broken, name) for name in names}

    def fail(c, key):
        raise Broken
    for stop in range(1, len(names) + 1):       # after each step, the last one included: only the marker is missing then
        with pytest.raises(Broken):
            broken.run(second[0], [*second[1][:stop], ("none", fail)])
        assert broken.finished() == [first[0]] and rows(broken, "history") == before["history"] and rows(broken, "ledger") == before["ledger"]
    assert broken.run(*second) and {name: rows(broken, name) for name in names} == want
    assert not broken.run(*second) and {name: rows(broken, name) for name in names} == want     # the marker is the gate


def test_an_older_cycle_is_refused(spark, tmp_path):
    c, (first, second, _) = Cycles(spark, str(tmp_path)), nights(spark)
    step = [("t", lambda c, key: spark.range(3))]
    c.run(second[0], step)
    with pytest.raises(ValueError):
        c.run(first[0], step)
    assert c.table("t", second[0]) is None and c.table("t").count() == 3
