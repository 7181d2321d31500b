"""Bit-sliced search, whitening and ranked search against plain versions, and their defined results for odd rows."""
import collections
import datetime
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import lexical, nearest
from barloom.llm import queries as q
from barloom.llm.lexical import index_notes, rank_notes
from barloom.llm.nearest import BitSlices, signed_digits, similar_tickers
from barloom.llm.whitening import scatter, whiten_features

FOLDER = "/root/testdata/sf0.001"
FEATURES = "ticker string, features array<double>, rank int, n string, score string, component string"


def plain_matches(rows, asked, k, scale=256):
    """(asking ticker, rank, match, score) by scoring every pair; rows are (ticker, vector)."""
    good = [(t, [math.floor(scale * x) for x in v]) for t, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, (t, a) in enumerate(good):
        if t is not None and asked(t):
            found = sorted(((-sum(x * y for x, y in zip(a, b)), u is None, u or "") for j, (u, b) in enumerate(good) if j != i))[:k]
            out += [(t, r + 1, None if none else u, -s) for r, (s, none, u) in enumerate(found)]
    return out


def feature_rows(n=150, dims=7, seed=5):
    r = np.random.default_rng(seed)
    rows = [(f"T{i:03d}", r.normal(size=dims).tolist()) for i in range(n)]
    rows += [(f"U{i}", rows[4][1]) for i in range(12)] + [("T004", rows[4][1]), (None, rows[4][1]), (None, rows[7][1])]     # copies, ties
    rows += [("V0", None), ("V1", [1.0, None, *[0.0] * (dims - 2)]), ("V2", [float("nan")] * dims), ("V3", [float("inf")] * dims),
             ("V4", [0.5, -2.0]), ("V5", []), ("V6", [0.0] * dims)]
    return rows


def exposures(spark, rows):
    return spark.createDataFrame([(t, v, 9, "n", "s", "c") for t, v in rows], FEATURES)


def ordered(rows):
    return sorted(tuple(r) for r in rows)


def test_signed_digits():
    v = np.array([0, 1, -1, 7, -7, 100, -255, 1 << 26])
    digits = list(signed_digits(v))
    assert (sum(d << a for a, d in digits) == v).all()
    assert all(not (d & e).any() for (_, d), (_, e) in zip(digits, digits[1:]))


@pytest.mark.parametrize("span,planes", [(1, 5), (40, 5), (40, 60), (5000, 3), (0, 5)])
def test_slices_select_the_best_sums(span, planes):
    r = np.random.default_rng(span)
    rows, ask = r.integers(-span, span + 1, (333, 9)), r.integers(-span, span + 1, (5, 9))
    s = BitSlices(rows, planes)
    sums, add = s.sums(ask)
    bits = np.unpackbits(sums.view(np.uint8), axis=2, count=s.n, bitorder="little").astype(np.int64)
    value = sum((b << i for i, b in enumerate(bits)), np.zeros((5, 333), np.int64))
    coarse = ask @ ((rows - rows.min(0)) >> s.cut).T
    assert (value + add[:, None] == coarse).all()
    kth = s.kth_largest(sums, 10)
    assert (kth == np.sort(value, axis=1)[:, -10]).all()
    assert (s.at_least(sums, kth) == (value >= kth[:, None])).all()


@pytest.mark.parametrize("block,planes,group", [(8192, 5, 1 << 24), (64, 2, 1 << 24), (64, 5, 500)])
def test_similar_tickers_equal_brute_force(spark, monkeypatch, block, planes, group):
    for name, value in (("BLOCK", block), ("GROUP_BYTES", group)):
        monkeypatch.setattr(nearest, name, value)
    monkeypatch.setattr(nearest.BitSlices.__init__, "__defaults__", (planes,))
    rows = feature_rows()
    got = similar_tickers(exposures(spark, rows), F.col("ticker").substr(-1, 1).isin("4", "0"), 5)
    assert got.columns == ["ticker", "rank", "match", "score"]
    assert ordered(got.select("ticker", "rank", F.coalesce("match", F.lit("")), "score").collect()) == ordered(
        (t, r, u or "", s) for t, r, u, s in plain_matches(rows, lambda t: t[-1] in "40", 5))


def test_similar_tickers_odd(spark):
    few = exposures(spark, [("A", [1.0, 2.0]), ("B", [1.0])])
    assert ordered(similar_tickers(few, F.lit(True), 5).collect()) == [("A", 1, "B", 65536), ("B", 1, "A", 65536)]
    assert similar_tickers(few, F.lit(False), 5).count() == 0 and similar_tickers(few.limit(0), F.lit(True)).count() == 0
    assert similar_tickers(few.limit(1), F.lit(None).cast("boolean")).count() == 0
    far = exposures(spark, [("A", [1e30]), ("B", [-1e30]), ("C", [1.0])])
    assert {(r["ticker"], r["match"]) for r in similar_tickers(far, F.lit(True), 1).collect()} == {("A", "C"), ("B", "C"), ("C", "A")}


def test_similar_sessions_of_the_feature_frame(spark):
    """The library's own records: the features of every ticker and session as arrays."""
    from barloom.config import FeatureConfig
    from barloom.operators.features import compute_features
    from barloom.sources.tables import Tables
    t = Tables(spark, FOLDER)
    frame = compute_features(t.weekly_bars(), FeatureConfig(min_names=3), bound=t.names_bound).filter(F.col("date") >= datetime.date(2000, 1, 1))
    names = [c for c in frame.columns if c not in ("date", "ticker", "sid")][:12]
    rows = frame.select("ticker", F.array(*[F.coalesce(c, F.lit(0.0)).cast("double") for c in names]).alias("features"))
    held = [(r["ticker"], list(r["features"])) for r in rows.collect()]
    one = min(t for t, _ in held)
    got = similar_tickers(rows, F.col("ticker") == one, 3)
    assert ordered(got.collect()) == ordered(plain_matches(held, lambda t: t == one, 3))
    assert whiten_features(rows, 4).select("component").distinct().count() == 4


# whitening


def plain_whitening(rows, components, grid=64):
    y = np.array([[math.floor(grid * x) for x in v] for _, v in rows], np.float64)
    v = np.cov(y.T, bias=True)
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)[:components]
    off = y - y.mean(0)
    return off @ u[:, order] / np.sqrt(e[order]), e[order] / e.sum(), (len(y) * off).round().astype(object)


def test_scatter_is_exact():
    r = np.random.default_rng(3)
    for low, high, n in ((-5, 9, 70), (0, 1, 1), (-(1 << 40), 1 << 40, 130), (4, 5, 64)):
        rows = r.integers(low, high, (n, 4))
        sums, product = scatter(rows)
        o = rows.astype(object)
        assert sums == o.sum(0).tolist() and product == (o.T @ o).tolist()


def test_whitening_equals_brute_force(spark):
    r = np.random.default_rng(8)
    rows = [(f"T{i:03d}", v) for i, v in enumerate((r.normal(size=(400, 6)) @ r.normal(size=(6, 6)) + 3).tolist())]
    rows += rows[:30] + [(None, rows[0][1])]
    bad = [("X", None), ("X", [None] * 6), ("X", [math.nan] * 6), ("X", [-math.inf] * 6)]
    got = whiten_features(exposures(spark, rows + bad), 4)
    assert got.columns == ["ticker", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    want, share, off = plain_whitening(rows, 4)
    found = collections.defaultdict(list)
    for row in got.collect():
        assert row.n == len(rows) and row.identity_error < 1e-9
        found[row.component].append((row.ticker or "", int(row.deviation), row.whitened))
        assert row.explained == pytest.approx(share[row.component - 1], rel=1e-9)
    far = [int(sum(x * x for x in o)) for o in off]
    for c in range(1, 5):
        mine = sorted(found[c])
        ours = sorted((t or "", d, w) for (t, _), d, w in zip(rows, far, want[:, c - 1]))
        theirs = sorted((t or "", d, -w) for (t, _), d, w in zip(rows, far, want[:, c - 1]))
        assert [m[:2] for m in mine] == [o[:2] for o in ours]
        a = np.array([m[2] for m in mine])
        assert min(np.abs(a - [o[2] for o in s]).max() for s in (ours, theirs)) < 1e-8


def test_whitening_odd(spark):
    assert whiten_features(exposures(spark, []), 4).count() == 0
    assert whiten_features(exposures(spark, [("A", [1.0, 2.0])] * 3), 4).count() == 0           # no variance
    short = whiten_features(exposures(spark, [("A", [1.0, 2.0]), ("B", [3.0]), ("C", [])]), 4).collect()
    assert {r.component for r in short} == {1, 2} and len(short) == 6
    far = whiten_features(exposures(spark, [("A", [1e12]), ("B", [0.0]), ("C", [-1e30])]), 1).collect()
    assert len(far) == 3 and all(r.deviation > 10**24 for r in far if r.ticker != "B")


# ranked search

WORD = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_ranks(notes, searches, k):
    held = [(key, collections.Counter(WORD.findall((t or "").translate(LOWER)))) for key, t in notes]
    held = [(key, c) for key, c in held if c]
    total, words = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in searches:
        scored = []
        for key, c in held:
            m = 25 + 75 * sum(c.values()) * total // words
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in WORD.findall((text or "").translate(LOWER)) if c[t])
            if s > 0:
                scored.append((-s, key is None, key or 0))
        out += [(item, r + 1, None if none else key, -s) for r, (s, none, key) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("slice_,short,group", [(4 << 20, 16, 4 << 20), (900, 2, 4 << 20), (900, 10**9, 100), (4000, 1, 4 << 20)])
def test_ranked_notes_equal_brute_force(spark, positions, rows, monkeypatch, slice_, short, group):
    for name, value in (("SLICE", slice_), ("SHORT", short), ("GROUP_BYTES", group)):
        monkeypatch.setattr(lexical, name, value)
    r = random.Random(4)
    texts = [t for _, t in rows if t]
    searches = [(i, " ".join(r.choice(texts).split()[:r.randint(1, 9)]).upper()) for i in range(25)] + [(30, None), (31, ""), (32, "?!"), (33, "zzz"), (3, "x y x")]
    asked = spark.createDataFrame([(i, t, 1, "s") for i, t in searches], "item_id long, text string, rank int, score string")
    got = rank_notes(index_notes(positions), asked, 7)
    assert got.columns == ["item_id", "rank", "position_id", "score"]
    assert ordered(got.collect()) == ordered(plain_ranks(rows, searches, 7))


def test_ranked_notes_odd(spark, nothing, odd):
    asked = spark.createDataFrame([(1, "Alpha beta"), (1, "alpha"), (None, "short")], "item_id int, text string")
    rows = [(r.position_id, r.note) for r in odd.collect()]
    plain = plain_ranks(rows, [(1, "Alpha beta"), (1, "alpha"), (None, "short")], 10)
    key = lambda r: [(-1 if x is None else x) for x in r]
    assert sorted(map(key, rank_notes(index_notes(odd), asked).collect())) == sorted(map(key, plain))
    assert rank_notes(index_notes(nothing), asked).count() == 0 and rank_notes(index_notes(odd), asked.limit(0)).count() == 0


def test_very_long_note(spark):
    long_ = " ".join(f"w{i % 977}" for i in range(60_000))
    notes = spark.createDataFrame([(1, long_), (2, "w1 w2"), (3, None), (4, "other words")], "position_id long, note string")
    asked = spark.createDataFrame([(7, "w1 w2 w976 other")], "item_id long, text string")
    assert ordered(rank_notes(index_notes(notes), asked).collect()) == ordered(
        plain_ranks([(1, long_), (2, "w1 w2"), (4, "other words")], [(7, "w1 w2 w976 other")], 10))


def test_queries_on_given_tables(spark):
    vectors = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    x = np.array([[math.floor(256 * c) for c in v] for _, v in vectors])
    ids = np.array([i for i, _ in vectors])
    want = []
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        best = [j for j in np.lexsort((ids, -s)) if j != i][:5]
        want += [(int(ids[i]), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(best)]
    assert ordered(q.op11_bit_sliced_topk(spark, FOLDER).select("query_id", "rank", "vec_id", "score").collect()) == ordered(want)
    white = q.op12_bit_sliced_scatter(spark, FOLDER)
    assert white.count() == 32 * len(vectors) and white.agg(F.max("identity_error")).first()[0] < 1e-4
    notes = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert ordered(q.op13_hybrid_search(spark, FOLDER).select("item_id", "rank", "doc_id", "score").collect()) == ordered(plain_ranks(notes, items, 10))
