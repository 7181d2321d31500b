"""Operators on position notes against plain versions, and their defined results for odd rows."""
import collections
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

import brute
from barloom.llm import queries as q
from barloom.llm.bytescan import Words
from barloom.llm.benchmark import PARTS, find_leaks, drop_leaks, index_items, search, split_item
from barloom.llm.jaccard import SignatureTree, fold, near_duplicates, prefix_size, signature
from barloom.llm.licenses import CONTAINMENT, TEMPLATES, brute_places, scan_licenses
from barloom.llm.line_dedup import common_blocks, dedup_lines, patience_diff
from barloom.llm.packing import Limits, pack_notes
from barloom.llm.personal import estimate, find_personal
from barloom.llm import quality
from barloom.llm.quality import fit_quality, judge_notes
from barloom.llm.sharding import balanced_shards
from barloom.llm.suffixes import SuffixFamily, cut_repeats, cut_runs
from barloom.llm.tokens import TextTokenizer
from barloom.llm.wavelet import WaveletMatrix, build, read_token_shards, write_token_shards
from barloom.session import scratch_path


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(q.vocabulary())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


# tokens


def test_pieces_give_the_ids_of_whole_texts(encode, rows):
    texts = [t for _, t in rows] + ["it's  a \n\n b", "<|endoftext|> x", "日本 語 です", "　a  b c", "é́ ,x.\ny", "a\tb c\x7f d"]
    ids, ends = TextTokenizer(q.vocabulary()).encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[ends[i]:ends[i + 1]].tolist() == encode(t), t


def test_wavelet_matrix_round_trip_rank_select():
    ids = np.random.default_rng(1).integers(0, 50_000, 5000).astype(np.uint16)
    ids[::7] = 11
    w = WaveletMatrix(build(ids))
    assert (w.decode() == ids).all() and w.count(11) == (ids == 11).sum() and w.count(60_000) == 0
    for i in (0, 1, 511, 512, 4999):
        assert w.access(i) == ids[i] and w.rank(11, i) == (ids[:i] == 11).sum()
    assert [w.select(11, k) for k in (0, 5, 100)] == np.flatnonzero(ids == 11)[[0, 5, 100]].tolist()
    with pytest.raises(IndexError):
        w.select(60_000, 0)
    assert len(WaveletMatrix(build(ids[:0])).decode()) == 0


def test_token_shards(spark, positions, rows, nothing, odd, encode):
    path = scratch_path(spark, "wavelet")
    write_token_shards(positions, path, q.vocabulary(), shard_tokens=500)
    got = {r.position_id: r for r in read_token_shards(spark, path).collect()}
    start = 0
    for k, t in rows:
        ids = encode(t) + [0]
        assert (got[k].start, got[k].n_tokens, bytes(got[k].ids)) == (start, len(ids), np.array(ids, "<u4").tobytes())
        start += len(ids)
    for table, n in ((nothing, 0), (odd, 6)):
        path = scratch_path(spark, "wavelet")
        write_token_shards(table, path, q.vocabulary())
        assert read_token_shards(spark, path).count() == n


@pytest.mark.parametrize("limits", [Limits(), Limits(64, 3, 64), Limits(64, 8, 20)])
def test_packing_keeps_every_id_within_limits(positions, rows, encode, limits):
    got = pack_notes(positions, q.vocabulary(), prompt="ticker", limits=limits).collect()
    by_note, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_note[r.position_id].append(r)
        by_sequence[r.sequence].append(r)
    head = encode("S1")
    for k, t in rows:
        pieces = sorted(by_note[k], key=lambda r: r.start)
        assert b"".join(bytes(p.ids) for p in pieces) == np.array(head + encode(t) + [1], "<u4").tobytes()
        assert [p.start for p in pieces] == [sum(x.length for x in pieces[:i]) for i in range(len(pieces))]
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [sum(x.length for x in pieces[:i]) for i in range(len(pieces))]
        loss = sum(p.start + p.length - max(p.start, min(len(head), p.start + p.length)) for p in pieces)
        assert sum(p.length for p in pieces) <= limits.tokens and len(pieces) <= limits.segments and loss <= limits.loss


def test_packing_odd(nothing, odd):
    assert pack_notes(nothing, q.vocabulary()).count() == 0
    assert sum(r.length for r in pack_notes(odd, q.vocabulary()).filter("note_tokens = 1").collect()) == 1


# sharding


def test_shards_are_even_and_keep_groups(spark):
    data = [(i, f"h{i // 4}" if i < 80 else None if i % 2 else f"u{i}") for i in range(403)] + [(1000 + i, "hot") for i in range(150)]
    got = balanced_shards(spark.createDataFrame(data, "position_id long, note_hash string"), 10).collect()
    counts = collections.Counter(r.shard for r in got)
    assert len(got) == len(data) and sorted(counts) == list(range(10)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    groups = collections.defaultdict(set)
    for r in got:
        if r.position_id < 80:
            groups[r.note_hash].add(r.shard)
    assert sum(len(g) == 1 for g in groups.values()) >= 18       # 20 groups of four
    hot = collections.Counter(r.shard for r in got if r.note_hash == "hot")
    assert sum(n for _, n in hot.most_common(5)) >= 110            # 150 rows, 56 a shard


def test_shards_odd(spark, nothing):
    assert balanced_shards(nothing, 3, hubs=("note",)).count() == 0
    few = balanced_shards(spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "position_id long, note string"), 5, hubs=("note",)).collect()
    assert len(few) == 3 and len({r.shard for r in few}) == 3


# lines


def test_patience_diff():
    assert patience_diff(list("abcd"), list("abcd")) == [(i, i) for i in range(4)]
    assert patience_diff(list("xaybz"), list("abq")) == [(1, 0), (3, 1)]
    assert patience_diff([], [1]) == [] and patience_diff([1, 1, 2], [3, 1, 1]) == [(0, 1), (1, 2)]
    pairs = patience_diff(list("abcXdef"), list("abcYdef"))
    assert common_blocks(pairs, [4] * 7, 10) == [(0, 2), (4, 6)] and common_blocks(pairs, [3] * 7, 10) == []


def test_line_dedup_cuts_later_blocks(spark, nothing, odd):
    long_, two = "one two three four five six seven eight nine ten eleven", "short line here\n\nand one more short line\nthe third of them"
    data = [(1, f"first\n{long_}\nend of first"), (2, f"second\n  {long_} \nend"), (3, f"a\n{two}\nb"), (4, f"c\n{two}\nd"),
            (5, "own text\nshort line here"), (6, f"first\n{long_}\nend of first"), (7, None), (8, "")]
    got = {r.position_id: r for r in dedup_lines(spark.createDataFrame(data, "position_id long, note string")).collect()}
    assert got[1].note == data[0][1] and got[1].n_removed == 0
    assert got[2].note == "second\nend" and (got[2].n_lines, got[2].n_removed) == (3, 1)
    assert got[3].n_removed == 0 and got[4].note == "c\nd" and got[4].n_removed == 4
    assert got[5].n_removed == 0 and got[6].note == "" and got[6].n_removed == 3
    assert got[7].note is None and got[7].n_lines == 0 and got[8].note == "" and got[8].n_lines == 1
    assert dedup_lines(nothing).count() == 0
    rows = dedup_lines(odd).collect()
    assert len(rows) == 6 and sorted((r.position_id or 0) for r in rows if r.n_removed) == [9]


@pytest.mark.parametrize("pool, copies", [(6, 1), (5, 4)])
def test_line_dedup_equals_all_earlier_holders(spark, pool, copies):
    rng = np.random.default_rng(pool)
    lines = [" ".join(f"{c}{i}" for i in range(n)) for c, n in zip("abcdefgh", [12, 10, 4, 7, 3, 11, 5, 9])]
    texts = ["\n".join(rng.choice(lines[:pool], rng.integers(1, 6))) for _ in range(40)] * copies
    swapped = [f"{lines[0]}\n{lines[1]}\nx", f"{lines[0]}\ny", f"{lines[1]}\nz\n{lines[0]}", f"{lines[0]}\nq\n{lines[0]}"]
    texts = swapped + texts
    got = {r.position_id: r.note for r in dedup_lines(spark.createDataFrame(list(enumerate(texts)), "position_id long, note string")).collect()}
    split = [t.split("\n") for t in texts]
    for k, b in enumerate(split):
        words, gone = [len(x.split()) for x in b], set()
        for a in split[:k]:
            for x, y in common_blocks(patience_diff(a, b), words, 10):
                gone |= set(range(x, y + 1))
        # without blank lines here: see test_blank_lines_go_with_the_lines_around_them
        assert got[k] == "\n".join(x for i, x in enumerate(b) if i not in gone), (k, texts[k])


def plain_lines(notes, least=10):
    """Remaining text of (key, text) notes: every earlier note is aligned, then blank lines between deleted lines go."""
    out = {}
    split = [(t.split("\n"), [i for i, x in enumerate(t.split("\n")) if x.strip()]) for _, t in notes]
    for n, (b, at) in enumerate(split):
        mine, gone = [" ".join(b[i].split()) for i in at], set()
        for a, there in split[:n]:
            for x, y in common_blocks(patience_diff([" ".join(a[i].split()) for i in there], mine), [len(w.split()) for w in mine], least):
                gone |= set(range(x, y + 1))
        lost = {at[i] for i in gone} | {p for i in gone if i + 1 in gone for p in range(at[i], at[i + 1])}
        out[notes[n][0]] = ("\n".join(x for i, x in enumerate(b) if i not in lost), len(lost))
    return out


def test_blank_lines_go_with_the_lines_around_them(spark):
    p, q4, l1, l2, q5 = [[f"{c}{i}" for i in range(n)] for c, n in zip("pqlmr", (4, 4, 5, 5, 5))]
    t = lambda *ls: "\n".join(" ".join(x) for x in ls)
    p1, p2, p3, blank = p, q4, [f"s{i}" for i in range(4)], []
    notes = [(0, t(l1, l2, p1, p2, p3)), (1, t(p2, p3, l1)), (2, t(l2, q5)), (3, t(l1, l2)), (4, t(p1, p2, p3, l1, blank, l2, q5)),
             (5, t(blank, l1, blank, blank, l2, blank)), (6, t(p1, p2, p3, l1, blank, l2, q5))]
    got = {r.position_id: (r.note, r.n_removed) for r in dedup_lines(spark.createDataFrame(notes, "position_id long, note string")).collect()}
    assert got == plain_lines(notes) and got[4][1] == 7


def test_line_dedup_on_documents(spark):
    notes = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text is not None)
    want = plain_lines(notes)
    assert {r.doc_id: (r.kept_sha256, r.n_removed) for r in q.op2_patience_lines(spark, "/root/testdata/sf0.001").collect() if r.doc_id in want} == {
        k: (hashlib.sha256(t.encode()).hexdigest(), n) for k, (t, n) in want.items()}


# quality


def test_quality_deals_reviewed_texts_only(spark):
    """All texts used to be dealt by key for the sake of the trusted ones."""
    table = spark.range(20_000).selectExpr("nullif(id, 7) as key", "concat('text ', id) as text")
    keys = spark.range(0, 30_000, 50).selectExpr("id as key_")
    assert quality._may_hold(table, keys).count() <= 420
    assert sorted(r.key for r in quality._notes_of(table.union(table), keys).collect()) == sorted(2 * list(range(0, 20_000, 50)))


def test_quality_counts_and_verdicts(spark, positions, rows, nothing, odd):
    labels = spark.createDataFrame([(k, 1, 0) for k, _ in rows] + [(1, 1, None), (None, 1, 0)], "position_id long, quality int, toxic int")
    model = fit_quality(positions, labels)
    got = {r.position_id: r for r in judge_notes(positions, model).collect()}
    for k, t in rows:
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(t), t
        assert r.kept <= (not r.base_failed)
    assert judge_notes(nothing, fit_quality(nothing, labels)).count() == 0
    empty = fit_quality(positions, labels.limit(0))
    assert all(r.kept == (not r.base_failed) and r.score == 0 for r in judge_notes(positions, empty).collect())
    assert judge_notes(odd, model).count() == 6


def test_likelihood_ratio_tells_junk_from_trusted(spark):
    rng = np.random.default_rng(5)
    good, bad = [f"w{i}" for i in range(300)], [f"w{i}!!" for i in range(300)]
    draw = lambda words: " ".join(rng.choice(words, 80))
    data = [(i, draw(good if i % 4 else bad)) for i in range(1200)]
    table = spark.createDataFrame(data, "position_id long, note string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(600)], "position_id long, quality int, toxic int")
    held = judge_notes(table.filter("position_id >= 600"), fit_quality(table, labels)).collect()
    assert np.mean([r.kept == (r.position_id % 4 > 0) for r in held]) > 0.97


def test_few_insults_in_long_notes_are_not_kept(spark):
    rng = np.random.default_rng(8)
    plain, insults = [f"w{i}" for i in range(300)], ["idiot", "trash", "scum"]

    def note(i):
        words = list(rng.choice(plain, 80 + i % 5 * 40))
        if i % 4 == 0:
            for at in rng.choice(len(words), len(words) // 25, replace=False):
                words[at] = str(rng.choice(insults))
        return " ".join(words)
    table = spark.createDataFrame([(i, note(i)) for i in range(1600)], "position_id long, note string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(800)], "position_id long, quality int, toxic int")
    model = fit_quality(table, labels)
    got = judge_notes(table.filter("position_id >= 800"), model).collect()
    assert np.mean([r.kept for r in got if r.position_id % 4 == 0]) < 0.05
    assert np.mean([r.kept for r in got if r.position_id % 4]) > 0.95
    assert model.untrusted_kept < 0.05 and model.trusted_kept > 0.99


def test_all_reviewed_notes_take_part(spark):
    labels = spark.range(50_000).selectExpr("id as position_id", "cast(id % 2 as int) as quality", "0 as toxic")
    roles = {r.role: r["count"] for r in quality._roles(labels, "position_id", "quality", "toxic").groupBy("role").count().collect()}
    assert sum(roles.values()) == 50_000 and roles[3] == 25_000 and 7_500 < roles[2] < 9_500
    values = spark.createDataFrame([(float(v),) for v in (5, 1, 1, 3, 9, 3, 3)], "v double")
    assert [quality._nth(values, "v", k) for k in range(7)] == [1, 1, 3, 3, 3, 5, 9]


# repeated bytes


def test_runs_cover_windows_once():
    data = np.frombuffer(("abcdefghij" * 30 + "the quick brown fox " * 8).encode(), np.uint8)
    bounds = np.array([0, 130, 130, 179, 300, len(data)])
    _, first, last, _ = cut_runs(data, bounds)
    windows = sorted(w for a, b in zip(first, last) for w in range(a, b + 1))
    assert windows == [w for a, b in zip(bounds[:-1], bounds[1:]) for w in range(a, b - 49)]


def test_family_levels_merge():
    family, seen, shared = SuffixFamily(), set(), set()
    rng = np.random.default_rng(2)
    for _ in range(11):
        batch = np.unique(rng.integers(0, 3000, 90).astype(np.uint64))
        family.add(batch)
        shared |= seen & set(batch.tolist())
        seen |= set(batch.tolist())
    assert set(family.shared().tolist()) == shared and [n for n, _ in family.levels] == [8, 2, 1]


def test_repeats_equal_brute_force(spark, positions, rows, nothing, odd):
    got = {r.position_id: (bytes(r.kept), r.n_removed, r.n_spans) for r in cut_repeats(positions).collect()}
    assert got == brute.repeats(rows)
    assert cut_repeats(nothing).count() == 0
    again = cut_repeats(odd).collect()
    assert sorted((r.position_id or 0, r.n_removed > 0) for r in again) == [(0, False), (5, False), (5, False), (5, False), (9, False), (9, True)]


@pytest.mark.parametrize("size", [49, 50, 51, 70, 120])
def test_repeats_of_every_size_and_place(spark, size):
    rng = np.random.default_rng(size)
    text = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared = text(size)
    data = [(i, text(int(rng.integers(0, 90))) + shared + text(int(rng.integers(0, 90)))) for i in range(25)]
    got = cut_repeats(spark.createDataFrame(data, "position_id long, note string")).collect()
    assert {r.position_id: (bytes(r.kept), r.n_removed, r.n_spans) for r in got} == brute.repeats(data)


# near-duplicates


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(positions, rows, nothing, odd, words, percent):
    got = {r.position_id: (r.n_shingles, r.component) for r in near_duplicates(positions, words=words, percent=percent).collect()}
    assert got == brute.components(rows, words, percent)
    assert near_duplicates(nothing).count() == 0
    ends = near_duplicates(odd).collect()
    assert len(ends) == 6 and {(r.position_id, r.component) for r in ends if r.n_shingles > 1} == {(None, None), (5, 5), (9, 5)}


def test_line_dedup_rounds_do_not_pile_up_in_the_driver(spark, monkeypatch):
    """A run with many holders that it is not aligned with takes few rounds, and each lets go of its plans."""
    from barloom.llm import line_dedup
    events = []
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name, keep=line_dedup.materialize: events.append(name) or keep(df, name))
    monkeypatch.setattr(line_dedup, "release", lambda spark: events.append("release"))
    run, line = " ".join(f"r{i}" for i in range(12)), lambda *k: " ".join("w%d_%d_%d" % (*k, i) for i in range(12))
    same = [line(0, i) for i in range(3)]
    # the last note is aligned by its three lines with each other note, where the run stands before them and not behind
    texts = ["\n".join([run, line(i, 1), *same]) for i in range(1, 65)] + ["\n".join([*same, run, line(99, 9)])]
    notes = list(enumerate(texts))
    got = {r.position_id: (r.note, r.n_removed) for r in dedup_lines(spark.createDataFrame(notes, "position_id long, note string")).collect()}
    assert got[64] == ("\n".join([run, line(99, 9)]), 3) and got[1] == (line(2, 1), 4)
    assert 1 <= events.count("pairs") - 1 <= 4
    assert max(map(len, "".join("|" if e == "release" else "." for e in events).split("|"))) <= 5


def test_near_duplicates_do_not_pile_up_in_the_driver(spark, monkeypatch):
    """Rounds over few links take few tasks, whatever the shuffle partitions; plans are let go before the largest ones and the result."""
    from barloom.llm import jaccard
    events, files = [], []

    def stored(df, name, keep=jaccard.materialize):
        made = keep(df, name)
        events.append(name)
        files.extend([len(made.inputFiles())] * (name == "components"))
        return made
    monkeypatch.setattr(jaccard, "materialize", stored)
    monkeypatch.setattr(jaccard, "release", lambda spark: events.append("release"))
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    texts = [" ".join(f"w{i + 2 * n}" for i in range(60)) for n in range(12)]      # a chain: each links with the next
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "position_id long, note string"), words=4, percent=85).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert {r.component for r in got} == {0} and len(got) == 12
    assert max(files) == 1
    assert events[-2:] == ["ends", "release"] and events[events.index("bitmaps") + 1] == "release"


def test_near_duplicates_with_small_bounds(spark, monkeypatch):
    """Hot probes, split groups and cut rounds change no result."""
    from barloom.llm import jaccard
    for name, value in (("HOT_COUNT", 3), ("BLOCK", 4), ("FIRST_LINKS", 1), ("SMALL", 2), ("CROWD", 5)):
        monkeypatch.setattr(jaccard, name, value)
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(60)]
    data = []
    for i in range(40):
        words = list(base)
        for at in rng.integers(0, 60, int(rng.integers(0, 6))):
            words[at] = f"x{rng.integers(0, 9)}"
        data.append((i, " ".join(words)))
    got = near_duplicates(spark.createDataFrame(data, "position_id long, note string"), words=4, percent=85).collect()
    assert {r.position_id: (r.n_shingles, r.component) for r in got} == brute.components(data, 4, 85)


def test_a_passage_in_unlike_notes_makes_no_groups(spark, monkeypatch):
    """Groups hold classes with an equal run of shingles, not all that have a shingle of a common passage."""
    from barloom.llm import jaccard
    stored = {}

    def counted(df, name, keep=jaccard.materialize):
        made = keep(df, name)
        stored[name] = stored.get(name, 0) + made.count()
        return made
    monkeypatch.setattr(jaccard, "materialize", counted)
    rng = np.random.default_rng(21)
    passage = " ".join(f"p{i}" for i in range(30))
    data = [(i, passage + " " + " ".join(f"w{x}" for x in rng.integers(0, 10_000, 60))) for i in range(120)]
    data += [(200 + i, data[i][1] + " end") for i in range(10)]
    got = near_duplicates(spark.createDataFrame(data, "position_id long, note string"), words=4, percent=85).collect()
    assert {r.position_id: (r.n_shingles, r.component) for r in got} == brute.components(data, 4, 85)
    assert 20 <= stored["groups"] <= 400


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_linked_sets_share_a_run(percent):
    """Sets at the very edge of a link, of sizes on both sides of every band, with changes wherever they hurt."""
    from barloom.llm.jaccard import run_probes
    rng = np.random.default_rng(percent)
    linked = 0
    for n in [*range(1, 40), 63, 64, 65, 127, 128, 129, 300, 513]:
        for m in {n, *rng.integers(n, 100 * n // percent + 1, 4).tolist()}:
            overlap = -(-percent * (n + m) // (100 + percent))
            if overlap > n:
                continue
            for low in (False, True):
                pool = np.unique(rng.integers(0, 1 << 63, n + m + 9).astype(np.uint64) * np.uint64(2))[:n + m - overlap]
                pool = pool if low else rng.permutation(pool)       # low: what only one side has comes first in the order of hashes
                own, rest = pool[:n + m - 2 * overlap], pool[n + m - 2 * overlap:]
                a, b = (np.sort(np.concatenate([x, rest])) for x in (own[:n - overlap], own[n - overlap:]))
                assert (len(a), len(b)) == (n, m)
                linked += len(own) > 0
                assert not len(own) or len(np.intersect1d(run_probes(a, percent), run_probes(b, percent))), (n, m, low)
    assert linked > 100


def test_signature_tree_loses_no_pair():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 62, 60).astype(np.uint64)) for _ in range(12)]
    sets += [np.unique(np.concatenate([s[: 60 - k], rng.integers(0, 1 << 62, k).astype(np.uint64)])) for s in sets for k in (2, 6, 12)]
    sets.sort(key=len)
    size = min(len(signature(s)) for s in sets)
    tree = SignatureTree(np.array([len(s) for s in sets]), np.stack([fold(np.frombuffer(signature(s), np.uint8), size) for s in sets]),
                         np.arange(len(sets)))
    found = set(tree.pairs(85, lambda i, j: True))
    want = {(i, j) for j in range(len(sets)) for i in range(j)
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert want and want <= found and prefix_size(10, 85) == 2 and prefix_size(1, 85) == 1


# licences


def test_licenses(spark, nothing, odd):
    texts = ["Licensed under CC BY-NC 4.0.", "cc by cc by", "the General\nPublic LICENSE, all rights reserved", "Released under MIT license now", None, "",
             "xcc by", "Released the mit license", "all rights were reserved", "This work is licensed under GNU General Public License version 3"]
    got = {r.position_id: r for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "position_id long, note string")).collect()}
    for i, t in enumerate(texts):
        places, r = brute_places(t), got[i]
        n = len(brute.LICENSE_WORD.findall((t or "").translate(brute.LOWER)))
        assert (r.n_words, r.n_base) == (n, len(places)), t
        assert (r.first_word, r.last_word) == (min([p for p, _ in places], default=None), max([p for p, _ in places], default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
    assert got[0].labels == "cc-by,cc-by-nc-4.0" and got[0].score == 1 and got[9].labels == "gpl,gpl-3.0" and 0.8 <= got[9].score < 1
    assert got[3].labels == "mit" and got[7].labels == "mit" and got[8].labels == "" and got[8].score == 0
    assert scan_licenses(nothing).count() == 0 and scan_licenses(odd).count() == 6


def brute_templates(text):
    """Labels and the largest share, by every window of every template's length."""
    words, out = brute.LICENSE_WORD.findall(text.translate(brute.LOWER)), {}
    for label, t in TEMPLATES:
        own, span = set(t.split()), int(len(t.split()) / CONTAINMENT + 1e-9)
        share = max(len(own & set(words[i:i + span])) / len(own) for i in range(max(len(words), 1)))
        if share >= CONTAINMENT - 1e-9:
            out[label] = share
    return ",".join(sorted(out)), max(out.values(), default=0)


def test_license_notices_over_lines_and_scattered_words(spark):
    mit, bsd = (dict(TEMPLATES)[k] for k in ("mit-text", "bsd"))
    wrapped = [mit.replace("a copy ", "a copy\n"), bsd.replace("with or without ", "with or without\n * "),
               mit.replace("free ", "free\n").replace("a copy ", "a copy\n"), bsd.replace("use ", "use\n").replace("without ", "without\n")]
    filler = [f"f{i}" for i in range(40)]
    scattered = [" ".join(x for w in t.split() for x in [w, *filler]) for _, t in TEMPLATES]
    rng = np.random.default_rng(4)
    mixed = []
    for _ in range(60):                                 # words lost, added and lines broken
        words = [w for _, t in rng.permutation(TEMPLATES)[:2] for w in [*filler[:8], *t.split()]]
        words = [x for w in words for x in ([] if rng.random() < 0.08 else [w, "added"] if rng.random() < 0.08 else [w])]
        mixed.append("".join(w + str(rng.choice([" ", "\n"])) for w in words))
    texts = wrapped + scattered + mixed
    got = {r.position_id: r for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "position_id long, note string")).collect()}
    assert [got[i].labels for i in range(4)] == ["mit-text", "bsd", "mit-text", "bsd"] and all(got[i].score == 1 for i in range(4))
    assert all(got[i].labels == "" and got[i].score == 0 for i in range(4, 4 + len(scattered)))
    for i, t in enumerate(texts):
        labels, score = brute_templates(t)
        assert set(filter(None, labels.split(","))) | {x for _, x in brute_places(t)} == set(filter(None, got[i].labels.split(","))), t
        assert got[i].score == pytest.approx(score), t


# personal data


def test_personal_base_spans_and_votes(spark, nothing, odd):
    texts = ["mail a.b@c-d.e.f@g.h, or x@y", "ip 1.2.3.4 256.1.1.1 0001.2.3.4.5.6.7.8", "card 4111 1111 1111 1111 and 4111111111111112",
             "call +1 (743) 555-3824 or +12 34", None, "", "é 4111-1111-1111-1111 é", "a@b.c.d_x@e.f", "1" * 4000, "a@" * 2000, "a." * 3000 + "@b.c",
             "born 12/03/1980 and ssn 123-45-6789", "order 123-45-6789"]
    found = find_personal(spark.createDataFrame(list(enumerate(texts)), "position_id long, note string")).collect()
    got = {r.position_id: r for r in found}
    for i, t in enumerate(texts):
        assert [tuple(s) for s in got[i].base] == brute.personal(t), t
        assert [tuple(s) for s in got[i].spans][:len(got[i].base)] == brute.personal(t)
    assert find_personal(nothing).count() == 0 and find_personal(odd).count() == 6


def test_expectation_maximisation_ranks_labelers():
    rng = np.random.default_rng(3)
    rates = [0.95, 0.9, 0.6, 0.8, 0.55, 0.9]
    votes = collections.Counter()
    for truth in rng.random(4000) < 0.4:
        votes[tuple(int((rng.random() < r) == truth) for r in rates)] += 1
    rel, post = estimate(dict(votes))
    worth = [a - b for a, b in rel]
    assert worth[0] > worth[3] > worth[2] > worth[4] - 0.05 and all(0 <= p <= 1 for p in post.values())
    assert estimate({})[1] == {}


# benchmark items


def test_leaks(spark, nothing):
    rng = np.random.default_rng(8)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    items = [(i, f"{words(int(rng.integers(8, 40)))}. {words(6)}.") for i in range(40)] + [(90, None), (91, "")]
    data = [(i, words(50) + " " + (items[i][1] if i < 20 else items[i][1].upper().replace(" ", "\n") if i < 30 else words(40)) + " " + words(300))
            for i in range(40)] + [(50, None), (51, ""), (52, items[3][1][: len(items[3][1]) // 3])]
    table = spark.createDataFrame(data, "position_id long, note string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    hits = {(r.position_id, r.item_id) for r in find_leaks(table, bench).collect()}
    assert hits == {(i, i) for i in range(30)}
    assert {r.position_id for r in drop_leaks(table, bench).collect()} == {k for k, _ in data} - set(range(30))
    assert find_leaks(nothing, bench).count() == 0 and find_leaks(table, bench.limit(0)).count() == 0
    assert drop_leaks(table, bench.limit(0)).count() == len(data)


def test_index_weights_and_blocks():
    index = index_items([(i, f"common w{i} x{i} y{i % 3}") for i in range(50)])
    for i in range(50):
        assert abs(index.weight[index.item == i].sum() - 1) < 1e-9
    for t in range(len(index.terms)):
        own = index.weight[index.ends[t]:index.ends[t + 1]]
        assert abs(own.max() - index.most[t]) < 1e-12
        assert abs(index.block_weight[index.block_ends[t]:index.block_ends[t + 1]].max() - index.most[t]) < 1e-12
    assert split_item("What is it? A bar.") == ("What is it? ", "A bar.") and split_item("one two three four")[1] == "four"


# whole queries


def test_queries_on_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {name: f(spark, folder).collect() for name, f in q.QUERIES.items()}
    for name, rows in got.items():
        if not name.startswith(("op9_", "op10_")):
            assert sorted(r.doc_id for r in rows) == sorted(docs), name
    ends = brute.components(list(docs.items()), 4, 85)
    assert all((r.n_shingles, r.component_id) == ends[r.doc_id] for r in got["op6_signature_tree"])
    cut = brute.repeats(list(docs.items()))
    assert all((r.n_removed, r.n_spans) == cut[r.doc_id][1:] and r.kept_sha256 == hashlib.sha256(cut[r.doc_id][0]).hexdigest()
               for r in got["op5_suffix_family"])


def test_added_secrets_and_accounts(spark):
    """Planted secrets, account numbers and key heads are found where they stand; check sums of other things, plain words and
    broken account numbers are not."""
    import hashlib
    secret = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(40)]
    texts = {i: f"words before token = \"{s}\" and after" for i, s in enumerate(secret)}
    texts |= {100 + i: f"see commit {s} for the change" for i, s in enumerate(secret)}
    texts |= {200 + i: "a mail to someone%d@mail.example and notinternationalisation words" % i for i in range(40)}
    texts |= {300: "iban DE89 3704 0044 0532 0130 00 please", 301: "iban DE88 3704 0044 0532 0130 00 please",
              302: "my private key -----BEGIN RSA PRIVATE KEY----- follows"}
    d = spark.createDataFrame(list(texts.items()), "position_id long, note string")
    got = {r["position_id"]: {(s["kind"], texts[r["position_id"]][s["start"]:s["end"]]) for s in r["spans"]} for r in find_personal(d).collect()}
    planted = {i for i in range(40)} | {300, 302}
    added = {i for i, s in got.items() if any(k in ("secret", "iban", "keyhead") for k, _ in s)}
    assert len(added & planted) >= 0.95 * len(planted) and len(added - planted) <= 0.05 * len(added)
    assert ("secret", secret[3]) in got[3] and ("keyhead", "-----BEGIN RSA PRIVATE KEY-----") in got[302]
    assert ("iban", "DE89 3704 0044 0532 0130 00") in got[300] and not got[301] and not got[100]


def test_leaks_do_not_depend_on_the_block(spark):
    """Blocks of a few items and of all give the same rows, scores included; repeated items and notes, null keys, ties between
    passages, and extra columns with the names that the operator uses itself."""
    rng = np.random.default_rng(12)
    pool = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(120)]
    words = lambda n: " ".join(rng.choice(pool, n))
    items = [(i, f"{words(int(rng.integers(8, 30)))}. {words(6)}.") for i in range(60)]
    items += [items[0], (None, f"{words(20)}. {words(6)}.")]
    data = [(i, words(60) + " " + items[i][1] + " " + words(200) + " " + items[i][1]) for i in range(30)] + [(None, items[3][1]), (5, items[61][1])]
    table = spark.createDataFrame(data + data[:2], "position_id long, note string").selectExpr("*", "1 as key", "2 as item", "3 as score")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "4 as note", "5 as term", "6 as words")
    order = lambda d: sorted(map(tuple, d.collect()), key=repr)
    whole = order(find_leaks(table, bench))
    assert whole == order(find_leaks(table, bench, block=7))
    # rows 0 and 1 stand twice, and so does item 0
    hits = collections.Counter((r[0], r[1]) for r in whole)
    assert hits == collections.Counter({**{(i, i): 1 for i in range(2, 30)}, (0, 0): 4, (1, 1): 2, (None, 3): 1, (5, None): 1})
    kept = drop_leaks(table.union(spark.sql("select 99, 'nothing of the kind', 1, 2, 3")), bench, block=7)
    assert [tuple(r) for r in kept.collect()] == [(99, "nothing of the kind", 1, 2, 3)]


def test_search_equals_plain_bm25():
    """Every passage and item with a score at the threshold or above is retrieved, and no other."""
    import math
    rng = np.random.default_rng(4)
    pool = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(pool, int(rng.integers(3, 25))))) for i in range(50)]
    notes = [" ".join(rng.choice(pool, int(n))) for n in rng.integers(0, 400, 30)] + ["", items[7][1]]
    index = index_items(items)
    text = [t.split() for _, t in items]
    mean, held = sum(map(len, text)) / 50, collections.Counter(w for t in text for w in set(t))
    own = [{w: math.log(1 + (50 - held[w] + 0.5) / (held[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in t} for t in text]
    want = {}
    for row, note in enumerate(notes):
        w, stride = note.split(), 32
        for k in range(max(1, -(-len(w) // stride) - 1) if w else 0):
            part = set(w[k * stride:k * stride + 2 * stride])
            for i, o in enumerate(own):
                score = sum(v for t, v in o.items() if t in part) / sum(o.values())
                if score >= 0.5:
                    want[row, k * stride, i] = score
    data = np.frombuffer("".join(notes).encode(), np.uint8)
    w = Words(data, np.cumsum([0, *map(len, notes)]), PARTS)
    first = np.concatenate([[0], np.cumsum(w.per_row)])
    got = {(r, s - int(first[r]), index.ids[i]): v for r, s, _, i, v in search(w, len(notes), index)}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got) and len(got) > 50
