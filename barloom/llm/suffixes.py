"""Long byte strings that notes repeat: a logarithmic family of sparse suffix arrays, and their exact removal."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from barloom.llm.bytescan import mix, prefix_hash, slices, span_hash
from barloom.llm.joins import salted_join
from barloom.session import discard, materialize, release

LENGTH = 50              # bytes of a string that counts as repeated
SEED = 20                # bytes at a suffix's start that windows choose it by
SIDE = (LENGTH - SEED + 1) // 2   # bytes beside the seed, on one side or the other, that equal windows have in common
BATCH_BYTES = 4 << 20    # text of a batch
RUN_SUFFIXES = 500_000   # suffixes that a bucket of the family holds, about
SPARE_BITS = 14          # bits kept of a suffix's hash beyond those that number all suffixes
_PLACE = 20              # bits of a place in a chunk
_SEAM = np.uint64((1 << _PLACE) - 1)


def cut_runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seed hash, first window, last window, seed place) of runs of windows: every window of LENGTH bytes inside a row belongs to the suffix
    that starts at the smallest seed hash in it, the leftmost of equal ones; consecutive windows of one suffix are a run. The
    choice depends on the window's bytes alone, so equal windows choose equally wherever they stand."""
    parts = []
    step = (1 << _PLACE) - LENGTH
    for at in range(0, max(len(data) - LENGTH + 1, 0), step):
        some = data[at:at + step + LENGTH - 1]
        parts.append(_runs_of_chunk(some, at, bounds))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts))


def _runs_of_chunk(data: np.ndarray, at: int, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    n = len(data) - SEED + 1
    place = np.arange(n)
    h = mix(span_hash(prefix_hash(data), place, place + SEED))
    low = (h & ~_SEAM) | place.astype(np.uint64)
    width, span = 1, LENGTH - SEED + 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:len(data) - LENGTH + 1], low[span - width:])
    fits = np.zeros(len(data) - LENGTH + 2, np.int64)      # windows that lie in one row
    first = np.clip(bounds[:-1] - at, 0, len(fits) - 1)
    last = np.clip(bounds[1:] - LENGTH + 1 - at, 0, len(fits) - 1)
    long_ = last > first
    np.add.at(fits, first[long_], 1)
    np.add.at(fits, last[long_], -1)
    window = np.flatnonzero(np.cumsum(fits)[:-1] > 0)
    suffix = (low[window] & _SEAM).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (suffix[1:] != suffix[:-1]) | (window[1:] != window[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(window)) - 1
    return h[suffix[begin]], window[begin] + at, window[end] + at, suffix[begin] + at


def sides(prefix: np.ndarray, bounds: np.ndarray, window: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Two hashes a run, of the seed with the SIDE bytes after it and with those before it, 0 where the row ends sooner. A window
    holds its seed and so one of both stretches whole: equal windows have an equal hash of a stretch."""
    row = np.searchsorted(bounds, window, "right") - 1
    out = np.zeros((2, len(seed)), np.uint64)
    for i, (a, b) in enumerate(((seed, seed + SEED + SIDE), (seed - SIDE, seed + SEED))):
        fits = (a >= bounds[row]) & (b <= bounds[row + 1])
        out[i, fits] = mix(span_hash(prefix, a[fits], b[fits]) ^ np.uint64(i))
    return out


class SuffixFamily:
    """Sorted suffix arrays in levels of 1, 2, 4, ... batches. A new batch's array is merge-scanned against every level; two
    levels of equal size are merged into one of twice the size. `shared` are the suffixes found in two batches."""

    def __init__(self):
        self.levels: list[tuple[int, np.ndarray]] = []
        self.found: list[np.ndarray] = []

    def add(self, suffixes: np.ndarray) -> None:
        for _, level in self.levels:
            at = np.minimum(np.searchsorted(level, suffixes), len(level) - 1)
            self.found.append(suffixes[level[at] == suffixes])
        if len(suffixes):
            self.levels.append((1, suffixes))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (_, b) = self.levels.pop(), self.levels.pop()
            both = np.sort(np.concatenate([a, b]), kind="stable")      # two sorted runs: one merge
            self.levels.append((2 * n, both[np.append(True, both[1:] != both[:-1])]))

    def shared(self) -> np.ndarray:
        return np.unique(np.concatenate(self.found)) if self.found else np.zeros(0, np.uint64)


def _pack(values: np.ndarray) -> bytes:
    """Differences of a sorted array, byte by byte of all of them, compressed."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(blob: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(raw.T).view("<u8").ravel(), dtype=np.uint64)


def _bucket(short: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Ranges of the hash, so that a bucket's suffixes are consecutive in sorted order."""
    return (short.astype(np.float64) * (buckets / 2.0 ** bits)).astype(np.int64).clip(0, buckets - 1)


class RepeatedBytes:
    """The steps of `cut_repeats` over one table of notes."""

    def __init__(self, positions: DataFrame, key: str, note: str):
        self.rows = positions.filter(F.col(key).isNotNull()).select(
            F.col(key).cast("long").alias("key"), F.xxhash64(note).alias("sig"), F.col(note).alias("note"))
        total = self.rows.agg(F.sum(F.octet_length("note"))).first()[0] or 0
        self.batches = max(1, -(-total // BATCH_BYTES))
        suffixes = max(2, total // 8)
        self.buckets = max(1, -(-suffixes // RUN_SUFFIXES))
        self.bits = min(64, math.ceil(math.log2(suffixes)) + SPARE_BITS)
        self.rows = self.rows.filter(F.octet_length("note") >= LENGTH)
        self.copies = materialize(self._copies(), "copies")
        self.dealt = self.rows.withColumn("batch", self._batch())

    def _batch(self):
        return F.pmod(F.xxhash64("key", "sig"), F.lit(self.batches)).cast("int")

    def _copies(self) -> DataFrame:
        """(key, sig, size) of notes whose whole text a smaller key has: these lose everything and need no suffixes."""
        each = self.rows.select("key", "sig", F.xxhash64(F.lit(1), "note").alias("sig2"), F.octet_length("note").cast("long").alias("size"))
        firsts = each.groupBy("sig", "sig2").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high")
        return (salted_join(each, firsts, ["sig", "sig2"], F.xxhash64("key")).filter("key > low")
                .select("key", "sig", "size").distinct())

    def suffix_arrays(self) -> DataFrame:
        """(bucket, batch, n, suffixes, many): a batch's sorted distinct stretch hashes in a bucket, and a bit for each that two keys
        of the batch hold."""
        bits, buckets = self.bits, self.buckets
        drop = np.uint64(64 - bits)

        def run(texts: pa.Table, copies: pa.Table) -> pa.Table:
            texts, found, keys = _without(texts, copies), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            names = texts.column("key").to_numpy()
            for lo, hi, data, bounds in slices(texts.column("note")):
                _, first, _, seed = cut_runs(data, bounds)
                own = names[lo:hi][np.searchsorted(bounds, first, "right") - 1]
                for h in sides(prefix_hash(data), bounds, first, seed):
                    found.append(h[h != 0] >> drop)
                    keys.append(own[h != 0])
            h, k = np.concatenate(found), np.concatenate(keys)
            order = np.lexsort([k, h])
            h, k = h[order], k[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            other = np.zeros(len(h), np.int64)
            other[1:] = ~new[1:] & (k[1:] != k[:-1])
            at = np.flatnonzero(new)
            many = np.add.reduceat(other, at) > 0 if len(at) else np.zeros(0, bool)
            h = h[at]
            ranges, first = np.unique(_bucket(h, bits, buckets), return_index=True)
            ends = np.append(first[1:], len(h))
            batch = texts.column("batch")[0].as_py() if texts.num_rows else 0
            return pa.table({"bucket": pa.array(ranges.astype(np.int32)), "batch": pa.array(np.full(len(ranges), batch, np.int32)),
                             "n": pa.array((ends - first).astype(np.int32)),
                             "suffixes": pa.array([_pack(h[a:b]) for a, b in zip(first, ends)], pa.binary()),
                             "many": pa.array([np.packbits(many[a:b]).tobytes() for a, b in zip(first, ends)], pa.binary())})

        copies = self.copies.select(self._batch().alias("batch"), "key", "sig")
        return self.dealt.groupBy("batch").cogroup(copies.groupBy("batch")).applyInArrow(
            run, "bucket int, batch int, n int, suffixes binary, many binary")

    def marks(self) -> DataFrame:
        """(batch, bucket, n, marks): a bit for each hash of a batch's array: two keys hold it."""
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("batch")
            arrays = [_unpack(s.as_py(), n.as_py()) for s, n in zip(table.column("suffixes"), table.column("n"))]
            family = SuffixFamily()
            for a in arrays:
                family.add(a)
            shared, out = family.shared(), []
            for a, many in zip(arrays, table.column("many")):
                hit = np.unpackbits(np.frombuffer(many.as_py(), np.uint8), count=len(a)).view(bool).copy()
                if len(shared):
                    hit |= shared[np.minimum(np.searchsorted(shared, a), len(shared) - 1)] == a
                out.append(np.packbits(hit).tobytes())
            return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "n": table.column("n"),
                             "marks": pa.array(out, pa.binary())})
        return self.suffix_arrays().groupBy("bucket").applyInArrow(run, "batch int, bucket int, n int, marks binary")

    def shared_runs(self) -> DataFrame:
        """Runs that may share a window with another note. Of equal runs in a batch only the smallest key's goes on, as
        (bucket, g, s, key, sig, start): seed hash, the run's bytes, note, place. The others are settled: whole spans
        (key, sig, start, end) with a null bucket. So a run that very many notes hold sends one row a batch."""
        buckets = self.buckets
        drop = np.uint64(64 - self.bits)

        def run(texts: pa.Table, marks: pa.Table) -> pa.Table:
            texts = _without(texts, marks.filter(pc.is_valid(marks.column("key"))))
            marks = marks.filter(pc.is_null(marks.column("key"))).sort_by("bucket")
            hit = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(m.as_py(), np.uint8), count=n.as_py()).view(bool)
                                                       for m, n in zip(marks.column("marks"), marks.column("n")))])
            names, sigs = texts.column("key").to_numpy(), texts.column("sig").to_numpy()
            held, hashes = [], [np.zeros(0, np.uint64)]
            for lo, hi, data, bounds in slices(texts.column("note")):
                g, first, last, seed = cut_runs(data, bounds)
                prefix = prefix_hash(data)
                both = sides(prefix, bounds, first, seed)
                hashes.append(both[both != 0] >> drop)
                held.append((lo, data, bounds, g, first, last, both, span_hash(prefix, first, last + LENGTH)))
            known = np.unique(np.concatenate(hashes))
            known = known[hit] if len(known) else known
            g, key, sig, start, size, check, places = ([] for _ in range(7))
            for lo, data, bounds, seeds, first, last, both, checks in held:
                some = np.zeros(len(seeds), bool)
                for h in both if len(known) else ():
                    some |= (h != 0) & (known[np.minimum(np.searchsorted(known, h >> drop), len(known) - 1)] == h >> drop)
                some = np.flatnonzero(some)
                row = np.searchsorted(bounds, first[some], "right") - 1
                end = last[some] + LENGTH
                g.append(seeds[some])
                key.append(names[lo + row])
                sig.append(sigs[lo + row])
                start.append(first[some] - bounds[row])
                size.append(end - first[some])
                check.append(checks[some])
                places.append((data, first[some]))
            g, check = (np.concatenate([np.zeros(0, np.uint64), *v]) for v in (g, check))
            key, sig, start, size = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (key, sig, start, size))
            late = key > _lowest(g, check, size, key)[0]
            end = start + size
            # settled runs of a note that touch are one span
            gone = np.flatnonzero(late)
            new = np.ones(len(gone), bool)
            new[1:] = (key[gone][1:] != key[gone][:-1]) | (sig[gone][1:] != sig[gone][:-1])
            new[1:] |= (start[gone][1:] > end[gone][:-1]) | (start[gone][1:] < start[gone][:-1])     # apart, or a repeated row
            first = gone[new]
            last = gone[np.append(np.flatnonzero(new)[1:], len(gone)) - 1] if len(gone) else gone
            text, on, n = _bytes_of(places, np.where(late, 0, size)).filter(pa.array(~late)), ~late, len(first)
            return pa.table({"bucket": pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array((g[on] % np.uint64(buckets)).astype(np.int32))]),
                             "g": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(g[on].view(np.int64))]),
                             "s": pa.concat_arrays([pa.nulls(n, pa.binary()), text]),
                             **{c: pa.array(np.concatenate([v[first if c != "end" else last], v[on]]))
                                for c, v in (("key", key), ("sig", sig), ("start", start), ("end", end))}})

        copies = self.copies.select(self._batch().alias("batch"), F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("int").alias("n"),
                                    F.lit(None).cast("binary").alias("marks"), "key", "sig")
        marks = self.marks().select("batch", "bucket", "n", "marks", F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("sig"))
        return (self.dealt.groupBy("batch").cogroup(marks.unionByName(copies).groupBy("batch"))
                .applyInArrow(run, "bucket int, g long, s binary, key long, sig long, start long, end long"))


def _lowest(g: np.ndarray, check: np.ndarray, size: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run the smallest key that holds an equal one, and the number of its class of equal runs."""
    order = np.lexsort([key, size, check, g])
    new = np.ones(len(g), bool)
    new[1:] = (g[order][1:] != g[order][:-1]) | (check[order][1:] != check[order][:-1]) | (size[order][1:] != size[order][:-1])
    of = np.cumsum(new) - 1
    low, kind = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
    low[order], kind[order] = key[order][new][of], of
    return low, kind


def settle(table: pa.Table) -> pa.Table:
    """(key, sig, start, end) that go, of all runs in a bucket of seeds: equal runs of larger keys whole; of different runs with one
    seed, windows that a run of a smaller key holds too."""
    text = table.column("s").combine_chunks().cast(pa.large_binary())
    data = np.frombuffer(text.buffers()[2], np.uint8)
    begin = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, 8 * text.offset)
    g, key, sig, start = (table.column(c).to_numpy() for c in ("g", "key", "sig", "start"))
    prefix, size = prefix_hash(data), np.diff(begin)
    low, kind = _lowest(g, span_hash(prefix, begin[:-1], begin[1:]), size, key)
    whole = key > low
    out = [(key[whole], sig[whole], start[whole], start[whole] + size[whole])]
    # one row of each class of equal runs, of seeds with several classes and keys
    _, one = np.unique(kind, return_index=True)
    one = one[np.argsort(g[one], kind="stable")]
    edge = np.flatnonzero(np.append(True, g[one][1:] != g[one][:-1]))
    n = np.diff(np.append(edge, len(one)))
    mixed = (n > 1) & (np.minimum.reduceat(low[one], edge) < np.maximum.reduceat(low[one], edge))
    one = one[np.repeat(mixed, n)]
    windows = size[one] - LENGTH + 1
    of = np.repeat(one, windows)
    i = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    w = span_hash(prefix, begin[of] + i, begin[of] + i + LENGTH)
    hit = low[of] > _lowest(g[of].view(np.uint64), w, np.zeros(len(of), np.int64), low[of])[0]
    places: dict[int, list[int]] = {}
    for k, at in zip(kind[of[hit]].tolist(), i[hit].tolist()):
        places.setdefault(k, []).append(at)
    if places:
        rows = [(r, at) for r in np.flatnonzero(~whole & np.isin(kind, list(places))).tolist() for at in places[int(kind[r])]]
        r, at = np.array(rows, np.int64).T
        out.append((key[r], sig[r], start[r] + at, start[r] + at + LENGTH))
    return pa.table(dict(zip(("key", "sig", "start", "end"), map(np.concatenate, zip(*out)))))


def _bytes_of(places: list[tuple[np.ndarray, np.ndarray]], size: np.ndarray) -> pa.Array:
    """The `size` bytes that stand at each place, place after place; `places` lists bytes and starts in them."""
    at, parts = 0, [np.zeros(0, np.uint8)]
    for data, start in places:
        n = size[at:at + len(start)]
        parts.append(data[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
        at += len(start)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(parts))])


def _without(texts: pa.Table, copies: pa.Table) -> pa.Table:
    """The texts of a batch but for those listed by key and hash."""
    if not copies.num_rows or not texts.num_rows:
        return texts
    gone = set(zip(copies.column("key").to_pylist(), copies.column("sig").to_pylist()))
    return texts.filter(pa.array([pair not in gone for pair in zip(texts.column("key").to_pylist(), texts.column("sig").to_pylist())]))


def repeated_spans(positions: DataFrame, *, key: str, note: str) -> DataFrame:
    """(key, sig, spans): the byte spans of each note that lie in strings of LENGTH bytes held by a smaller key."""
    work = RepeatedBytes(positions, key, note)
    copies = work.copies
    runs = materialize(work.shared_runs(), "runs")
    del work
    release(positions.sparkSession)
    spans = ["key", "sig", "start", "end"]
    settled = runs.filter("bucket is not null").groupBy("bucket").applyInArrow(settle, "key long, sig long, start long, end long")
    full = copies.select("key", "sig", F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))
    every = runs.filter("bucket is null").select(*spans).unionByName(settled).unionByName(full)
    listed = materialize(every.groupBy("key", "sig").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")   # bounded by the note
    discard(runs, copies)
    release(positions.sparkSession)
    return listed


def cut_repeats(positions: DataFrame, *, key: str = "position_id", note: str = "note") -> DataFrame:
    """`positions` with `kept` (the note's remaining bytes), n_bytes, n_removed and n_spans.

    A byte goes if it lies in a string of LENGTH bytes that also starts in a note with a smaller key (an integer); strings are
    judged on the notes as given, and never reach from one note to the next. The result is exact:

    Notes that copy a whole note go first. In the others every window of LENGTH bytes belongs to one suffix, chosen by its own
    bytes (`cut_runs`), about one suffix in 16 bytes. Notes are dealt into batches; each batch's suffixes, sorted by the hash of
    their first bytes (`sides`), are its suffix array, dealt further into ranges of that order. In a range the batches pass one
    after the other through a logarithmic family of arrays, which tells the suffixes that several notes hold. These alone go on
    with their runs of windows: of equal runs all but the smallest key's are removed whole; runs of one seed that differ are
    compared window by window. Hashes cut to fewer bits only let more suffixes go on; runs and windows are told apart by 128 bits.

    A null or empty note has 0 bytes. Rows with equal keys never cut each other, a null key neither cuts nor is cut. An empty
    table gives no rows; columns named like a result are replaced."""
    made = {"kept": "binary", "n_bytes": "long", "n_removed": "long", "n_spans": "long"}
    names = [c for c in positions.columns if c not in made]
    spans = repeated_spans(positions.select(key, note), key=key, note=note).select(
        F.col("key").alias("key_"), F.col("sig").alias("sig_"), F.col("spans").alias("spans_"))
    given = positions.select(*names).withColumn("hash_", F.xxhash64(note))
    both = given.join(spans, (F.col(key).cast("long") == F.col("key_")) & (F.col("hash_") == F.col("sig_")), "left").drop("key_", "sig_", "hash_")
    text_at, columns = names.index(note), [*names, *made]
    schema = positions.select(*names).schema
    for n, k in made.items():
        schema = schema.add(n, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans_at = batch.column(len(names))
            for lo, hi, data, bounds in slices(batch.column(text_at)):
                kept, removed, runs = [], [], []
                for r in range(hi - lo):
                    text = data[bounds[r]:bounds[r + 1]]
                    mine = spans_at[lo + r]
                    if not mine.is_valid:
                        kept.append(text.tobytes())
                        removed.append(0)
                        runs.append(0)
                        continue
                    edge = np.zeros(len(text) + 1, np.int64)
                    np.add.at(edge, mine.values.field("start").to_numpy(), 1)
                    np.add.at(edge, mine.values.field("end").to_numpy(), -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    kept.append(text[~gone].tobytes())
                    removed.append(int(gone.sum()))
                    runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(lo, hi - lo).columns[:len(names)], pa.array(kept, pa.binary()), pa.array(np.diff(bounds)),
                     pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], names=columns)

    return both.mapInArrow(run, schema)
