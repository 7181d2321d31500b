"""Blocks of lines that notes share: overlapping notes are aligned by patience diff, the later one loses the block."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from barloom.llm.bytescan import Words, mix, powers, prefix_hash, slices, span_hash
from barloom.llm.joins import busy_keys, salted_join
from barloom.session import discard, materialize, release

MIN_WORDS = 10      # words of a block that is deleted, at least
PAIRS = 64          # pairs of a holder that meet in one task, about
WIDER = 4           # holders of a run that are tried in a round, for each of the round before


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain of pairs (sorted by their first place) whose second places rise too: patience sorting."""
    tops, piles, back = [], [], [0] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        back[n] = piles[k - 1] if k else -1
        if k == len(tops):
            tops.append(j)
            piles.append(n)
        else:
            tops[k], piles[k] = j, n
    chain, n = [], piles[-1] if piles else -1
    while n >= 0:
        chain.append(pairs[n])
        n = back[n]
    return chain[::-1]


def patience_diff(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j) of equal lines, rising in both. Equal ends of a stretch are aligned first, then the lines that
    are unique in both sides of it, in their longest common order, then what lies between them in the same way. Without unique
    lines the first occurrences of common lines take their part."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        in_a, in_b = Counter(a[i0:i1]), Counter(b[j0:j1])
        common = in_a.keys() & in_b.keys()
        picked = {h for h in common if in_a[h] == 1 == in_b[h]} or common
        if not picked:
            continue
        at = {}
        for j in range(j0, j1):
            at.setdefault(b[j], j)
        first, pairs = set(), []
        for i in range(i0, i1):
            if a[i] in picked and a[i] not in first:
                first.add(a[i])
                pairs.append((i, at[a[i]]))
        i, j = i0, j0
        for x, y in [*_increasing(pairs), (i1, j1)]:
            todo.append((i, x, j, y))
            if x < i1:
                out.append((x, y))
            i, j = x + 1, y + 1
    return sorted(out)


def common_blocks(pairs: list[tuple[int, int]], words: list[int], least: int) -> list[tuple[int, int]]:
    """(first, last) place in the later note of blocks that run on in both notes and hold at least `least` words."""
    out, at = [], 0
    for n in range(1, len(pairs) + 1):
        if n == len(pairs) or pairs[n] != (pairs[n - 1][0] + 1, pairs[n - 1][1] + 1):
            if sum(words[j] for _, j in pairs[at:n]) >= least:
                out.append((pairs[at][1], pairs[n - 1][1]))
            at = n
    return out


def runs(lines: np.ndarray, words: np.ndarray, row: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, hash) of the shortest run of lines with `least` words that begins, and that ends, at each line of a note.
    Every line of a block worth deleting stands in a run that lies inside the block."""
    n = len(lines)
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    at = np.arange(n)
    first = np.concatenate([at, np.searchsorted(total, total[1:] - least, "right") - 1])
    last = np.concatenate([np.searchsorted(total, total[:-1] + least) - 1, at])
    able = (first >= 0) & (last < n)
    able[able] = row[first[able]] == row[last[able]]
    first, last = np.unique(np.stack([first[able], last[able]]), axis=1) if able.any() else (at[:0], at[:0])
    up, down = powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(lines.view(np.uint64) * up[:-1], out=prefix[1:])
    return first, last, mix((prefix[last + 1] - prefix[first]) * down[first]).view(np.int64)


def note_lines(positions: DataFrame, *, key: str, note: str, least: int = MIN_WORDS) -> DataFrame:
    """(key, sig, at, lines, words, probes) per note: place, hash and word count of each line with a word, and the hashes by
    which overlaps are found: those of `runs`. These are long enough to be rare by themselves."""
    kind = positions.schema[key].dataType
    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    out = T.StructType([T.StructField("key", kind), T.StructField("sig", T.LongType()), T.StructField("at", ints),
                        T.StructField("lines", longs), T.StructField("words", ints), T.StructField("probes", longs)])
    given = positions.select(F.col(key).alias("key"), F.xxhash64(note).alias("sig"), F.col(note).alias("note")).filter("key is not null")

    def lists(values: np.ndarray, cuts: np.ndarray, kinds: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values, kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in slices(batch.column(2)):
                words = Words(data, bounds)
                stop = np.flatnonzero(data == 10)
                # number of the line that a word stands in, counted in its note
                line = np.searchsorted(stop, words.start) - np.searchsorted(stop, bounds[:-1])[words.row]
                new = np.ones(len(words), bool)
                new[1:] = (words.row[1:] != words.row[:-1]) | (line[1:] != line[:-1])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(words)) - 1
                n = (last - first + 1).astype(np.int32)
                row, at = words.row[first], line[first]
                # a line from its first word to its last: white space around it does not count
                h = mix(span_hash(prefix_hash(data), words.start[first], words.end[last])) if len(first) else np.zeros(0, np.uint64)
                begin, _, probe = runs(h.view(np.int64), n, row, least)
                cuts = np.searchsorted(row, np.arange(hi - lo + 1))
                probes = np.searchsorted(begin, cuts)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(lo, hi - lo).columns[:2], lists(at.astype(np.int32), cuts, pa.int32()), lists(h.view(np.int64), cuts, pa.int64()),
                     lists(n, cuts, pa.int32()), lists(probe, probes, pa.int64())], names=out.names)

    return given.mapInArrow(run, out)


def _pairs(found: DataFrame) -> DataFrame:
    """(key, sig, from_key, from_sig, probes) of rows (key, sig, from_key, from_sig, probe)."""
    return found.groupBy("key", "sig", "from_key", "from_sig").agg(F.collect_set("probe").alias("probes"))   # a note's probes at most


def overlapping(probes: DataFrame) -> DataFrame:
    """Pairs (key, sig, from_key, from_sig, probes): a note and the first holder of some of its probes. A probe held by n notes
    makes n - 1 pairs, however many that are."""
    owners = (probes.groupBy("probe").agg(F.min(F.struct("key", "sig")).alias("own"), F.max("key").alias("top"))
              .filter("own.key < top").select("probe", "own"))
    return _pairs(salted_join(probes, owners, ["probe"], F.xxhash64("key")).filter("own.key < key")
                  .select("key", "sig", F.col("own.key").alias("from_key"), F.col("own.sig").alias("from_sig"), "probe"))


def align(pairs: DataFrame, lines: DataFrame, least: int) -> DataFrame:
    """(key_, sig_, x, y, first, last, probe, places): the blocks that patience diff gives for each pair, from the x-th to the y-th
    line with a word (place `first` to `last` among all lines), and with `probe` the numbers of the lines of the pair's shared
    runs that are not inside these blocks. Only notes that `pairs` names are sent, a holder to one task for each PAIRS of its pairs."""
    busy = busy_keys(pairs, ["from_key", "from_sig"], PAIRS)
    sized = (salted_join(pairs, busy, ["from_key", "from_sig"], F.xxhash64("sig", "key"), "left")
             .withColumn("salts", F.coalesce("salts", F.lit(1))))
    later = lines.select("key", "sig", "at", "lines", "words").join(pairs.select("key", "sig").distinct(), ["key", "sig"], "left_semi")
    both = sized.join(_once(later), ["key", "sig"])
    holders = lines.select(F.col("key").alias("from_key"), F.col("sig").alias("from_sig"), F.col("lines").alias("from_lines"))
    holders = _once(holders.join(pairs.select("from_key", "from_sig").distinct(), ["from_key", "from_sig"], "left_semi"))
    holders = holders.join(busy, ["from_key", "from_sig"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    both = salted_join(both, holders, ["from_key", "from_sig", "salts"], F.xxhash64("key", "sig"), salts=F.col("salts")).select(
        "key", "sig", "at", "lines", "words", "from_lines", "probes")
    out = T.StructType([T.StructField("key_", lines.schema["key"].dataType), T.StructField("sig_", T.LongType()),
                        *(T.StructField(c, T.IntegerType()) for c in ("x", "y", "first", "last")),
                        T.StructField("probe", T.LongType()), T.StructField("places", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for r, (at, b, words, a, shared) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 7)))):
                gone = np.zeros(len(b), bool)
                for x, y in common_blocks(patience_diff(a, b), words, least):
                    gone[x:y + 1] = True
                    made.append((r, x, y, at[x], at[y], None, None))
                if gone.all():
                    continue
                shared = set(shared)
                for x, y, h in zip(*(v.tolist() for v in runs(np.array(b, np.int64), np.array(words), np.zeros(len(b)), least))):
                    if h in shared and not gone[x:y + 1].all():
                        made.append((r, None, None, None, None, h, list(range(x, y + 1))))
            row, *columns = zip(*made) if made else [[]] * 7
            took = pa.array(row, pa.int32())
            kinds = [*[pa.int32()] * 4, pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(took), batch.column(1).take(took),
                                              *(pa.array(c, k) for c, k in zip(columns, kinds))], names=out.names)

    return both.mapInArrow(run, out)


def _once(notes: DataFrame) -> DataFrame:
    """One row of each (key, sig), the first two columns."""
    return notes.dropDuplicates(notes.columns[:2])


def _cuts(found: DataFrame) -> DataFrame:
    """(key_, sig_, cuts_): a note's blocks, those that follow one another as one, so blank lines between them are inside."""
    block = F.struct("x", "y", "first", "last")
    rows = found.filter("x is not null").groupBy("key_", "sig_").agg(F.sort_array(F.collect_set(block)).alias("blocks"))   # a note's lines at most

    def join(done, b):
        last = F.element_at(done, -1)
        wider = F.struct(last["x"].alias("x"), F.greatest(last["y"], b["y"]).alias("y"), last["first"].alias("first"),
                         F.greatest(last["last"], b["last"]).alias("last"))
        touches = (F.size(done) > 0) & (b["x"] <= F.try_element_at(done, F.lit(-1))["y"] + 1)
        return F.when(touches, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(done, F.array(b)))

    empty = F.filter("blocks", lambda b: F.lit(False))
    return rows.select("key_", "sig_", F.aggregate("blocks", empty, join).alias("cuts_"))


def _open(found: DataFrame) -> DataFrame:
    """(key, sig, probe) of runs with a line that no block of `found` holds."""
    left = materialize(found.filter("probe is not null").select("key_", "sig_", "probe", "places").distinct(), "left")
    near = found.join(left.select("key_", "sig_").distinct(), ["key_", "sig_"], "left_semi")
    held = lambda p: F.exists("cuts_", lambda c: (c["x"] <= p) & (p <= c["y"]))
    return (left.join(_cuts(near), ["key_", "sig_"], "left").filter(F.col("cuts_").isNull() | ~F.forall("places", held))
            .select(F.col("key_").alias("key"), F.col("sig_").alias("sig"), "probe").distinct())


def copies(lines: DataFrame, least: int) -> DataFrame:
    """(key_, sig_, x, y, first, last, probe, places) of notes with an equal earlier note: one block, all their lines."""
    twice = lines.groupBy("sig").agg(F.min("key").alias("own"), F.max("key").alias("top")).filter("own < top").select("sig", "own")
    whole = lines.filter(F.aggregate("words", F.lit(0), lambda a, w: a + w) >= least).select(
        "key", "sig", F.lit(0).alias("x"), (F.size("at") - 1).alias("y"), F.element_at("at", 1).alias("first"), F.element_at("at", -1).alias("last"))
    return (salted_join(whole, twice, ["sig"], F.xxhash64("key")).filter("own < key")
            .select(F.col("key").alias("key_"), F.col("sig").alias("sig_"), "x", "y", "first", "last", F.lit(None).cast("long").alias("probe"),
                    F.lit(None).cast("array<int>").alias("places")).distinct())


def all_blocks(lines: DataFrame, least: int) -> DataFrame:
    """The blocks of equal earlier notes (`copies`), `align` of every other note with the first holder of each of its runs, and
    of the runs that stay with their other earlier holders (equal notes are one), about 3, 12, 48, ... of a run's holders a round,
    until all have been tried or the run is covered. A holder's round comes from a hash, so a run's holders are not sorted. After
    each round the driver lets go of its plans and small broadcast tables, so its memory does not grow with the rounds."""
    spark = lines.sparkSession
    same = materialize(copies(lines, least), "copies")
    probes = lines.select(F.explode(F.array_distinct("probes")).alias("probe"), "key", "sig")
    rest = overlapping(probes).join(same.select(F.col("key_").alias("key"), F.col("sig_").alias("sig")), ["key", "sig"], "left_anti")
    pairs = materialize(rest, "pairs")
    blocks = materialize(align(pairs, lines, least), "blocks")
    discard(pairs)
    release(spark)
    open_ = materialize(_open(blocks), "open")
    found = same.unionByName(blocks)
    if open_.isEmpty():
        return found
    held = blocks      # of notes with open runs
    holders = probes.join(open_.select("probe").distinct(), "probe", "left_semi").groupBy("probe", "sig").agg(F.min("key").alias("key"))
    holders = materialize(holders, "holders")
    # the lines of notes that a later round can name: those with an open run and its holders
    near = open_.select("key", "sig").union(holders.select("key", "sig")).distinct()
    few = materialize(lines.select("key", "sig", "at", "lines", "words").join(near, ["key", "sig"], "left_semi"), "open-lines")
    sizes = holders.groupBy("probe").agg(F.count(F.lit(1)).alias("n"))
    share = F.pmod(F.xxhash64("key", "sig", "probe"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    turn = F.floor(F.log(float(WIDER), F.floor(share * F.col("n")) + 1)).cast("int")
    own = materialize(salted_join(holders, sizes, ["probe"], F.xxhash64("sig"))
                      .select("probe", F.struct("key", "sig").alias("own"), turn.alias("turn")), "turns")
    last = own.agg(F.max("turn")).first()[0]
    release(spark)
    for step in range(last + 1):
        pairs = _pairs(salted_join(own.filter(F.col("turn") == step), open_.groupBy("probe").agg(F.max("key").alias("top")), ["probe"], F.xxhash64("own"))
                       .filter("own.key < top").drop("top").join(open_, "probe").filter("own.key < key")
                       .select("key", "sig", F.col("own.key").alias("from_key"), F.col("own.sig").alias("from_sig"), "probe"))
        pairs = materialize(pairs, "pairs")
        more = materialize(align(pairs, few, least), "blocks")
        discard(pairs)
        release(spark)
        found = found.unionByName(more)
        notes = open_.select(F.col("key").alias("key_"), F.col("sig").alias("sig_")).distinct()
        held = materialize(held.unionByName(more).join(notes, ["key_", "sig_"], "left_semi"), "held")
        old, open_ = open_, materialize(_open(held), "open")
        discard(old)
        release(spark)
        if open_.isEmpty():
            break
    return found


def dedup_lines(positions: DataFrame, *, key: str = "position_id", note: str = "note", least: int = MIN_WORDS) -> DataFrame:
    """`positions` with the shared blocks cut out of `note`, and n_lines and n_removed.

    Two notes overlap when they share a probe (see `note_lines`); a note is aligned with earlier ones by patience diff over the
    lines that hold a word, and every aligned block of `least` words or more is deleted from the later note. The first holder
    (smallest key) of each probe comes first, then the other earlier holders of those not deleted yet (see `all_blocks`), so the
    lines with words that are deleted are the same as if every earlier note were tried. A blank line goes when the lines with
    words before and behind it both go, whichever notes they were aligned with. Notes are judged as given, not as cut, so the
    result does not depend on an order of work. A note may lose all lines with words; its row stays.

    Keys order the notes: rows with equal keys never cut each other, a null key neither cuts nor is cut. A null note stays null
    with 0 lines, an empty one has one line; an empty table gives no rows; columns named n_lines or n_removed are replaced."""
    lines = materialize(note_lines(positions, key=key, note=note, least=least), "lines")
    cuts = _cuts(all_blocks(lines, least))
    split = F.split(note, "\n", -1)
    gone = lambda i: F.exists("cuts_", lambda c: (c["first"] <= i) & (i <= c["last"]))
    kept = F.filter(split, lambda x, i: ~gone(i))
    n_lines = F.coalesce(F.when(F.col(note).isNull(), 0).otherwise(F.size(split)), F.lit(0)).cast("long")
    given = positions.drop("n_lines", "n_removed")
    cut = given.withColumn("hash_", F.xxhash64(note)).join(cuts, (F.col(key) == F.col("key_")) & (F.col("hash_") == F.col("sig_")), "left")
    cut = cut.withColumn("kept_", F.when(F.col("cuts_").isNotNull(), kept))
    text = F.when(F.col("cuts_").isNotNull(), F.array_join("kept_", "\n")).otherwise(F.col(note))
    return cut.select(*[text.alias(c) if c == note else F.col(c) for c in given.columns], n_lines.alias("n_lines"),
                      F.coalesce(n_lines - F.size("kept_"), F.lit(0)).cast("long").alias("n_removed"))
