"""Near-duplicate notes: an exact Jaccard join of word shingles with signature trees, and its connected components."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from barloom.llm.bytescan import LOWER, Words, mix, slices
from barloom.llm.joins import busy_keys, salted_join
from barloom.session import discard, materialize, release

HOT_COUNT = 256                     # pairs of a set that meet in one task when texts are compared, about
WIDTH = 2                           # largest size of a band of sizes over the largest of the band below
KEY_BITS = 1 << 24                  # of the bitmap that leaves out notes whose text is not wanted
ROUND_EDGES = 50_000                # edges, in both directions, that a task of a round of components takes, about
BLOCK = 2048                        # members of a probe's group that one task compares with as many others
BASKET_ROWS = 4000                  # rows of groups that a task takes together
CROWD = 24                          # members from which on a group is searched with fine bitmaps
SMALL = 4                           # members of a group that are compared without a tree
LEAF, FAN = 8, 8                    # members of a leaf and children of a node of a signature tree
FIRST_LINKS = 8                     # candidates between two components in a group, in the first round; 16 times more in the next
FINE = 8                            # bits for a member in the bitmaps that candidates are looked at again with
_PLACE, _BAND = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)
_HALF = np.uint64(32)


def ones(bits: np.ndarray) -> np.ndarray:
    """Bits set in each row of bitmaps."""
    return np.bitwise_count(bits).sum(-1, dtype=np.int64)


def prefix_size(n: int, percent: int) -> int:
    """Shingles of a set of n of which a set with enough overlap must hold one, whatever the order."""
    return n - -(-percent * n // 100) + 1


def can_link(n: int, m: int, overlap: int, percent: int) -> bool:
    return 100 * overlap >= percent * (n + m - overlap) > 0


def most_apart(n: int, m: int, percent: int) -> int:
    """Members that only one of two linked sets of n and m can hold, at most; never less for larger sets."""
    return (n + m) * (100 - percent) // (100 + percent)


@lru_cache(1 << 16)
def bands(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(band, runs, apart) for a set of n: the bands of sizes in which the larger set of a linked pair can lie, into how many runs
    the range of hashes is cut there, and how many members at most are held by one side only. Empty when only equal sets link."""
    largest = 100 * n // percent
    if prefix_size(largest, percent) == 1:
        return []
    band, top = 0, 8
    while top < n:
        band, top = band + 1, top * WIDTH
    out = []
    while True:
        most = most_apart(top, top, percent)
        out.append((band, most + 2 + most // 24, most_apart(n, min(top, largest), percent)))
        if top >= largest:
            return out
        band, top = band + 1, top * WIDTH


def run_probes(s: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of runs of a sorted set, of which linked sets that differ share one: a set sends its first `apart` + 1 runs that
    hold a member. Each member that only one side holds spoils one run, so of the runs that the set with the shorter stretch
    sends, one at least is the same in the other set. A set with fewer such runs sends all, with the empty ones."""
    out = []
    for band, runs, apart in bands(len(s), percent):
        place = ((s >> _HALF) * np.uint64(runs)) >> _HALF
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        if len(first) > apart:
            end = int(first[apart + 1]) if len(first) > apart + 1 else len(s)
            first = first[:apart + 1]
            place, sums = place[first], np.add.reduceat(s[:end], first)
        else:
            sums = np.zeros(runs, np.uint64)
            sums[place[first].astype(np.int64)] = np.add.reduceat(s, first)
            place = np.arange(runs, dtype=np.uint64)
        out.append(mix(sums + (place + np.uint64(1)) * _PLACE + np.full(1, band, np.uint64) * _BAND))
    return np.concatenate(out) if out else s[:0]


def note_sets(column: pa.Array, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First row of a slice and the sorted distinct shingle hashes of its notes. Fewer words: the whole sequence as one."""
    for lo, hi, data, bounds in slices(column):
        w = Words(LOWER[data], bounds)
        ends = np.concatenate([[0], np.cumsum(w.per_row)])
        shingles, _ = w.windows(words)
        sets = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if b - a >= words:
                sets.append(np.unique(shingles[a:b - words + 1]))
            elif b > a:
                h = np.array([b - a], np.uint64)
                for x in w.hash[a:b]:
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x)
                sets.append(h)
            else:
                sets.append(shingles[:0])
        yield lo, sets


def set_id(s: np.ndarray) -> bytes:
    """128 bits that stand for a set; equal sets have equal ids."""
    with np.errstate(over="ignore"):
        a, b = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def signature(s: np.ndarray, each: int = 2) -> bytes:
    """Bitmap of a set with at least `each` bits for a member, a power of two of bytes from 32 up."""
    size = 32
    while size * 8 < each * len(s):
        size *= 2
    bits = np.zeros(size * 8, bool)
    bits[(s >> np.uint64(20)) % np.uint64(size * 8)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def fold(bitmap: np.ndarray, size: int) -> np.ndarray:
    """A bitmap's OR over its stretches of `size` bytes: the bitmap that the shorter size would have given."""
    return np.bitwise_or.reduce(bitmap.reshape(-1, size), axis=0)


def may_link(n: int, a: np.ndarray, m: int, b: np.ndarray, percent: int) -> bool:
    """Whether sizes and bitmaps allow a link: a bit that only one side has is a member that only this side has."""
    size = min(len(a), len(b))
    a, b = fold(a, size), fold(b, size)
    most = min(n - int(ones(a & ~b)), m - int(ones(b & ~a)))
    return can_link(n, m, most, percent)


def rows_may_link(n: np.ndarray, a: pa.Array, m: np.ndarray, b: pa.Array, percent: int) -> np.ndarray:
    """`may_link` for the rows of two columns of bitmaps."""
    sizes = np.stack([pc.binary_length(a).to_numpy(), pc.binary_length(b).to_numpy()])
    good = np.zeros(len(n), bool)
    for x, y in np.unique(sizes, axis=1).T.tolist():
        rows = np.flatnonzero((sizes[0] == x) & (sizes[1] == y))
        size = min(x, y)
        left, right = (np.bitwise_or.reduce(np.frombuffer(b"".join(v.take(pa.array(rows)).to_pylist()), np.uint64).reshape(len(rows), -1, size // 8), axis=1)
                       for v in (a, b))
        most = np.minimum(n[rows] - ones(left & ~right), m[rows] - ones(right & ~left))
        good[rows] = (100 * most >= percent * (n[rows] + m[rows] - most)) & (most > 0)
    return good


class SignatureTree:
    """Members sorted by size under nodes that hold the OR of their bitmaps, their range of sizes, and their component if it
    is one. `size` bytes of each bitmap are used."""

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray, labels: np.ndarray):
        self.sizes, self.bitmaps, self.labels = sizes, np.ascontiguousarray(bitmaps).view(np.uint64), labels
        self.most = ones(self.bitmaps)      # bits set; other members of a set share a bit with these
        level = [(i, min(i + LEAF, len(sizes)), None) for i in range(0, len(sizes), LEAF)]
        level = [self._node(lo, hi, kids) for lo, hi, kids in level]
        while len(level) > 1:
            level = [self._node(g[0]["lo"], g[-1]["hi"], g) for g in (level[i:i + FAN] for i in range(0, len(level), FAN))]
        self.root = level[0] if level else None

    def _node(self, lo: int, hi: int, kids) -> dict:
        one = self.labels[lo] if (self.labels[lo:hi] == self.labels[lo]).all() else -1
        return {"lo": lo, "hi": hi, "kids": kids, "least": int(self.sizes[lo:hi].min()), "most": int(self.sizes[lo:hi].max()),
                "label": one, "bits": np.bitwise_or.reduce(self.bitmaps[lo:hi], axis=0),
                # members that share a bit with another member of their own set
                "shared": int((self.sizes[lo:hi] - self.most[lo:hi]).max())}

    def pairs(self, percent: int, ask) -> Iterator[tuple[int, int]]:
        """Dual traversal: pairs of members i < j that may link. A pair of nodes is left when it holds one component only, when
        its sizes are too far apart, or when the bits that both have are too few for the overlap that their smallest sizes need.
        `ask(i, j)` says whether a pair is still wanted."""
        todo = [(self.root, self.root)] if self.root else []
        while todo:
            x, y = todo.pop()
            if x["label"] == y["label"] != -1:
                continue
            if 100 * min(x["most"], y["most"]) < percent * max(x["least"], y["least"]):
                continue
            if x is not y:
                most = int(ones(x["bits"] & y["bits"])) + min(x["shared"], y["shared"])
                if not can_link(x["least"], y["least"], min(most, x["most"], y["most"]), percent) and \
                        (100 + percent) * most < percent * (x["least"] + y["least"]):
                    continue
            if x["kids"] is None and y["kids"] is None:
                yield from self._leaves(x, y, percent, ask)
            elif x is y:
                kids = x["kids"]
                todo += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(i, len(kids))]
            elif y["kids"] is None or x["kids"] is not None and x["hi"] - x["lo"] >= y["hi"] - y["lo"]:
                todo += [(k, y) for k in x["kids"]]
            else:
                todo += [(x, k) for k in y["kids"]]

    def _leaves(self, x: dict, y: dict, percent: int, ask) -> Iterator[tuple[int, int]]:
        a, b = np.arange(x["lo"], x["hi"]), np.arange(y["lo"], y["hi"])
        i, j = (v.ravel() for v in np.meshgrid(a, b, indexing="ij"))
        keep = (i < j) & (self.labels[i] != self.labels[j]) if x is y else self.labels[i] != self.labels[j]
        i, j = i[keep], j[keep]
        n, m = self.sizes[i], self.sizes[j]
        most = np.minimum(n - ones(self.bitmaps[i] & ~self.bitmaps[j]), m - ones(self.bitmaps[j] & ~self.bitmaps[i]))
        good = 100 * most >= percent * (n + m - most)
        for p, q in zip(i[good].tolist(), j[good].tolist()):
            if ask(p, q):
                yield (p, q) if p < q else (q, p)


def components(edges: DataFrame) -> DataFrame:
    """(c, label): the smallest set id that links lead to. `edges` has (c, d). Labels spread to neighbours and jump to their
    label's label, so the rounds grow with the logarithm of a chain's length; each round is a stored table."""
    both = materialize(edges.select("c", "d").unionByName(edges.select(F.col("d").alias("c"), F.col("c").alias("d"))).distinct(), "edges")
    tasks = both.count() // ROUND_EDGES + 1      # few edges take few tasks, however many the shuffles of large tables take
    state = materialize(both.groupBy("c").agg(F.least(F.min("d"), F.col("c")).alias("label")).coalesce(tasks), "components")
    while True:
        near = both.join(state.select(F.col("c").alias("d"), "label"), "d").select("c", "label")
        jump = state.join(state.select(F.col("c").alias("label"), F.col("label").alias("next")), "label").select(
            "c", F.col("next").alias("label"))
        own = state.select("c", "label", F.col("label").alias("old"))
        new = (near.unionByName(jump).unionByName(own, allowMissingColumns=True)
               .groupBy("c").agg(F.min("label").alias("label"), F.max("old").alias("old")))
        new = materialize(new.coalesce(tasks), "components")
        changed = new.filter("label <> old").limit(1).count()
        discard(state)
        release(edges.sparkSession)     # plans and broadcast tables of a round do not stay in the driver
        if not changed:
            discard(both)
            return new
        state = new


class JaccardJoin:
    """The steps of `near_duplicates` over one table of notes."""

    def __init__(self, positions: DataFrame, key: str, note: str, words: int, percent: int):
        self.given = positions.select(F.col(key).alias("key"), F.col(note).alias("note"), F.xxhash64(note).alias("sig"))
        self.words, self.percent, self.kind = words, percent, positions.schema[key].dataType
        self.used: list[DataFrame] = []      # tables that the pairs made next read

    def stored(self, pairs: DataFrame, name: str) -> DataFrame:
        """`pairs` as a table; what it was made from is deleted, its shuffle files too."""
        made = materialize(pairs, name)
        discard(*self.used)
        self.used.clear()
        release(made.sparkSession)
        return made

    def summaries(self) -> DataFrame:
        """(key, sig, c, n, bits, fine, probes) of each note: hash of the text, set id, size, bitmaps and hashes of runs."""
        words, percent = self.words, self.percent
        out = T.StructType([T.StructField("key", self.kind), T.StructField("sig", T.LongType()), T.StructField("c", T.BinaryType()),
                            T.StructField("n", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("fine", T.BinaryType()),
                            T.StructField("probes", T.ArrayType(T.LongType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, sets in note_sets(batch.column(2), words):
                    probes = [run_probes(s, percent) for s in sets]
                    cuts = np.concatenate([[0], np.cumsum([len(p) for p in probes])]).astype(np.int32)
                    flat = np.concatenate([*probes, np.zeros(0, np.uint64)]).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(x).slice(lo, len(sets)) for x in (0, 1)), pa.array([set_id(s) for s in sets], pa.binary()),
                         pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.binary()),
                         pa.array([signature(s, FINE) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))], names=out.names)
        return self.given.select("key", "sig", "note").mapInArrow(run, out)

    def texts(self, wanted: DataFrame, keys: DataFrame) -> DataFrame:
        """(c, note): the text of one note of each set in `wanted` (c). A bitmap of hashed keys, as large for any table, leaves
        out most other notes before texts are dealt by key."""
        some = materialize(keys.join(wanted, "c", "left_semi").select("c", "key", "sig"), "wanted")
        at = F.pmod(F.xxhash64("key"), F.lit(KEY_BITS))
        held = some.select(at.alias("b")).groupBy(F.expr("b div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("held"))
        near = (self.given.withColumn("b", at).withColumn("w", F.expr("b div 64")).join(F.broadcast(held), "w")
                .filter(F.expr("shiftrightunsigned(held, cast(b % 64 as int)) & 1 = 1")).select("key", "sig", "note"))
        made = materialize(near.join(some, ["key", "sig"]).dropDuplicates(["key", "sig"]).select("c", "note"), "texts")
        discard(some)
        release(made.sparkSession)      # the bitmap, a broadcast table
        return made

    def verified(self, pairs: DataFrame, keys: DataFrame) -> DataFrame:
        """The pairs (c, d) whose sets overlap enough, made again from the texts, which are shorter than sets of hashes. A set
        with many pairs is sent to one task for each HOT_COUNT of them."""
        words, percent = self.words, self.percent
        texts = self.texts(pairs.select("c").unionByName(pairs.select(F.col("d").alias("c"))), keys)
        busy = busy_keys(pairs, ["d"], HOT_COUNT)
        other = texts.select(F.col("c").alias("d"), F.col("note").alias("others")).join(pairs.select("d").distinct(), "d", "left_semi")
        other = other.join(busy, "d", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        both = salted_join(pairs, busy, ["d"], F.xxhash64("c"), "left").withColumn("salts", F.coalesce("salts", F.lit(1))).join(texts, "c")
        both = salted_join(both, other, ["d", "salts"], F.xxhash64("c"), salts=F.col("salts")).select("c", "d", "note", "others")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place = batch.column(1).dictionary_encode().indices.to_numpy()
                _, at = np.unique(place, return_index=True)
                good = np.zeros(batch.num_rows, bool)
                for lo, sets in note_sets(batch.column(3).take(pa.array(at)), words):      # each other text of a batch once
                    rows = np.flatnonzero((place >= lo) & (place < lo + len(sets)))
                    for first, some in note_sets(batch.column(2).take(pa.array(rows)), words):
                        for r, a in zip(rows[first:first + len(some)].tolist(), some):
                            b = sets[place[r] - lo]
                            overlap = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) and len(b) else 0
                            good[r] = can_link(len(a), len(b), overlap, percent)
                yield batch.select([0, 1]).filter(pa.array(good))
        self.used += [texts, pairs, busy]
        return self.stored(both.mapInArrow(run, "c binary, d binary"), "links")

    def first_pairs(self, members: DataFrame, classes: DataFrame) -> DataFrame:
        """Pairs (c, d) of every member of a group with the group's hub that sizes and bitmaps allow."""
        percent = self.percent
        pairs = materialize(members.filter("h <> hub").select("h", "hub").distinct(), "hubs")
        left = pairs.join(classes.select("h", "c", "n", "bits"), "h")
        right = materialize(classes.select(F.col("h").alias("hub"), F.col("c").alias("d"), F.col("n").alias("m"), F.col("bits").alias("others"))
                            .join(pairs.select("hub").distinct(), "hub", "left_semi"), "hubs")
        self.used += [pairs, right]
        both = left.join(right, "hub").filter(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = rows_may_link(batch.column(2).to_numpy(), batch.column(4), batch.column(3).to_numpy(), batch.column(5), percent)
                yield batch.select([0, 1]).filter(pa.array(good))
        return both.select("c", "d", "n", "m", "bits", "others").mapInArrow(run, "c binary, d binary")

    def cross_pairs(self, members: DataFrame, labels: DataFrame, classes: DataFrame, most: int) -> DataFrame:
        """(probe, c, d): pairs between components inside a group, its hub aside, found by the group's signature tree. A row without
        a pair says that two components of the group had more than `most` candidates."""
        percent = self.percent
        ends = labels.join(classes.select("c", "h"), "c").select("h", F.xxhash64("label").alias("label"))
        named = members.filter("h <> hub and size > 2").join(ends, "h", "left").select("probe", "h", F.coalesce("label", "h").alias("label"))
        open_ = (named.groupBy("probe").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"))
                 .filter("lo <> hi").select("probe", "size", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
        open_ = materialize(open_, "open")
        total = open_.agg(F.sum(F.col("size") * F.col("blocks"))).first()[0] or 0
        baskets = max(64, total // BASKET_ROWS)
        rows = named.join(open_, "probe").join(classes.select("h", "c", "n", "bits"), "h")
        # in crowded groups many pairs are nearly alike: their members come with fine bitmaps
        crowd = named.join(open_.filter(F.col("size") > CROWD), "probe").select("h").distinct().join(classes.select("h", "c"), "h")
        crowd = materialize(crowd.select("c"), "crowd")
        fine = materialize(classes.select("c", "fine").join(crowd, "c", "left_semi"), "bitmaps")
        self.used += [open_, crowd, fine]
        release(open_.sparkSession)     # the search itself is the largest plan
        rows = rows.join(fine, "c", "left").withColumn(
            "bits", F.when(F.col("size") > CROWD, F.coalesce("fine", "bits")).otherwise(F.col("bits")))
        rows = (rows.withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
                .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
                .withColumn("basket", F.pmod(F.xxhash64("probe", "i", "j"), F.lit(baskets)).cast("int")))
        rows = rows.select("basket", "probe", "i", "j", "own", "c", "label", "n", "bits")

        def run(table: pa.Table) -> pa.Table:
            groups = defaultdict(list)
            for r, g in enumerate(zip(*(table.column(c).to_pylist() for c in ("probe", "i", "j")))):
                groups[g].append(r)
            c, label, n, own = (table.column(x).to_pylist() for x in ("c", "label", "n", "own"))
            bits = [np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()]
            near = lambda a, b: 100 * min(n[a], n[b]) >= percent * max(n[a], n[b]) and may_link(n[a], bits[a], n[b], bits[b], percent)
            pairs, cuts = set(), set()
            for (probe, i, j), some in groups.items():
                apart = lambda a, b: label[a] != label[b] and (i == j or own[a] != own[b])
                if len(some) <= SMALL:
                    found = [(a, b) for x, a in enumerate(some) for b in some[:x] if apart(a, b) and near(a, b)]
                else:
                    found, cut = search_group(some, n, bits, label, c, percent, apart, most)
                    if cut:
                        cuts.add(probe)
                pairs.update((min(c[a], c[b]), max(c[a], c[b])) for a, b in found)
            listed = sorted(pairs)
            return pa.table({"probe": pa.array([None] * len(listed) + sorted(cuts), pa.int64()),
                             "c": pa.array([p[0] for p in listed] + [None] * len(cuts), pa.binary()),
                             "d": pa.array([p[1] for p in listed] + [None] * len(cuts), pa.binary())})

        return rows.groupBy("basket").applyInArrow(run, "probe long, c binary, d binary").distinct()


def search_group(some: list[int], n: list, bits: list, label: list, c: list, percent: int, apart, most: int) -> tuple[list, bool]:
    """Candidate pairs of a group by its signature tree, `most` at most between two components; whether there were more."""
    some = sorted(some, key=lambda r: (n[r], label[r], c[r]))
    size = min(len(bits[r]) for r in some)
    names = {x: k for k, x in enumerate(dict.fromkeys(label[r] for r in some))}
    tree = SignatureTree(np.array([n[r] for r in some]), np.stack([fold(bits[r], size) for r in some]),
                         np.array([names[label[r]] for r in some]))
    seen: dict[tuple, int] = {}

    def ask(p: int, q: int) -> bool:
        a, b = some[p], some[q]
        if not apart(a, b):
            return False
        if len(bits[a]) > size < len(bits[b]) and not may_link(n[a], bits[a], n[b], bits[b], percent):    # the tree saw shortened bitmaps
            return False
        ends = tuple(sorted((names[label[a]], names[label[b]])))
        seen[ends] = seen.get(ends, 0) + 1
        return seen[ends] <= most
    found = [(some[p], some[q]) for p, q in tree.pairs(percent, ask)]
    return found, any(v > most for v in seen.values())


def near_duplicates(positions: DataFrame, *, key: str = "position_id", note: str = "note", words: int = 5,
                    percent: int = 80) -> DataFrame:
    """(key, n_shingles, component): two notes link when 100 x intersection >= `percent` x union of their sets of `words`-word
    shingles (A-Z lower-cased, fewer words: the whole sequence as one); `component` is the smallest key that links lead to.

    Equal sets are one class. The range of hashes is cut into runs, more of them than two linked sets of their sizes can differ
    in, so two classes that link share a run (see `run_probes`), and groups of classes with a common run hold every link. A run
    is several shingles, so a passage in many unlike notes makes no large groups. Each class is first compared with its groups' hubs (one
    class a group, so pairs grow with the rows); what links becomes a component. Groups that still hold several components
    are then searched with a signature tree for pairs between components that sizes and bitmaps allow. Two components of a
    group send a bounded number of candidates a round; while a round was cut, another follows with the components merged and
    a bound 16 times higher, so no link is lost and copies are not expanded into all pairs. Groups of more than BLOCK
    classes are dealt as pairs of blocks. Every candidate is verified on the full sets.

    Null, empty and blank notes have 0 shingles and link with nothing. Repeated rows of a key are returned as often as given.
    A null key is a note of its own without links. An empty table gives no rows; other columns are ignored."""
    join = JaccardJoin(positions, key, note, words, percent)
    whole = materialize(join.summaries(), "summaries")
    rows = materialize(whole.select("key", "c", "n"), "sizes")
    live = rows.filter("n > 0 and key is not null")
    copies = live.groupBy("c").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("c", "rep")
    named = salted_join(live.select("key", "c"), copies, ["c"], F.xxhash64("key"), "left").select(
        "key", "c", F.coalesce("rep", "key").alias("rep"))
    named = materialize(named, "classes")
    reps = named.filter("key = rep").select("c", "key").distinct()
    # h: half of a set's id. Two sets with one h would only be candidates together, as a row stands for both from here on
    classes = whole.join(reps, ["c", "key"]).dropDuplicates(["c", "key"])
    classes = materialize(classes.withColumn("h", F.conv(F.hex(F.substring("c", 2, 7)), 16, 10).cast("long")), "reps")
    discard(whole)
    release(positions.sparkSession)
    probes = classes.select(F.explode("probes").alias("probe"), "h")
    groups = probes.groupBy("probe").agg(F.min("h").alias("hub"), F.max("h").alias("top"), F.count(F.lit(1)).alias("size"))
    groups = materialize(groups.filter("hub < top").drop("top"), "probes")
    release(positions.sparkSession)
    members = materialize(probes.join(groups, "probe").select("probe", "h", "hub", "size"), "groups")
    discard(groups)
    release(positions.sparkSession)
    keys = classes.select("c", "key", "sig")

    pairs = join.stored(join.first_pairs(members, classes), "pairs")
    links = join.verified(pairs, keys)
    discard(pairs)
    labels = components(links)
    most, left = FIRST_LINKS, members
    while True:
        pairs = join.stored(join.cross_pairs(left, labels.select("c", "label"), classes, most), "pairs")
        found = join.verified(pairs.filter("c is not null").select("c", "d"), keys)
        old, links = links, materialize(links.unionByName(found), "links")
        discard(old, found, labels)
        labels = components(links)
        cut = pairs.filter("c is null").select("probe")
        if not cut.limit(1).count():
            break
        # only groups whose candidates were cut are searched again; the others have sent all of theirs
        left = materialize(members.join(cut, "probe", "left_semi"), "groups")
        discard(pairs)
        most *= 16
    discard(pairs, members)
    labels = labels.select("c", "label")
    ends = labels.join(classes.select("c", "key"), "c").groupBy("label").agg(F.min("key").alias("end"))
    ends = materialize(labels.join(ends, "label").select("c", "end"), "ends")       # stored, so the result is a small plan
    release(positions.sparkSession)
    whole = salted_join(named, ends, ["c"], F.xxhash64("key"), "left").select(
        F.col("key").alias("key_"), F.col("c").alias("c_"), F.coalesce("end", "rep").alias("component")).distinct()
    out = rows.join(whole, (F.col("key") == F.col("key_")) & (F.col("c") == F.col("c_")), "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component"))
