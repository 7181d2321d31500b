"""Ranked search in position notes: an inverted index in blocks of notes, searched by a hybrid of term-at-a-time and
document-at-a-time evaluation.

In a block, the short posting lists of a search are summed into one table of accumulators (term at a time). The table then
stands beside the long lists as one more list with a bound, and the lists are walked note by note: lists that together can
not lift a note to the k-th best score so far name no notes themselves, they are only looked into for notes that others name
and that can still get there."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from barloom.llm.benchmark import PARTS
from barloom.llm.bytescan import LOWER, Words, slices
from barloom.session import materialize

SLICE = 4 << 20          # bytes of notes in a block, about; a longer note is a block of its own
SHORT = 16               # a list with at most 1/16 of a block's notes is summed into the accumulators
GROUP_BYTES = 4 << 20    # text of the searches that are broadcast together, about
SCALE = 1_000_000_000    # of a term's saturated frequency
LENGTH_SHARE = 75        # percent of the length in a note's divisor


def note_terms(text: str) -> np.ndarray:
    """Term hashes of a text: runs of ASCII letters and digits and of characters beyond ASCII, only A-Z lower-cased."""
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    return Words(data, np.array([0, len(data)]), PARTS).hash if len(data) else np.zeros(0, np.uint64)


def index_notes(positions: DataFrame, *, key: str = "position_id", note: str = "note") -> DataFrame:
    """Inverted index of all notes, stored in the shared folder: a row per block of notes.

    `keys` and `lengths` (terms) of the block's notes that have a term; `terms`, sorted 64-bit hashes; the postings of term i are
    `notes` and `counts` in [ends[i], ends[i+1]), by rising note; `n_notes` and `n_terms` are the block's totals. Arrays are little-endian
    (hashes of 8 bytes, the rest of 4). The index serves any searches, so texts are read once. Two terms share a hash with a
    chance of about 1e-19 a pair. Null notes and notes without terms are not in the index; an empty table gives no block."""
    given = positions.select(F.col(key).alias("key"), F.col(note).alias("note"))
    out = T.StructType([T.StructField("keys", T.ArrayType(positions.schema[key].dataType)), T.StructField("n_notes", T.LongType()),
                        T.StructField("n_terms", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("lengths", "terms", "ends", "notes", "counts"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in slices(batch.column(1), SLICE):
                words = Words(LOWER[data], bounds, PARTS)
                held = np.flatnonzero(words.per_row)
                if not len(held):
                    continue
                order = np.lexsort((words.row, words.hash))
                term, row = words.hash[order], words.row[order]
                first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (row[1:] != row[:-1])]))
                counts = np.diff(first, append=len(term)).astype("<u4")
                term, row = term[first], np.searchsorted(held, row[first]).astype("<u4")
                names, ends = np.unique(term, return_index=True)
                keys = batch.column(0).slice(lo, hi - lo).take(pa.array(held))
                blobs = (words.per_row[held].astype("<u4"), names.astype("<u8"), np.append(ends, len(term)).astype("<u4"), row, counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), keys), pa.array([len(held)], pa.int64()),
                     pa.array([len(words)], pa.int64()), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], names=out.names)

    return materialize(given.mapInArrow(run, out), "postings")


class Block:
    """The postings of one block that a group of searches needs, with each posting's share of a score."""

    def __init__(self, lengths: bytes, terms: bytes, ends: bytes, notes: bytes, counts: bytes, wanted: np.ndarray, total: int, words: int):
        n = np.frombuffer(lengths, "<u4").astype(np.int64)
        self.size = len(n)
        names, bounds = np.frombuffer(terms, "<u8"), np.frombuffer(ends, "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
        has = names[at] == wanted
        self.begin = np.where(has, bounds[at], 0)
        self.end = np.where(has, bounds[at + 1], 0)
        size = self.end - self.begin
        place = np.repeat(self.begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        self.begin, self.end = np.cumsum(size) - size, np.cumsum(size)
        self.notes = np.frombuffer(notes, "<u4")[place].astype(np.int64)
        tf = np.frombuffer(counts, "<u4")[place].astype(np.int64)
        longer = 100 - LENGTH_SHARE + LENGTH_SHARE * n * total // words
        self.share = SCALE * tf // (1000 * tf + 8 * longer[self.notes])
        self.most = np.zeros(len(wanted), np.int64)
        if len(place):
            self.most[size > 0] = np.maximum.reduceat(self.share, self.begin[size > 0])

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        return self.notes[self.begin[term]:self.end[term]], self.share[self.begin[term]:self.end[term]]

    def search(self, terms: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(notes by rising place, scores) of the notes with a score of `least` (at least 1) or more. `terms` are places in the wanted
        terms, `weights` their weights times their occurrences in the search."""
        size = self.end[terms] - self.begin[terms]
        use = (size > 0) & (weights > 0)
        terms, weights, size = terms[use], weights[use], size[use]
        none = np.zeros(0, np.int64)
        if int((self.most[terms] * weights).sum()) < least:
            return none, none
        short = size * SHORT <= self.size
        lists, bounds = [], []
        if short.any():            # term at a time into the accumulators
            table = np.zeros(self.size, np.int64)
            for t, w in zip(terms[short].tolist(), weights[short].tolist()):
                at, share = self.postings(t)
                table[at] += w * share
            at = np.flatnonzero(table)
            lists.append((at, table[at]))
            bounds.append(int(table.max()))
        for t, w in zip(terms[~short].tolist(), weights[~short].tolist()):
            at, share = self.postings(t)
            lists.append((at, w * share))
            bounds.append(w * int(self.most[t]))
        order = sorted(range(len(lists)), key=bounds.__getitem__)
        below, passive = 0, 0      # lists that cannot reach `least` together
        while passive < len(order) and below + bounds[order[passive]] < least:
            below += bounds[order[passive]]
            passive += 1
        if passive == len(order):
            return none, none
        score = np.zeros(self.size, np.int64)
        for i in order[passive:]:
            at, value = lists[i]
            score[at] += value
        notes = np.flatnonzero(score)
        score = score[notes]
        for i in reversed(order[:passive]):        # the largest bound first; notes that cannot get there are skipped
            able = score + below >= least
            notes, score = notes[able], score[able]
            at, value = lists[i]
            place = np.minimum(np.searchsorted(at, notes), len(at) - 1)
            score = score + np.where(at[place] == notes, value[place], 0)
            below -= bounds[i]
        good = score >= max(1, least)
        return notes[good], score[good]


class _Last:
    """Orders keys with null behind all others; the reverse, for a heap whose top is the worst."""

    def __init__(self, score: int, key: object):
        self.score, self.key = score, key

    def __lt__(self, other: _Last) -> bool:
        if self.score != other.score:
            return self.score < other.score
        if self.key is None or other.key is None:
            return self.key is None and other.key is not None
        return self.key > other.key


def _weights(counts: np.ndarray, total: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * c + 1))) for c in counts.tolist()], np.int64)


def rank_notes(index: DataFrame, searches: DataFrame, k: int = 10, *, key: str = "position_id", item: str = "item_id",
               text: str = "text") -> DataFrame:
    """(item, rank, key, score): the `k` notes with the highest scores above 0 for each search, from rank 1.

    `index` comes from `index_notes`. General on the other side: the library has no table of searches, any (item, text)
    serves. With N notes that have terms, L terms in all, n terms of a note, df notes with a term and tf of its places in the
    note, a term weighs floor(1000 * ln((2N+2) / (2df+1))), and a note's score is the sum over the search's terms, repeats
    included, of weight * (10**9*tf div (1000*tf + 8*(25 + 75*n*N div L))), all in 64-bit integers. Equal scores rank by key, nulls
    last. The sums do not depend on how notes fall into blocks, so the result is that of scoring every note.

    Each row of `searches` is ranked on its own, also where an item repeats; null texts and texts without terms give no rows,
    nor does an empty table on either side. Repeated notes are notes of their own. Other columns are ignored.

    Searches go to all tasks in groups of about GROUP_BYTES of text; the index is read once a group for the frequencies of
    the group's terms and once to search. A task emits its k best of each search."""
    spark = index.sparkSession
    kind, item_kind = index.schema["keys"].dataType.elementType, searches.schema[item].dataType
    out = T.StructType([T.StructField("search", T.LongType()), T.StructField(item, item_kind), T.StructField(key, kind),
                        T.StructField("score", T.LongType())])
    size = index.agg(F.coalesce(F.sum("n_notes"), F.lit(0)).alias("notes"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("terms")).first()
    given = searches.select(F.col(item).alias("item"), F.col(text).alias("text")).filter("text is not null")
    letters = given.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, -(-letters // GROUP_BYTES))
    found, asked = None, 0
    for g in range(groups if size["terms"] else 0):
        some = given.filter(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == g).collect()
        counted = [(r["item"], Counter(note_terms(r["text"]).tolist())) for r in some]
        counted = [c for c in counted if c[1]]
        if not counted:
            continue
        wanted = np.array(sorted(set().union(*(c for _, c in counted))), np.uint64)
        held = _frequencies(index, wanted)
        weight = _weights(held, size["notes"])
        plans = []
        for _, c in counted:
            at = np.searchsorted(wanted, np.array(list(c), np.uint64))
            plans.append((at, weight[at] * np.array(list(c.values()), np.int64)))
        sent = spark.sparkContext.broadcast((wanted, plans, [i for i, _ in counted]))
        part = index.select("keys", "lengths", "terms", "ends", "notes", "counts").mapInArrow(
            _searcher(sent, k, size["notes"], size["terms"], asked, kind, item_kind, out.names), out)
        part, asked = materialize(part, "ranked"), asked + len(counted)
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], T.StructType([T.StructField(item, item_kind), T.StructField("rank", T.IntegerType()),
                                                       T.StructField(key, kind), T.StructField("score", T.LongType())]))
    place = F.row_number().over(W.partitionBy("search").orderBy(F.desc("score"), F.col(key).asc_nulls_last()))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select(item, "rank", key, "score")


def _frequencies(index: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """Notes that hold each of the sorted terms."""
    sent = index.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for terms, ends in zip(batch.column(0), batch.column(1)):
                names, bounds = np.frombuffer(terms.as_py(), "<u8"), np.frombuffer(ends.as_py(), "<u4").astype(np.int64)
                at = np.minimum(np.searchsorted(names, sent.value), len(names) - 1)
                total += np.where(names[at] == sent.value, bounds[at + 1] - bounds[at], 0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "n"])

    rows = index.select("terms", "ends").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(wanted), np.int64)
    out[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
    sent.destroy()
    return out


def _searcher(sent, k: int, total: int, words: int, first: int, kind: T.DataType, item_kind: T.DataType, names: list[str]):
    from pyspark.sql.pandas.types import to_arrow_type
    key_type, item_type = to_arrow_type(kind), to_arrow_type(item_kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, plans, items = sent.value
        best: list[list[_Last]] = [[] for _ in plans]
        for batch in batches:
            for r in range(batch.num_rows):
                block = Block(*(batch.column(c)[r].as_py() for c in range(1, 6)), wanted, total, words)
                keys = batch.column(0)[r].values
                rank = np.empty(len(keys), np.int64)
                rank[pc.sort_indices(keys, null_placement="at_end").to_numpy()] = np.arange(len(keys))
                for s, (terms, weights) in enumerate(plans):
                    heap = best[s]
                    notes, score = block.search(terms, weights, heap[0].score if len(heap) == k else 1)
                    if len(notes) > k:
                        some = np.lexsort((rank[notes], -score))[:k]
                        notes, score = notes[some], score[some]
                    for at, value in zip(notes.tolist(), score.tolist()):
                        entry = _Last(value, keys[at].as_py())
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif heap[0] < entry:
                            heapq.heapreplace(heap, entry)
        rows = [(s, e) for s, heap in enumerate(best) for e in heap]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([first + s for s, _ in rows], pa.int64()), pa.array([items[s] for s, _ in rows], item_type),
                 pa.array([e.key for _, e in rows], key_type), pa.array([e.score for _, e in rows], pa.int64())], names=names)

    return run
