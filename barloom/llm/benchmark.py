"""Benchmark items found in notes: a BM25 index of the items with block maxima, queried by every passage."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from barloom.llm.bytescan import LOWER, Words, slices
from barloom.session import materialize

K1, B = 1.2, 0.75
RETRIEVE = 0.5        # share of an item's own BM25 score that a passage must reach
QUESTION, ANSWER = 0.8, 0.5   # shares of the five-word shingles of both parts that must stand in the passage
SHINGLE = 5
BLOCK = 16            # items of a posting block
LEAST_STRIDE = 32
#: Every ASCII byte but letters and digits parts words, so that punctuation does not matter.
PARTS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item: the answer is the last sentence, or the last quarter of the words of a single one."""
    cut = [m.end() for m in re.finditer(r"[.?!:]\s+(?=\S)", text)]
    if cut:
        return text[:cut[-1]], text[cut[-1]:]
    words = text.split(" ")
    n = len(words) - max(1, len(words) // 4)
    return (" ".join(words[:n]), " ".join(words[n:])) if n > 0 else (text, "")


def _terms(text: str) -> np.ndarray:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    return Words(data, np.array([0, len(data)]), PARTS).hash if len(data) else np.zeros(0, np.uint64)


def _shingles(terms: np.ndarray) -> np.ndarray:
    """Distinct hashes of runs of SHINGLE words; of fewer words, of the whole."""
    n = min(SHINGLE, len(terms))
    if not n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(terms) - n + 1, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + terms[j:j + len(out)]
    return np.unique(out)


@dataclass(frozen=True)
class ItemIndex:
    """Inverted index: sorted `terms`; postings (item, weight) of term i in [ends[i], ends[i + 1]); the same per block of items;
    `most`: the largest weight of each term. A weight is the term's BM25 share of the item's own score, so the weights of an
    item sum to 1 and one threshold serves all items."""

    ids: list
    terms: np.ndarray
    ends: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    block_ends: np.ndarray
    block: np.ndarray
    block_weight: np.ndarray
    most: np.ndarray
    stride: int
    parts: list          # (question terms, answer terms, shortest shingle) per item


@dataclass
class ItemCounts:
    """What weights and passages depend on, over all items: items and words, the longest item, and items holding a term."""
    items: int
    words: int
    longest: int
    held: dict[int, int]


def count_items(items: list[tuple[object, str]]) -> ItemCounts:
    """The counts of items that are all at hand."""
    found = [w for w in (_terms(t) for _, t in items if t) if len(w)]
    return ItemCounts(len(found), sum(map(len, found)), max(map(len, found), default=0), Counter(t for w in found for t in np.unique(w).tolist()))


def index_items(items: list[tuple[object, str]], counts: ItemCounts | None = None) -> ItemIndex:
    """Index of (id, text), weighted by the `counts` of all items (of these if left out); items without words are left out."""
    kept = [(i, t, _terms(t)) for i, t in items if t]
    kept = [(i, t, w) for i, t, w in kept if len(w)]
    counts_ = counts or count_items(items)
    held, n, mean = counts_.held, counts_.items, counts_.words / max(1, counts_.items)
    found: list[tuple[int, int, float]] = []
    for i, (_, _, words) in enumerate(kept):
        terms, counts = np.unique(words, return_counts=True)
        idf = np.array([math.log(1 + (n - held[t] + 0.5) / (held[t] + 0.5)) for t in terms.tolist()])
        own = idf * counts * (K1 + 1) / (counts + K1 * (1 - B + B * len(words) / mean))
        found += zip(terms.tolist(), [i] * len(terms), (own / own.sum()).tolist())
    found.sort()
    names = np.array([f[0] for f in found], np.uint64)
    item, weight = np.array([f[1] for f in found], np.int64), np.array([f[2] for f in found])
    terms, first = np.unique(names, return_index=True)
    ends = np.append(first, len(names))
    pair = np.repeat(np.arange(len(terms)), np.diff(ends)) * (len(kept) // BLOCK + 1) + item // BLOCK
    blocks, at = np.unique(pair, return_index=True)
    top = np.maximum.reduceat(weight, at) if len(at) else weight
    block_term = blocks // (len(kept) // BLOCK + 1)
    parts = []
    for _, text, _ in kept:
        q, a = split_item(text)
        parts.append((_shingles(_terms(q)), min(SHINGLE, len(_terms(q))), _shingles(_terms(a)), min(SHINGLE, len(_terms(a)))))
    return ItemIndex([i for i, _, _ in kept], terms, ends, item, weight, np.searchsorted(block_term, np.arange(len(terms) + 1)),
                     blocks % (len(kept) // BLOCK + 1), top, np.maximum.reduceat(weight, first) if len(first) else weight,
                     max(LEAST_STRIDE, counts_.longest), parts)


def _expand(ends: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all postings of `terms`, and which of them each belongs to."""
    n = ends[terms + 1] - ends[terms]
    of = np.repeat(np.arange(len(terms)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[terms], n), of


def passages(words: Words, stride: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, word after the last, and row of passages of two strides; a row's last words are in its last passage."""
    first = np.concatenate([[0], np.cumsum(words.per_row)])
    n = np.maximum(1, -(-words.per_row // stride) - 1) * (words.per_row > 0)
    row = np.repeat(np.arange(rows), n)
    start = first[row] + stride * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
    return start, np.minimum(start + 2 * stride, first[row + 1]), row


def search(words: Words, rows: int, index: ItemIndex) -> list[tuple[int, int, int, float]]:
    """(row, first word of the passage, item, score) of all passages and items with a score of RETRIEVE or more.

    The weak-and test runs for many passages at once: a passage whose terms' maxima do not sum to the threshold is dropped,
    of the others only blocks whose maxima reach it are opened, and their items are scored in full."""
    start, end, row = passages(words, index.stride, rows)
    if not len(start) or not len(index.terms):
        return []
    at = np.minimum(np.searchsorted(index.terms, words.hash), len(index.terms) - 1)
    known = index.terms[at] == words.hash
    upto = np.concatenate([[0], np.cumsum(known)])
    place, term = np.flatnonzero(known), at[known]
    n = upto[end] - upto[start]
    passage = np.repeat(np.arange(len(start)), n)
    mine = term[np.arange(len(passage)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(upto[start], n)]
    pairs = np.unique(passage * len(index.terms) + mine)          # a term counts once in a passage
    passage, mine = pairs // len(index.terms), pairs % len(index.terms)
    able = np.bincount(passage, index.most[mine], len(start)) >= RETRIEVE - 1e-9
    keep = able[passage]
    passage, mine = passage[keep], mine[keep]
    if not len(passage):
        return []
    blocks = len(index.ids) // BLOCK + 1
    posting, of = _expand(index.block_ends, mine)
    key, inverse = np.unique(passage[of] * blocks + index.block[posting], return_inverse=True)
    open_ = key[np.bincount(inverse, index.block_weight[posting]) >= RETRIEVE - 1e-9]
    if not len(open_):
        return []
    keep = np.isin(passage, open_ // blocks)
    passage, mine = passage[keep], mine[keep]
    posting, of = _expand(index.ends, mine)
    keep = np.isin(passage[of] * blocks + index.item[posting] // BLOCK, open_)
    posting, of = posting[keep], of[keep]
    key, inverse = np.unique(passage[of] * len(index.ids) + index.item[posting], return_inverse=True)
    score = np.bincount(inverse, index.weight[posting])
    good = score >= RETRIEVE - 1e-9
    p, item = key[good] // len(index.ids), key[good] % len(index.ids)
    return list(zip(row[p].tolist(), start[p].tolist(), end[p].tolist(), item.tolist(), score[good].tolist()))


def _share(terms: np.ndarray, wanted: np.ndarray, n: int) -> float:
    """Share of the `wanted` shingles of n words that stand in the passage; 1 if there are none."""
    if not len(wanted):
        return 1.0
    k = len(terms) - n + 1
    if k <= 0:
        return 0.0
    out = np.zeros(k, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + terms[j:j + k]
    return float(np.isin(wanted, out).mean())


def _leaks(column: pa.Array, index: ItemIndex) -> Iterator[tuple[int, int, dict[tuple[int, int], tuple]]]:
    """Per slice of a text column: first row, row after the last, and the verified hits: (row, item) to (passage's first word in
    the note, score, question share, answer share), the best passage of each."""
    for lo, hi, data, bounds in slices(column):
        words = Words(LOWER[data], bounds, PARTS)
        first = np.concatenate([[0], np.cumsum(words.per_row)])
        best: dict[tuple[int, int], tuple] = {}
        for row, start, end, item, score in search(words, hi - lo, index):
            q, qn, a, an = index.parts[item]
            terms = words.hash[start:end]
            found = (_share(terms, q, qn), _share(terms, a, an))
            if found[0] >= QUESTION and found[1] >= ANSWER:
                entry = (score, *found, -(start - int(first[row])))
                best[row, item] = max(entry, best.get((row, item), entry))
        yield lo, hi, best


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each item its distinct terms, and a row without a term that holds the number of its words."""
    for batch in batches:
        terms, words = [], []
        for text in batch.column(0).to_pylist():
            found = _terms(text) if text else ()
            if len(found):
                own = np.unique(found).view(np.int64).tolist()
                terms += [None, *own]
                words += [len(found), *[0] * len(own)]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(words, pa.int64())], names=["term", "words"])


def _indexes(benchmark: DataFrame, item: str, text: str, block: int) -> Iterator:
    """Broadcast indexes of about `block` items each. Counts are taken over all items first, so the blocks bound memory and
    change nothing that is found."""
    spark = benchmark.sparkSession
    given = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).filter("text is not null")
    terms = lambda d: d.select("text").mapInArrow(_item_terms, "term long, words long")
    head = terms(given).filter("term is null").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"), F.max("words").alias("most")).first()
    blocks = max(1, -(-head["n"] // block))
    held = terms(given).filter("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    if blocks > 1:
        held = materialize(held, "item-terms")
    for b in range(blocks):
        some = given.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        mine = held if blocks == 1 else held.join(terms(some).select("term").distinct(), "term", "left_semi")
        counts = ItemCounts(head["n"], head["words"] or 0, head["most"] or 0, {r["term"] % (1 << 64): r["n"] for r in mine.collect()})
        yield spark.sparkContext.broadcast(index_items(sorted(((r["item"], r["text"]) for r in some.collect()), key=repr), counts))


def find_leaks(positions: DataFrame, benchmark: DataFrame, *, key: str = "position_id", note: str = "note",
               item: str = "item_id", text: str = "text", block: int = 20_000) -> DataFrame:
    """(key, item, passage, score, question_overlap, answer_overlap) of every note and item that it leaks.

    General: the library has no test items of its own; any table of (item, text) serves. A note is cut into passages of
    twice the longest item (with steps of one), so every copy of an item lies whole in one. Passages that reach RETRIEVE of
    an item's own BM25 score are retrieved, all of them, and verified: QUESTION of the five-word shingles of its question
    and ANSWER of those of its answer must stand in the passage. `passage` is the first word of the best passage.

    Term weights, mean length and passages come from counts over all items; the items are then searched in blocks of about
    `block`, which bound what is broadcast: whatever the block, the result is the same.

    Words are runs of ASCII letters and digits and bytes beyond ASCII, lower-cased. Null and empty notes or items match
    nothing; repeated rows give repeated results; an empty table on either side gives no rows; other columns are ignored."""
    kind, item_kind = positions.schema[key].dataType, benchmark.schema[item].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField(item, item_kind), T.StructField("passage", T.LongType()),
                        T.StructField("score", T.DoubleType()), T.StructField("question_overlap", T.DoubleType()),
                        T.StructField("answer_overlap", T.DoubleType())])
    given = positions.select(F.col(key).alias("key"), F.col(note).alias("note"))
    result = None
    for index in _indexes(benchmark, item, text, block):
        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, _, best in _leaks(batch.column(1), index.value):
                    hits = sorted(best.items())
                    if hits:
                        rows = [h[0][0] + lo for h in hits]
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(rows)), _like(item_kind, [index.value.ids[h[0][1]] for h in hits]),
                             pa.array([-h[1][3] for h in hits], pa.int64()), *(pa.array([h[1][j] for h in hits], pa.float64()) for j in range(3))],
                            names=out.names)
        part = given.mapInArrow(run, out)
        result = part if result is None else result.unionByName(part)
    return result


def _like(kind: T.DataType, values: list) -> pa.Array:
    from pyspark.sql.pandas.types import to_arrow_type
    return pa.array(values, to_arrow_type(kind))


def drop_leaks(positions: DataFrame, benchmark: DataFrame, *, note: str = "note", item: str = "item_id",
               text: str = "text", block: int = 20_000) -> DataFrame:
    """The notes that leak no item by the rules of `find_leaks`, with all their columns, in one pass without a shuffle."""
    at = positions.columns.index(note)
    for index in _indexes(benchmark, item, text, block):
        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, best in _leaks(batch.column(at), index.value):
                    clean = np.ones(hi - lo, bool)
                    clean[[row for row, _ in best]] = False
                    yield batch.slice(lo, hi - lo).filter(pa.array(clean))
        positions = positions.mapInArrow(run, positions.schema)
    return positions
