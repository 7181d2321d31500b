"""Quality rules for notes: plain counts, and a hashed n-gram likelihood ratio between trusted and raw text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from barloom.functions.ladder import ladder
from barloom.llm.bytescan import Words, prefix_hash, row_sums, slices, span_hash
from barloom.session import discard, materialize, release

BUCKETS = 1 << 17      # of words, and as many of word pairs
KEY_BITS = 1 << 24     # of the bitmap that leaves out notes without a trusted review
PRIOR = 10.0           # pseudo-counts of the raw multinomial added to both sides of a bucket
MAX_LOSS = 0.003       # share of held-out trusted notes beyond each of the two limits
UNTRUSTED = -1.0       # a word with a ratio below this is untrusted
MIN_WORDS, REPEAT_PERCENT, REPEAT_WORDS = 20, 30, 8
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])


@dataclass(frozen=True)
class QualityModel:
    """Log ratio of every bucket, the smallest mean ratio and the largest share of untrusted words of a note that is kept, and
    the shares of the held-out trusted and of the untrusted reviewed notes that are within both."""

    ratio: np.ndarray
    threshold: float
    limit: float = float("inf")
    trusted_kept: float | None = None
    untrusted_kept: float | None = None


def plain_counts(data: np.ndarray, bounds: np.ndarray, words: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the notes of a slice."""
    rows = len(bounds) - 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = np.bincount(words.row, points[words.end] - points[words.start], rows) if len(words) else np.zeros(rows)
    return {"n_words": words.per_row, "word_chars": chars.astype(np.int64), "n_symbols": row_sums(_SYMBOL[data], bounds),
            "n_dup_lines": _repeated_lines(data, bounds, words), "n_repeat_words": _repeated_words(words, rows)}


def _repeated_lines(data: np.ndarray, bounds: np.ndarray, words: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their note."""
    ends = np.union1d(np.flatnonzero(data == 10), bounds[1:])
    starts = np.concatenate([[0], ends[:-1] + (data[np.minimum(ends[:-1], len(data) - 1)] == 10)]) if len(data) else ends[:0]
    if not len(data):
        return np.zeros(len(bounds) - 1, np.int64)
    full = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    starts, ends = starts[full], ends[full]
    row = np.searchsorted(bounds, starts, "right") - 1
    key = np.stack([row.astype(np.uint64), span_hash(prefix_hash(data), starts, ends), (ends - starts).astype(np.uint64)])
    order = np.lexsort(key)
    same = (key[:, order][:, 1:] == key[:, order][:, :-1]).all(0)
    return np.bincount(row[order[1:]][same], minlength=len(bounds) - 1)


def _repeated_words(words: Words, rows: int) -> np.ndarray:
    """Words inside 8-word windows that stand at least twice in their note."""
    hashes, whole = words.windows(REPEAT_WORDS)
    at = np.flatnonzero(whole)
    keys = hashes[at] ^ (words.row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    same &= words.row[at[order[1:]]] == words.row[at[order[:-1]]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + REPEAT_WORDS + 1, np.int64)
    edge[at[twice]] += 1
    edge[at[twice] + REPEAT_WORDS] -= 1
    covered = np.cumsum(edge)[:len(words)] > 0
    return np.bincount(words.row[covered], minlength=rows)


def ngram_buckets(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words of a slice, buckets of its word pairs, and the rows of the pairs."""
    one = (words.hash % np.uint64(BUCKETS)).astype(np.int64)
    pair, whole = words.windows(2)
    two = (pair[whole] % np.uint64(BUCKETS)).astype(np.int64) + BUCKETS
    return one, two, words.row[:len(whole)][whole]


def mean_ratio(words: Words, rows: int, ratio: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each note per n-gram; 0 for a note without words."""
    one, two, row2 = ngram_buckets(words)
    total = np.bincount(words.row, ratio[one], rows) + np.bincount(row2, ratio[two], rows)
    n = np.bincount(words.row, minlength=rows) + np.bincount(row2, minlength=rows)
    return total / np.maximum(n, 1)


def untrusted_share(words: Words, rows: int, ratio: np.ndarray) -> np.ndarray:
    """Share of the words of each note with a ratio below UNTRUSTED; 0 for a note without words."""
    one = (words.hash % np.uint64(BUCKETS)).astype(np.int64)
    return np.bincount(words.row[ratio[one] < UNTRUSTED], minlength=rows) / np.maximum(words.per_row, 1)


def _roles(labels: DataFrame, key: str, trusted: str, toxic: str) -> DataFrame:
    """All reviewed notes, trusted ones split by a hash of the key: 1 fits the trusted side, 2 (trusted) the
    limits, which 3 (not trusted) checks."""
    one = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key_")).agg(
        F.min(F.coalesce(F.col(trusted), F.lit(0))).alias("good"), F.max(F.coalesce(F.col(toxic), F.lit(0))).alias("bad"))
    good = (F.col("good") == 1) & (F.col("bad") == 0)
    return one.select("key_", F.when(good & (F.xxhash64("key_") % 3 != 0), 1).when(good, 2).otherwise(3).alias("role"))


def _may_hold(notes: DataFrame, keys: DataFrame) -> DataFrame:
    """`notes` (key, text) without most of those whose key is not in `keys` (key_): a bitmap of hashed keys, as large for any table."""
    at = F.pmod(F.xxhash64("key_"), F.lit(KEY_BITS))
    words = (keys.select(at.alias("b")).groupBy(F.expr("b div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits"))
             .toPandas())
    bits = np.zeros(KEY_BITS // 64, np.int64)
    bits[words.w.astype(np.int64)] = words.bits
    known = notes.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column(2).to_numpy().astype(np.uint64)
            good = (known.value[b // np.uint64(64)] >> b % np.uint64(64)) & np.uint64(1)
            yield batch.select([0, 1]).filter(pa.array(good.astype(bool)))
    return notes.select("key", "text", F.pmod(F.xxhash64("key"), F.lit(KEY_BITS)).alias("b")).mapInArrow(run, notes.select("key", "text").schema)


def _notes_of(notes: DataFrame, keys: DataFrame) -> DataFrame:
    """The `notes` whose key is in `keys`. Only texts that may be are dealt by key, by one plan at every size."""
    return _may_hold(notes, keys).join(keys.hint("merge"), F.col("key") == F.col("key_"), "left_semi")


def _nth(d: DataFrame, value: str, k: int) -> float:
    """The k-th smallest value (from 0), exactly: equal values are counted and looked up in their running counts."""
    steps = ladder(d, [], value)
    return steps.filter((F.col("below") <= k) & (F.col("below") + F.col("cnt") > k)).first()[value]


def fit_quality(positions: DataFrame, labels: DataFrame, *, key: str = "position_id", note: str = "note",
                trusted: str = "quality", toxic: str = "toxic") -> QualityModel:
    """Counts the hashed words and word pairs of all notes (raw) and of reviewed trusted notes (target), and sets the threshold.

    The ratio of a bucket is log((t + PRIOR) / (e + PRIOR)): t its target count, e the count that the raw multinomial
    expects. The threshold is the MAX_LOSS quantile of the scores of trusted notes that took no part in the target, and the
    limit leaves out the same share of them by their untrusted words: few bad words in a long note hardly move its mean. Both
    are checked on reviewed notes that are not trusted. All notes and all reviews count. Without reviewed notes all ratios are 0
    and every note passes."""
    spark = positions.sparkSession
    notes, roles = positions.select(F.col(key).alias("key"), F.col(note).alias("text")), _roles(labels, key, trusted, toxic)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, bounds in slices(batch.column(0)):
                one, two, _ = ngram_buckets(Words(data, bounds))
                sums += np.bincount(one, minlength=2 * BUCKETS) + np.bincount(two, minlength=2 * BUCKETS)
        used = np.flatnonzero(sums)
        for at in range(0, len(used), 50_000):
            some = used[at:at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["bucket", "n"])

    def counted(d: DataFrame) -> np.ndarray:
        # one row per bucket: bounded by 2 * BUCKETS whatever the notes are
        rows = d.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
        out = np.zeros(2 * BUCKETS)
        out[rows.bucket] = rows.n
        return out

    raw, target = counted(notes), counted(_notes_of(notes, roles.filter("role = 1").select("key_")))
    ratio = np.zeros(2 * BUCKETS, np.float32)
    for half in (slice(0, BUCKETS), slice(BUCKETS, 2 * BUCKETS)):
        if target[half].sum() and raw[half].sum():
            expected = raw[half] * (target[half].sum() / raw[half].sum())
            ratio[half] = np.log((target[half] + PRIOR) / (expected + PRIOR))
    known = spark.sparkContext.broadcast(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in slices(batch.column(1)):
                words = Words(data, bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(mean_ratio(words, hi - lo, known.value)),
                     pa.array(untrusted_share(words, hi - lo, known.value)), pa.array(words.per_row.astype(np.int64))],
                    names=["key", "score", "share", "n_words"])

    made = T.StructType([notes.schema["key"], *T._parse_datatype_string("score double, share double, n_words long").fields])
    scores = notes.filter("key is not null").mapInArrow(score, made).filter(F.col("n_words") >= MIN_WORDS)
    seen = materialize(scores.join(roles.filter("role > 1"), F.col("key") == F.col("key_")).select("role", "score", "share"), "review-scores")
    trusted = seen.filter("role = 2")
    n = trusted.count()
    lost = int(MAX_LOSS * n)
    threshold = _nth(trusted, "score", lost) if n else float("-inf")
    limit = _nth(trusted, "share", n - 1 - lost) if n else float("inf")
    within = ((F.col("score") >= threshold) & (F.col("share") <= limit)).cast("int")
    kept = seen.agg(*[F.avg(F.when(F.col("role") == k, within)) for k in (2, 3)]).first()
    discard(seen)
    release(spark)      # the driver needs neither plans nor broadcast keys of the fit any more
    return QualityModel(ratio, threshold, limit, *kept)


def judge_notes(positions: DataFrame, model: QualityModel, *, note: str = "note") -> DataFrame:
    """`positions` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept.

    base_failed: under 20 words, or over 30 % of the words in repeated 8-word windows. kept: base rules passed, the mean
    ratio is at or above the threshold and the share of untrusted words is within the limit, so equal notes always get equal verdicts. A null or empty note has no words and
    fails. Result columns replace given ones of the same name; repeated rows are judged one by one."""
    made = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
            "base_failed": "boolean", "score": "double", "kept": "boolean"}
    given = positions.drop(*made)
    text_at = given.columns.index(note)
    out = T.StructType([*given.schema.fields, *(T.StructField(n, T._parse_datatype_string(k)) for n, k in made.items())])
    known, names = positions.sparkSession.sparkContext.broadcast(model), [*given.columns, *made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, threshold, limit = known.value.ratio, known.value.threshold, known.value.limit
        for batch in batches:
            for lo, hi, data, bounds in slices(batch.column(text_at)):
                words = Words(data, bounds)
                c = plain_counts(data, bounds, words)
                failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])
                score = mean_ratio(words, hi - lo, ratio)
                passed = ~failed & (score >= threshold) & (untrusted_share(words, hi - lo, ratio) <= limit)
                cols = [*batch.slice(lo, hi - lo).columns, *(pa.array(v.astype(np.int64)) for v in c.values()), pa.array(failed),
                        pa.array(score), pa.array(passed)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return given.mapInArrow(run, out)
