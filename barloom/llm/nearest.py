"""The feature rows most like a given one: exact top-k inner products from a bit-sliced index.

A block of rows is kept as bit planes: bit i of a feature, for all rows of the block, is one bitmap. The score of a question
is a sum of bitmaps with weights, added by carry-save adders; the k best sums are found from the top plane down. Only the top
planes of the features are added, so a sum is known up to a bound; the rows within the bound of the k-th best are the boundary
rows, and these are resolved exactly from the stored integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from barloom.session import discard, materialize

LIMIT = 1 << 26         # integers beyond are clipped, so that sums of 2,000 products fit 64 bits
BLOCK = 8192            # rows whose bitmaps are searched together
PLANES = 5              # top planes of the features that are added
TOGETHER = 8            # questions that go through the adders together
TASK_ROWS = 1 << 16     # rows of a task, about
GROUP_BYTES = 16 << 20  # integers of the questions that are broadcast together, about


def signed_digits(q: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(a, digits in {-1, 0, 1}) with q = sum of digits * 2**a and no two digits in a row: few bitmaps are added."""
    rest, a = q.copy(), 0
    while rest.any():
        digit = np.where(rest & 1, 2 - (rest & 3), 0)
        yield a, digit
        rest = (rest - digit) >> 1
        a += 1


class BitSlices:
    """Bit planes of a block of integer rows."""

    def __init__(self, rows: np.ndarray, planes: int = PLANES):
        self.n, self.dims = rows.shape
        self.low = rows.min(0) if self.n else np.zeros(self.dims, np.int64)
        shifted = rows - self.low
        bits = int(shifted.max(initial=0)).bit_length()
        self.cut = max(0, bits - planes)            # low planes that are not added
        self.planes = bits - self.cut
        words = -(-self.n // 64)
        top = (shifted >> self.cut).T
        made = np.zeros((2, self.planes, self.dims, words * 64), np.uint8)
        for i in range(self.planes):
            made[0, i, :, :self.n] = (top >> i) & 1
        made[1] = 1 - made[0]
        self.valid = np.packbits(np.arange(words * 64) < self.n, bitorder="little").view(np.uint64)
        # plane i of feature d at i * dims + d, its complement behind all planes, an empty bitmap last
        flat = np.packbits(made.reshape(-1, words * 64), axis=1, bitorder="little").view(np.uint64)
        self.flat = np.concatenate([flat, np.zeros((1, words), np.uint64)])

    def sums(self, questions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Planes (level, question, words) of non-negative sums, and what to add to each question's sums: together they are
        the inner products with the rows without their low planes."""
        empty, other = len(self.flat) - 1, self.planes * self.dims
        count, most = len(questions), (1 << self.planes) - 1
        wanted: dict[int, list[np.ndarray]] = {}
        add = np.zeros(count, np.int64)
        feature = np.arange(self.dims)
        for a, digit in signed_digits(questions):
            add -= (digit < 0).sum(1) * (most << a)       # -u is its complement less the largest u
            for i in range(self.planes):
                at = np.where(digit == 0, empty, np.where(digit > 0, 0, other) + i * self.dims + feature)
                wanted.setdefault(i + a, []).append(at)
        out, carried, level = [], [], 0
        while level <= max(wanted, default=-1) or carried:
            at = np.concatenate(wanted[level], axis=1) if level in wanted else np.zeros((count, 0), np.int64)
            at = np.sort(at, axis=1)                       # the empty bitmaps go last, and those of all questions are left out
            at = at[:, :int((at < empty).sum(1).max(initial=0))]
            stack = np.concatenate([self.flat[at.T], *carried]) if carried else self.flat[at.T]
            carried = []
            while len(stack) > 2:
                k = len(stack) // 3
                a, b, c = stack[:k], stack[k:2 * k], stack[2 * k:3 * k]
                half = a ^ b
                carried.append((a & b) | (half & c))
                stack = np.concatenate([half ^ c, stack[3 * k:]])
            if len(stack) == 2:
                carried.append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
            out.append(stack[0] if len(stack) else np.zeros((count, len(self.valid)), np.uint64))
            level += 1
        return np.array(out).reshape(len(out), count, len(self.valid)), add

    def kth_largest(self, sums: np.ndarray, k: int) -> np.ndarray:
        """The k-th largest sum of each question, found from the top plane down."""
        left = np.broadcast_to(self.valid, sums.shape[1:])
        need, value = np.full(sums.shape[1], k), np.zeros(sums.shape[1], np.int64)
        for level in range(len(sums) - 1, -1, -1):
            ones = left & sums[level]
            held = np.bitwise_count(ones).sum(1, dtype=np.int64)
            up = held >= need
            left = np.where(up[:, None], ones, left & ~sums[level])
            need = np.where(up, need, need - held)
            value += up.astype(np.int64) << level
        return value

    def at_least(self, sums: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Whether each row's sum reaches its question's bound: (question, row)."""
        over, same = np.zeros(sums.shape[1:], np.uint64), np.broadcast_to(self.valid, sums.shape[1:])
        held = np.clip(bound, 0, (1 << len(sums)) - 1)
        for level in range(len(sums) - 1, -1, -1):
            wants = ((held >> level) & 1).astype(bool)[:, None]
            over = np.where(wants, over, over | (same & sums[level]))
            same = same & np.where(wants, sums[level], ~sums[level])
        found = np.where((bound >= 1 << len(sums))[:, None], np.uint64(0), over | same)
        return np.unpackbits(found.view(np.uint8), axis=1, count=self.n, bitorder="little").view(bool)


class Best:
    """The k best (score, row) of each question that a task has seen."""

    def __init__(self, questions: np.ndarray, rows: np.ndarray, k: int):
        self.questions, self.own, self.k = questions, rows, k
        self.score = np.zeros((len(questions), k), np.int64)
        self.row = np.zeros((len(questions), k), np.int64)
        self.held = np.zeros(len(questions), np.int64)

    def search(self, rows: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(question, places in `rows`, scores) of the rows that are among the question's best so far. `numbers` rise with the
        order in which equal scores rank."""
        dims = self.questions.shape[1]
        rows = np.pad(rows[:, :dims], ((0, 0), (0, max(0, dims - rows.shape[1]))))
        index = BitSlices(rows)
        reach = int(np.abs(rows).max(initial=0)) * int(np.abs(self.questions).max(initial=0)) * dims
        kind = np.float64 if reach < 1 << 53 else np.int64       # exact in either
        exact, asked = rows.astype(kind), self.questions.astype(kind)
        for lo in range(0, len(self.questions), TOGETHER):
            q = self.questions[lo:lo + TOGETHER]
            sums, add = index.sums(q)
            unknown = (1 << index.cut) - 1
            slack = unknown * np.abs(q).sum(1) >> index.cut
            bound = index.kth_largest(sums, min(self.k + 1, index.n)) - slack       # one more: the question's own row
            full = self.held[lo:lo + TOGETHER] == self.k
            known = q @ index.low + (add << index.cut) + unknown * np.maximum(q, 0).sum(1)
            behind = -((known - self.score[lo:lo + TOGETHER, -1]) >> index.cut)
            found = index.at_least(sums, np.where(full, np.maximum(bound, behind), bound))
            for j in range(len(q)):
                at = np.flatnonzero(found[j])
                at = at[numbers[at] != self.own[lo + j]]
                if len(at):
                    yield from self._take(lo + j, at, (exact[at] @ asked[lo + j]).astype(np.int64), numbers)

    def _take(self, question: int, at: np.ndarray, score: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        held = int(self.held[question])
        scores = np.concatenate([self.score[question, :held], score])
        order = np.lexsort((np.concatenate([self.row[question, :held], numbers[at]]), -scores))[:self.k]
        fresh = order[order >= held] - held
        if len(fresh):
            rows = np.concatenate([self.row[question, :held], numbers[at]])
            self.held[question] = len(order)
            self.score[question, :len(order)], self.row[question, :len(order)] = scores[order], rows[order]
            yield question, at[fresh], score[fresh]


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column, the shorter ones padded with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    bounds = lists.offsets.to_numpy()
    size, values = np.diff(bounds), lists.values.to_numpy()[bounds[0]:bounds[-1]]
    out = np.zeros((len(lists), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = values
    return out


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of many small batches in blocks of `size`."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= size:
            table = pa.Table.from_batches(held)
            for lo in range(0, rows - size + 1, size):
                yield table.slice(lo, size)
            table = table.slice(rows // size * size)
            held, rows = table.to_batches(), table.num_rows
    if rows:
        yield pa.Table.from_batches(held)


def usable(features: Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite entries."""
    return features.isNotNull() & ~F.exists(features, lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(True)))


def similar_tickers(exposures: DataFrame, asked: Column, k: int = 5, *, ticker: str = "ticker", features: str = "features",
                    scale: int = 256) -> DataFrame:
    """(ticker, rank, match, score): for every feature row that `asked` picks, the `k` other rows of `exposures` with the
    highest inner products, from rank 1.

    `exposures` has a row per ticker of a session (or per ticker and session) with its features as one array, for example
    `F.array(*FEATURES)` of the feature frame. Features become integers, floor(scale * value), and `score` is the exact integer
    product. Equal scores rank by `ticker`, nulls last. Every row but the asking one may match, equal rows too, so a ticker
    that stands on several rows can match itself; each asking row has ranks of its own.

    Rows whose array is null or holds null or non-finite values take no part; shorter arrays count as filled up with zeros;
    integers beyond 2**26 are clipped to it. Fewer than k other rows give fewer ranks, an empty table gives none. Other
    columns are ignored, whatever their names.

    Rows are sorted by ticker and stored once; tasks turn them into bit slices block by block. The asking rows go to all
    tasks in groups of about GROUP_BYTES; a task emits only rows that are among its k best so far, which are merged by group."""
    spark, kind = exposures.sparkSession, exposures.schema[ticker].dataType
    value = F.col(features).cast("array<double>")
    whole = F.transform(value, lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))))
    given = exposures.filter(usable(value)).select(F.col(ticker).alias("key"), F.coalesce(asked, F.lit(False)).alias("asks"), whole.alias("x"))
    total = given.count()
    tasks = max(-(-total // TASK_ROWS), min(-(-total // BLOCK), 4 * spark.sparkContext.defaultParallelism), 1)
    order = [F.col("key").asc_nulls_last(), F.xxhash64("x"), F.col("asks")]       # a key with many rows is spread
    rows = materialize(given.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
                       .select(F.monotonically_increasing_id().alias("row"), "key", "asks", "x"), "features")
    asking = rows.filter("asks")
    size = asking.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("x")), F.lit(0)).alias("values")).first()
    groups = max(1, -(-size["values"] * 8 // GROUP_BYTES))
    out = T.StructType([T.StructField("asking", T.LongType()), T.StructField(ticker, kind), T.StructField("row", T.LongType()),
                        T.StructField("match", kind), T.StructField("score", T.LongType())])
    made = []
    for g in range(groups if size["n"] else 0):
        some = asking.filter(F.pmod(F.xxhash64("row"), F.lit(groups)) == g).select("row", "key", "x").toArrow()
        if not some.num_rows:
            continue
        sent = spark.sparkContext.broadcast((some.column("row").to_numpy(), some.column("key").combine_chunks(), _matrix(some.column("x"))))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            numbers, keys, questions = sent.value
            best = Best(questions, numbers, k)
            for block in _blocks(batches, BLOCK):
                rows_, names = block.column("row").to_numpy(), block.column("key").combine_chunks()
                hits = list(best.search(_matrix(block.column("x")), rows_))
                if hits:
                    who = np.repeat([h[0] for h in hits], [len(h[1]) for h in hits])
                    at = np.concatenate([h[1] for h in hits])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(numbers[who]), keys.take(pa.array(who)), pa.array(rows_[at]), names.take(pa.array(at)),
                         pa.array(np.concatenate([h[2] for h in hits]))], names=out.names)

        made.append(materialize(rows.select("row", "key", "x").mapInArrow(run, out), "best"))
        sent.destroy()
    if not made:
        discard(rows)
        return spark.createDataFrame([], T.StructType([T.StructField(ticker, kind), T.StructField("rank", T.IntegerType()),
                                                       T.StructField("match", kind), T.StructField("score", T.LongType())]))
    found = made[0]
    for more in made[1:]:
        found = found.unionByName(more)
    place = F.row_number().over(W.partitionBy("asking").orderBy(F.desc("score"), "row"))
    discard(rows)
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select(ticker, "rank", "match", "score")
