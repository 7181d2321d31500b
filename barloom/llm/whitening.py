"""Whitened features: exact cross-products from bit-sliced rows, centred as integers before the decomposition.

Features become integers on a grid. A block keeps every feature's bit planes, shifted to start at zero, as bitmaps over its
rows; the cross-product of two features is the weighted sum of the popcounts of their planes' intersections, exact whatever
the order of the rows. The sums of all blocks are added by Spark, so the covariance has no rounding before its last division."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from barloom.llm.nearest import _blocks, _matrix, usable

LIMIT = 1 << 40          # integers beyond are clipped, so that sums over 10**13 rows have 38 digits at most
BLOCK = 1 << 16          # rows of a block of bitmaps
PART = 2048              # rows that are projected together
FLAT = 1e-10             # share of the largest eigenvalue from which a component counts as having variance


def scatter(rows: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Exact sums and cross-products of integer rows: ANDs and popcounts of bit planes, in Python's integers."""
    n, dims = rows.shape
    low = rows.min(0)
    shifted = rows - low
    sums = [int(s) for s in shifted.sum(0)]
    bits = int(shifted.max(initial=0)).bit_length()
    words = -(-n // 64)
    planes = np.zeros((bits, dims, words * 8), np.uint8)
    for i in range(bits):
        part = np.packbits(((shifted >> i) & 1).T.astype(np.uint8), axis=1, bitorder="little")
        planes[i, :, :part.shape[1]] = part
    cells = planes.view(np.uint64)
    product = [[0] * dims for _ in range(dims)]
    for d in range(dims):
        # counts[i, j, e]: rows with bit i of feature d and bit j of feature e, for e from d on
        counts = np.zeros((bits, bits, dims - d), np.int64)
        for i in range(bits):
            both = cells[i, d] & cells[:, d:]
            counts[i] = np.bitwise_count(both).sum(2, dtype=np.int64)
        for e in range(d, dims):
            u = sum(int(counts[i, j, e - d]) << (i + j) for i in range(bits) for j in range(bits))
            m, o = int(low[d]), int(low[e])
            product[d][e] = product[e][d] = u + m * sums[e] + o * sums[d] + n * m * o
    return [s + n * int(m) for s, m in zip(sums, low)], product


def _exact(values) -> pa.Array:
    return pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))


def feature_scatter(grid: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """Number, sums and cross-products of all integer rows in the array column `y`; what reaches the driver is one number for
    each pair of features. A feature that a row has not counts as 0."""
    out = T.StructType([T.StructField("d", T.IntegerType()), T.StructField("e", T.IntegerType()), T.StructField("v", T.DecimalType(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, product = 0, [], []
        for block in _blocks(batches, BLOCK):
            rows = _matrix(block.column(0))
            if not rows.shape[1]:
                n += len(rows)
                continue
            s, p = scatter(rows)
            n, more = n + len(rows), len(s) - len(sums)
            if more > 0:
                sums += [0] * more
                product = [r + [0] * more for r in product] + [[0] * len(s) for _ in range(more)]
            for d in range(len(s)):
                sums[d] += s[d]
                for e in range(len(s)):
                    product[d][e] += p[d][e]
        if n:
            dims = len(sums)
            pairs = [(d, e) for d in range(dims) for e in range(d, dims)]
            rows = [(-1, -1, n), *((-1, d, v) for d, v in enumerate(sums)), *((d, e, product[d][e]) for d, e in pairs)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                              _exact(r[2] for r in rows)], names=out.names)

    found = {(r["d"], r["e"]): int(r["v"]) for r in
             grid.select("y").mapInArrow(run, out).groupBy("d", "e").agg(F.sum("v").alias("v")).toLocalIterator()}
    dims = max((e for d, e in found if d == -1), default=-1) + 1
    return (found.get((-1, -1), 0), [found[-1, d] for d in range(dims)],
            [[found.get((min(d, e), max(d, e)), 0) for e in range(dims)] for d in range(dims)])


def decompose(n: int, sums: list[int], product: list[list[int]], components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit eigenvectors (columns) by falling eigenvalue, the eigenvalues, and their shares of the trace. The scatter is
    centred in integers, n * product - sum * sum, and divided once. Directions without variance are left out."""
    v = np.array([[(n * p - a * b) / (n * n) for p, b in zip(row, sums)] for row, a in zip(product, sums)])
    e, u = np.linalg.eigh(v)
    keep = np.argsort(-e, kind="stable")[:components]
    keep = keep[(e[keep] > FLAT * e.max()) & (e[keep] > 0)]
    return u[:, keep], e[keep], e[keep] / np.trace(v)


def _deviations(y: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over features of (n * y - sum)**2, exact."""
    most = max((n * int(np.abs(y).max(initial=0)) + abs(s) for s in sums), default=0)
    if most * most * max(1, len(sums)) < 1 << 63:
        off = n * y - np.array(sums, np.int64)
        return pa.array((off * off).sum(1)).cast(pa.decimal128(38, 0))
    return _exact(sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in y.tolist())


def _projected(y: np.ndarray, n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray) -> np.ndarray:
    mean, rest = np.array([s // n for s in sums], np.int64), np.array([s % n / n for s in sums])
    return ((y - mean) - rest) @ vectors / np.sqrt(values)


def _fitted(rows: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, dims - rows.shape[1])))


def whiten_features(exposures: DataFrame, components: int = 32, *, ticker: str = "ticker", features: str = "features",
                    grid: int = 64) -> DataFrame:
    """(ticker, component, n, deviation, whitened, explained, identity_error) of every feature row and component.

    `exposures` has a row per ticker of a session (or per ticker and session) with its features as one array, for example
    `F.array(*FEATURES)` of the feature frame. Features become integers y = floor(grid * value); all rows are the fit.
    Components are the unit eigenvectors of the covariance of y (divisor n), numbered from 1 by falling eigenvalue e:
    `whitened` is the row's distance from the mean along the component over sqrt(e), `explained` is e over the trace,
    `deviation` the exact sum over features of (n*y - sum of y)**2, and `identity_error` how far the covariance of all whitened
    rows is from the identity, at most (one value). Adding a constant to y changes none of these.

    Rows whose array is null or holds null or non-finite values are dropped; shorter arrays count as filled up with zeros;
    integers beyond 2**40 are clipped to it. Directions without variance (below FLAT of the largest eigenvalue) are no
    components, so equal rows alone, and an empty table, give no rows. Repeated rows and null tickers stay. Other columns are
    ignored, whatever their names. `deviation` is a decimal of 38 digits.

    Three scans of one column and no shuffle but that of the sums; the driver gets one number for each pair of features."""
    spark, kind = exposures.sparkSession, exposures.schema[ticker].dataType
    value = F.col(features).cast("array<double>")
    whole = F.transform(value, lambda v: F.floor(F.greatest(F.least(v * grid, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))))
    rows = exposures.filter(usable(value)).select(whole.alias("y"), F.col(ticker).alias(ticker))
    n, sums, product = feature_scatter(rows)
    out = T.StructType([T.StructField(ticker, kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
                        T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.DoubleType()),
                        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    vectors, values, shares = decompose(n, sums, product, components) if n and sums else ([], [], [])
    if not len(values):
        return spark.createDataFrame([], out)
    dims, count = vectors.shape

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(count), np.zeros((count, count))
        for batch in batches:
            for lo in range(0, batch.num_rows, PART):
                w = _projected(_fitted(_matrix(batch.column(0).slice(lo, PART)), dims), n, sums, vectors, values)
                total, square = total + w.sum(0), square + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(-1, count), count), pa.int32()),
                                          pa.array(np.tile(np.arange(count), count + 1), pa.int32()),
                                          pa.array(np.concatenate([total, square.ravel()]))], names=["d", "e", "v"])

    made = {(r["d"], r["e"]): r["v"] for r in rows.select("y").mapInArrow(products, "d int, e int, v double")
            .groupBy("d", "e").agg(F.sum("v").alias("v")).toLocalIterator()}
    mean = np.array([made[-1, e] for e in range(count)]) / n
    cover = np.array([[made[d, e] for e in range(count)] for d in range(count)]) / n - np.outer(mean, mean)
    error = float(np.abs(cover - np.eye(count)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PART):
                y = _fitted(_matrix(batch.column(0).slice(lo, PART)), dims)
                of = pa.array(np.repeat(np.arange(len(y)), count))
                number = np.tile(np.arange(count), len(y))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(lo, PART).take(of), pa.array((number + 1).astype(np.int32)), pa.array(np.full(len(number), n, np.int64)),
                     _deviations(y, n, sums).take(of), pa.array(_projected(y, n, sums, vectors, values).ravel()),
                     pa.array(shares[number]), pa.array(np.full(len(number), error))], names=out.names)

    return rows.mapInArrow(run, out)
