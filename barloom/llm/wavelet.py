"""Token ids of notes as one wavelet matrix per shard."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.taskcontext import TaskContext

from barloom.llm.bytescan import slices
from barloom.llm.tokens import SLICE, tokenizer_of

BITS = 16                  # ids are below 65536
BLOCK = 512                # bits between two entries of a rank directory
_MAGIC = b"BLWM"
_COUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def build(ids: np.ndarray) -> bytes:
    """A wavelet matrix of `ids`: per bit, highest first, the ids' bits as a plane, then the ids are parted stably by that
    bit. Layout: magic, count, zeros and byte length of each plane, rank directories, planes (each zstd-compressed)."""
    now, zeros, planes, ranks = np.ascontiguousarray(ids, np.uint16), [], [], []
    squeeze = zstandard.ZstdCompressor(level=1)
    for bit in range(BITS - 1, -1, -1):
        ones = (now & np.uint16(1 << bit)) != 0
        packed = np.packbits(ones)
        low = now[~ones]
        zeros.append(len(low))
        now = np.concatenate([low, now[ones]])
        planes.append(squeeze.compress(packed.tobytes()))
        ranks.append(_directory(packed))
    listed = squeeze.compress(np.concatenate(ranks).astype("<u4").tobytes())
    sizes = [len(p) for p in planes]
    return b"".join([_MAGIC, struct.pack(f"<{2 + 2 * BITS}q", len(ids), len(listed), *zeros, *sizes), listed, *planes])


def _directory(packed: np.ndarray) -> np.ndarray:
    """Ones before each block of a plane."""
    step = BLOCK // 8
    full = np.zeros(-(-max(len(packed), 1) // step) * step, np.uint8)
    full[:len(packed)] = packed
    return np.concatenate([[0], np.cumsum(_COUNT[full].reshape(-1, step).sum(1, dtype=np.int64))])


class WaveletMatrix:
    """Reads what `build` made: `access`, `count`, `rank`, `select` and whole decoding."""

    def __init__(self, blob: bytes):
        if blob[:4] != _MAGIC:
            raise ValueError("not a wavelet matrix")
        head = struct.unpack_from(f"<{2 + 2 * BITS}q", blob, 4)
        self.n, listed, self.zeros, sizes = head[0], head[1], head[2:2 + BITS], head[2 + BITS:]
        at = 4 + 8 * (2 + 2 * BITS)
        expand = zstandard.ZstdDecompressor()
        self.ranks = np.frombuffer(expand.decompress(blob[at:at + listed]), "<u4").reshape(BITS, -1)
        at += listed
        self.planes = []
        for size in sizes:
            self.planes.append(np.frombuffer(expand.decompress(blob[at:at + size]), np.uint8))
            at += size

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, plane = i // BLOCK, self.planes[level]
        found = int(self.ranks[level, block]) + int(_COUNT[plane[block * BLOCK // 8:i // 8]].sum())
        return found + (bin(int(plane[i // 8]) >> (8 - i % 8)).count("1") if i % 8 else 0)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i // 8]) >> (7 - i % 8) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(BITS):
            one, ones = self._bit(level, i), self._ones(level, i)
            value = value << 1 | one
            i = self.zeros[level] + ones if one else i - ones
        return value

    def rank(self, token: int, i: int) -> int:
        """Occurrences of `token` among the first i ids."""
        lo, hi = 0, i
        for level in range(BITS):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if token >> (BITS - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of `token`."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        lo, hi = 0, self.n
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.rank(token, mid) > k else (mid, hi)
        return lo

    def decode(self) -> np.ndarray:
        """All ids: from the lowest plane up, the parting by each bit is undone."""
        now = np.zeros(self.n, np.uint16)
        for level in range(BITS - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n).view(bool) if self.n else np.zeros(0, bool)
            up = np.empty_like(now)
            up[~ones] = now[:self.zeros[level]]
            up[ones] = now[self.zeros[level]:] | np.uint16(1 << (BITS - 1 - level))
            now = up
        return now


def write_token_shards(positions: DataFrame, path: str, tokenizer: str, *, key: str = "position_id", note: str = "note",
                       end_id: int = 0, shard_tokens: int = 1 << 19) -> None:
    """Writes the ids of all notes, in ascending key order, as wavelet matrices under `path`.

    Notes are dealt by ranges of the key (rows of one key further by a hash of their text, so a hot key is spread), sorted
    in their partition and encoded; each note ends with `end_id`. A shard is closed by the note that fills `shard_tokens`,
    so it holds whole notes; every shard is one row (part, shard, start in part, tokens, keys, lengths, matrix) of the table.
    Null or empty text: the end id alone. Null keys come first, repeated rows stay, an empty table gives no shard."""
    given = (positions.select(F.col(key).alias("key"), F.col(note).alias("text"))
             .repartitionByRange(F.col("key"), F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text")))
    out = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()),
                        T.StructField("start", T.LongType()), T.StructField("tokens", T.LongType()),
                        T.StructField("keys", T.ArrayType(positions.schema[key].dataType)),
                        T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("matrix", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, shard, start = tokenizer_of(tokenizer), TaskContext.get().partitionId(), 0, 0
        keys, lengths, ids = [], [], []

        def close(kinds: pa.DataType) -> pa.RecordBatch:
            stream = np.concatenate(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([start], pa.int64()),
                 pa.array([len(stream)], pa.int64()), pa.array([keys], pa.list_(kinds)),
                 pa.array([lengths], pa.list_(pa.int64())), pa.array([build(stream)], pa.binary())],
                names=["part", "shard", "start", "tokens", "keys", "lengths", "matrix"])

        kinds, held, end = None, 0, np.array([end_id], np.uint16)
        for batch in batches:
            kinds = batch.column(0).type
            for lo, hi, _, _ in slices(batch.column(1), SLICE):
                made, cuts = coder.encode(batch.column(1).slice(lo, hi - lo))
                for r, k in enumerate(batch.column(0).slice(lo, hi - lo).to_pylist()):
                    ids += [made[cuts[r]:cuts[r + 1]], end]
                    keys.append(k)
                    lengths.append(int(cuts[r + 1] - cuts[r]) + 1)
                    held += lengths[-1]
                    if held >= shard_tokens:
                        yield close(kinds)
                        keys, lengths, ids, shard, start, held = [], [], [], shard + 1, start + held, 0
        if keys:
            yield close(kinds)

    given.mapInArrow(run, out).write.parquet(path)


def read_token_shards(spark: SparkSession, path: str, *, key: str = "position_id") -> DataFrame:
    """(key, start, n_tokens, ids) of every note, decoded from the matrices under `path`. `start` counts the ids of all
    notes before it; `ids` are little-endian unsigned 32-bit integers with the end id last."""
    shards = spark.read.parquet(path)
    # one row per partition of the write: their number does not grow with the rows of a partition
    sums = shards.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select(F.col("part").alias("part_"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    kind = shards.schema["keys"].dataType.elementType
    out = T.StructType([T.StructField("part", T.IntegerType()), T.StructField(key, kind), T.StructField("start", T.LongType()),
                        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                lengths = np.array(batch.column(3)[r].as_py(), np.int64)
                keys = batch.column(2)[r].values
                ids = WaveletMatrix(batch.column(4)[r].as_py()).decode().astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - lengths + batch.column(1)[r].as_py()
                for lo in range(0, len(lengths), 2000):
                    hi = min(lo + 2000, len(lengths))
                    cuts = ends[lo:hi] - (ends[lo] - lengths[lo])
                    data = ids[ends[lo] - lengths[lo]:ends[hi - 1]]
                    offsets = np.concatenate([[0], cuts])
                    blobs = pa.array([data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(hi - lo, batch.column(0)[r].as_py(), np.int32)), keys.slice(lo, hi - lo),
                         pa.array(starts[lo:hi]), pa.array(lengths[lo:hi]), blobs],
                        names=["part", key, "start", "n_tokens", "ids"])

    notes = shards.select("part", "start", "keys", "lengths", "matrix").mapInArrow(run, out)
    return (notes.join(F.broadcast(bases), F.col("part") == F.col("part_"))
            .select(key, (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids"))
