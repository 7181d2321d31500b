"""Notes packed into training sequences: vector bin packing with the dot-product heuristic."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.taskcontext import TaskContext

from barloom.llm.bytescan import slices
from barloom.llm.tokens import SLICE, tokenizer_of


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold: tokens, pieces of notes, and tokens that bear loss (those after the prompt)."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


POOL_NOTES, POOL_TOKENS = 1500, 1 << 20   # what a task holds before it fills sequences


class _Pool:
    """Notes that wait in a task, and the sequences being filled from them."""

    def __init__(self, limits: Limits):
        self.limits, self.rows, self.waiting, self.made = limits, [], 0, 0

    def add(self, key, ids: np.ndarray, prompt: int) -> None:
        self.rows.append((key, ids, prompt, 0))
        self.waiting += len(ids)

    def full(self) -> bool:
        return len(self.rows) >= POOL_NOTES or self.waiting >= POOL_TOKENS

    def fill(self, keep: int) -> Iterator[tuple]:
        """Fills sequences until at most `keep` tokens and a quarter of the notes wait. A sequence takes, again and again, the note that fits
        with the largest dot product of its sizes and the free room; if none fits, the longest note is cut to the room."""
        lim, rows = self.limits, self.rows
        at = np.array([r[3] for r in rows])
        total, prompt = np.array([len(r[1]) for r in rows]), np.array([r[2] for r in rows])
        size = total - at
        loss = total - np.maximum(at, np.minimum(prompt, total))
        left, waiting = len(rows), int(size.sum())
        floor = len(rows) // 4 if keep else 0
        while left and (waiting > keep or left > floor and keep):
            room, seats, bearing, offset = lim.tokens, lim.segments, lim.loss, 0
            while room and seats and left:
                score = np.where((size > 0) & (size <= room) & (loss <= bearing),
                                 size * (room / lim.tokens ** 2) + loss * (bearing / lim.loss ** 2), -1.0)
                i = int(score.argmax())
                n = int(size[i])
                if score[i] < 0:
                    most = np.minimum(np.minimum(size, room), np.maximum(prompt - at, 0) + bearing)
                    i = int(most.argmax())
                    n = int(most[i])
                    if n <= 0:
                        break
                key, ids, p, _ = rows[i]
                a = int(at[i])
                yield key, a, n, ids[a:a + n].astype("<u4").tobytes(), len(ids), self.made, offset
                at[i] += n
                size[i] -= n
                used = int(loss[i])
                loss[i] = len(ids) - max(a + n, min(p, len(ids)))
                bearing -= used - int(loss[i])
                room, seats, offset, waiting = room - n, seats - 1, offset + n, waiting - n
                left -= size[i] == 0
            self.made += 1
        self.rows = [(k, ids, p, int(a)) for (k, ids, p, _), a, s in zip(rows, at, size) if s]
        self.waiting = waiting


def pack_notes(positions: DataFrame, tokenizer: str, *, key: str = "position_id", note: str = "note",
               prompt: str | None = None, limits: Limits = Limits(), end_id: int = 1) -> DataFrame:
    """Pieces of position notes placed in sequences under `limits`.

    A note is its `prompt` column (if one is named), its text and `end_id`; ids come from the tokenizer file without
    special tokens. Only tokens after the prompt bear loss. Each task packs the rows of its own partition, so nothing is
    shuffled and memory is bounded by the pool; only the last sequence of a task is left short, or one that reached the
    segment or loss limit. Every id lies in exactly one piece.

    Returns (key, start, length, ids, note_tokens, sequence, offset); `ids` are little-endian unsigned 32-bit integers and
    `sequence` is unique, not gapless. Null or empty text: the end id alone. Repeated rows are packed as often as they
    occur; a null key is kept; an empty table gives no rows; other columns are ignored."""
    if min(limits.tokens, limits.segments, limits.loss) < 1:
        raise ValueError("limits must be positive")
    kind = positions.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                        T.StructField("ids", T.BinaryType()), T.StructField("note_tokens", T.LongType()),
                        T.StructField("sequence", T.LongType()), T.StructField("offset", T.LongType())])
    said = F.col(prompt) if prompt else F.lit(None)
    given = positions.select(F.col(key).alias("key"), said.cast("string").alias("prompt"), F.col(note).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, pool = tokenizer_of(tokenizer), _Pool(limits)
        base = TaskContext.get().partitionId() << 33

        def table(rows: list[tuple], kinds: pa.DataType) -> pa.RecordBatch:
            keys, start, length, ids, tokens, sequence, offset = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, kinds), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()),
                 pa.array(tokens, pa.int64()), pa.array(np.array(sequence, np.int64) + base), pa.array(offset, pa.int64())],
                names=[key, "start", "length", "ids", "note_tokens", "sequence", "offset"])

        kinds = None
        for batch in batches:
            kinds = batch.column(0).type
            for lo, hi, _, _ in slices(batch.column(2), SLICE):
                keys = batch.column(0).slice(lo, hi - lo).to_pylist()
                ids, ends = coder.encode(batch.column(2).slice(lo, hi - lo))
                head, cuts = coder.encode(batch.column(1).slice(lo, hi - lo)) if prompt else (ids[:0], np.zeros(hi - lo + 1, int))
                for r, k in enumerate(keys):
                    mine = np.concatenate([head[cuts[r]:cuts[r + 1]], ids[ends[r]:ends[r + 1]], [end_id]])
                    pool.add(k, mine.astype(np.uint16), int(cuts[r + 1] - cuts[r]))
                    if pool.full():
                        yield table(list(pool.fill(POOL_TOKENS // 4)), kinds)
        if pool.rows:
            yield table(list(pool.fill(0)), kinds)

    return given.mapInArrow(run, out)
