"""Token ids of whole texts. Byte-level BPE splits a text before it merges anything, and some places always are
splits (a lone space between visible characters, a letter before a comma, a line end after a visible character), so the ids of
a text are the ids of the pieces between such places, in order. A worker encodes every distinct piece once; a bounded table of
128-bit hashes, kept from task to task, remembers the ids."""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from barloom.llm.bytescan import mix, prefix_hash, slices, span_hash

REMEMBERED = 2_000_000   # pieces kept by a worker; the table is emptied when it is full
JOINED = 100_000         # bytes of new pieces that one call encodes
SLICE = 4 << 20
_OTHER = np.random.default_rng(7).permutation(256).astype(np.uint8)   # byte values behind the second hash


def _letters(data: np.ndarray) -> np.ndarray:
    return ((data | 32) >= 97) & ((data | 32) <= 122)


@lru_cache(maxsize=1)
def tokenizer_of(path: str) -> TextTokenizer:
    """The worker's tokenizer, with what it has learned in earlier tasks."""
    return TextTokenizer(path)


class TextTokenizer:
    """Encodes Arrow text columns with a tokenizer file; ids are those of `encode(text, add_special_tokens=False)`,
    with the strings of special tokens taken as ordinary text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.model.no_truncation()
        self.model.no_padding()
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        if max(vocabulary.values()) > 65535:
            raise ValueError("ids over 65535 need a wider table")
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)   # bytes of a token: its letters stand for bytes
        self.width[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self._forget()

    def _forget(self) -> None:
        self.hash, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)     # sorted by hash
        self.number = np.zeros(0, np.int64)                                         # of the piece with that hash
        self.ends = np.zeros(0, np.int64)                                           # where the ids of a piece end
        self.ids = np.zeros(0, np.uint16)

    def _ids_of(self, pieces: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces and how many each has. Words with a space before them stand side by side in the array's bytes as
        they could in a text, so one call encodes many; the lengths of the tokens show where a piece ends."""
        bounds = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1, 8 * pieces.offset)
        data = np.frombuffer(pieces.buffers()[2], np.uint8)
        size = np.diff(bounds)
        word = (size > 1) & (data[bounds[:-1]] == 32)
        word[word] = _letters(data[bounds[:-1][word] + 1]) & _letters(data[bounds[1:][word] - 1])
        made, counts = [None] * 2, np.zeros(len(pieces), np.int64)
        plain = pieces.filter(pa.array(word))
        ids = []
        if len(plain):
            cuts = np.frombuffer(plain.buffers()[1], np.int64, len(plain) + 1, 8 * plain.offset)
            at, text, lengths = 0, plain.buffers()[2], []
            while at < len(plain):
                upto = max(at + 1, int(np.searchsorted(cuts, cuts[at] + JOINED, "right")) - 1)
                some = np.array(self.model.encode_batch_fast([text[cuts[at]:cuts[upto]].to_pybytes().decode()],
                                                             add_special_tokens=False)[0].ids, np.int64)
                stops = np.searchsorted(np.cumsum(self.width[some]), cuts[at + 1:upto + 1] - cuts[at]) + 1
                lengths.append(np.diff(stops, prepend=0))
                ids.append(some)
                at = upto
            counts[word] = np.concatenate(lengths)
        made[0] = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        rest = [e.ids for e in self.model.encode_batch_fast(pieces.filter(pa.array(~word)).to_pylist(), add_special_tokens=False)]
        counts[~word] = list(map(len, rest))
        made[1] = np.fromiter(chain.from_iterable(rest), np.int64)
        out = np.zeros(int(counts.sum()), np.uint16)
        which = np.repeat(word, counts)
        out[which], out[~which] = made
        return out, counts

    def _learn(self, pieces: pa.LargeStringArray) -> np.ndarray:
        """Numbers of the distinct `pieces`, encoding those not seen before."""
        bounds = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1, 8 * pieces.offset)
        data = np.frombuffer(pieces.buffers()[2], np.uint8)[bounds[0]:bounds[-1]]
        bounds = bounds - bounds[0]
        h = mix(span_hash(prefix_hash(data), bounds[:-1], bounds[1:]))
        check = span_hash(prefix_hash(_OTHER[data]), bounds[:-1], bounds[1:]) ^ np.diff(bounds).astype(np.uint64)
        if len(self.hash) + len(h) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.hash, h)
        safe = np.minimum(at, max(len(self.hash) - 1, 0))
        known = (self.hash[safe] == h) & (self.check[safe] == check) if len(self.hash) else np.zeros(len(h), bool)
        number = np.zeros(len(h), np.int64)
        number[known] = self.number[safe[known]]
        if not known.all():
            ids, counts = self._ids_of(pieces.filter(pa.array(~known)))
            first = len(self.ends)
            self.ends = np.concatenate([self.ends, len(self.ids) + np.cumsum(counts)])
            self.ids = np.concatenate([self.ids, ids])
            number[~known] = first + np.arange(len(counts))
            order = np.argsort(h[~known])
            into = np.searchsorted(self.hash, h[~known][order])
            self.hash = np.insert(self.hash, into, h[~known][order])
            self.check = np.insert(self.check, into, check[~known][order])
            self.number = np.insert(self.number, into, number[~known][order])
        return number

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and the bounds of each row's ids. A null is an empty text."""
        made = [self._encode(data, bounds) for _, _, data, bounds in slices(column, SLICE)]
        if not made:
            return np.zeros(0, np.uint16), np.zeros(1, np.int64)
        base = np.cumsum([0, *(len(ids) for ids, _ in made)])
        return (np.concatenate([ids for ids, _ in made]),
                np.concatenate([[0], *(cuts[1:] + b for (_, cuts), b in zip(made, base))]))

    def _encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, n = len(bounds) - 1, len(data)
        cut = np.zeros(n + 1, bool)
        if n > 2:
            before, here, after = data[:-2], data[1:-1], data[2:]
            plain = (data > 32) & (data < 127)
            letter = _letters(data)
            # before a space that stands alone between two visible characters; white space beyond ASCII ends in or starts
            # with an odd byte, and there is no cut beside one
            solid = (data > 32) & (data != 127) & ~_ODD[data]
            cut[1:n - 1] = (here == 32) & solid[:-2] & solid[2:]
            # between a visible character and a line end, between a letter and a comma or full stop
            cut[1:n - 1] |= plain[:-2] & (here == 10) | letter[:-2] & ((here == 44) | (here == 46))
            # between a lone line end and a letter
            cut[2:n] |= plain[:-2] & (here == 10) & letter[2:]
        cut[bounds] = True
        edges = np.flatnonzero(cut)
        if edges[0] != 0:
            edges = np.concatenate([[0], edges])
        if n == 0:
            return np.zeros(0, np.uint16), np.zeros(rows + 1, np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data))
        coded = pieces.dictionary_encode()
        number = self._learn(coded.dictionary)[coded.indices.to_numpy()]
        begins = np.concatenate([[0], self.ends[:-1]])
        sizes = (self.ends - begins)[number]
        stops = np.cumsum(sizes)
        step = np.repeat(begins[number] - (stops - sizes), sizes) + np.arange(int(stops[-1]))
        at = np.searchsorted(edges, bounds)
        return self.ids[step], np.concatenate([[0], stops])[at]


# Last and first bytes of the UTF-8 forms of white space outside ASCII (U+0085, U+00A0, U+1680, U+2000 to 200A, 2028, 2029,
# 202F, 205F, 3000). Fixed values.
_ODD = np.isin(np.arange(256), [0x85, 0xA0, 0xC2, 0xE1, 0xE2, 0xE3, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F])
