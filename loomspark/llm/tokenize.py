"""Encoding of a corpus with a public byte-level BPE vocabulary.

Texts are split into pieces by the vocabulary's pattern. Pieces that a worker has not met before are encoded together:
they are put into padded integer matrices by length, and in every round each row merges its leftmost pair of minimum
rank, found in an open-addressing hash table of pairs; the merged column is removed by compaction, and rows without a
further merge leave the matrix. Pieces beyond `LONG_PIECE` bytes, where padded rounds would be quadratic, are merged by a
heap, with the same result. A worker keeps the ids of pieces in a dictionary that is emptied when it is full; this only
saves repeated work.

The operator is a narrow transformation: no shuffle, no broadcast (each worker reads the vocabulary file once, a file
that must be at the same path on every executor, as the tokenizer's installation puts it).
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenization pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_PIECE = 256
#: Pieces a worker remembers, and rows of one matrix.
REMEMBERED, MATRIX_ROWS = 400_000, 20_000
NONE = np.int32(2**31 - 1)


class PairTable:
    """rank of (left id, right id) by hashed lookup in vectors; NONE where they do not merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 2
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    values.append(rank)
        keys, values = np.array(keys, np.int64), np.array(values, np.int32)
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 4 + 1))))
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == -1]
            self.keys[at[free]] = keys[free]  # of several for one slot the last stays
            won = left[self.keys[at[left]] == keys[left]]
            self.ranks[at[won]] = values[won]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        self.single = dict(zip(keys.tolist(), values.tolist()))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1) & (keys != -2))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class Encoder:
    def __init__(self, path: str = DEFAULT_VOCABULARY):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.whole = ranks
        self.pairs = PairTable(ranks)
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def merge_matrix(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces of similar length: one padded row each."""
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        m = np.full((len(pieces), width + 1), -1, np.int32)
        m[np.arange(width + 1) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        out: list = [None] * len(pieces)
        live, n = np.arange(len(pieces)), lengths.copy()
        ranks = self.pairs.lookup(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(len(m), width)
        while len(live):
            best = ranks.argmin(axis=1)  # the leftmost of the smallest
            rows = np.arange(len(live))
            rank = ranks[rows, best]
            done = rank == NONE
            if done.any():
                for r in np.flatnonzero(done):
                    out[live[r]] = m[r, : n[r]].tolist()
                keep = ~done
                live, n, m, ranks, best, rank = live[keep], n[keep], m[keep], ranks[keep], best[keep], rank[keep]
                if not len(live):
                    break
                width = int(n.max())
                m, ranks, rows = np.ascontiguousarray(m[:, : width + 1]), np.ascontiguousarray(ranks[:, :width]), np.arange(len(live))
            # Compaction: the columns after the merged pair move one to the left.
            moved = np.arange(m.shape[1] - 1) > best[:, None]
            m[rows, best] = rank
            m[:, :-1] = np.where(moved, m[:, 1:], m[:, :-1])
            m[:, -1] = -1
            moved = np.arange(ranks.shape[1] - 1) >= best[:, None]
            ranks[:, :-1] = np.where(moved, ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            n -= 1
            ranks[rows, best] = self.pairs.lookup(m[rows, best], m[rows, best + 1])
            has = best > 0
            r, b = rows[has], best[has]
            ranks[r, b - 1] = self.pairs.lookup(m[r, b - 1], m[r, b])
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """The same merges for a long piece, by a heap of pairs over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n, size, single = len(ids), self.pairs.size, self.pairs.single
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := single.get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := single.get(rank * size + ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[after[i]]))
            if (h := before[i]) >= 0 and (r := single.get(ids[h] * size + rank)) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return [x for x in ids if x >= 0]

    def learn(self, pieces: set[str]) -> None:
        """Add the ids of new pieces to those known."""
        short: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            if (rank := self.whole.get(raw)) is not None:
                self.known[piece] = [rank]
            elif len(raw) > LONG_PIECE:
                self.known[piece] = self.merge_long(raw)
            else:
                short.setdefault((len(raw) + 3) // 4 if len(raw) <= 32 else 8 + len(raw).bit_length(), []).append((piece, raw))
        for bucket in short.values():
            for k in range(0, len(bucket), MATRIX_ROWS):
                part = bucket[k : k + MATRIX_ROWS]
                self.known.update(zip((p for p, _ in part), self.merge_matrix([b for _, b in part])))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts; null and empty texts have none."""
        split = [self.split(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fresh = set().union(*split).difference(self.known)
        if fresh:
            self.learn(fresh)
        known = self.known
        flat: list[int] = []
        offsets = np.zeros(len(texts) + 1, np.int32)
        for i, pieces in enumerate(split):
            for p in pieces:
                flat += known[p]
            offsets[i + 1] = len(flat)
        return offsets, np.array(flat, np.int32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str = DEFAULT_VOCABULARY) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, block_chars: int = 2_000_000) -> DataFrame:
    """(id, ids): the ids of each text, without special tokens and without any change to the text.

    A null or an empty text gives an empty list. Every row gives one row: repeated rows and null ids stay. Texts of any
    length are encoded whole. Further columns are not read.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            start, chars = 0, 0
            for i, t in enumerate(texts):
                chars += len(t or "")
                if chars >= block_chars or i == len(texts) - 1:
                    offsets, ids = enc.encode(texts[start : i + 1])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, i + 1 - start), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["doc_id", "ids"])
                    start, chars = i + 1, 0

    return rows.mapInArrow(run, schema)
