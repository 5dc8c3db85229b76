"""Byte-level BPE by rounds over length-bucketed, padded numpy matrices.

Distinct pieces of a batch, of similar length, are rows of one matrix of token ids. In each
round every row merges its leftmost pair of least rank: pair ranks come from a hash table
kept in arrays, and merged rows are compacted to the left. A row without a mergeable pair is
done and leaves the matrix.

Null texts are empty; an empty text has no ids. Texts of any length are encoded whole; pieces
over `LONG` bytes, for which the matrix's work would grow with the square of the length, merge
the same pairs in the same order with a heap. Repeated rows are encoded alike. Other columns
of the input pass through unless their names clash with the operator's, which then win.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LONG = 1024
CACHED_PIECES = 400_000
NONE = np.int32(2**31 - 1)


class PairTable:
    """Open-addressing table from (left id, right id) to the merged token's rank."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(8, int(4 * len(rank)).bit_length())
        self.key = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.rank = np.full(1 << self.bits, NONE, np.int32)
        self.probes = 1
        wanted = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        todo, at = np.arange(len(rank)), self._slot(wanted)
        while len(todo):
            free = self.key[at[todo]] == np.uint64(2**64 - 1)
            _, one = np.unique(np.where(free, at[todo], -1 - np.arange(len(todo))), return_index=True)
            one = one[free[one]]
            put = todo[one]
            self.key[at[put]], self.rank[at[put]] = wanted[put], rank[put]
            todo = np.delete(todo, one)
            if len(todo):
                at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
                self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where a pair does not merge."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._slot(key)
        out = np.where(self.key[at] == key, self.rank[at], NONE)
        left_over = np.flatnonzero((out == NONE) & (self.key[at] != np.uint64(2**64 - 1)))
        for _ in range(self.probes):
            if not len(left_over):
                break
            at = (at if len(at) == len(left_over) else at[left_over]) + 1
            at &= (1 << self.bits) - 1
            found = self.key[at] == key[left_over]
            out[left_over[found]] = self.rank[at[found]]
            go = ~found & (self.key[at] != np.uint64(2**64 - 1))
            left_over, at = left_over[go], at[go]
        return out


class Codec:
    """Ranks of a vocabulary file, ready to encode pieces and to decode ids."""

    def __init__(self, path: str, pattern: str):
        self.pattern = regex.compile(pattern)
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = dict(zip(self.ranks.values(), self.ranks))
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.pairs = PairTable(*np.array(pairs, np.int64).T)
        self.pair = {(a, b): r for a, b, r in pairs}
        self.cache: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece; a piece that is a token itself is that token."""
        out: list = [None] * len(pieces)
        by: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = (whole,)
            elif len(p) > LONG:
                out[i] = self._merge_long(p)
            else:
                by.setdefault(len(p) if len(p) < 16 else -(-len(p) // 8) * 8, []).append(i)
        for width, rows in by.items():
            step = max(1, 2_000_000 // width)
            for lo in range(0, len(rows), step):
                own = rows[lo : lo + step]
                for i, ids in zip(own, self._merge_rows([pieces[i] for i in own], width)):
                    out[i] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = self.byte[raw]
        row = np.arange(len(pieces))
        out: list = [None] * len(pieces)
        place = np.arange(width)
        rank = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        rank[place[1:] >= n[:, None]] = NONE
        while len(ids):
            best = rank.argmin(axis=1)  # the first of equals: the leftmost
            least = rank[np.arange(len(ids)), best]
            over = least == NONE
            if over.any():
                for i in np.flatnonzero(over):
                    out[row[i]] = tuple(ids[i, : n[i]].tolist())
                keep = ~over
                ids, rank, n, row, best, least = ids[keep], rank[keep], n[keep], row[keep], best[keep], least[keep]
                if not len(ids):
                    break
            n -= 1
            w = int(n.max())
            take = place[:w] + (place[:w] > best[:, None])
            ids = np.take_along_axis(ids, np.minimum(take, ids.shape[1] - 1), 1)
            at = np.arange(len(ids))
            ids[at, best] = least
            if w == 1:
                rank = np.full((len(ids), 1), NONE, np.int32)
                continue
            gone = place[: w - 1] + (place[: w - 1] >= best[:, None])
            rank = np.take_along_axis(rank, np.minimum(gone, rank.shape[1] - 1), 1)
            has = np.flatnonzero(best < w - 1)
            rank[has, best[has]] = self.pairs.find(ids[has, best[has]], ids[has, best[has] + 1])
            has = np.flatnonzero(best > 0)
            rank[has, best[has] - 1] = self.pairs.find(ids[has, best[has] - 1], ids[has, best[has]])
            rank[place[1:w] >= n[:, None]] = NONE
        return out

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pair.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (s := self.pair.get((ids[x], ids[after[x]]))) is not None:
                    heapq.heappush(heap, (s, x, ids[x], ids[after[x]]))
        return tuple(x for x in ids if x >= 0)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        found = [self.pattern.findall(t) for t in texts]
        if len(self.cache) > CACHED_PIECES:
            self.cache.clear()
        new = list({p for ps in found for p in ps}.difference(self.cache))
        for p, ids in zip(new, self.merge([p.encode() for p in new])):
            self.cache[p] = struct.pack(f"<{len(ids)}I", *ids)
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, ps)), "<u4") for ps in found]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    return Codec(path, pattern)


OWN = ("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256")


def encode_decode(df: DataFrame, ranks: str, pattern: str, text: str = "text", outputs: tuple[str, ...] = OWN) -> DataFrame:
    """Adds ids (array of int), n_tokens, their SHA-256, and the decoded text and its SHA-256.

    ranks: a file of base64 tokens and ranks, readable on every machine; pattern: splits a
    text into pieces. `outputs` picks the columns to make. Map side only: no shuffle.
    """
    kinds = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded": T.StringType(), "decoded_sha256": T.StringType()}
    kept = [f for f in df.schema.fields if f.name not in outputs]
    schema = T.StructType(kept + [T.StructField(c, kinds[c]) for c in outputs])
    df = df if text in [f.name for f in kept] else df.withColumnRenamed(text, "__text")
    source = text if text in df.columns else "__text"
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for whole in batches:
            lo = 0
            while lo < whole.num_rows:
                hi, size = lo, 0
                column = whole.column(source)
                while hi < whole.num_rows and (hi == lo or size < 1_000_000):
                    size += len(column[hi].as_py() or "")
                    hi += 1
                batch = whole.slice(lo, hi - lo)
                lo = hi
                texts = [x or "" for x in batch.column(source).to_pylist()]
                ids = own.encode(texts)
                back = [own.decode(x) for x in ids] if {"decoded", "decoded_sha256"} & set(outputs) else []
                made = {
                    "ids": lambda: pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())),
                    "n_tokens": lambda: pa.array([len(x) for x in ids], pa.int64()),
                    "ids_sha256": lambda: pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                    "decoded": lambda: pa.array([x.decode() for x in back], pa.string()),
                    "decoded_sha256": lambda: pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
                }
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [made[c]() for c in outputs], names=names + list(outputs))

    return df.mapInArrow(run, schema)
