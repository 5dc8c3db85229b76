"""Benchmark decontamination by winnowing.

Fingerprints of a text are the least `k`-gram hash of each `w` consecutive ones, where
k + w - 1 = `window`: any span of `window` words that two texts share has a fingerprint in
common. Fingerprints of documents are joined with those of the benchmark, and each hit is
extended to both sides over equal words; a span of at least `window` words contaminates.

The benchmark is dealt in blocks of at most `block_bytes` of text, each broadcast by itself
(its size is what bounds it); documents are streamed past it, without a shuffle. Beyond one
block, documents get a number and are written once; the driver makes one block after another, and
what each finds is written and joined by that number at the end.

Null and empty texts have no words: they are never hit, and as items occur nowhere. Items
shorter than the window count as one window of their own length. Equal texts of several items
are matched once, and all their ids reported; repeated rows of an item count once. Documents
are reported row by row, repeated ones too. Texts of any length are taken whole. Other columns pass through unless their names clash
with the operator's.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from ._arrays import ALNUM, LOWER, blocks, grams, text_buffers, winnow, words
from ._cluster import Scratch

BLOCK_BYTES = 8 << 20


class Benchmark:
    """Items of one block, by the fingerprints of their distinct word sequences."""

    def __init__(self, ids: list[int], texts: list[str], window: int, k: int):
        self.window, self.k, self.w = window, k, window - k + 1
        by: dict[bytes, set[int]] = defaultdict(set)
        raw = pa.array(texts, pa.string())
        buf, at = text_buffers(raw)
        found = words(LOWER[buf], at, ALNUM)
        data = found.buf.tobytes()
        for t, i in enumerate(ids):
            lo, hi = found.first[t], found.first[t + 1]
            if lo < hi:
                by[b" ".join(data[s:e] for s, e in zip(found.start[lo:hi], found.end[lo:hi]))].add(i)
        self.ids = [sorted(x) for x in by.values()]
        self.words = [x.split(b" ") for x in by]
        places: list[tuple[int, int, int]] = []
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.hash: list[np.ndarray] = []
        for n, x in enumerate(self.words):
            joined = b" ".join(x)
            own = words(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]), ALNUM).hashes()
            self.hash.append(own)
            if len(own) < window:
                self.short[len(own)][int(grams(own, len(own))[0])].append(n)
            else:
                g = grams(own, k)
                places += [(int(g[p]), n, int(p)) for p in np.unique(winnow(g, self.w))]
        places.sort()
        self.key = np.array([x[0] for x in places], np.uint64)
        self.item = np.array([x[1] for x in places], np.int64)
        self.place = np.array([x[2] for x in places], np.int64)
        self.short = {n: (np.array(sorted(x), np.uint64), dict(x)) for n, x in self.short.items()}


    def scan(self, buf: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]], set[int]]]:
        """(words, spans hit, sequences with an occurring window) of each text."""
        found = words(LOWER[buf], at, ALNUM)
        h, rest, text = found.hashes(), found.rest(), found.text_of()
        first = found.first
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set[int]] = defaultdict(set)
        data = found.buf

        def word(i: int) -> bytes:
            return data[found.start[i] : found.end[i]].tobytes()

        def equal(i: int, x: list[bytes]) -> bool:
            return all(word(i + j) == y for j, y in enumerate(x))

        if len(self.key) and len(h) >= self.window:
            g = grams(h, self.k)
            chosen = winnow(g, self.w)
            chosen = np.unique(chosen[rest[: len(chosen)] >= self.window])
            lo = np.searchsorted(self.key, g[chosen], "left")
            hi = np.searchsorted(self.key, g[chosen], "right")
            covered: dict[tuple[int, int, int], int] = {}  # (text, item, diagonal) -> words up to which it is done
            for j in np.flatnonzero(hi > lo):
                p = int(chosen[j])
                t = int(text[p])
                for m in range(int(lo[j]), int(hi[j])):
                    n, q = int(self.item[m]), int(self.place[m])
                    line = (t, n, p - q)
                    if covered.get(line, -1) >= p + self.k:
                        continue
                    y = self.hash[n]
                    back = min(p - int(first[t]), q)
                    same = h[p - back : p][::-1] == y[q - back : q][::-1]
                    a = p - (back if same.all() else int(same.argmin()))
                    ahead = min(int(first[t + 1]) - p, len(y) - q)
                    same = h[p : p + ahead] == y[q : q + ahead]
                    b = p + (ahead if same.all() else int(same.argmin()))
                    covered[line] = b
                    if b - a >= self.window and equal(a, self.words[n][a - p + q : b - p + q]):
                        spans[t].append((a - int(first[t]), b - int(first[t])))
                        items[t].add(n)
        for size, (keys, by) in self.short.items():
            g = grams(h, size)
            if not len(g):
                continue
            g = np.where(rest[: len(g)] >= size, g, np.uint64(0))
            near = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            for p in np.flatnonzero(keys[near] == g):
                t = int(text[p])
                if rest[p] < size:
                    continue
                for n in by[int(g[p])]:
                    if equal(int(p), self.words[n]):
                        spans[t].append((int(p) - int(first[t]), int(p) - int(first[t]) + size))
                        items[t].add(n)
        for t in range(len(at) - 1):
            yield int(first[t + 1] - first[t]), spans.get(t, []), items.get(t, set())


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without overlaps, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("items", T.ArrayType(T.LongType()))])


def _scan(sent, keep: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for rows, buf, at in blocks(batch, text):
                got = list(own.scan(buf, at))
                part = batch.slice(rows.start, rows.stop - rows.start)
                arrays = [
                    pa.array([x[0] for x in got], pa.int64()),
                    pa.array([[list(s) for s in joined(x[1])] for x in got], pa.list_(pa.list_(pa.int32()))),
                    pa.array([sorted({i for n in x[2] for i in own.ids[n]}) for x in got], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + arrays, names=keep + [f.name for f in FOUND])

    return run


def _benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[tuple[list[int], list[str]]]:
    """Items in blocks of bounded text, one at a time on the driver."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col(item_id).cast("long"), text).where(f"{item_id} is not null and {text} is not null").distinct().toLocalIterator():
        if ids and size + len(row[1]) > block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1])
    yield ids, texts


def _merged(spans):
    """joined(), on a column."""
    last = lambda acc: F.element_at(acc, -1)
    wider = lambda acc, s: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(last(acc)[0], F.greatest(last(acc)[1], s[1]))))
    step = lambda acc, s: F.when((F.size(acc) > 0) & (s[0] <= F.try_element_at(acc, F.lit(-1))[1]), wider(acc, s)).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.array().cast("array<array<int>>"), step)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, k: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, spans ([first, past last] word places hit) and items (ids found)."""
    spark = ship(docs.sparkSession)
    send = spark.sparkContext.broadcast
    keep = [c for c in docs.columns if c not in FOUND.names]
    parts = _benchmark_blocks(benchmark, item_id, item_text, block_bytes)
    first, second = next(parts), next(parts, None)
    if second is None:
        schema = T.StructType([docs.schema[c] for c in keep] + FOUND.fields)
        return docs.mapInArrow(_scan(send(Benchmark(*first, window, k)), keep, doc_text), schema).select(*keep, *FOUND.names)
    scratch = Scratch(spark, "decontamination")
    # numbered rows are written, so that a task that runs again reads the same numbers
    rows = scratch.save(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(F.lit(0).alias("_"), *keep).alias("doc"), F.col(doc_text).alias("text")), "rows")
    texts, found = rows.select("row", "text"), None
    schema = T.StructType([T.StructField("row", T.LongType()), *FOUND.fields])
    for n, part in enumerate(chain([first, second], parts)):
        sent = send(Benchmark(*part, window, k))
        got = texts.mapInArrow(_scan(sent, ["row"], "text"), schema)
        got = scratch.save(got if n == 0 else got.where("size(items) > 0"), f"found-{n}")
        sent.destroy()
        found = got if found is None else found.unionByName(got)
    found = found.groupBy("row").agg(F.max("n_words").alias("n_words"), _merged(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return rows.join(found, "row").select(*(F.col(f"doc.{c}").alias(c) for c in keep), *FOUND.names)


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row for each of contamination()'s, with counts and a hash of the items found."""
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0), lambda a, s: a + s[1] - s[0]), F.lit(0)).cast("long")
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(F.col(doc_id).alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
