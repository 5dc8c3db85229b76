"""SimHash near-duplicates, found by fuzzy hashing with the binary Golay code.

A fingerprint's 64 bits are dealt to three segments of at most 23 bits. Where two fingerprints
differ in at most four bits, some two of the segments differ in at most two bits together
(otherwise all three pairs would hold three differences or more: at least five bits). Each
segment is decoded to the codewords of the (23, 12, 7) Golay code near it, one for a word that
lies within two bits of a codeword and six for others; words at most two bits apart have one in
common. Pairs of codeword indices are the keys: fingerprints with a common key are compared.

Equal fingerprints are grouped before anything else, so copies make no pairs. Fingerprints of
one key are compared in blocks and only the links of a spanning forest leave. Keys with more
than `crowd` fingerprints take another exact way: fingerprints at most four bits apart have a
word within two bits of both in common, and all that share such a middle word are linked through
the least of them, in rows that grow in proportion.

Null and empty texts have fingerprint zero, and link like any other. Repeated rows share a
component. A null id is never the name of a component unless all its rows' ids are null.
Texts of any length are taken whole. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cluster import Scratch, components, hot, join_salted, partitions

CROWD = 2000
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Majority of the bits of XXH64 of the shingles, repeats included."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    whole = b" ".join(w)
    if len(w) <= shingle:
        return xxhash.xxh64_intdigest(whole, seed)
    size = np.fromiter(map(len, w), np.int64, len(w))
    start = np.zeros(len(w), np.int64)
    np.cumsum(size[:-1] + 1, out=start[1:])
    n = len(w) - shingle + 1
    end = (start + size)[shingle - 1 :]
    h = xxhash.xxh64_intdigest
    counts, step = np.zeros(64, np.int64), 1 << 14
    for lo in range(0, n, step):
        own = np.array([h(whole[a:b], seed) for a, b in zip(start[lo : min(n, lo + step)].tolist(), end[lo : lo + step].tolist())], "<u8")
        counts += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * counts > n)))


def with_fingerprint(docs: DataFrame, text: str, shingle: int = 4) -> DataFrame:
    """docs with fingerprint (long: the 64 bits, signed); a clashing column is replaced."""
    keep = [c for c in docs.columns if c not in ("fingerprint", text)]
    schema = docs.select(*keep).schema.add("fingerprint", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.array([fingerprint(x.as_py(), shingle) for x in b.column(text)], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(own)], names=[*keep, "fingerprint"])

    return docs.select(*keep, text).mapInArrow(run, schema)


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """(codeword index of each 23-bit word's nearest codeword's top 12 bits, offsets):
    offsets[s] lists, for the syndrome s of a word, what to add to it to reach each codeword of
    its keys; -1 fills up."""
    poly = 0b110001110101  # generator polynomial of the perfect (23, 12) code
    def syndrome(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for bit in range(22, 10, -1):
            x ^= np.where(x >> bit & 1, poly << (bit - 11), 0)
        return x

    leader = np.zeros(2048, np.int64)
    weight = {}
    for n in range(4):
        for at in combinations(range(23), n):
            x = sum(1 << i for i in at)
            weight[x] = n
    words = np.array(list(weight), np.int64)
    leader[syndrome(words)] = words
    four = np.array([sum(1 << i for i in at) for at in combinations(range(23), 4)], np.int64)
    s4 = syndrome(four)
    offsets = np.full((2048, 6), -1, np.int64)
    offsets[:, 0] = leader
    order = np.argsort(s4, kind="stable")
    at = np.searchsorted(s4[order], np.arange(2049))
    for s in range(2048):
        near = four[order[at[s] : at[s + 1]]]
        if weight[int(leader[s])] == 3:
            offsets[s, 1 : 1 + len(near)] = near
    table = syndrome(np.arange(1 << 23, dtype=np.int32)).astype(np.int16)
    return table, offsets


def segment_keys(x: np.ndarray) -> np.ndarray:
    """Indices (the top 12 bits) of up to six codewords for each 23-bit word; -1 fills up."""
    table, offsets = golay()
    add = offsets[table[x]]
    return np.where(add < 0, -1, (x[:, None] ^ add) >> 11)


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every pair of codeword indices of every pair of segments."""
    part = [segment_keys((fp >> np.uint64(lo) & np.uint64((1 << n) - 1)).astype(np.int64)) for lo, n in SEGMENTS]
    rows, out = [], []
    for m, (i, j) in enumerate(combinations(range(3), 2)):
        a, b = part[i][:, :, None], part[j][:, None, :]
        ok = (a >= 0) & (b >= 0)
        row, _, _ = np.nonzero(ok)
        rows.append(row)
        out.append(((a << 12 | b) * 3 + m)[ok])
    return np.concatenate(rows), np.concatenate(out)


def forest(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links between fingerprints at most `distance` apart: a spanning forest of them."""
    root = np.arange(len(fp))
    out = []
    for i in range(len(fp) - 1):
        near = i + 1 + np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= distance)
        for j in near[root[near] != root[i]]:
            a, b = root[i], root[j]
            if a != b:
                out.append((int(i), int(j)))
                root[root == max(a, b)] = min(a, b)
    return out


def _compare(distance: int, crowd: int):
    """Links inside each run of equal keys (rows come sorted by key and fingerprint)."""

    def small(key: np.ndarray, fp: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        cut = np.flatnonzero(np.diff(key)) + 1
        start = np.concatenate([[0], cut])
        size = np.diff(np.concatenate([start, [len(key)]]))
        left, right = [], []
        few = size <= 8
        for lag in range(1, 8):
            s = start[few & (size > lag)]
            n = size[few & (size > lag)] - lag
            if not len(s):
                break
            i = np.repeat(s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ok = np.bitwise_count(fp[i] ^ fp[i + lag]) <= distance
            left.append(fp[i[ok]])
            right.append(fp[i[ok] + lag])
        for s, n in zip(start[~few], size[~few]):
            got = forest(fp[s : s + n], distance)
            left.append(fp[[s + a for a, _ in got]] if got else fp[:0])
            right.append(fp[[s + b for _, b in got]] if got else fp[:0])
        return left, right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        crowded = None

        def out(left, right, kind) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(left.astype(np.int64)), pa.array(right.astype(np.int64)), pa.array(np.full(len(left), kind, np.int8))], names=["a", "b", "kind"])

        def done(key, fp):
            left, right = small(key, fp)
            pair = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0) if left else np.zeros((0, 2), np.uint64)
            return out(pair[:, 0], pair[:, 1], 0)

        for b in batches:
            key = np.concatenate([held_key, b.column(0).to_numpy()])
            fp = np.concatenate([held, b.column(1).to_numpy().astype(np.uint64)])
            if not len(key):
                continue
            if crowded is not None:  # the rest of a crowded key
                n = int(np.searchsorted(key, crowded, "right"))
                if n:
                    yield out(fp[:n], fp[:n], 1)
                key, fp = key[n:], fp[n:]
                if len(key):
                    crowded = None
            if not len(key):
                held_key, held = key, fp
                continue
            last = int(np.searchsorted(key, key[-1], "left"))
            ready_key, ready = key[:last], fp[:last]
            held_key, held = key[last:], fp[last:]
            if len(held) > crowd:
                crowded = held_key[-1]
                yield out(held, held, 1)
                held_key, held = held_key[:0], held[:0]
            if len(ready):
                cut = np.concatenate([[0], np.flatnonzero(np.diff(ready_key)) + 1, [len(ready)]])
                big = np.flatnonzero(np.diff(cut) > crowd)
                for x in big:
                    yield out(ready[cut[x] : cut[x + 1]], ready[cut[x] : cut[x + 1]], 1)
                if len(big):
                    keep = np.ones(len(ready), bool)
                    for x in big:
                        keep[cut[x] : cut[x + 1]] = False
                    ready_key, ready = ready_key[keep], ready[keep]
                if len(ready):
                    yield done(ready_key, ready)
        if len(held):
            yield done(held_key, held)

    return run


def _middles(radius: int):
    """(word at most `radius` bits away, fingerprint) of each fingerprint."""
    flips = np.array([sum(1 << i for i in at) for n in range(radius + 1) for at in combinations(range(64), n)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().astype(np.uint64)
            for lo in range(0, len(fp), 64):
                own = fp[lo : lo + 64]
                yield pa.RecordBatch.from_arrays([pa.array((own[:, None] ^ flips).ravel().astype(np.int64)), pa.array(np.repeat(own, len(flips)).astype(np.int64))], names=["m", "f"])

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy().astype(np.uint64)
        for lo in range(0, len(fp), 4096):
            row, key = keys(fp[lo : lo + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[lo : lo + 4096][row].astype(np.int64))], names=["key", "f"])


def links(scratch: Scratch, prints: DataFrame, distance: int = 4, crowd: int = CROWD) -> DataFrame:
    """(a, b) fingerprints whose links give the components of all at most `distance` (four at
    most) bits apart. prints: distinct fingerprints in column f."""
    if distance not in (2, 4):
        raise ValueError("links are found at a distance of two or four bits")
    spark = prints.sparkSession
    n = partitions(spark)
    keyed = prints.mapInArrow(_keyed, "key long, f long").repartition(n, "key").sortWithinPartitions("key", "f")
    found = scratch.save(keyed.mapInArrow(_compare(distance, crowd), "a long, b long, kind tinyint"), "compared")
    hot = found.where("kind = 1").select(F.col("a").alias("f")).distinct()
    met = hot.mapInArrow(_middles(distance // 2), "m long, f long")
    least = met.groupBy("m").agg(F.min("f").alias("a"), F.count("*").alias("n")).where("n > 1")
    met = met.join(least.select("m", "a").hint("merge"), "m").where("a != f").select("a", F.col("f").alias("b"))
    return found.where("kind = 0").select("a", "b").unionByName(met).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4, crowd: int = CROWD, also: tuple[str, ...] = (), group: str | None = None) -> DataFrame:
    """doc_id, the columns of also, fingerprint (long) and component_id: the smallest id linked to the document.
    Components that hold the same id share a component_id; a column `group` is a number for each alone."""
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.save(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *also), "text", shingle), "fingerprints")
    prints = scratch.save(marked.groupBy(F.col("fingerprint").alias("f")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    parts = components(scratch, links(scratch, prints.select("f"), distance, crowd))
    named = prints.join(parts.hint("merge"), F.col("f") == F.col("node"), "left").select("f", "first", F.coalesce("component", "f").alias("c"))
    least = named.groupBy("c").agg(F.min("first").alias("component_id"))
    own = [F.col("c").alias(group)] if group else []
    named = scratch.save(named.join(least.hint("merge"), "c").select(F.col("f").alias("fingerprint"), "component_id", *own), "named")
    # documents of a frequent fingerprint, such as empty ones, are spread by their row
    often = hot(prints, "f", "n", marked.count())
    rows = marked.withColumn("__row", F.monotonically_increasing_id())
    return join_salted(rows, named, "fingerprint", often, "__row").select("doc_id", *also, "fingerprint", "component_id", *([group] if group else []))
