"""Phrases whose words stand together more often than their parts would, for each language.

Texts (A-Z lower-cased) are split at `.,;:!?` and line ends into pieces, and those into words at spaces and tabs.
f counts a phrase's contiguous occurrences within pieces, overlaps included. Candidates have 2 to 4 words
and f >= least. A cut after the first k words gives l and r, the counts of both sides, and a score
floor(scale * f / (l + r)); the lowest cut counts, the shortest first part of equal ones. A candidate that lies in
a longer one (dropped or not) with at least `absorbed` percent of its count goes; each language's `top` stay.

Chunks: texts become runs of numbers of a chunk's own dictionary, one language a chunk. Words that occur `least` times in their language are numbered
densely over all languages; other words can't be in a candidate, so they break pieces, like a piece's end. The numbers
reach the chunks by a join with their dictionaries, with the word table broadcast only where it is checked to be small.

Counting, for two words, then three, then four: a chunk packs its n-grams into keys of 16 bytes (four numbers of 4
bytes, the first highest, 0 after the last), sorts and counts them, cuts them at range boundaries and sends each range's part as one packed row.
Ranges are sorted by, merged and run-length counted; only counts of at least `least` leave. Boundaries come from a bounded sample of keys and
change the balance only. n-grams with a part known to be rare by a bit array of fixed size (the frequent
shorter n-grams) are not packed: with very many frequent ones the array lets more pass, which costs time, not results.

Null text is empty; null language is `und`. Repeated rows count each. Equal scores rank by count, then by phrase in
UTF-8 order. Texts of any length are taken whole; other columns don't matter; no rows give no rows. Products are
decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._arrays import LOWER, blocks, mix, words
from ._cluster import SALTS, Scratch, hot, join_salted, partitions

LEAST, TOP, SCALE, ABSORBED, LONGEST = 30, 2000, 2_000_000, 80, 4
CHUNK_TOKENS = 1 << 20
RANGE_KEYS = 1 << 21
"""Keys of a range, about: what a task sorts at once."""
SAMPLE = 100_000
"""Keys that boundaries are taken from, at most."""
SMALL_WORDS = 32 << 20
"""Bytes of numbered words up to which they are broadcast."""
SIEVE_BITS = 26
_U = np.uint64

PIECE = np.zeros(256, bool)
PIECE[[ord(c) for c in ".,;:!?"]] = PIECE[0x0A:0x0E] = True
WORD = ~PIECE
WORD[[0x20, 0x09]] = False

CHUNK = "chunk long, lang string, words array<string>, counts array<bigint>, tokens binary"
CODED = "chunk long, n long, tokens binary"
PACKED = "range int, n long, hi binary, lo binary, counts binary"
COUNTED = "hi long, lo long, f long"


def pack(x: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T) if len(x) else x
    return zstandard.compress(planes.tobytes(), 1)


def unpack(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)


def _chunks(chunk_tokens: int):
    """Chunks of one language: its distinct words and counts, and tokens as numbers of these from 1, 0 between pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def chunk(lang: str) -> pa.RecordBatch:
            tables, tokens = zip(*held.pop(lang))
            coded = pa.chunked_array(tables).combine_chunks().dictionary_encode()
            number, at, out = coded.indices.to_numpy().astype(np.int64), 0, []
            for t, own in zip(tables, tokens):
                out.append(np.where(own > 0, number[at + np.maximum(own, 1) - 1] + 1, 0) if len(t) else own)
                at += len(t)
            line = np.concatenate(out).astype("<u4")
            counts = np.bincount(line, minlength=len(coded.dictionary) + 1)[1:].astype(np.int64)
            name = int.from_bytes(np.random.default_rng().bytes(8), "little", signed=True)
            row = [pa.array([name]), pa.array([lang], pa.string()), pa.array([coded.dictionary.to_pylist()], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64())), pa.array([pack(line)], pa.binary())]
            return pa.RecordBatch.from_arrays(row, names=[x.split()[0] for x in CHUNK.split(", ")])

        for batch in batches:
            kinds = batch.column("lang")
            for lang in kinds.unique().to_pylist():
                for _, buf, at in blocks(batch.filter(pc.equal(kinds, lang))):
                    low = LOWER[buf]
                    found = words(low, at, WORD)
                    n = len(found.start)
                    if not n:
                        continue
                    bound = np.zeros(n + 1, np.int64)
                    np.cumsum(found.end - found.start, out=bound[1:])
                    every = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(bound), pa.py_buffer(np.ascontiguousarray(low[WORD[low]]))])
                    coded = every.dictionary_encode()
                    cuts = np.zeros(len(low) + 1, np.int64)
                    np.cumsum(PIECE[low], out=cuts[1:])
                    new = np.zeros(n, bool)
                    new[1:] = cuts[found.start[1:]] > cuts[found.end[:-1]]
                    new[found.first[:-1][found.first[:-1] < n]] = True
                    held.setdefault(lang, []).append((coded.dictionary, np.insert(coded.indices.to_numpy().astype(np.int64) + 1, np.flatnonzero(new), 0)))
                    size += n
                    if size >= chunk_tokens:
                        for x in list(held):
                            yield chunk(x)
                        size = 0
        for x in list(held):
            yield chunk(x)

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens as numbers of frequent words; others, and pieces' ends, are single zeros."""
    for b in batches:
        for row in b.to_pylist():
            number = np.zeros(len(row["counts"]) + 1, "<u4")
            for x in row["known"] or ():
                number[x["place"] + 1] = x["number"]
            line = number[unpack(row["tokens"], "<u4")]
            keep = np.ones(len(line), bool)
            keep[1:] = (line[1:] > 0) | (line[:-1] > 0)
            line = line[keep]
            yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]]), pa.array([len(line)]), pa.array([pack(line)], pa.binary())], names=["chunk", "n", "tokens"])


def _sorted_counts(key: np.ndarray, size: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each stands there (or the sum of its sizes)."""
    if size is None:
        return np.unique(key, return_counts=True)
    order = np.argsort(key, kind="stable")
    key, size = key[order], size[order]
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[cut], np.add.reduceat(size, cut)


def name_of(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return mix(mix(hi) + lo)


def _has(sieve: np.ndarray, bits: int, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    at = name_of(hi, lo) >> _U(64 - bits)
    return (sieve[(at >> _U(6)).astype(np.int64)] >> (at & _U(63)) & _U(1)).astype(bool)


def grams_of(line: np.ndarray, size: int, sieves: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hi, lo, count) of the distinct n-grams of a run of numbers, ascending; sieves: of two words, of three."""
    line = line.astype(_U)
    n = len(line) - size + 1
    if n <= 0:
        return (np.zeros(0, _U),) * 2 + (np.zeros(0, np.int64),)
    good = np.ones(n, bool)
    for j in range(size):
        good &= line[j : j + n] > 0
    two = line[:-1] << _U(32) | line[1:]
    if size > 2:
        common = _has(sieves[0], bits, two, np.zeros(1, _U))
        for j in range(size - 1):
            good &= common[j : j + n]
    if size > 3:
        common = _has(sieves[1], bits, two[:-1], line[2:] << _U(32))
        for j in range(2):
            good &= common[j : j + n]
    at = np.flatnonzero(good)
    if size == 2:
        hi, count = _sorted_counts(two[at])
        return hi, np.zeros(len(hi), _U), count
    first, rank = np.unique(two[at], return_inverse=True)
    key, count = _sorted_counts(rank.astype(_U) << _U(32) | line[at + 2]) if size == 3 else (None, None)
    if size == 3:
        return first[(key >> _U(32)).astype(np.int64)], key << _U(32), count
    last, end = np.unique(two[at + 2], return_inverse=True)
    key, count = _sorted_counts(rank.astype(_U) << _U(32) | end.astype(_U))
    return first[(key >> _U(32)).astype(np.int64)], last[(key & _U(0xFFFFFFFF)).astype(np.int64)], count


def _sampled(size: int, each: int, one_in: int, sieves, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, tokens in zip(b.column("chunk").to_pylist(), b.column("tokens").to_pylist()):
                if chunk % one_in:
                    continue
                hi, _, _ = grams_of(unpack(tokens, "<u4"), size, sieves.value, bits)
                at = np.linspace(0, len(hi) - 1, min(each, len(hi))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hi[at].astype(np.int64)), pa.array(np.full(len(at), len(hi) / max(len(at), 1)))], names=["hi", "weight"])

    return run


def _packed(size: int, bounds: np.ndarray, sieves, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tokens in b.column("tokens").to_pylist():
                hi, lo, count = grams_of(unpack(tokens, "<u4"), size, sieves.value, bits)
                at = np.concatenate([[0], np.searchsorted(hi, bounds), [len(hi)]])
                for r in np.flatnonzero(np.diff(at)).tolist():
                    own = slice(at[r], at[r + 1])
                    row = [pa.array([r], pa.int32()), pa.array([at[r + 1] - at[r]]), *(pa.array([pack(x)], pa.binary()) for x in (np.diff(hi[own], prepend=_U(0)), lo[own], count[own]))]
                    yield pa.RecordBatch.from_arrays(row, names=[x.split()[0] for x in PACKED.split(", ")])

    return run


def _merge(hi: np.ndarray, lo: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((lo, hi)) if lo.any() else np.argsort(hi, kind="stable")
    hi, lo, count = hi[order], lo[order], count[order]
    cut = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])) if len(hi) else np.zeros(0, np.int64)
    return hi[cut], lo[cut], np.add.reduceat(count, cut) if len(cut) else count


def _counted(least: int):
    """Sums of each range's packed rows (sorted by range); those of at least `least` leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, size, merged = None, [], 0, 0

        def close() -> pa.RecordBatch:
            hi, lo, count = _merge(*(np.concatenate(x) for x in zip(*parts)))
            keep = count >= least
            return pa.RecordBatch.from_arrays([pa.array(x[keep].astype(np.int64)) for x in (hi, lo, count)], names=["hi", "lo", "f"])

        for b in batches:
            for row in b.to_pylist():
                if row["range"] != now:
                    if parts:
                        yield close()
                    now, parts, size, merged = row["range"], [], 0, 0
                parts.append((np.cumsum(unpack(row["hi"], "<u8"), dtype=_U), unpack(row["lo"], "<u8"), unpack(row["counts"], "<i8")))
                size += row["n"]
                if size > 4 * RANGE_KEYS + 2 * merged:
                    parts = [_merge(*(np.concatenate(x) for x in zip(*parts)))]
                    size = merged = len(parts[0][0])
        if parts:
            yield close()

    return run


def bit_array(counted: DataFrame, bits: int) -> np.ndarray:
    """A bit for each n-gram; 2**bits bits, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << (bits - 6), _U)
        for b in batches:
            at = name_of(b.column("hi").to_numpy().astype(_U), b.column("lo").to_numpy().astype(_U)) >> _U(64 - bits)
            np.bitwise_or.at(own, (at >> _U(6)).astype(np.int64), _U(1) << (at & _U(63)))
        used = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(own[used].astype(np.int64))], names=["w", "b"])

    out = np.zeros(1 << (bits - 6), _U)
    got = counted.select("hi", "lo").mapInArrow(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out[got.column("w").to_numpy()] = got.column("b").to_numpy().astype(_U)
    return out


def boundaries(coded: DataFrame, chunks: int, size: int, sieves, bits: int) -> np.ndarray:
    """Keys between ranges of about RANGE_KEYS distinct keys of the chunks each."""
    each = max(1, min(512, SAMPLE // max(chunks, 1)))
    got = coded.select("chunk", "tokens").mapInArrow(_sampled(size, each, max(1, chunks // SAMPLE), sieves, bits), "hi long, weight double").toArrow()
    hi, weight = got.column("hi").to_numpy().astype(_U), got.column("weight").to_numpy() * max(1, chunks // SAMPLE)
    order = np.argsort(hi, kind="stable")
    hi, upto = hi[order], np.cumsum(weight[order])
    if not len(hi):
        return np.zeros(0, _U)
    ranges = max(partitions(coded.sparkSession), int(upto[-1] // RANGE_KEYS) + 1)
    return np.unique(hi[np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges)])


def numbered_words(scratch: Scratch, counts: DataFrame, least: int) -> DataFrame:
    """lang, word, f and number (dense, from 1) of the words that occur `least` times."""
    frequent = scratch.save(counts.where(F.col("f") >= least).withColumn("__i", F.monotonically_increasing_id()), "frequent")
    sizes = frequent.groupBy(F.shiftright("__i", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # a row a partition
    at, offsets = 1, {}
    for p, n in sizes:
        offsets[p] = at
        at += n
    start = F.element_at(F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv)), F.shiftright("__i", 33)) if offsets else F.lit(0)
    return scratch.save(frequent.select("lang", "word", "f", (start + F.expr("__i & 8589934591L")).cast("long").alias("number")), "words")


def _part(k: int, n: int) -> tuple[str, str]:
    """SQL of (hi, lo) of the words k to n - 1 of a key."""
    word = lambda i: f"shiftrightunsigned({'hi' if i < 2 else 'lo'}, 32)" if i % 2 == 0 else f"({'hi' if i < 2 else 'lo'} & 4294967295L)"
    own = [word(i) for i in range(k, n)] + ["0L"] * 4
    return f"(shiftleft({own[0]}, 32) | {own[1]})", f"(shiftleft({own[2]}, 32) | {own[3]})"


def frequent_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, chunk_tokens: int = CHUNK_TOKENS, bits: int = SIEVE_BITS) -> tuple[Scratch, DataFrame, DataFrame, DataFrame]:
    """(its tables, words: lang, word, f, number; totals: lang, n; phrases of one to four words: hi, lo, size, f)."""
    spark = docs.sparkSession
    scratch, parts = Scratch(spark, "collocations"), partitions(spark)
    own = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chunks = scratch.save(own.mapInArrow(_chunks(chunk_tokens), CHUNK), "chunks")
    each = chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("lang", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    counts = scratch.save(each.groupBy("lang", "word").agg(F.sum("n").alias("f")), "counts")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    known = numbered_words(scratch, counts, least)

    small = known.agg(F.sum(F.length("word") * 4 + 24)).first()[0] or 0
    places = chunks.select("chunk", "lang", F.posexplode("words").alias("place", "word"))
    if small <= SMALL_WORDS:
        found = places.join(F.broadcast(known.select("lang", "word", "number")), ["lang", "word"])
    else:
        found = places.join(known.select("lang", "word", "number").hint("merge"), ["lang", "word"])
    told = found.groupBy("chunk").agg(F.collect_list(F.struct("place", F.col("number"))).alias("known"))
    coded = chunks.select("chunk", "counts", "tokens").join(told.hint("merge"), "chunk", "left").mapInArrow(_numbered, CODED)
    coded = scratch.save(coded, "coded")
    n, sieves, tables = coded.count(), [], []
    for size in range(2, longest + 1):
        shared = spark.sparkContext.broadcast(list(sieves))
        bounds = boundaries(coded, n, size, shared, bits)
        packed = coded.select("tokens").mapInArrow(_packed(size, bounds, shared, bits), PACKED)
        ranges = packed.repartitionByRange(max(parts, min(len(bounds) + 1, 20_000)), "range").sortWithinPartitions("range")
        tables.append(scratch.save(ranges.mapInArrow(_counted(least), COUNTED), f"phrases-{size}").withColumn("size", F.lit(size)))
        if size < longest:
            sieves.append(bit_array(tables[-1], bits))
    phrases = known.select(F.shiftleft("number", 32).alias("hi"), F.lit(0).cast("long").alias("lo"), "f", F.lit(1).alias("size"))
    for t in tables:
        phrases = phrases.unionByName(t)
    return scratch, known, totals, phrases


def mine(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP, scale: int = SCALE, absorbed: int = ABSORBED, chunk_tokens: int = CHUNK_TOKENS, bits: int = SIEVE_BITS) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score."""
    scratch, known, totals, phrases = frequent_phrases(docs, lang, text, least, LONGEST, chunk_tokens, bits)
    longer = phrases.where("size > 1")

    # inside longer candidates: the greatest count of those that hold a phrase
    inner = []
    for n in (3, 4):
        spans = sorted({(k, m) for k in range(n) for m in range(k + 2, n + 1)} - {(0, n)})
        inner.append(longer.where(F.col("size") == n).select(F.explode(F.array(*(F.expr(f"struct({a} as hi, {b} as lo)") for a, b in (_part(k, m) for k, m in spans)))).alias("x"), "f").select("x.hi", "x.lo", "f"))
    above = inner[0].unionByName(inner[1]).groupBy("hi", "lo").agg(F.max("f").alias("most"))
    left = longer.join(above, ["hi", "lo"], "left").where(f"most is null or cast(100 as decimal(3,0)) * cast(most as decimal(20,0)) < cast({absorbed} as decimal(3,0)) * cast(f as decimal(20,0))")
    left = scratch.save(left.select("hi", "lo", "size", F.col("f").alias("a")), "left")

    # counts of both sides of each cut
    sides = []
    for n in (2, 3, 4):
        cuts = [F.expr(f"struct({k} as k, {s} as side, {h} as ph, {lo} as pl)") for k in range(1, n) for s, (h, lo) in ((0, _part(0, k)), (1, _part(k, n)))]
        sides.append(left.where(F.col("size") == n).select("hi", "lo", "a", F.explode(F.array(*cuts)).alias("x")).select("hi", "lo", "a", "x.k", "x.side", "x.ph", "x.pl"))
    sides = sides[0].unionByName(sides[1]).unionByName(sides[2])
    sides = sides.withColumn("part", F.struct("ph", "pl")).drop("ph", "pl")
    parts = phrases.select(F.struct(F.col("hi").alias("ph"), F.col("lo").alias("pl")).alias("part"), "f")
    keyed = scratch.save(sides, "sides")
    sizes = keyed.groupBy("part").agg(F.count("*").alias("m"))
    frequent = [r[0] for r in sizes.where(F.col("m") > max(64, keyed.count() // 1000)).select(F.xxhash64("part")).collect()]
    by = lambda df: df.withColumn("__h", F.xxhash64("part"))
    told = join_salted(by(keyed), by(parts).withColumnRenamed("part", "own"), "__h", frequent, "hi").where("part = own")
    cut = told.groupBy("hi", "lo", "a", "k").agg(F.max(F.expr("case when side = 0 then f end")).alias("l"), F.max(F.expr("case when side = 1 then f end")).alias("r"))
    score = f"cast((cast({scale} as decimal(18,0)) * cast(a as decimal(20,0))) div cast(l + r as decimal(20,0)) as long)"
    best = cut.withColumn("score", F.expr(score)).groupBy("hi", "lo", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("hi", "lo", "a", "x.score", "x.l", "x.r")
    best = scratch.save(best, "scored")

    # words, and the first of each language; no language meets in one task but for the first of its parts
    spelt = best.select("hi", "lo", F.posexplode(F.expr("filter(array(shiftrightunsigned(hi, 32), hi & 4294967295L, shiftrightunsigned(lo, 32), lo & 4294967295L), x -> x > 0)")).alias("i", "number"))
    numbers = spelt.groupBy("number").agg(F.count("*").alias("m"))
    spelt = join_salted(spelt, known.select("number", "lang", "word"), "number", hot(numbers, "number", "m", spelt.count()), "hi")
    spelt = spelt.groupBy("hi", "lo").agg(F.first("lang").alias("lang"), F.expr("array_join(transform(array_sort(collect_list(struct(i, word))), x -> x.word), ' ')").alias("phrase"))
    rows = best.join(spelt, ["hi", "lo"])
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("hi", "lo"), F.lit(SALTS))).orderBy(*order))).where(F.col("__r") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
