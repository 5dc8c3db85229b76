"""Katz backoff language model of words: training and scoring.

Tokens are a text's words (A-Z lower-cased) and one end. The model has two orders. Below lies

    base(w) = (c(w) + 1/2) / (N + (V + 1) / 2)

over the V training types and one unknown type. All bigrams of all types are counted. With
Good-Turing discounts d(r) for counts r up to `cutoff`,

    P(w | v) = d(c(vw)) c(vw) / c(v)   where c(vw) > 0,   else   a(v) P(w)

with a(v) such that all words sum to one exactly. A history not seen in training leaves P(w).
Where a caller asks for a `vocabulary`, only so many most frequent types (no tie is broken) have
bigrams of their own; all others are one class, shared out under base. The query asks for none.
Where Good-Turing gives no discount between 0 and 1 for an r, (r - 1/2) / r is taken; a history
all of whose counts are over the cutoff keeps 1 / (c(v) + 1) for other words.

Texts are made into chunks of about `chunk_tokens` tokens: distinct word hashes and each token's place
among them. Chunks send distinct words, then distinct bigrams, with training counts to buckets
by hash; a bucket adds them up, stores its part of the table, and answers each chunk with the
counts of what it sent. Word buckets also number their words. Bigrams go to buckets by their history;
those of the `HOT` most frequent words (and of a text's beginning and others) by a part of `SALTS`
that the second word gives too. Then a bucket sends each chunk the totals and backoff weights of the
histories it asked for; only discounts and the hot histories are broadcast. Words are told apart by 64-bit hashes.

Null and empty texts have one token, the end. A null id is not held out. Without training rows
every word is unknown and has probability base (c = N = V = 0). Repeated rows count and score each by
itself. Texts of any length are taken whole. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import LOWER, WHITE, blocks, mix, words
from ._cluster import Scratch, partitions

CUTOFF, CHUNK_TOKENS, HOT, SALTS = 5, 1 << 20, 256, 32
BUCKET_TOKENS = 8 << 20
"""Tokens for each bucket, which one call holds: there are more buckets than shuffle partitions where these are too few."""
END = np.uint64(0)
BEGIN, OTHERS, FIRST = 0, 1, 2
"""Numbers of a text's beginning, the class of others and the first word."""


def _pack(x: np.ndarray, sort: bool = False) -> bytes:
    """An array compressed; sort: of ascending numbers, by their differences."""
    x = np.diff(x, prepend=x.dtype.type(0)) if sort else x
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T) if len(x) else x
    return zstandard.compress(planes.tobytes(), 1)


def _unpack(data: bytes, kind: str, sort: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    x = np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)
    return np.cumsum(x, dtype=kind) if sort else x


CHUNK = "chunk long, ids binary, nulls binary, held binary, sizes binary, types binary, tokens binary"


def _chunks(chunk_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            ids, nulls, out, sizes, tokens = (np.concatenate(x) for x in zip(*held))
            types, places = np.unique(tokens, return_inverse=True)
            number = int.from_bytes(np.random.default_rng().bytes(8), "little", signed=True)
            row = [number, _pack(ids), _pack(nulls), _pack(out), _pack(sizes), _pack(types, True), _pack(places.astype(np.int32))]
            return pa.RecordBatch.from_arrays([pa.array([row[0]])] + [pa.array([x], pa.binary()) for x in row[1:]], names=[x.split()[0] for x in CHUNK.split(", ")])

        for batch in batches:
            for rows, buf, at in blocks(batch):
                part = batch.slice(rows.start, rows.stop - rows.start)
                found = words(LOWER[buf], at, WHITE)
                n = np.diff(found.first)
                tokens = np.insert(found.hashes(), found.first[1:], END)
                ids = part.column("id")
                held.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), part.column("held").to_numpy(zero_copy_only=False), (n + 1).astype(np.int32), tokens))
                size += len(tokens)
                if size >= chunk_tokens:
                    yield chunk()
                    held.clear()
                    size = 0
        if held:
            yield chunk()

    return run


@dataclass
class Chunk:
    number: int
    ids: np.ndarray
    nulls: np.ndarray
    held: np.ndarray
    sizes: np.ndarray
    types: np.ndarray
    tokens: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Chunk:
        get = lambda c, kind, sort=False: _unpack(row[c], kind, sort)
        return cls(row["chunk"], get("ids", "<i8"), get("nulls", "?"), get("held", "?"), get("sizes", "<i4"), get("types", "<u8", True), get("tokens", "<i4"))

    def trained(self) -> np.ndarray:
        """For each token, whether the model learns from it."""
        return np.repeat(~self.held, self.sizes)

    def pairs(self, numbers: np.ndarray, buckets: int, hot: np.ndarray) -> Pairs:
        """Distinct bigrams; numbers: of the types."""
        own = numbers[self.tokens]
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = BEGIN
        key, at, places = np.unique(before << np.uint64(32) | own, return_index=True, return_inverse=True)
        bucket = _bucket_of(key, buckets, hot)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return Pairs(key[order], bucket[order], at[order], rank[places])


@dataclass
class Pairs:
    """Distinct bigrams (history's number, word's number) in the order of buckets and ascending in
    each, a token where each stands, and the place of each token's."""

    key: np.ndarray
    bucket: np.ndarray
    at: np.ndarray
    places: np.ndarray


def _among(v: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of v are in some, an ascending array that isn't empty."""
    return some[np.minimum(np.searchsorted(some, v), len(some) - 1)] == v


def _bucket_of(key: np.ndarray, buckets: int, hot: np.ndarray) -> np.ndarray:
    v, w = key >> np.uint64(32), key & np.uint64(2**32 - 1)
    salt = np.where(_among(v, hot), mix(w + np.uint64(1)) % np.uint64(SALTS), np.uint64(0))
    return (mix(v << np.uint64(8) | salt) % np.uint64(buckets)).astype(np.int64)


def _asked(key: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether it is hot, whether it is the first of its history and not hot) of each bigram."""
    v = key >> np.uint64(32)
    is_hot = _among(v, hot)
    first = ~is_hot
    first[1:] &= v[1:] != v[:-1]
    return is_hot, first


SENT = "bucket int, chunk long, keys binary, counts binary, below binary"
"""below: training counts of bigrams' last words; -1 for the class of others."""


def _sent(number: int, bucket: np.ndarray, key: np.ndarray, count: np.ndarray, buckets: int, below: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each bucket, from keys in the order of buckets and ascending in each."""
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    own = [b for b in range(buckets) if cut[b] < cut[b + 1]]
    packed = lambda x, sort=False: pa.array([None if x is None else _pack(x[cut[b] : cut[b + 1]], sort) for b in own], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(own, pa.int32()), pa.array([number] * len(own), pa.int64()), packed(key, True), packed(count.astype(np.int64)), packed(below)],
        names=["bucket", "chunk", "keys", "counts", "below"],
    )


def _split_words(x: Chunk, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bucket = ((x.types >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    return bucket, x.types, np.bincount(x.tokens[x.trained()], minlength=len(x.types))


def _send_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = Chunk.of(row)
                yield _sent(x.number, *_split_words(x, buckets), buckets)

    return run


ADDED = "table boolean, bucket int, chunk long, keys binary, counts binary, more binary, repeats array<struct<r: long, n: long>>, chunks array<long>, asked array<binary>"
"""table: all keys of a bucket seen in training, with their counts, how often each count occurs, and
for bigrams the counts of their last words (more) and the histories that chunks asked for. Others: the
counts of the keys that a chunk sent, in their order, and for words their numbers (more)."""


def _add(buckets: int, hot: np.ndarray | None):
    """hot: of bigrams; None for words."""

    def run(key, sent):
        bucket = key[0].as_py()
        read = lambda c, kind, sort=False: [_unpack(x, kind, sort) for x in sent.column(c).to_pylist()]
        keys, chunk = read("keys", "<u8", True), sent.column("chunk").to_pylist()
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, place, np.concatenate(read("counts", "<i8")))
        parts = np.split(place, np.cumsum([len(x) for x in keys])[:-1])
        known = total > 0
        r, n = np.unique(total[known], return_counts=True)
        if hot is None:
            if len(every) * buckets + FIRST >= 1 << 32:
                raise OverflowError("more words than numbers: more shuffle partitions don't help, wider numbers do")
            number = np.empty(len(every), np.uint64)
            number[np.argsort(-total, kind="stable")] = np.arange(len(every), dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket + FIRST)
            more, asked = [None, *(_pack(number[p]) for p in parts)], None
        else:
            below = np.zeros(len(every), np.int64)
            below[place] = np.concatenate(read("below", "<i8"))
            more, asked = [_pack(below[known])] + [None] * len(keys), [_pack((k >> np.uint64(32))[_asked(k, hot)[1]], True) for k in keys]
        m = len(keys)
        return pa.table(
            {
                "table": [True] + [False] * m,
                "bucket": pa.array([bucket] * (m + 1), pa.int32()),
                "chunk": pa.array([None, *chunk], pa.int64()),
                "keys": pa.array([_pack(every[known], True)] + [None] * m, pa.binary()),
                "counts": pa.array([_pack(total[known])] + [_pack(total[p]) for p in parts], pa.binary()),
                "more": pa.array(more, pa.binary()),
                "repeats": pa.array([[{"r": a, "n": b} for a, b in zip(r.tolist(), n.tolist())]] + [None] * m, pa.list_(pa.struct([("r", pa.int64()), ("n", pa.int64())]))),
                "chunks": pa.array([None if asked is None else chunk] + [None] * m, pa.list_(pa.int64())),
                "asked": pa.array([asked] + [None] * m, pa.list_(pa.binary())),
            }
        )

    return run


def _counted(scratch: Scratch, sent: DataFrame, buckets: int, name: str, hot: np.ndarray | None = None) -> DataFrame:
    return scratch.save(sent.groupBy("bucket").applyInArrow(_add(buckets, hot), ADDED), name, "table")


def _frequent(buckets: int):
    """The most frequent words of a bucket's table: number, count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, counts in zip(batch.column("bucket").to_pylist(), batch.column("counts").to_pylist()):
                c = np.sort(_unpack(counts, "<i8"))[::-1][:HOT]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c)) * buckets + bucket + FIRST), pa.array(c)], names=["v", "c"])

    return run


def _repeats(counted: DataFrame) -> dict[int, int]:
    """How many keys have each count; at most sqrt(2 N) rows for N tokens."""
    rows = counted.where("table").select(F.explode("repeats").alias("x")).groupBy("x.r").agg(F.sum("x.n").alias("n"))
    return {r: n for r, n in rows.toLocalIterator()}


def discounts(repeats: dict[int, int], cutoff: int = CUTOFF) -> np.ndarray:
    """d(r) for r from 0 to cutoff + 1 (1 for all from there on)."""
    out = np.ones(cutoff + 2)
    n = [repeats.get(r, 0) for r in range(cutoff + 2)]
    common = (cutoff + 1) * n[cutoff + 1] / n[1] if n[1] else 1.0
    for r in range(1, cutoff + 1):
        found = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        out[r] = found if 0 < found < 1 else (r - 0.5) / r
    return out


@dataclass
class Model:
    tokens: int
    types: int
    vocabulary: np.ndarray | None = None
    """Of a table over numbered classes: its types, and P(w) of each class and the last, others."""
    lower: np.ndarray | None = None
    discount: np.ndarray | None = None
    least: int = 0
    """Words of fewer training occurrences are in the class of others, whose P is `others`."""
    others: float = 0.0
    hot: np.ndarray | None = None
    """Numbers of hot histories, ascending."""
    weights: tuple[np.ndarray, ...] = ()
    """Numbers of those seen, ascending, and their totals, scales and backoff weights."""

    def base(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / (self.tokens + 0.5 * (self.types + 1))

    def below(self, count: np.ndarray) -> np.ndarray:
        return np.where(count < 0, self.others, self.base(count))


def _sums(m: Model, v: np.ndarray, c: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(v, total, discounted total, P of the words seen) of each history, from its bigrams."""
    start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    add = lambda x: np.add.reduceat(x, start) if len(start) else x[:0]
    return v[start], add(c), add(c * m.discount[np.minimum(c, len(m.discount) - 1)]), add(lower)


def _weights(total: np.ndarray, kept: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scale, backoff weight) of each history."""
    kept, rest = kept / total, 1 - seen
    scale = np.where(1 - kept > 1e-9, 1.0, total / (total + 1) / kept)
    full = rest <= 1e-12
    scale[full] = 1 / kept[full]
    return scale, np.where(full, 0.0, (1 - scale * kept) / np.where(full, 1.0, rest))


def _weigh(sent):
    """Backoff weights of each history of a table over numbered classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        k = len(m.vocabulary) + 2
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                key, c = _unpack(keys, "<u8", True).astype(np.int64), _unpack(counts, "<i8")
                v, total, kept, seen = _sums(m, key // k, c, m.lower[key % k])
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(total), *map(pa.array, _weights(total, kept, seen))], names=["v", "total", "scale", "backoff"])

    return run


def _table_sums(m: Model, keys: bytes, counts: bytes, below: bytes, keep) -> tuple[np.ndarray, ...]:
    key, c, lower = _unpack(keys, "<u8", True), _unpack(counts, "<i8"), m.below(_unpack(below, "<i8"))
    v = key >> np.uint64(32)
    some = keep(v)
    return _sums(m, v[some], c[some], lower[some])


def _hot_sums(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("keys", "counts", "more"))):
                v, *sums = _table_sums(sent.value, *row, lambda v: _among(v, sent.value.hot))
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)), *map(pa.array, sums)], names=["v", "total", "kept", "seen"])

    return run


ANSWER = "chunk long, bucket int, kind int, counts binary, more binary"
"""kind 0: counts and numbers of words; 1: counts of bigrams; 2: totals of histories, then their
scales and backoff weights."""


def _answer(sent):
    """Totals (0: not seen) and weights of the histories that chunks asked a bucket for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                v, total, kept, seen = _table_sums(sent.value, row["keys"], row["counts"], row["more"], lambda v: ~_among(v, sent.value.hot))
                # one more, for histories not seen
                v, total, scale, backoff = (np.append(x, y) for x, y in zip((v, total, *_weights(total, kept, seen)), (v.dtype.type(2**64 - 1), 0, 1.0, 1.0)))
                for chunk, asked in zip(row["chunks"], row["asked"]):
                    want = _unpack(asked, "<u8", True)
                    at = np.searchsorted(v, want)
                    at[v[at] != want] = len(v) - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([chunk]), pa.array([row["bucket"]], pa.int32()), pa.array([2], pa.int32()), pa.array([_pack(total[at])], pa.binary()), pa.array([_pack(np.concatenate([scale[at], backoff[at]]))], pa.binary())],
                        names=["chunk", "bucket", "kind", "counts", "more"],
                    )

    return run


def _gathered(got: dict, kind: int, column: int, dtype: str, bucket: np.ndarray, buckets: int, part: int = 0, parts: int = 1) -> np.ndarray:
    """What buckets answered, for keys in the order of buckets."""
    out, cut = np.zeros(len(bucket), dtype), np.searchsorted(bucket, np.arange(buckets + 1))
    for b in range(buckets):
        if cut[b] < cut[b + 1]:
            out[cut[b] : cut[b + 1]] = np.split(_unpack(got[kind, b][column], dtype), parts)[part]
    return out


def _numbered(m: Model, x: Chunk, got: dict, buckets: int) -> tuple[np.ndarray, np.ndarray, Pairs]:
    """Counts of a chunk's types, whether each is in the class of others, and the bigrams."""
    bucket = _split_words(x, buckets)[0]
    count = _gathered(got, 0, 0, "<i8", bucket, buckets)
    others = count < m.least
    return count, others, x.pairs(np.where(others, np.uint64(OTHERS), _gathered(got, 0, 1, "<u8", bucket, buckets)), buckets, m.hot)


def _answers_of(answered: pa.Table) -> dict:
    return {(a["kind"], a["bucket"]): (a["counts"], a["more"]) for a in answered.select(["kind", "bucket", "counts", "more"]).to_pylist()}


def _send_pairs(m: Model, buckets: int):
    def run(key, own: pa.Table, answered: pa.Table) -> pa.Table:
        x = Chunk.of(own.to_pylist()[0])
        count, others, pairs = _numbered(m, x, _answers_of(answered), buckets)
        sent = np.bincount(pairs.places[x.trained()], minlength=len(pairs.key))
        return pa.Table.from_batches([_sent(x.number, pairs.bucket, pairs.key, sent, buckets, np.where(others, -1, count)[x.tokens[pairs.at]])])

    return run


def train(scratch: Scratch, docs: DataFrame, vocabulary: int | None, cutoff: int, chunk_tokens: int) -> tuple[DataFrame, DataFrame, DataFrame, Model, int]:
    """(chunks, answers on words, counted bigrams, model, buckets). docs: id, text, held."""
    spark = docs.sparkSession
    chunks = scratch.save(docs.mapInArrow(_chunks(chunk_tokens), CHUNK), "chunks")
    buckets = max(partitions(spark), chunks.count() * chunk_tokens // BUCKET_TOKENS)
    counted = _counted(scratch, chunks.mapInArrow(_send_words(buckets), SENT), buckets, "words")
    repeats = _repeats(counted)
    m = Model(sum(r * n for r, n in repeats.items()), sum(repeats.values()))
    if vocabulary is not None:
        found, m.least = 0, max(repeats, default=0) + 1
        for r in sorted(repeats, reverse=True):
            if found + repeats[r] > vocabulary:
                break
            found, m.least = found + repeats[r], r
        m.others = max(0.0, 1 - sum(n * m.base(r) for r, n in repeats.items() if r >= m.least))
    top = counted.where("table").select("bucket", "counts").mapInArrow(_frequent(buckets), "v long, c long").orderBy(F.desc("c"), "v").limit(HOT).toArrow()
    m.hot = np.sort(np.append(top.column("v").to_numpy(), [BEGIN, OTHERS])).astype(np.uint64)
    answers = counted.where("not table").select("chunk", "bucket", F.lit(0).alias("kind"), "counts", "more")
    sent = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_send_pairs(m, buckets), SENT)
    pairs = _counted(scratch, sent, buckets, "bigrams", m.hot)
    m.discount = discounts(_repeats(pairs), cutoff)
    # at most HOT + 2 histories, each in SALTS buckets
    hot = pairs.where("table").mapInArrow(_hot_sums(spark.sparkContext.broadcast(m)), "v long, total long, kept double, seen double")
    hot = hot.groupBy("v").agg(*(F.sum(c).alias(c) for c in ("total", "kept", "seen"))).orderBy("v").toArrow()
    v, total, kept, seen = (hot.column(c).to_numpy() for c in ("v", "total", "kept", "seen"))
    m.weights = (v.astype(np.uint64), total, *_weights(total, kept, seen))
    return chunks, answers, pairs, m, buckets


def _log_probability(m: Model, x: Chunk, count: np.ndarray, others: np.ndarray, pairs: Pairs, got: dict, buckets: int) -> np.ndarray:
    """log10 P(w | v) of each token. count, others: of each token."""
    hot, first = _asked(pairs.key, m.hot)
    total, scale, backoff = np.zeros(len(hot), np.int64), np.ones(len(hot)), np.ones(len(hot))
    asked = pairs.bucket[first]
    at = (np.cumsum(first) - 1)[~hot]
    total[~hot] = _gathered(got, 2, 0, "<i8", asked, buckets)[at]
    scale[~hot], backoff[~hot] = (_gathered(got, 2, 1, "<f8", asked, buckets, k, 2)[at] for k in range(2))
    v = pairs.key[hot] >> np.uint64(32)
    at = np.searchsorted(m.weights[0], v)
    known = at < len(m.weights[0])
    known[known] = m.weights[0][at[known]] == v[known]
    for y, z in zip((total, scale, backoff), m.weights[1:]):
        y[np.flatnonzero(hot)[known]] = z[at[known]]
    c = _gathered(got, 1, 0, "<i8", pairs.bucket, buckets)
    seen = c > 0
    own = np.where(total > 0, np.maximum(backoff, 1e-300), 1.0)
    own[seen] = scale[seen] * m.discount[np.minimum(c[seen], len(m.discount) - 1)] * c[seen] / total[seen]
    low = m.base(count)
    share = np.where(others, low / max(m.others, 1e-300), 1.0)
    return np.log10(own)[pairs.places] + np.log10(np.where(seen[pairs.places], share, low))


SCORES = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: int | None = None, cutoff: int = CUTOFF, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document.
    It learns from those whose crc32(id as text) mod 5 is not 1."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "katz")
    held = F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), held.alias("held"))
    chunks, answers, pairs, m, buckets = train(scratch, rows, vocabulary, cutoff, chunk_tokens)
    sent = spark.sparkContext.broadcast(m)
    answers = answers.unionByName(pairs.where("not table").select("chunk", "bucket", F.lit(1).alias("kind"), "counts", "more")).unionByName(pairs.where("table").mapInArrow(_answer(sent), ANSWER))

    def run(key, own: pa.Table, answered: pa.Table) -> pa.Table:
        model, got = sent.value, _answers_of(answered)
        x = Chunk.of(own.to_pylist()[0])
        count, others, found = _numbered(model, x, got, buckets)
        count, others = count[x.tokens], others[x.tokens]
        start = np.cumsum(x.sizes) - x.sizes
        add = lambda y: np.add.reduceat(y, start)
        return pa.table(
            {
                "id": pa.array(x.ids, pa.int64(), mask=x.nulls), "held_out": x.held, "n_tokens": x.sizes.astype(np.int64), "n_known": add((count > 0).astype(np.int64)), "train_tokens": np.full(len(x.ids), model.tokens, np.int64),
                "base_score": add(np.log10(model.base(count))), "score": add(_log_probability(model, x, count, others, found, got, buckets)),
            }
        )

    found = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, SCORES)
    return found.withColumnRenamed("id", "doc_id")
