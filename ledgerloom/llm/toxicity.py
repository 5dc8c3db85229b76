"""Toxicity by compression distance.

Two zstandard dictionaries are trained by zstandard's own trainer, one on toxic and one on ordinary
text. A text's windows are compressed with both, and how much shorter the toxic dictionary makes
them is summed up in a few figures: the most, the mean of the three most, counts and shares of
windows that gain 1 to 8 bytes, and the mean. A logistic curve, fitted on training rows, calibrates
them to a score; its threshold is 0.5.

Both dictionaries begin with the same ordinary content, so that they differ only by what toxic text
adds. The toxic one is trained on the passages of toxic texts that hold telling strings: byte strings
of `SIZES` in more than twice as large a share of toxic texts as of others, with a likelihood ratio
that leaves less than one false string to expect among all those tested, however large the sample.

Training takes at most `toxic` and `ordinary` labelled documents (these bounds are parameters), those
of the least hash of their ids, each with its whole text. Of near copies with one label only the first
trains, as every string of a document would seem telling if it came a hundred times. Strings are
counted, passages found and windows measured by executors; the driver gets telling strings, passages, and a row of figures for each
sampled document. The figures that the curve is fitted on come from dictionaries trained without the
fold a document is in, so that no document is measured against itself. With no training rows of
one class, every score is the share of the other (0.5 with none at all).

Null and empty texts have a score too (one empty window). Repeated rows score alike; of rows with one
labelled id and several texts the one of the least hash trains. Rows of `labels` with null or other
values are left out; with labels that contradict, toxic wins. Texts of any length are taken whole.
Other columns pass through unless their names clash with the operator's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ._arrays import WHITE, grams, mix, words
from ._cluster import Scratch

TOXIC, ORDINARY = 1200, 3600
WINDOW, OVERLAP = 32, 8
SHARED, OWN_BYTES = 16384, 8192
SIZES, FOLDS, GAINS = (6, 8), 4, 8
BANDS, BAND = 16, 3
"""Sampled texts with one label that share the least hashes of a band's permutations, over shingles
of five words, are near copies: all but surely from a similarity of 0.8 on, hardly ever below 0.2."""
FIGURES = 2 * GAINS + 5


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    mean: tuple[float, ...] = (0.0,) * FIGURES
    scale: tuple[float, ...] = (1.0,) * FIGURES
    weights: tuple[float, ...] = (0.0,) * (FIGURES + 1)


def plain(text: str | None) -> bytes:
    return b" " + b" ".join((text or "").encode().lower().split()) + b" "


def _strings(data: bytes, size: int) -> np.ndarray:
    """The byte strings of a size as numbers, one for each place."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(raw) - size + 1), np.uint64)
    for j in range(size):
        out = out << np.uint64(8) | raw[j : j + len(out)]
    return out


# ---- the sample


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds = mix(np.arange(1, BANDS * BAND + 1, dtype=np.uint64))
    for batch in batches:
        out = []
        for t in batch.column("t"):
            s = np.frombuffer(plain(t.as_py()), np.uint8)
            found = words(s, np.array([0, len(s)]), WHITE).hashes()
            h = grams(found, 5) if len(found) >= 5 else np.array([xxhash.xxh64_intdigest(s.tobytes())], np.uint64)
            least = np.array([mix(h ^ x).min() for x in seeds]).reshape(BANDS, BAND)
            out.append(mix(least[:, 0] ^ mix(least[:, 1] ^ mix(least[:, 2] + np.arange(BANDS, dtype=np.uint64)))).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("o"), batch.column("y"), pa.array([x.tolist() for x in out], pa.list_(pa.int64()))], names=["o", "y", "bands"])


def distinct(sample: DataFrame) -> DataFrame:
    """The sample without near copies of one label; its sketches are bounded as it is."""
    got = sample.mapInArrow(_sketches, "o long, y int, bands array<long>").orderBy("o", "y").toArrow()
    seen: set[tuple[int, int]] = set()
    stay = []
    for o, y, bands in zip(*(got.column(c).to_pylist() for c in ("o", "y", "bands"))):
        own = {(y, x) for x in bands}
        if not own & seen:
            stay.append((o,))
        # a copy's copies are copies as well
        seen |= own
    return sample.join(F.broadcast(sample.sparkSession.createDataFrame(stay, "o long")), "o", "left_semi")


# ---- telling strings


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of each fold and label hold a string; added up over some texts at a time."""
    names = [f"{c}{f}" for c in "ab" for f in range(FOLDS)]
    held: list[tuple[np.ndarray, int]] = []
    size = 0

    def rows() -> pa.RecordBatch:
        key, place = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        n = np.zeros((len(names), len(key)), np.int32)
        np.add.at(n, (np.repeat([c for _, c in held], [len(x) for x, _ in held]), place), 1)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *map(pa.array, n)], names=["g", *names])

    for batch in batches:
        for t, y, fold in zip(batch.column("t"), batch.column("y").to_pylist(), batch.column("fold").to_pylist()):
            s = plain(t.as_py())
            x = np.unique(np.concatenate([_strings(s, k) for k in SIZES]))
            held.append((x, fold if y else FOLDS + fold))
            size += len(x)
            if size > 2_000_000:
                yield rows()
                held, size = [], 0
    if held:
        yield rows()


def _least_gain(tested: int) -> float:
    """The likelihood ratio that chance passes once in `tested` times (chi-square, one degree)."""
    lo, hi = 0.0, 400.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erfc(math.sqrt(mid / 2)) * max(tested, 1) > 1 else (lo, mid)
    return hi


def telling(sample: DataFrame, scratch: Scratch, sizes: dict[tuple[int, int], int], ratio: float = 2.0, least: int = 3) -> list[np.ndarray]:
    """The telling strings of the texts outside each fold, and at the end of all texts.

    sizes: how many texts there are by (fold, label)."""
    names = [f"{c}{f}" for c in "ab" for f in range(FOLDS)]
    counted = sample.mapInArrow(_count, "g long, " + ", ".join(f"{x} int" for x in names)).groupBy("g").agg(*(F.sum(x).alias(x) for x in names))
    # strings that too few toxic texts hold are never tested
    counted = scratch.save(counted.where(" + ".join(f"a{f}" for f in range(FOLDS)) + f" >= {least}"), "strings")
    out = []
    for without in range(FOLDS + 1):
        rest = [f for f in range(FOLDS) if f != without]
        n1, n0 = (float(sum(sizes.get((f, y), 0) for f in rest)) for y in (1, 0))
        if not n1 or not n0:
            out.append(np.zeros(0, np.uint64))
            continue
        a, b = (sum((F.col(f"{c}{f}") for f in rest), F.lit(0)).cast("double") for c in "ab")
        own = counted.select("g", a.alias("a"), b.alias("b")).where(F.col("a") >= least)
        term = lambda n, of, share: F.when(n > 0, n * F.log(n / of / share)).otherwise(0.0)
        share = (F.col("a") + F.col("b")) / (n1 + n0)
        gain = 2 * (term(F.col("a"), n1, share) + term(F.col("b"), n0, share) + term(n1 - F.col("a"), n1, 1 - share) + term(n0 - F.col("b"), n0, 1 - share))
        good = own.withColumn("gain", gain).where((F.col("a") / n1 > ratio * (F.col("b") + 0.5) / n0) & (F.col("gain") >= _least_gain(own.count())))
        got = good.select("g").toArrow()
        out.append(np.sort(got.column("g").to_numpy().view(np.uint64)))
    return out


# ---- dictionaries


def _among(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x if len(some) else np.zeros(len(x), bool)


def passages(s: bytes, strings: np.ndarray) -> list[bytes]:
    """The longest passages of a text that telling strings cover."""
    edge = np.zeros(len(s) + 1, np.int32)
    for k in SIZES:
        hit = np.flatnonzero(_among(_strings(s, k), strings))
        edge[hit] += 1
        edge[hit + k] -= 1
    cover = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
    return [s[a:b] for a, b in np.flatnonzero(np.diff(cover)).reshape(-1, 2).tolist()]


def _material(sent):
    """What dictionaries are trained on: passages of toxic texts for each fold left out (the last: none),
    and ordinary texts whole, cut into windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, bytes]] = []
            for t, y, fold in zip(batch.column("t"), batch.column("y").to_pylist(), batch.column("fold").to_pylist()):
                s = plain(t.as_py())
                if y:
                    out += [(without, 1, x) for without, own in enumerate(sent.value) if without != fold for x in passages(s, own)]
                else:
                    out += [(fold, 0, s[i : i + 64]) for i in range(0, len(s), 64)]
            fold, y, data = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(fold, pa.int32()), pa.array(y, pa.int32()), pa.array(data, pa.binary())], names=["fold", "y", "data"])

    return run


def _trained(size: int, samples: list[bytes], k: int, d: int) -> bytes:
    """A trained dictionary; the samples themselves, each once, where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """(toxic, ordinary), equally long and with the same beginning; empty without toxic passages."""
    if not toxic:
        return b"", b""
    own = _trained(OWN_BYTES, toxic, 24, 8)
    base = _trained(SHARED + len(own), ordinary, 64, 6).rjust(SHARED + len(own))
    shared = base[-SHARED:]
    return shared + own, shared + base[:-SHARED][-len(own) :]


@lru_cache(16)
def compressor(content: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters(compression_level=6, min_match=6, strategy=zstandard.STRATEGY_LAZY2, window_log=14, hash_log=17, chain_log=17, search_log=8, write_content_size=False, write_dict_id=False)
    # as plain content: texts this short pay for own entropy tables more than these tell of them
    own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(compression_params=settings, dict_data=own)


def lengths(content: bytes, windows: list[bytes]) -> np.ndarray:
    got = compressor(content).multi_compress_to_buffer(windows)
    return np.fromiter(map(len, got), np.int64, len(windows))


def figures(texts: list[str | None], toxic: bytes, ordinary: bytes) -> np.ndarray:
    """A row for each text; windows of many texts are compressed together."""
    if not texts or not toxic:
        return np.zeros((len(texts), FIGURES))
    windows, counts, gain = [], [], []

    def measure() -> None:
        gain.append(lengths(ordinary, windows) - lengths(toxic, windows))
        windows.clear()

    for t in texts:
        s, before = plain(t), sum(map(len, gain)) + len(windows)
        for i in range(0, max(1, len(s) - OVERLAP), WINDOW):
            windows.append(s[i : i + WINDOW + OVERLAP])
            if len(windows) == 20_000:
                measure()
        counts.append(sum(map(len, gain)) + len(windows) - before)
    if windows:
        measure()
    every, n = np.concatenate(gain), np.array(counts)
    start = np.cumsum(n) - n
    rows = np.repeat(np.arange(len(texts)), n)
    ordered = every[np.lexsort((-every, rows))]
    three = sum(np.where(n > k, ordered[np.minimum(start + k, len(every) - 1)], 0) for k in range(3)) / np.minimum(n, 3)
    over = [np.add.reduceat((every >= k).astype(float), start) for k in range(1, GAINS + 1)]
    mean = np.add.reduceat(every, start) / n
    return np.stack([ordered[start], three, *(x / n for x in over), *map(np.log1p, over), mean, mean * np.sqrt(n), np.log1p(n)], 1)


# ---- calibration


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    b = np.zeros(x.shape[1])
    keep = ridge * np.eye(len(b))
    keep[0, 0] = 0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(len(b)), x.T @ (p - y) + keep @ b)
    return b


def calibrated(x: np.ndarray, y: np.ndarray, toxic: bytes, ordinary: bytes) -> Model:
    mean, scale = x.mean(0), x.std(0) + 1e-9
    return Model(toxic, ordinary, *(tuple(v.tolist()) for v in (mean, scale, _curve((x - mean) / scale, y))))


def score(texts: list[str | None], model: Model) -> np.ndarray:
    x = (figures(texts, model.toxic, model.ordinary) - np.array(model.mean)) / np.array(model.scale)
    b = np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(b[0] + x @ b[1:], -30, 30)))


def held_out(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about a million characters."""
    lo, size = 0, 0
    for hi, t in enumerate(texts, 1):
        size += len(t or "")
        if size > 1_000_000:
            yield lo, hi
            lo, size = hi, 0
    if lo < len(texts):
        yield lo, len(texts)


def _measured(sent):
    """Figures of each document by the dictionaries trained without its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, folds = batch.column("t").to_pylist(), np.array(batch.column("fold").to_pylist())
            x = np.zeros((len(texts), FIGURES))
            for f in np.unique(folds).tolist():
                own = np.flatnonzero(folds == f)
                for lo, hi in _blocks([texts[i] for i in own]):
                    x[own[lo:hi]] = figures([texts[i] for i in own[lo:hi]], *sent.value[f])
            yield pa.RecordBatch.from_arrays([batch.column("o"), batch.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["o", "y", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", toxic: int = TOXIC, ordinary: int = ORDINARY) -> Model:
    """Learns from labelled rows that are not held out; at most toxic + ordinary of them."""
    spark = ship(docs.sparkSession)
    send, scratch = spark.sparkContext.broadcast, Scratch(spark, "toxicity")
    rows = labels.select(F.col(doc_id).alias("i"), F.col(label).alias("y")).where("i is not null and y in (0, 1)").where(~held_out("i")).groupBy("i").agg(F.max("y").cast("int").alias("y"))
    # labels without a document take no place in the sample
    rows = rows.join(docs.select(F.col(doc_id).alias("i")), "i", "left_semi").withColumn("o", F.xxhash64("i"))
    some = rows.where("y = 1").orderBy("o", "i").limit(toxic).unionByName(rows.where("y = 0").orderBy("o", "i").limit(ordinary))
    # at most toxic + ordinary ids and numbers are broadcast; one text stays of each id
    met = docs.select(F.col(doc_id).alias("i"), F.struct(F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"), F.col(text).alias("t")).alias("x")).join(F.broadcast(some), "i")
    met = met.groupBy("i", "y", "o").agg(F.min("x").alias("x")).select("i", "y", "o", F.pmod(F.xxhash64("o", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold"), F.col("x.t").alias("t"))
    sample = scratch.save(distinct(scratch.save(met, "labelled")), "sample")
    known = sample.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()
    n = {y: sum(r.n for r in known if r.y == y) for y in (0, 1)}
    if not n[0] or not n[1]:
        p = float(np.clip(n[1] / (n[0] + n[1]), 0.001, 0.999)) if n[0] + n[1] else 0.5
        scratch.remove()
        return Model(b"", b"", weights=(math.log(p / (1 - p)), *(0.0,) * FIGURES))
    strings = telling(sample, scratch, {(r.fold, r.y): r.n for r in known})
    got = sample.mapInArrow(_material(send(strings)), "fold int, y int, data binary").orderBy("fold", "y", "data").toArrow()
    fold, y, data = (got.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "y", "data"))
    pairs = [dictionaries(list(data[(y == 1) & (fold == f)]), list(data[(y == 0) & (fold != f)])) for f in range(FOLDS + 1)]
    seen = sample.mapInArrow(_measured(send(pairs[:FOLDS])), "o long, y int, x array<double>").orderBy("o", "y").toArrow()
    x = np.array(seen.column("x").to_pylist(), float)
    scratch.remove()
    return calibrated(x, seen.column("y").to_numpy().astype(float), *pairs[FOLDS])


OWN = ("held_out", "score", "predicted")


def classify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with held_out, score and predicted."""
    spark = ship(docs.sparkSession)
    keep = [c for c in docs.columns if c not in OWN]
    schema = docs.select(*keep).schema.add("score", "double")
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            out = [score(texts[lo:hi], sent.value) for lo, hi in _blocks(texts)] or [np.zeros(0)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(np.concatenate(out))], names=[*keep, "score"])

    made = docs.select(*keep).mapInArrow(run, schema)
    return made.select(*keep, F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
