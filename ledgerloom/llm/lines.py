"""Line deduplication over content-defined chunks of lines.

Each line is hashed; a rolling hash over `ROLL` line hashes ends a chunk where its low bit is
zero, so boundaries depend on nearby lines only and fall into place again after an insertion.
Chunks have `LEAST` to `MOST` lines; a text's last line alone joins the chunk before it. A text is cut
by `RULES` such rules, so that what one leaves at the edges of a repeated passage another catches. Of
chunks of two lines or more with equal bytes, anywhere, the first by id and line stays and all
others are removed.

Hashes of chunks with two places or more go to a bit array of fixed size; chunks that it lets
pass are dealt by hash and compared byte for byte. Of equal chunks in a batch only the first is sent.

Null and empty texts have one empty line and stay as they are. Ties (equal id and line: repeated
rows) don't remove each other. A null id comes before all others. Texts of any length are taken
whole. Other columns pass through unless their names clash with the operator's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrays import mix
from ._cluster import Scratch, partitions, sieve

ROLL, LEAST, MOST, RULES = 2, 2, 32, 3
SIEVE_BITS = 26


def chunks(text: bytes) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Lines of a text, and the [first, past last] lines of its chunks by all rules, in order."""
    lines = text.split(b"\n")
    n = len(lines)
    if n <= LEAST:
        return lines, [(0, n)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, n)
    rolled = h.copy()
    for j in range(1, ROLL):
        rolled[j:] ^= h[:-j] << np.uint64(j) | h[:-j] >> np.uint64(64 - j)
    ends, out = mix(rolled), set()
    for rule in range(RULES):
        out.update(_cut(np.flatnonzero((ends >> np.uint64(rule) & np.uint64(1)) == 0) + 1, n))
    return lines, sorted(out)


def _cut(ends: np.ndarray, n: int) -> list[tuple[int, int]]:
    out, lo = [], 0
    for end in [*ends.tolist(), n]:
        while end - lo > MOST:
            out.append((lo, lo + MOST))
            lo += MOST
        if end - lo >= LEAST:
            out.append((lo, end))
            lo = end
    if lo < n:
        # fewer lines than a chunk has: they join the one before
        out[-1:] = [(out[-1][0], n)]
    return out


def _texts(column) -> Iterator[bytes]:
    for x in column:
        yield (x.as_py() or "").encode()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[int] = []
        for t in _texts(batch.column("text")):
            lines, own = chunks(t)
            found += [xxhash.xxh64_intdigest(b"\n".join(lines[a:b])) for a, b in own if b - a > 1]
        name, n = np.unique(np.array(found, np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(name.astype(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], names=["name", "n"])


CHUNK = "doc long, h long, lo int, hi int, name long, bytes binary"
"""Lines lo to hi - 1 of a document with their bytes; without bytes: they are removed."""


def _candidates(marked, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = marked.value
        for batch in batches:
            batch = batch.take(pa.array(np.argsort(batch.column("doc").to_numpy(), kind="stable")))
            out, size, seen = [], 0, {}

            def rows() -> pa.RecordBatch:
                a = list(zip(*out)) or [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(a, kinds)], names=["doc", "h", "lo", "hi", "name", "bytes"])

            for doc, h, t in zip(batch.column("doc").to_pylist(), batch.column("h").to_pylist(), _texts(batch.column("text"))):
                lines, own = chunks(t)
                for a, b in own:
                    if b - a < 2:
                        continue
                    whole = b"\n".join(lines[a:b])
                    name = xxhash.xxh64_intdigest(whole)
                    slot = name >> (64 - bits)
                    if not int(bit[slot >> 6]) >> (slot & 63) & 1:
                        continue
                    signed = name - (1 << 64) if name >> 63 else name
                    if seen.setdefault(whole, (doc, a)) < (doc, a):
                        if out and out[-1][0] == doc and out[-1][1] == h and out[-1][3] == a and out[-1][5] is None:
                            out[-1] = (doc, h, out[-1][2], b, out[-1][4], None)
                        else:
                            out.append((doc, h, a, b, signed, None))
                    else:
                        out.append((doc, h, a, b, signed, whole))
                        size += len(whole)
                if size > 4_000_000 or len(out) > 50_000:
                    yield rows()
                    out, size, seen = [], 0, {}
            yield rows()

    return run


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks to remove, from chunks sorted by name, bytes and place."""
    first = None
    for b in batches:
        out = []
        for doc, h, lo, hi, name, whole in zip(*(c.to_pylist() for c in b.columns)):
            if whole is None:
                out.append((doc, h, lo, hi))
            elif first is None or first[0] != name or first[1] != whole:
                first = (name, whole, doc, lo)
            elif (first[2], first[3]) < (doc, lo):
                out.append((doc, h, lo, hi))
        a = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(a, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc", "h", "lo", "hi"])


OWN = ("kept", "n_lines", "n_removed", "kept_sha256")


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = OWN, drop_text: bool = False, sieve_bits: int = SIEVE_BITS) -> DataFrame:
    """df (drop_text: but for its text) with kept (lines left), n_lines, n_removed, kept_sha256."""
    spark = df.sparkSession
    scratch = Scratch(spark, "lines")
    kinds = {"kept": T.StringType(), "n_lines": T.LongType(), "n_removed": T.LongType(), "kept_sha256": T.StringType()}
    keep = [c for c in df.columns if c not in outputs and not (drop_text and c == text)]
    others = [c for c in keep if c != text]
    doc = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))
    row = df.select(F.struct(F.lit(0).alias("_"), *others).alias("row"), F.col(text).alias("text"), doc.alias("doc"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"))
    texts = row.select("doc", "h", "text")
    counted = texts.select("text").mapInArrow(_hashes, "name long, n tinyint").groupBy("name").agg(F.sum("n").alias("n")).where("n > 1")
    marked = spark.sparkContext.broadcast(sieve(counted, sieve_bits))
    dealt = texts.mapInArrow(_candidates(marked, sieve_bits), CHUNK).repartition(partitions(spark), "name", F.when(F.col("bytes").isNull(), F.col("doc")))
    gone = scratch.save(dealt.sortWithinPartitions("name", "bytes", "doc", "lo").mapInArrow(_copies, "doc long, h long, lo int, hi int"), "gone")
    met = row.join(gone.groupBy("doc", "h").agg(F.collect_set(F.struct("lo", "hi")).alias("cover")).hint("merge"), ["doc", "h"], "left").select("row", "text", "cover")
    same = ["text"] if text in keep else []
    schema = T.StructType([met.schema["row"], *[met.schema[c] for c in same]] + [T.StructField(c, kinds[c]) for c in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n, less, sha = [], [], [], []
            for t, cover in zip(_texts(batch.column("text")), batch.column("cover")):
                lines = t.split(b"\n")
                n.append(len(lines))
                if cover.is_valid:
                    for x in cover.as_py():
                        lines[x["lo"] : x["hi"]] = [None] * (x["hi"] - x["lo"])  # spans may overlap
                    lines = [x for x in lines if x is not None]
                less.append(n[-1] - len(lines))
                kept.append(b"\n".join(lines))
                sha.append(hashlib.sha256(kept[-1]).hexdigest())
            made = {"kept": lambda: pa.array([x.decode() for x in kept], pa.string()), "n_lines": lambda: pa.array(n, pa.int64()), "n_removed": lambda: pa.array(less, pa.int64()), "kept_sha256": lambda: pa.array(sha, pa.string())}
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", *same)] + [made[c]() for c in outputs], names=["row", *same, *outputs])

    return met.mapInArrow(run, schema).select(*[F.col("text").alias(c) if c == text else F.col(f"row.{c}") for c in keep], *outputs)
