"""Substring deduplication with suffix automata.

Every window of `span` words whose sequence also starts earlier (smaller id, or earlier in the
same document) is removed with all its words.

1. Winnowing names each window by the least of its word k-grams' hashes, so equal windows
   have equal names. Names with two places or more go to a bit array of a fixed size, which is
   all that is broadcast; what it lets pass wrongly costs time only. A second such array holds names
   with `hot` places or more.
2. Passages (runs of windows of one name) with such names are dealt, with their words, to reference
   shards by name. Of passages with equal bytes in a batch only the first is sent. Windows of a hot name
   go one by one, by a hash of all their words, so that a phrase that stands everywhere, each
   time in other surroundings, is split among shards by these.
3. A shard keeps the first of every distinct passage, builds suffix automata of at most
   `shard_words` words over them in the order of their places, and streams the passages through
   for matching statistics: where at least `span` words match, the state that holds just those
   words knows where they first ended. A window that first ended elsewhere is removed. A passage that
   equals a reference passage byte for byte would match it from end to end, and isn't streamed again.
4. Spans meet their documents again by id and text hash.

Automata of all documents can't be broadcast at 100 TB, nor can each document be streamed past
all shards; windows of a name are in one shard, so documents meet only the automata that can match.

Null and empty texts, and those of fewer than `span` words, are kept whole. Ties (equal id and
place: repeated rows) don't remove each other. A null id comes before all others. Texts of any
length are taken whole. Other columns pass through unless their names clash with the operator's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrays import WHITE, blocks, grams, mix, winnow, words
from ._cluster import Scratch, partitions, sieve

K = 10
SIEVE_BITS = 26
SHARD_WORDS, HOT = 200_000, 4096


class Automaton:
    """Suffix automaton of several word sequences; first[s] is where state s first ended."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.first = [-1], [0], [-1]
        self.last = 0

    def _state(self, length: int, first: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.len.append(length)
        self.first.append(first)
        return len(self.len) - 1

    def add(self, seq: list[int], place: int) -> None:
        """Adds a sequence whose words' places are place, place + 1 and so on."""
        nxt, link, length = self.next, self.link, self.len
        last = 0
        for i, c in enumerate(seq, place):
            if (q := nxt[last].get(c)) is not None:
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._split(last, c, q)
                continue
            cur = self._state(length[last] + 1, i)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = cur

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.len[p] + 1, self.first[q])
        self.next[clone] = self.next[q].copy()
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def earliest(self, seq: list[int], span: int) -> Iterator[tuple[int, int]]:
        """(window's start in seq, place where its words first ended), where `span` words match."""
        nxt, link, length, first = self.next, self.link, self.len, self.first
        s = n = 0
        for i, c in enumerate(seq):
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            if c in nxt[s]:
                s, n = nxt[s][c], n + 1
            while s and length[link[s]] >= span:
                s = link[s]
                n = length[s]
            if n >= span:
                yield i - span + 1, first[s]


def _named(buf: np.ndarray, at: np.ndarray, span: int):
    """Words of a block; per window its start, the place of its name's k-gram, and the name."""
    found = words(buf, at, WHITE)
    g = grams(found.hashes(), K)
    chosen = winnow(g, span - K + 1)
    start = np.flatnonzero(found.rest()[: len(chosen)] >= span)
    return found, start, chosen[start], g


def _names(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, buf, at in blocks(batch):
                _, _, chosen, g = _named(buf, at, span)
                name, n = np.unique(g[np.unique(chosen)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(name.astype(np.int64)), pa.array(n)], names=["name", "n"])

    return run


PASSAGE = "doc long, h long, lo int, hi int, name long, shift int, words binary"
"""Windows lo to hi - 1 of a document, with their words; without: they are removed."""

COLUMNS = [x.split()[0] for x in PASSAGE.split(", ")]


def _in(bit: np.ndarray, bits: int, name: np.ndarray) -> np.ndarray:
    slot = name >> np.uint64(64 - bits)
    return (bit[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _passages(marked, hot, span: int, bits: int):
    """Passages with names in the sieve; those equal to one before them in their batch without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit, hot_bit = marked.value, hot.value
        for batch in batches:
            order = np.argsort(batch.column("doc").to_numpy(), kind="stable")
            batch = batch.take(pa.array(order))
            for rows, buf, at in blocks(batch):
                found, start, chosen, g = _named(buf, at, span)
                some = _in(bit, bits, g[chosen])
                start, chosen = start[some], chosen[some]
                if not len(start):
                    continue
                name, alone = g[chosen], _in(hot_bit, bits, g[chosen])
                if alone.any():
                    name[alone] = grams(found.hashes(), span)[start[alone]]
                text = found.text_of()[start]
                first = np.flatnonzero(np.concatenate([[True], (np.diff(chosen) != 0) | (np.diff(text) != 0) | (np.diff(start) != 1) | alone[1:] | alone[:-1]]))
                last = np.concatenate([first[1:], [len(start)]]) - 1
                doc, h = batch.column("doc").to_numpy()[rows.start : rows.stop], batch.column("h").to_numpy()[rows.start : rows.stop]
                data = buf.tobytes()
                lo, hi, t, name = start[first], start[last], text[first], name[first].astype(np.int64)
                shift, base = np.where(alone[first], 0, chosen[first] - lo), found.first[t]
                seen: dict[tuple[bytes, int], tuple[int, int]] = {}
                sent, gone = [], np.zeros(len(lo), bool)
                for i, (a, b, k, d, p) in enumerate(zip(found.start[lo].tolist(), found.end[hi + span - 1].tolist(), shift.tolist(), doc[t].tolist(), (lo - base).tolist())):
                    own = b" ".join(data[a:b].split())
                    if seen.setdefault((own, k), (d, p)) < (d, p):
                        gone[i] = True
                    else:
                        sent.append(own)
                lo, hi = lo - base, hi - base + 1
                stay = np.flatnonzero(~gone)
                # neighbours among the removed become one span; any task can hold them
                g0, g1, gt = lo[gone], hi[gone], t[gone]
                new = np.flatnonzero(np.concatenate([[True], (gt[1:] != gt[:-1]) | (g0[1:] != g1[:-1])]))[: len(g0)]
                end = np.concatenate([new[1:], [len(g0)]]) - 1 if len(g0) else new
                sent += [None] * len(new)
                lo, hi, t = np.concatenate([lo[stay], g0[new]]), np.concatenate([hi[stay], g1[end]]), np.concatenate([t[stay], gt[new]])
                name, shift = np.concatenate([name[stay], mix(gt[new].astype(np.uint64)).astype(np.int64)]), np.concatenate([shift[stay], np.zeros(len(new), np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[t]), pa.array(h[t]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(name), pa.array(shift.astype(np.int32)), pa.array(sent, pa.binary())],
                    names=COLUMNS,
                )

    return run


def _judge(span: int, shard_words: int):
    """Spans to remove, from passages sorted by name, shift, words and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []
        shard: list[tuple[int, int, int, int, bytes]] = []  # first places of distinct passages
        size = 0
        group: list[tuple[int, int, int, int, bytes]] = []
        name, key = None, None

        def match() -> None:
            shard.sort()
            ids: dict[bytes, int] = {}
            sequences = [[ids.setdefault(w, len(ids)) for w in x[4].split(b" ")] for x in shard]
            own, place, where = Automaton(), 0, []
            for s in sequences:
                where.append(place)
                own.add(s, place)
                place += len(s)
            which = np.repeat(np.arange(len(shard)), [len(s) for s in sequences])
            for i, (s, x) in enumerate(zip(sequences, shard)):
                for at, end in own.earliest(s, span):
                    j = int(which[end])
                    y = shard[j]
                    if (y[0], y[2] + end - where[j] - span + 1) < (x[0], x[2] + at):
                        out.append((x[0], x[1], x[2] + at, x[2] + at + 1))
            shard.clear()

        def batch() -> pa.RecordBatch:
            a = list(zip(*out)) or [[], [], [], []]
            got = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(a, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc", "h", "lo", "hi"])
            out.clear()
            return got

        for b in batches:
            for doc, h, lo, hi, n, shift, text in zip(*(b.column(c).to_pylist() for c in COLUMNS)):
                if text is None:
                    out.append((doc, h, lo, hi))
                    continue
                if n != name:
                    if len(group) > 1:
                        shard += group
                        size += sum(x[3] - x[2] + span for x in group)
                        if size > shard_words:
                            match()
                            size = 0
                    group, name, key = [], n, None
                if (shift, text) != key:
                    key = (shift, text)
                    group.append((doc, h, lo, hi, text))
                elif group[-1][0] < doc or (group[-1][0] == doc and group[-1][2] < lo):
                    out.append((doc, h, lo, hi))
            if len(out) > 50_000:
                yield batch()
        if len(group) > 1:
            shard += group
        if shard:
            match()
        yield batch()

    return run


def repeated_spans(docs: DataFrame, scratch: Scratch, span: int = 20, sieve_bits: int = SIEVE_BITS, shard_words: int = SHARD_WORDS, hot: int = HOT) -> DataFrame:
    """docs(doc, h, text) -> doc, h, cover: [first, past last] of the windows' starts to remove."""
    spark = docs.sparkSession
    n = partitions(spark)
    send = spark.sparkContext.broadcast
    counted = scratch.save(docs.select("text").mapInArrow(_names(span), "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).where("n > 1"), "names")
    marked, often = send(sieve(counted, sieve_bits)), send(sieve(counted.where(F.col("n") >= hot), sieve_bits))
    dealt = docs.mapInArrow(_passages(marked, often, span, sieve_bits), PASSAGE).repartition(n, "name").sortWithinPartitions("name", "shift", "words", "doc", "lo")
    judged = scratch.save(dealt.mapInArrow(_judge(span, shard_words), "doc long, h long, lo int, hi int"), "judged")
    return judged.groupBy("doc", "h").agg(F.collect_set(F.struct("lo", "hi")).alias("cover"))


OWN = ("kept", "n_words", "n_removed", "kept_sha256")


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = 20, outputs: tuple[str, ...] = OWN, drop_text: bool = False, sieve_bits: int = SIEVE_BITS, shard_words: int = SHARD_WORDS, hot: int = HOT) -> DataFrame:
    """df (drop_text: but for its text) with kept (the words left, joined by one space), n_words, n_removed, kept_sha256."""
    if span <= K:
        raise ValueError(f"span must be over {K} words")
    scratch = Scratch(df.sparkSession, "substring")
    kinds = {"kept": T.StringType(), "n_words": T.LongType(), "n_removed": T.LongType(), "kept_sha256": T.StringType()}
    keep = [c for c in df.columns if c not in outputs and not (drop_text and c == text)]
    doc = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))
    h = F.coalesce(F.xxhash64(text), F.lit(0))
    spans = repeated_spans(df.select(doc.alias("doc"), h.alias("h"), F.col(text).alias("text")), scratch, span, sieve_bits, shard_words, hot)
    others = [c for c in keep if c != text]
    row = df.select(F.struct(F.lit(0).alias("_"), *others).alias("row"), F.col(text).alias("text"), doc.alias("doc"), h.alias("h"))
    met = row.join(spans, ["doc", "h"], "left").select("row", "text", "cover")
    same = ["text"] if text in keep else []
    schema = T.StructType([met.schema["row"], *[met.schema[c] for c in same]] + [T.StructField(c, kinds[c]) for c in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n, less, sha = [], [], [], []
            for t, cover in zip(batch.column("text"), batch.column("cover")):
                w = (t.as_py() or "").encode().split()
                n.append(len(w))
                if cover.is_valid:
                    edge = np.zeros(len(w) + 1, np.int64)
                    own = cover.values.flatten()
                    np.add.at(edge, own[0].to_numpy(), 1)
                    np.add.at(edge, np.minimum(own[1].to_numpy() + span - 1, len(w)), -1)
                    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    w = [w[i] for i in stay.tolist()]
                less.append(n[-1] - len(w))
                kept.append(b" ".join(w))
                sha.append(hashlib.sha256(kept[-1]).hexdigest())
            made = {"kept": lambda: pa.array([x.decode() for x in kept], pa.string()), "n_words": lambda: pa.array(n, pa.int64()), "n_removed": lambda: pa.array(less, pa.int64()), "kept_sha256": lambda: pa.array(sha, pa.string())}
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", *same)] + [made[c]() for c in outputs], names=["row", *same, *outputs])

    return met.mapInArrow(run, schema).select(*[F.col("text").alias(c) if c == text else F.col(f"row.{c}") for c in keep], *outputs)
