"""Near-duplicates by Jaccard similarity of word shingles: bottom-k sketches, overlaps, exact verification.

A text's set holds its distinct shingles of `shingle` words (A-Z lower-cased); with fewer words, the whole
sequence as one. Texts of equal sets are one node. Texts link where 100 |A & B| >= percent |A | B|.

Sketches: one hash function gives each shingle 64 bits, and a node keeps the k least values of its set.
Inverted lists: for each value, the nodes that retain it. Of two nodes that link, at least half of either's
sketch is in the other's but for a chance of 4e-10 a pair at a similarity of exactly 0.85 (each of the k
least values of the union is in both with that probability); so a node stands only in the lists of its
rarest values, one more than half of them, and such a pair still meets in one. Sets of up to k shingles meet for certain.

Pairs: the members of a list meet its most central one, then `leaders` others, if they aren't in one component
with them: groups in which most link cost a few pairs a member, however large they are. Nodes in lists that still hold
several components meet by their whole sets: in the lists of their rarest shingles, as many as it takes to lose no pair of
the similarity asked for, they meet leaders again; then all members outside a list's largest component
meet every member of another one. So no link between components is lost.

Estimation: of the k least values of the union of two sketches the share that both hold must be a half. Exact: what is left is
compared on the full sets, which are made from the texts again, for members of lists only. Both send a member's
values to its leader, whose rows are dealt to several tasks where they are many.

Shingles are told apart by 64-bit hashes, sets by 128. Null and empty texts, and those without words, have empty sets and
link with nothing: their component is their own id. A null id is never the name of a component unless
all its rows' ids are null. Repeated rows share a component. Texts of any length are taken whole. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ._arrays import LOWER, WHITE, blocks, grams, mix, words
from ._cluster import SALTS, Scratch, components, hot, join_salted, partitions, sieve

K, SHINGLE, PERCENT = 64, 5, 85
ROUNDS, LEADERS = 2, 8
SIEVE_BITS = 26
_U = np.uint64
_SECOND = _U(0xA0761D6478BD642F)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, first): distinct shingle hashes of each text of a block, ascending; text t has values first[t]:first[t+1]."""
    found = words(LOWER[buf], offsets, WHITE)
    h, n = found.hashes(), np.diff(found.first)
    text, rest = found.text_of(), found.rest()
    own, of = [], []
    if len(h):
        g = grams(h, shingle)
        whole = np.flatnonzero(rest[: len(g)] >= shingle)
        own.append(g[whole])
        of.append(text[whole])
        for m in range(1, shingle):
            few = np.flatnonzero(n == m)
            if len(few):
                own.append(grams(h, m)[found.first[few]])
                of.append(few)
    value = np.concatenate(own) if own else np.zeros(0, _U)
    at = np.concatenate(of) if of else np.zeros(0, np.int64)
    order = np.lexsort((value, at))
    value, at = value[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1])
    value, at = value[new], at[new]
    return value, np.searchsorted(at, np.arange(len(n) + 1))


def names_of(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, in two numbers."""
    out = []
    for x in (mix(value), mix(value ^ _SECOND)):
        total = np.zeros(len(x) + 1, _U)
        np.cumsum(x, out=total[1:])
        out.append(mix(total[first[1:]] - total[first[:-1]]).astype(np.int64))
    return out[0], out[1]


def _lists(value: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(first.astype(np.int64)), pa.array(value.astype(np.int64)))


def with_sketch(docs: DataFrame, shingle: int, k: int) -> DataFrame:
    """doc_id, h1, h2 (name of the set), n (its size) and sketch (its k least values, ascending as unsigned numbers)."""
    schema = docs.select("doc_id").schema.add("h1", "long").add("h2", "long").add("n", "long").add("sketch", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, at in blocks(batch):
                value, first = shingle_sets(buf, at, shingle)
                h1, h2 = names_of(value, first)
                n = np.diff(first)
                least = np.minimum(n, k)
                start = np.concatenate([[0], np.cumsum(least)])
                keep = np.repeat(first[:-1], least) + np.arange(start[-1]) - np.repeat(start[:-1], least)
                sketch = _lists(value[keep], start).cast(pa.list_(pa.int64()))
                part = batch.slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(h1), pa.array(h2), pa.array(n), sketch], names=["doc_id", "h1", "h2", "n", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def full_sets(docs: DataFrame, shingle: int, asked: np.ndarray, bits: int) -> DataFrame:
    """(h1, h2, shingles) of sets whose h1 has its bit in `asked`; a task sends a set once, or a few times."""
    share = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit, sent = share.value, set()
        for batch in batches:
            for _, buf, at in blocks(batch):
                value, first = shingle_sets(buf, at, shingle)
                h1, h2 = names_of(value, first)
                place = h1.astype(_U) >> _U(64 - bits)
                hit = np.flatnonzero((bit[(place >> _U(6)).astype(np.int64)] >> (place & _U(63)) & _U(1)).astype(bool) & (np.diff(first) > 0))
                new = []
                for i in hit.tolist():
                    if (name := (int(h1[i]), int(h2[i]))) not in sent:
                        sent.add(name)
                        new.append(i)
                if len(sent) > 1 << 18:
                    sent.clear()
                if new:
                    sets = pa.array([value[first[i] : first[i + 1]].astype(np.int64) for i in new], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(h1[new]), pa.array(h2[new]), sets], names=["h1", "h2", "shingles"])

    return docs.select("text").mapInArrow(run, "h1 long, h2 long, shingles array<bigint>")


def estimate(k: int):
    """Whether half of the union's sketch is in both sketches."""

    def test(a: np.ndarray, b: np.ndarray) -> bool:
        both = np.sort(np.concatenate([a, b]))
        twin = both[1:] == both[:-1]
        keep = np.ones(len(both), bool)
        keep[1:] = ~twin
        union = both[keep][:k]
        return 2 * int(np.count_nonzero(both[1:][twin] <= union[-1])) >= len(union)

    return test


def jaccard(percent: int):
    """Whether the sets' similarity is at least percent / 100, exactly."""

    def test(a: np.ndarray, b: np.ndarray) -> bool:
        both = np.sort(np.concatenate([a, b]))
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        return 100 * common >= percent * (len(a) + len(b) - common)

    return test


def _meet(test):
    """Pairs whose values pass; rows come sorted so that a leader's own row (kind 0) is before its members'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, own = None, None
        for b in batches:
            leads, kinds, members, lists = b.column("lead").to_numpy(), b.column("kind").to_numpy(), b.column("x").to_numpy(), b.column("values")
            value, at = lists.values.to_numpy().astype(_U), lists.offsets.to_numpy()
            good = []
            for i in range(b.num_rows):
                v = value[at[i] : at[i + 1]]
                if kinds[i] == 0:
                    lead, own = leads[i], v.copy()
                elif leads[i] == lead and test(own, v):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(leads[good]), pa.array(members[good])], names=["lead", "x"])

    return run


def meet(pairs: DataFrame, values: DataFrame, test) -> DataFrame:
    """Of distinct pairs (lead, x), those whose values (id, values) pass the test."""
    spark = pairs.sparkSession
    sizes = pairs.groupBy("lead").agg(F.count("*").alias("m"))
    often = F.col("lead").isin(hot(sizes, "lead", "m", pairs.count()) or [None])
    members = pairs.withColumn("salt", F.when(often, F.pmod(F.xxhash64("x"), F.lit(SALTS))).otherwise(0).cast("int"))
    members = members.join(values.withColumnRenamed("id", "x"), "x").select("lead", "salt", F.lit(1).alias("kind"), "x", "values")
    leads = sizes.select("lead", F.explode(F.when(often, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    leads = leads.join(values.withColumnRenamed("id", "lead"), "lead").select("lead", "salt", F.lit(0).alias("kind"), F.col("lead").alias("x"), "values")
    rows = members.unionByName(leads).repartition(partitions(spark), "lead", "salt").sortWithinPartitions("lead", "salt", "kind")
    return rows.select("lead", "kind", "x", "values").mapInArrow(_meet(test), "lead long, x long")


def inverted_lists(values: DataFrame, percent: int) -> DataFrame:
    """values: id, n, s (how many values the node has here) and key -> (key, id, n, core, pos): each node in the lists of its rarest
    values, as many as it takes to meet every node that shares `percent` of its s values; values that no other node
    has are the rarest and make no list. core: how many of a node's values others have, too; pos: the place of the key among the node's, rarest first."""
    counts = values.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    shared = join_salted(values, counts, "key", hot(counts, "key", "df", values.count()), "id")
    mine = Window.partitionBy("id")
    shared = shared.withColumn("rank", F.row_number().over(mine.orderBy("df", "key"))).withColumn("core", F.count("*").over(mine))
    return shared.where(f"s - core + rank <= s - (s * {percent} + 99) div 100 + 1").select("key", "id", "n", "core", F.expr("s - core + rank").alias("pos"))


class _Search:
    """Rounds of pairs over inverted lists."""

    def __init__(self, scratch: Scratch, lists: DataFrame, sketches: DataFrame, sets: DataFrame, k: int, percent: int):
        self.scratch, self.lists, self.sketches, self.sets, self.k, self.percent = scratch, lists, sketches, sets, k, percent
        self.total = lists.count()
        self.whole = False
        self.links: DataFrame | None = None
        self.tested: DataFrame | None = None
        self.parts: DataFrame | None = None

    def open(self) -> DataFrame:
        """(key, id, n, c): members with their components, of lists that hold several."""
        rows = self.lists.withColumn("c", F.col("id"))
        if self.parts is not None:
            named = self.parts.select(F.col("node").alias("id"), F.col("component").alias("own"))
            rows = self.lists.join(named, "id", "left").select("key", "id", "n", "core", "pos", F.coalesce("own", "id").alias("c"))
        state = rows.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("size"))
        self.hot = hot(state, "key", "size", self.total)
        return join_salted(rows, state.where("low < high").select("key"), "key", self.hot, "id")

    def close_enough(self, a: str, b: str, pos_a: str, pos_b: str):
        """Whether sizes allow a link: a common part is no larger than either set; and, of whole sets that have this key as
        the first in common, no larger than what follows it in either. (Those that have one before it meet there.)"""
        sizes = f"100 * least({a}, {b}) >= {self.percent} * greatest({a}, {b})"
        common = f"(1 + least({a} - {pos_a}, {b} - {pos_b}))"
        return F.expr(f"{sizes} and 100 * {common} >= {self.percent} * ({a} + {b} - {common})" if self.whole else sizes)

    def led(self, members: DataFrame, round: int, leaders: int) -> DataFrame:
        """Pairs of the members of lists with a few leaders of these that aren't in one component with them: the most
        central member (copies of one text share most values with it) of each of `leaders` parts of a list, dealt anew each round."""
        part = F.pmod(F.xxhash64("id", F.lit(round)), F.lit(leaders))
        lead = F.struct("core", (-F.col("id")).alias("o"), F.col("id").alias("lead"), F.col("n").alias("m"), F.col("pos").alias("q"), F.col("c").alias("d"))
        own = members.groupBy("key").agg(*(F.max(F.when(part == j, lead)).alias(f"l{j}") for j in range(leaders)))
        rows = join_salted(members, own, "key", self.hot, "id")
        rows = rows.select("id", "n", "pos", "c", F.explode(F.array_compact(F.array(*(f"l{j}" for j in range(leaders))))).alias("l"))
        return rows.where(self.close_enough("n", "l.m", "pos", "l.q") & F.expr("c != l.d")).select(F.col("l.lead").alias("lead"), F.col("id").alias("x"))

    def rest(self, members: DataFrame) -> DataFrame:
        """Pairs of all members outside their list's largest component with all members of others."""
        sizes = members.groupBy("key", "c").agg(F.count("*").alias("size"))
        large = sizes.groupBy("key").agg(F.max(F.struct("size", "c")).alias("l")).select("key", F.col("l.c").alias("large"))
        rows = join_salted(members, large, "key", self.hot, "id")
        outside = rows.where("c != large").select("key", F.col("id").alias("lead"), F.col("n").alias("m"), F.col("pos").alias("q"), F.col("c").alias("d"))
        pairs = join_salted(rows, outside, "key", self.hot, "id").where(self.close_enough("n", "m", "pos", "q") & F.expr("c != d and (c = large or id < lead)"))
        return pairs.select("lead", F.col("id").alias("x"))

    def verify(self, pairs: DataFrame, name: str) -> int:
        """Links of the pairs that were not tested before; the number of all links."""
        unordered = [F.least("lead", "x").alias("a"), F.greatest("lead", "x").alias("b")]
        pairs = pairs.groupBy(*unordered).agg(F.min(F.struct("lead", "x")).alias("p")).select("a", "b", "p.lead", "p.x")
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = self.scratch.save(pairs, f"pairs-{name}")
        own = pairs.select("a", "b")
        self.tested = own if self.tested is None else self.tested.unionByName(own)
        near = pairs.select("lead", "x")
        if not self.whole:  # pairs that whole sets brought together need no estimate
            near = self.scratch.save(meet(near, self.sketches, estimate(self.k)), f"near-{name}")
        found = self.scratch.save(meet(near, self.sets, jaccard(self.percent)), f"links-{name}").select(F.col("lead").alias("a"), F.col("x").alias("b"))
        self.links = found if self.links is None else self.links.unionByName(found)
        self.parts = self.scratch.save(components(self.scratch, self.links, f"parts-{name}"), f"named-{name}")
        return pairs.count()

    def led_rounds(self, name: str, leaders: list[int]) -> DataFrame:
        """One round for each number of leaders; members of lists that still hold several components."""
        for r, n in enumerate(leaders):
            members = self.scratch.save(self.open(), f"open-{name}-{r}")
            if members.isEmpty():
                return members
            self.verify(self.led(members, r, n), f"{name}-{r}")
        return self.scratch.save(self.open(), f"open-{name}")

    def run(self, rounds: int, leaders: int) -> DataFrame | None:
        members = self.led_rounds("sketch", [1, *[leaders] * (rounds - 1)][:rounds])
        if members.isEmpty():
            return self.parts
        # who is left meets by whole sets: lists of their rarest shingles, so many that no link is missed
        left = self.sets.join(members.select("id").distinct(), "id")
        shingles = left.select("id", F.size("values").cast("long").alias("n"), F.size("values").cast("long").alias("s"), F.explode("values").alias("key"))
        self.lists = self.scratch.save(inverted_lists(shingles, self.percent), "shingle-lists")
        self.total, self.whole = self.lists.count(), True
        members = self.led_rounds("shingle", [leaders])
        if not members.isEmpty():
            self.verify(self.rest(members), "rest")
        return self.parts


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, k: int = K, rounds: int = ROUNDS, leaders: int = LEADERS) -> DataFrame:
    """doc_id, n_shingles (long), component_id (the smallest id linked to the document) and kept (whether that is its own)."""
    if percent < 80:
        raise ValueError("lists and estimates are made for similarities of at least 0.8")
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = scratch.save(with_sketch(docs, shingle, k), "marked")
    some = marked.where("n > 0")
    nodes = some.groupBy("h1", "h2").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    nodes = scratch.save(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    values = nodes.select("id", "n", F.size("sketch").cast("long").alias("s"), F.explode("sketch").alias("key"))
    lists = scratch.save(inverted_lists(values, 50), "lists")
    in_lists = lists.select("id").distinct()
    asked = scratch.save(nodes.select("id", "h1", "h2", "n").join(in_lists, "id", "left_semi"), "asked")
    bits = sieve(asked.select(F.col("h1").alias("name")), SIEVE_BITS)
    sets = full_sets(docs, shingle, bits, SIEVE_BITS).join(asked, ["h1", "h2"]).groupBy("id").agg(F.first("shingles").alias("values"))
    sets = scratch.save(sets, "sets")
    parts = _Search(scratch, lists, nodes.select("id", F.col("sketch").alias("values")), sets, k, percent).run(rounds, leaders)

    named = nodes.select("id", "h1", "h2", "first", "rows")
    if parts is not None:
        named = named.join(parts.withColumnRenamed("node", "id"), "id", "left")
    else:
        named = named.withColumn("component", F.col("id"))
    named = named.select("h1", "h2", "first", "rows", F.coalesce("component", "id").alias("c"))
    least = named.groupBy("c").agg(F.min("first").alias("component_id"))
    named = scratch.save(named.join(least, "c").select("h1", "h2", "rows", "component_id"), "named")
    often = hot(named, "h1", "rows", marked.count())
    rows = marked.select("doc_id", "h1", "h2", "n").withColumn("row", F.monotonically_increasing_id())
    own = named.select("h1", F.col("h2").alias("g2"), "component_id")
    linked = join_salted(rows.where("n > 0"), own, "h1", often, "row").where("h2 = g2").select("doc_id", "n", "component_id")
    alone = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
