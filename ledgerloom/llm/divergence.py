"""How the words of each source of a language diverge from those of its other sources and of the language.

Terms are runs of letters (A-Z lower-cased) and of characters beyond ASCII. A language keeps the terms
that stand in at least `least_docs` of its documents: V terms. A giver, that is a (lang, source) group or
a whole language, with `count` occurrences of a kept term among N of all kept terms gives it

    p = 1 + floor(10**9 (count + 1) / (N + V))

and p diverges from q by f(p, q) = floor((p - q)**2 / q). Two parts come out: `pair`, the sum of f over
all kept terms between a group and each other source of its language, and `term`, the `top` terms that
the group uses and more than its language does.

Runs: tasks write (lang, term, source, document) runs with the number of documents and occurrences, added up
over what a task holds. They are dealt by (lang, term) and sorted by all four, terms first; one scan of the runs adds up
document frequency and counts and keeps or drops a term. A second scan, with the groups' sums beside the
counts, emits partial sums of pairs of sources that have a term in common, and partial best terms, per
run. Nothing is held but one term's sources, and sums of bounded number.

Terms that one or both sources of a pair lack need no pairs of rows. With p0 the p of count 0,

    sum f(p, q) = V f(p0, q0) + sum over terms of s (f(p, q0) - f(p0, q0)) + sum over terms of t
                  (f(p0, q) - f(p0, q0)) + sum over terms of both (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))

and the middle sums need only how many terms of a group have each count.

Null text, lang and source are ''. A document is a row: repeated rows and ids count each by themselves. A
language without kept terms has V = 0 and pairs of value 0; a group without terms gives p0. Equal values rank
by item. Texts of any length are taken whole; other columns don't matter. No rows give no rows. All numbers are integers;
sums pass through 64 bits while V is below 5 * 10**8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._arrays import LOWER, blocks, words
from ._cluster import Scratch, hot, join_salted, partitions

LEAST_DOCS, TOP = 3, 200
HELD_RUNS, HELD_BYTES = 1 << 19, 24 << 20
"""Runs that a task holds before it sends them."""
SMALL_GROUPS = 50_000
"""Groups up to which their sums are broadcast; more are joined."""
SCALE = 10**9
ORDER = ["term", "lang", "source"]
"""Terms come first: rows are compared by the first bytes of the first column, and languages are few."""

LETTERS = np.ones(256, bool)
LETTERS[0x00:0x41] = LETTERS[0x5B:0x61] = LETTERS[0x7B:0x80] = False
"""Bytes of `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`."""

RUN = "lang string, term string, source string, document long, docs long, n long"
KEPT = "lang string, term string, source string, n long, total long, first int"
FOUND = "part string, lang string, source string, item string, value long"


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 (count + 1) / whole), by long division in base 1000; exact while whole is below 9 * 10**15."""
    rest, out = count + 1, np.zeros(len(count), np.int64)
    over, rest = rest // whole, rest % whole
    out += over
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return 1 + out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _strings(buf: np.ndarray, keep: np.ndarray, size: np.ndarray) -> pa.Array:
    """Words as an Arrow array: the bytes of buf where keep holds, cut into pieces of the sizes given."""
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(buf[keep]))])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of (lang, term, source) over what the task holds; documents are whole in it."""
    names = ["group", "term", "document", "docs", "n"]
    kinds = pa.schema([("group", pa.int32()), ("term", pa.large_string()), ("document", pa.int64()), ("docs", pa.int64()), ("n", pa.int64())])
    groups: dict[tuple[str, str], int] = {}
    held: list[pa.Table] = []
    size = space = 0

    def added() -> pa.Table:
        t = pa.concat_tables(held)
        held.clear()
        t = t.group_by(["group", "term"], use_threads=False).aggregate([("document", "min"), ("docs", "sum"), ("n", "sum")]).rename_columns(names)
        pa.default_memory_pool().release_unused()
        return t

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        by = list(groups)
        lang, source = pa.array([x[0] for x in by], pa.string()), pa.array([x[1] for x in by], pa.string())
        for b in t.to_batches(max_chunksize=1 << 15):
            g = b.column("group")
            yield pa.RecordBatch.from_arrays([lang.take(g), b.column("term").cast(pa.string()), source.take(g), *b.columns[2:]], names=[x.split()[0] for x in RUN.split(", ")])

    for batch in batches:
        own = [groups.setdefault(x, len(groups)) for x in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())]
        own, documents = np.array(own, np.int64), batch.column("document").to_numpy()
        for rows, buf, at in blocks(batch):
            low = LOWER[buf]
            found = words(low, at, LETTERS)
            if not len(found.start):
                continue
            coded = _strings(low, LETTERS[low], found.end - found.start).dictionary_encode()
            term, doc = coded.indices.to_numpy().astype(np.int64), found.text_of()
            m = rows.stop - rows.start
            each, n = np.unique(term * m + doc, return_counts=True)
            run = (each // m) << 32 | own[rows][each % m]
            order = np.argsort(run, kind="stable")
            run, place, n = run[order], (each % m)[order], n[order]
            cut = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            docs = np.diff(np.append(cut, len(run)))
            group = pa.array((run[cut] & 0xFFFFFFFF).astype(np.int32))
            held.append(pa.table([group, coded.dictionary.take(pa.array(run[cut] >> 32)), pa.array(documents[rows][place[cut]]), pa.array(docs), pa.array(np.add.reduceat(n, cut))], schema=kinds))
            size, space = size + len(cut), space + held[-1].nbytes
            if size > HELD_RUNS or space > HELD_BYTES:
                held.append(added())
                size, space = held[0].num_rows, held[0].nbytes
                if size > HELD_RUNS // 2 or space > HELD_BYTES // 2:
                    yield from out(held.pop())
                    size = space = 0
        if len(groups) > 1 << 20:  # very many groups: forget them with what was held
            if held:
                yield from out(added())
                size = space = 0
            groups.clear()
    if held:
        yield from out(added())


def _changes(*columns: pa.ChunkedArray) -> np.ndarray:
    """Where rows differ from the row before in any of the columns; the first does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        if len(c) > 1:
            out[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return out


def _scan(least_docs: int):
    """Adds up sorted runs; a term's sources leave when its last run has been seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # sources of the term that is still open

        def summed(t: pa.Table) -> pa.Table:
            cut = np.flatnonzero(_changes(t["lang"], t["term"], t["source"]))
            add = lambda c: pa.array(np.add.reduceat(t[c].to_numpy(), cut))
            docs, n = add("docs"), add("n")
            t = t.take(pa.array(cut))
            return pa.table([t["lang"], t["term"], t["source"], docs, n], names=["lang", "term", "source", "docs", "n"])

        def out(t: pa.Table) -> list[pa.RecordBatch]:
            new = _changes(t["lang"], t["term"])
            cut, n, docs = np.flatnonzero(new), t["n"].to_numpy(), t["docs"].to_numpy()
            many = np.diff(np.append(cut, len(new)))
            total, frequency = np.repeat(np.add.reduceat(n, cut), many), np.repeat(np.add.reduceat(docs, cut), many)
            good = frequency >= least_docs
            t = pa.table([t["lang"], t["term"], t["source"], t["n"], pa.array(total), pa.array(new.astype(np.int32))], names=["lang", "term", "source", "n", "total", "first"])
            return t.filter(pa.array(good)).combine_chunks().to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]).select(["lang", "term", "source", "docs", "n"])
            t = summed(pa.concat_tables([held, t.cast(held.schema)]) if held else t)
            last = int(np.flatnonzero(_changes(t["lang"], t["term"]))[-1])
            held = t.slice(last)
            if last:
                yield from out(t.slice(0, last))
        if held:
            yield from out(held)

    return run


class _Sums:
    """Partial sums of pairs of groups, by a number for each group seen."""

    def __init__(self):
        self.numbers: dict[tuple[str, str], int] = {}
        self.keys: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.size = 0

    def add(self, key: np.ndarray, value: np.ndarray) -> None:
        self.keys.append(key)
        self.values.append(value)
        self.size += len(key)
        if self.size > 1 << 21:
            self.reduce()

    def reduce(self) -> None:
        if not self.size:
            return
        key = np.concatenate(self.keys)
        order = np.argsort(key, kind="stable")
        key = key[order]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.keys, self.values = [key[cut]], [np.add.reduceat(np.concatenate(self.values)[order], cut)]
        self.size = len(cut)

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.reduce()
        if not self.size:
            return
        by = list(self.numbers)
        lang, name = pa.array([x[0] for x in by], pa.string()), pa.array([x[1] for x in by], pa.string())
        key, value = self.keys[0], self.values[0]
        for lo in range(0, len(key), 1 << 16):
            k = key[lo : lo + (1 << 16)]
            s, t = pa.array(k >> 32), pa.array(k & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([pa.array(["pair"] * len(k)), lang.take(s), name.take(s), name.take(t), pa.array(value[lo : lo + (1 << 16)])], names=[x.split()[0] for x in FOUND.split(", ")])
        self.keys, self.values, self.size = [], [], 0


def _best(t: pa.Table, top: int) -> pa.Table:
    """The first `top` items of each group."""
    t = t.sort_by([("lang", "ascending"), ("source", "ascending"), ("value", "descending"), ("item", "ascending")])
    new = _changes(t["lang"], t["source"])
    cut = np.flatnonzero(new)
    rank = np.arange(len(new)) - np.repeat(cut, np.diff(np.append(cut, len(new))))
    return t.filter(pa.array(rank < top))


def _emit(top: int):
    """Partial sums of pairs and partial best terms of rows sorted by ORDER."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, best, size = _Sums(), [], 0
        held: pa.Table | None = None
        names = [x.split()[0] for x in FOUND.split(", ")]

        def pairs(t: pa.Table) -> None:
            by = list(zip(t["lang"].to_pylist(), t["source"].to_pylist()))
            number = np.fromiter((sums.numbers.setdefault(x, len(sums.numbers)) for x in by), np.int64, len(by))
            whole, n = t["whole"].to_numpy(), t["n"].to_numpy()
            p, p0 = share(n, whole), share(np.zeros_like(n), whole)
            cut = np.flatnonzero(_changes(t["lang"], t["term"]))
            many = np.diff(np.append(cut, len(n)))
            size = np.repeat(many, many)
            start = np.repeat(cut, many)
            lo = 0
            while lo < len(n):  # pairs of some rows at a time
                hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(size[lo:]), 1 << 19, "right")))
                i = np.repeat(np.arange(lo, hi), size[lo:hi])
                j = np.arange(len(i)) - np.repeat(np.cumsum(size[lo:hi]) - size[lo:hi], size[lo:hi]) + start[i]
                i, j = i[i != j], j[i != j]
                f = divergence
                sums.add(number[i] << 32 | number[j], f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j]))
                lo = hi

        def terms(t: pa.Table) -> pa.Table:
            p, q = share(t["n"].to_numpy(), t["whole"].to_numpy()), share(t["total"].to_numpy(), t["all_whole"].to_numpy())
            t = pa.table([pa.array(["term"] * t.num_rows), t["lang"], t["source"], t["term"], pa.array(divergence(p, q))], names=names)
            return t.filter(pa.array(p > q))

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t.cast(held.schema)]) if held else t
            last = int(np.flatnonzero(_changes(t["lang"], t["term"]))[-1])
            held = t.slice(last)
            if last:
                ready = t.slice(0, last).combine_chunks()
                pairs(ready)
                best.append(terms(ready))
                size += best[-1].num_rows
                if size > 1 << 18:
                    best = [_best(pa.concat_tables(best), top)]
                    size = best[0].num_rows
                    if size > 1 << 17:
                        yield from best[0].to_batches(max_chunksize=1 << 16)
                        best, size = [], 0
            if sums.size > 1 << 22:  # very many groups
                yield from sums.rows()
        if held:
            pairs(held.combine_chunks())
            best.append(terms(held.combine_chunks()))
        if best:
            yield from _best(pa.concat_tables(best), top).to_batches(max_chunksize=1 << 16)
        yield from sums.rows()

    return run


def _share(count: str, whole: str) -> str:
    return f"(1 + (cast({SCALE} as decimal(10,0)) * cast({count} + 1 as decimal(20,0))) div cast({whole} as decimal(20,0)))"


def _f(p: str, q: str) -> str:
    return f"cast(({p} - {q}) * ({p} - {q}) div {q} as decimal(38,0))"


def ranked(rows: DataFrame, top: int | None = None) -> DataFrame:
    """rows with rank: by value, greatest first, ties by item, within (part, lang, source)."""
    order = [F.col("value").desc(), F.col("item")]
    if top:  # parts of a group by item first, so that no group meets in one task
        part = Window.partitionBy("part", "lang", "source", F.pmod(F.xxhash64("item"), F.lit(16))).orderBy(*order)
        rows = rows.withColumn("__r", F.row_number().over(part)).where(F.col("__r") <= top).drop("__r")
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy("part", "lang", "source").orderBy(*order)))
    return out.where(F.col("rank") <= top) if top else out


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value (long), rank (int, from 1)."""
    spark = docs.sparkSession
    scratch, n = Scratch(spark, "divergence"), partitions(spark)
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))
    runs = own.withColumn("document", F.monotonically_increasing_id()).mapInArrow(_runs, RUN)
    sorted_runs = runs.repartition(n, "lang", "term").sortWithinPartitions(*ORDER, "document")
    kept = scratch.save(sorted_runs.mapInArrow(_scan(least_docs), KEPT), "kept")

    langs = kept.groupBy("lang").agg(F.sum("n").alias("all_n"), F.sum("first").alias("v"))
    given = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = own.select("lang", "source").distinct().join(given, ["lang", "source"], "left").join(langs, "lang", "left")
    whole = lambda c: (F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col("v"), F.lit(0))).alias
    groups = scratch.save(groups.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), whole("n")("whole"), whole("all_n")("all_whole")), "groups")

    used = groups.where("v > 0")
    if used.count() <= SMALL_GROUPS:
        joined = kept.join(F.broadcast(used), ["lang", "source"])
    else:
        sizes = kept.groupBy(F.xxhash64("lang", "source").alias("g")).agg(F.count("*").alias("m"))
        keyed = kept.withColumn("g", F.xxhash64("lang", "source"))
        named = used.select(F.xxhash64("lang", "source").alias("g"), F.struct("lang", "source", "whole", "all_whole").alias("own")).groupBy("g").agg(F.collect_list("own").alias("own"))
        joined = join_salted(keyed, named, "g", hot(sizes, "g", "m", kept.count()), "term")
        joined = joined.withColumn("own", F.expr("filter(own, x -> x.lang = lang and x.source = source)[0]")).select("*", "own.whole", "own.all_whole")
    joined = joined.select("lang", "term", "source", "n", "total", "whole", "all_whole")
    joined = joined.repartition(n, "lang", "term").sortWithinPartitions(*ORDER)
    found = scratch.save(joined.mapInArrow(_emit(top), FOUND), "found")

    # pairs: all terms as if neither had them, corrected by the terms of one and by those of both
    other = groups.select("lang", F.col("source").alias("other"), F.col("whole").alias("other_whole"))
    both = groups.join(other, "lang").where("source != other")
    zero = both.withColumn("value", F.expr(f"case when v = 0 then 0 else v * {_f(_share('0L', 'whole'), _share('0L', 'other_whole'))} end"))
    counts = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("m")).join(groups, ["lang", "source"])
    met = counts.join(other, "lang").where("source != other")
    met = met.selectExpr("lang", "source", "other", "m", f"{_share('n', 'whole')} as p", f"{_share('0L', 'whole')} as p0", f"{_share('0L', 'other_whole')} as q0")
    given_by = met.groupBy("lang", F.col("source").alias("s"), F.col("other").alias("t"))
    one = given_by.agg(F.expr(f"sum(m * ({_f('p', 'q0')} - {_f('p0', 'q0')}))").alias("left"), F.expr(f"sum(m * ({_f('q0', 'p')} - {_f('q0', 'p0')}))").alias("right"))
    whole_sums = [
        zero.select("lang", "source", F.col("other").alias("item"), F.col("value").cast("decimal(38,0)")),
        one.select("lang", F.col("s").alias("source"), F.col("t").alias("item"), F.col("left").cast("decimal(38,0)").alias("value")),
        one.select("lang", F.col("t").alias("source"), F.col("s").alias("item"), F.col("right").cast("decimal(38,0)").alias("value")),
        found.where("part = 'pair'").select("lang", "source", "item", F.col("value").cast("decimal(38,0)")),
    ]
    summed = whole_sums[0].unionByName(whole_sums[1]).unionByName(whole_sums[2]).unionByName(whole_sums[3]).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    pairs = ranked(summed.withColumn("part", F.lit("pair")))
    terms = ranked(found.where("part = 'term'"), top)
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int"))
