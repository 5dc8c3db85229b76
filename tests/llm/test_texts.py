"""Source divergence, MinHash near-duplicates and collocations, on small messy tables against brute force."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import collocations, divergence, minhash

SCHEMA = "doc_id long, text string, lang string, source string, n int, rank int, id int, key int, h1 string, word string, value int"
SMALL = ["the", "of", "Über", "日本", "x", "new", "york", "city", "hall", "a"]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def messy(seed=3):
    rng = random.Random(seed)
    base = " ".join(f"w{rng.randrange(400)}" for _ in range(300))
    rows = [(1, None, "en", "s0"), (2, "", "en", "s0"), (3, " \t\n", None, None), (None, "the of the", "en", None), (None, None, None, "s1"), (4, "one two", "de", "s1"), (4, "one two", "de", "s1"), (5, "ONE two", "de", "only"), (6, "1 2 3", "fr", "s0"), (7, "é" * 4000, "en", "s1")]
    for i in range(10, 50):
        text = " ".join(rng.choice(SMALL) for _ in range(rng.randrange(1, 60)))
        text = re.sub(" x ", rng.choice([", ", ". ", "\n", " X\t"]), text) if i % 2 else text
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", "s2"])))
    for i in range(60, 90):  # near copies of one text, at similarities round the limit
        w = base.split()
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s2"))
    rows += [(90, " ".join(f"q{i}" for i in range(9000)), "en", "s1"), (91, rows[-1][1].upper(), "en", "s1")]
    return [(*r, 1, 2, 3, 4, "h", "w", 5) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(messy(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_divergence(rows, least=3, top=200):
    seen, count, groups = defaultdict(set), defaultdict(Counter), set()
    for r, (_, text, lang, source, *_) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text)):
            seen[lang, w].add(r)
            count[lang, source][w] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), d in seen.items() if x == lang and len(d) >= least]
        mine = [s for x, s in groups if x == lang]
        whole = Counter()
        for s in mine:
            whole.update(count[lang, s])

        def shares(c):
            n = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 1) // (n + len(kept)) for w in kept}

        of, all_of = {s: shares(count[lang, s]) for s in mine}, shares(whole)
        for s in mine:
            pairs = [(-sum((of[s][w] - of[t][w]) ** 2 // of[t][w] for w in kept), t.encode()) for t in mine if t != s]
            terms = [(-((of[s][w] - all_of[w]) ** 2 // all_of[w]), w.encode()) for w in kept if count[lang, s][w] and of[s][w] > all_of[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"HELD_RUNS": 8, "SMALL_GROUPS": 0}])
def test_divergence(docs, none, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(divergence, k, v)
    names = ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r[c] for c in names) for r in divergence.audit(docs, top=5).collect()) == brute_divergence(messy(), top=5)
    assert divergence.audit(none).collect() == []


def test_divergence_runs_hold_few_rows(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD_RUNS", 4)
    b = pa.record_batch([pa.array(["en"] * 3), pa.array(["s"] * 3), pa.array(["a b", "a", "c a a"]), pa.array([1, 2, 3])], names=["lang", "source", "text", "document"])
    got = Counter()
    for x in divergence._runs(iter([b])):
        for r in x.to_pylist():
            got[r["term"]] += r["n"]
    assert got == {"a": 4, "b": 1, "c": 1}


def test_share_is_exact():
    rng = random.Random(1)
    for _ in range(200):
        whole = rng.randrange(1, 9 * 10**15)
        n = rng.randrange(0, whole)
        assert divergence.share(np.array([n]), np.array([whole]))[0] == 1 + 10**9 * (n + 1) // whole


def brute_minhash(rows, percent=85, shingle=5):
    sets = []
    for _, text, *_ in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", lower(text)) if x]
        sets.append({" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    part = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = part[i], part[j]
            part = [a if x == b else x for x in part]
    out = []
    for i, r in enumerate(rows):
        ids = [x[0] for x, p in zip(rows, part) if p == part[i] and x[0] is not None]
        low = min(ids, default=None)
        out.append((r[0], len(sets[i]), low, r[0] == low))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"rounds": 1}, {"rounds": 0}, {"k": 128, "percent": 90}])
def test_minhash(docs, options):
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs, **options).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    want = brute_minhash(messy(), options.get("percent", 85))
    assert got == want
    assert len({x[2] for x in want if x[0] and 60 <= x[0] < 90}) > 1


def test_minhash_of_nothing(none, spark):
    assert minhash.near_duplicates(none).collect() == []
    alone = spark.createDataFrame([(1, None), (2, ""), (None, "")], "doc_id long, text string")
    assert sorted((tuple(r) for r in minhash.near_duplicates(alone).collect()), key=str) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)]


def test_estimate_passes_what_links():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        whole = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        common = -(-85 * n // 100)
        a, b = np.sort(whole[:n]), np.sort(np.concatenate([whole[:common], whole[n : n + (n - common) // 2]]))
        if minhash.jaccard(85)(a, b):
            assert minhash.estimate(64)(a[:64], b[:64])


def brute_collocations(rows, least=30, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    long = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    most = Counter()
    for (lang, w), a in long.items():
        for k in range(len(w)):
            for m in range(k + 2, len(w) + 1):
                if m - k < len(w):
                    most[lang, w[k:m]] = max(most[lang, w[k:m]], a)
    by = defaultdict(list)
    for (lang, w), a in long.items():
        if 100 * most[lang, w] < 80 * a:
            score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            by[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in by.items() for k, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


@pytest.mark.parametrize("options", [{}, {"chunk_tokens": 40, "bits": 8}, {"least": 3, "top": 7}])
def test_collocations(docs, none, monkeypatch, options):
    if "bits" in options:
        monkeypatch.setattr(collocations, "RANGE_KEYS", 4)
        monkeypatch.setattr(collocations, "SMALL_WORDS", 0)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = collocations.mine(docs, **{"least": 6, **options})
    want = brute_collocations(messy(), options.get("least", 6), options.get("top", 2000))
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == want and len(want) > 20
    assert collocations.mine(none).collect() == []
    assert collocations.mine(docs.where(F.lit(False))).collect() == []
