"""Similarity of strings, for distinct pairs: indel ratio and its token forms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit for each character of a."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len a + len b)."""
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    left = " ".join(filter(None, [both, " ".join(sorted(x - y))]))
    right = " ".join(filter(None, [both, " ".join(sorted(y - x))]))
    return max([ratio(left, right)] + ([ratio(both, left), ratio(both, right)] if both else []))


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter string against the other's windows of its length, edges included."""
    a, b = sorted((a, b), key=len)
    if not a:
        return 100.0 if not b else 0.0
    return max(ratio(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)))


SCORERS = {"ratio": ratio, "token_sort_ratio": token_sort, "token_set_ratio": token_set, "partial_ratio": partial}


def similarity(name: str, a: Column, b: Column) -> Column:
    """A scorer over two text columns, a batch at a time; null with null."""
    own = SCORERS[name]

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else own(p, q) for p, q in zip(x, y)], dtype="float64")

    return run(a, b)


def header_similarity(a: Column, b: Column) -> Column:
    """0.4 Jaccard + 0.4 share found in order + 0.2 length ratio, of two header arrays; of two empty ones 1."""
    n, m = F.size(a), F.size(b)
    jaccard = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    step = lambda s, x: F.when(F.array_position(F.slice(b, s["at"] + 1, F.greatest(m - s["at"], F.lit(0))), x) > 0, F.struct((s["n"] + 1).alias("n"), (s["at"] + F.array_position(F.slice(b, s["at"] + 1, F.greatest(m - s["at"], F.lit(0))), x).cast("int")).alias("at"))).otherwise(s)
    ordered = F.aggregate(a, F.struct(F.lit(0).alias("n"), F.lit(0).alias("at")), step)["n"] / F.greatest(n, m)
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(F.round(0.4 * jaccard + 0.4 * ordered + 0.2 * F.least(n, m) / F.greatest(n, m), 3))
