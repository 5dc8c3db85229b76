"""The fuzzy master match against all pairs, and its bounds."""

import random

from ledgerloom.operators import identities
from ledgerloom.functions.text import drug_name
from pyspark.sql import functions as F

WORDS = ["AMARYL", "TELMA", "DOLO", "PAN", "D", "650", "40MG", "40", "1MG", "FORTE", "Plus", "TAB", "é日", "A", "A", "CAL-D", "(1X15)", "GEL", "20GM", "B12"]


def cases(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        x = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 5)))
        if rng.random() < 0.6:
            k = rng.randrange(len(x))
            x = x[:k] + rng.choice(["", "x", "Q ", "1"]) + x[k + rng.randrange(2) :]
        out.append(x)
    return out


def test_equal_to_all_pairs(spark):
    names, masters = sorted({*cases(1, 60), "  dolo   650 ", "zzzzqq", "P", "é日"}), cases(2, 40)
    coded = [(f"M{k % 37}", x) for k, x in enumerate(masters)] + [(None, "X"), ("M1", None)]
    known = spark.createDataFrame(coded, "code string, item_name string")
    df = spark.createDataFrame([(x,) for x in [*names, " ", "", None]], "name string")
    spelt = {r.name: r.core for r in df.where("trim(name) <> ''").select(F.trim(F.regexp_replace("name", r"\s+", " ")).alias("name")).withColumn("core", drug_name(F.col("name"))).collect()}
    for block in (2000, 7):
        got = {r.name: (r.code, r.score, r.match_type) for r in identities.fuzzy_match(df, known, block=block).collect()}
        assert got.keys() == spelt.keys()
        kinds = set()
        for name, core in spelt.items():
            every = [(-identities.score(name, core, m, " ".join(m.split()).upper()), m, c or "") for c, m in coded if m is not None]
            s, _, code = min(every)
            want = (None, 0.0, "UNRESOLVED") if -s < 75 else (code or None, round(-s + 1e-12, 1), "EXACT_NAME_MATCH" if -s >= 99 else "FUZZY_MATCH")
            assert got[name] == want, name
            kinds.add(want[2])
        assert len(kinds) == 3
    assert {r.match_type for r in identities.fuzzy_match(df, known.limit(0)).collect()} == {"UNRESOLVED"}
    assert identities.fuzzy_match(df.limit(0), known).count() == 0


def test_bounds_hold():
    names, masters = cases(3, 80), cases(4, 80)
    pairs = [(x, " ".join(x.upper().split())) for x in names], [(x, " ".join(x.upper().split())) for x in masters]
    most = identities._bounds(*pairs)
    loose = 0
    for i, (n, c) in enumerate(pairs[0]):
        for j, (m, o) in enumerate(pairs[1]):
            s = identities.score(n, c, m, o)
            assert most[i, j] >= s - 1e-9, (n, m)
            loose += most[i, j] >= 75 > s
    assert loose < 0.4 * len(names) * len(masters)
