"""Suppliers, product aliases and layouts."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import STRENGTH_UNIT
from ..functions.fuzzy import partial, token_set, token_sort
from ..functions.text import collapsed, drug_name


def by_priority(rows: DataFrame, known: DataFrame, keys: list[str], value: str, row_key: str) -> DataFrame:
    """The value of the first of `keys` that has one, by equality; least value on ties."""
    out = rows
    for k in keys:
        one = known.where(F.col(k).isNotNull() & (F.col(k) != "")).groupBy(F.col(k).alias("__k")).agg(F.min(value).alias(f"__{k}"))
        out = out.join(one, F.col(k) == F.col("__k"), "left").drop("__k")
    tier = F.coalesce(*[F.when(F.col(f"__{k}").isNotNull(), F.lit(k)) for k in keys])
    return out.withColumn(value, F.coalesce(*[F.col(f"__{k}") for k in keys])).withColumn("matched_by", tier).select(row_key, value, "matched_by")


def best_alias(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """names: name, supplier; aliases: alias, supplier, item, confidence, matches.

    A supplier's own alias first (confidence, then matches), then anyone's (matches, then confidence)."""
    met = names.alias("n").join(aliases.alias("a"), F.upper(collapsed(F.col("n.name"))) == F.upper(collapsed(F.col("a.alias"))))
    own = F.coalesce(F.col("n.supplier") == F.col("a.supplier"), F.lit(False))
    by = Window.partitionBy("n.name", "n.supplier").orderBy(F.desc(own), F.desc(F.when(own, F.col("a.confidence"))), F.desc(F.when(own, F.col("a.matches"))), F.desc("a.matches"), F.desc("a.confidence"), "a.item")
    ranked = met.withColumn("r", F.row_number().over(by)).where("r = 1")
    return ranked.select(F.col("n.name"), F.col("n.supplier"), F.col("a.item"), F.when(own, "SUPPLIER_ALIAS").otherwise("GLOBAL_ALIAS").alias("source"))


def score(raw: str, core: str, master: str, master_core: str) -> float:
    """Best of the scorers over an item's name and its core against a master's; a partial match counts from 95 on."""
    bare = lambda x: re.sub(STRENGTH_UNIT, "", x).strip()
    p = partial(core, master_core)
    units = token_sort(bare(core), bare(master_core)) if bare(core) and bare(master_core) else 0.0
    return max(token_sort(raw.upper(), master.upper()), token_sort(core, master_core), token_set(raw.upper(), master.upper()), token_set(core, master_core), units, p if p >= 95 else 0.0)


BLOCK = 2000
"""Names and masters that meet at once."""


class _Bags:
    """Strings as counts of their characters: letters, digits, blanks and others. What two strings have in common in any order
    is no less than their longest common subsequence."""

    def __init__(self, strings: list[str]):
        self.length = np.array([len(x) for x in strings], np.int32)
        self.counts = np.zeros((39, len(strings)), np.int16)
        for k, x in enumerate(strings):
            for c in x:
                at = ord(c)
                self.counts[at - 65 if 65 <= at <= 90 else at - 22 if 48 <= at <= 57 else 36 if c == " " else 37 + (at > 127), k] += 1

    def common(self, other: _Bags) -> np.ndarray:
        out = np.zeros((len(self.length), len(other.length)), np.int16)
        for mine, theirs in zip(self.counts, other.counts):
            i, j = np.flatnonzero(mine), np.flatnonzero(theirs)
            if len(i) and len(j):
                out[np.ix_(i, j)] += np.minimum.outer(mine[i], theirs[j])
        return out


def _most(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """200 common / (length a + length b): a ratio's bound."""
    return 200.0 * common / np.maximum(a[:, None] + b[None, :], 1)


def _most_shared(names: list[str], masters: list[str]) -> np.ndarray:
    """The ratio of the tokens that two strings share to either string's own tokens, exactly; 0 without any."""
    sets, known = [set(x.split()) for x in names], {}
    for j, x in enumerate(masters):
        for t in set(x.split()):
            known.setdefault(t, []).append(j)
    mine: dict[str, list[int]] = {}
    for i, x in enumerate(sets):
        for t in x:
            if t in known:
                mine.setdefault(t, []).append(i)
    size, count = (np.zeros((len(names), len(masters)), np.int16) for _ in range(2))
    for t, i in mine.items():
        at = np.ix_(i, known[t])
        size[at] += len(t)
        count[at] += 1
    own = np.array([len(" ".join(x)) for x in sets], np.int32)
    other = np.array([len(" ".join(set(x.split()))) for x in masters], np.int32)
    both = size + np.maximum(count - 1, 0)
    return np.where(count > 0, 200.0 * both / (both + np.minimum(own[:, None], other[None, :])), 0.0)


def _bounds(names: list[tuple[str, str]], masters: list[tuple[str, str]]) -> np.ndarray:
    """No less than the score of each name and core against each master and core."""
    bare = lambda x: " ".join(re.sub(STRENGTH_UNIT, "", x).split())
    once = lambda x: " ".join(dict.fromkeys(x.split()))
    out = np.zeros((len(names), len(masters)))
    (raw_a, raw_b), (core_a, core_b) = ([[x[0].upper() for x in y] for y in (names, masters)], [[x[1] for x in y] for y in (names, masters)])
    forms = [(raw_a, raw_b), (core_a, core_b), ([bare(x) for x in core_a], [bare(x) for x in core_b]), ([once(x) for x in raw_a], [once(x) for x in raw_b]), ([once(x) for x in core_a], [once(x) for x in core_b])]
    for k, (x, y) in enumerate(forms):
        a, b = _Bags([" ".join(v.split()) for v in x]), _Bags([" ".join(v.split()) for v in y])
        common = a.common(b)
        np.maximum(out, _most(common, a.length, b.length), out=out)
        if k == 1:  # a partial ratio of 95 has nine tenths of the shorter core in common
            out[10 * common >= 9 * np.minimum(a.length[:, None], b.length[None, :])] = 100.0
    for x, y in ((raw_a, raw_b), (core_a, core_b)):
        np.maximum(out, _most_shared(x, y), out=out)
    return out


def _best(names: pd.DataFrame, masters: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The best master of each name among these, if it scores enough."""
    out = []
    if len(names) and len(masters):
        known = list(zip(masters["item_name"], masters["own"], masters["code"]))
        bounds = _bounds(list(zip(names["name"], names["core"])), [(m, c) for m, c, _ in known])
        for (name, core), most in zip(zip(names["name"], names["core"]), bounds):
            best, at = threshold, None
            candidates = np.flatnonzero(most >= threshold - 1e-6)
            for j in candidates[np.argsort(-most[candidates], kind="stable")]:
                if most[j] < best - 1e-6:
                    break
                master, own, code = known[j]
                s = score(name, core, master, own)
                if s > best or s == best and (at is None or (master, code) < (known[at][0], known[at][2])):
                    best, at = s, j
            if at is not None:
                out.append((name, best, known[at][0], known[at][2]))
    return pd.DataFrame(out, columns=["name", "score", "item_name", "code"])


def fuzzy_match(names: DataFrame, masters: DataFrame, threshold: float = 75.0, block: int = BLOCK) -> DataFrame:
    """Distinct names (name) against masters (code, item_name): code and match_type of the best one, and its score; the first
    by item name and code wins among equals. Below the threshold none does, and the score is 0.

    Names and masters meet in blocks: a join by the numbers of both blocks. In a block characters and tokens in common
    bound every pair's score from above; only pairs whose bound reaches the threshold, and the best score so far, are scored."""
    distinct = names.select("name").where(F.trim("name") != "").distinct().select(collapsed(F.col("name")).alias("name")).distinct().withColumn("core", drug_name(F.col("name")))
    known = masters.where(F.col("item_name").isNotNull()).select("code", "item_name", F.upper(collapsed(F.col("item_name"))).alias("own"))
    parts = lambda n: max(1, -(-n // block))
    rows, columns = parts(distinct.count()), parts(known.count())
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = distinct.withColumn("__r", F.pmod(F.xxhash64("name"), F.lit(rows)).cast("int")).withColumn("__c", every(columns))
    theirs = known.withColumn("__c", F.pmod(F.xxhash64("code", "item_name"), F.lit(columns)).cast("int")).withColumn("__r", every(rows))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _best(a, b, threshold)

    found = mine.groupBy("__r", "__c").cogroup(theirs.groupBy("__r", "__c")).applyInPandas(run, "name string, score double, item_name string, code string")
    best = found.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), "item_name", "code")).alias("x"))
    best = distinct.join(best, "name", "left").select("name", "core", F.col("x.code").alias("code"), F.coalesce(-F.col("x.s"), F.lit(0.0)).alias("score"))
    kind = F.when(F.col("score") >= 99, "EXACT_NAME_MATCH").when(F.col("score") >= threshold, "FUZZY_MATCH").otherwise("UNRESOLVED")
    return best.select("name", "core", "code", F.round("score", 1).alias("score"), kind.alias("match_type"))


def resolve_items(rows: DataFrame, aliases: DataFrame, masters: DataFrame, threshold: float = 75.0) -> DataFrame:
    """rows with name and supplier -> with code, match_type and match_score: by an alias of the name, else of its core
    (the supplier's own before others'), else by likeness to a master. aliases: alias, supplier, item (a code),
    confidence, matches; a blank name is unresolved with score 0."""
    keys = rows.select("name", "supplier").distinct().withColumn("core", drug_name(F.col("name")))
    tried = keys.select("name", "supplier", F.explode(F.array(F.struct(F.lit(0).alias("tier"), F.col("name").alias("key")), F.struct(F.lit(1).alias("tier"), F.col("core").alias("key")))).alias("t")).select("name", "supplier", "t.*")
    a = aliases.alias("a")
    met = tried.alias("t").join(a, F.upper(collapsed(F.col("t.key"))) == F.upper(collapsed(F.col("a.alias"))))
    own = F.coalesce(F.col("t.supplier") == F.col("a.supplier"), F.lit(False))
    order = F.struct(-F.col("t.tier"), own, F.when(own, F.col("a.confidence")), F.when(own, F.col("a.matches")), F.col("a.matches"), F.col("a.confidence"))
    found = met.groupBy("t.name", "t.supplier").agg(F.max(F.struct(order.alias("o"), F.col("a.item").alias("item"), F.col("a.confidence").alias("c"), own.alias("own"))).alias("x"))
    left = keys.join(found.select("name", "supplier"), (keys["name"] == found["name"]) & keys["supplier"].eqNullSafe(found["supplier"]), "left_anti").select("name").distinct()
    like = fuzzy_match(left, masters, threshold).select(F.col("name").alias("__name"), F.col("code").alias("__code"), "score", F.col("match_type").alias("__type"))
    by_alias = found.select(F.col("name").alias("__n"), F.col("supplier").alias("__s"), "x")
    out = rows.join(by_alias, (F.col("name") == F.col("__n")) & F.col("supplier").eqNullSafe(F.col("__s")), "left").join(like, collapsed(F.col("name")) == F.col("__name"), "left")
    has = F.col("x").isNotNull()
    kind = F.when(has & F.col("x.own"), "SUPPLIER_ALIAS").when(has, "GLOBAL_ALIAS").otherwise(F.coalesce("__type", F.lit("UNRESOLVED")))
    return out.select(*rows.columns, F.when(has, F.col("x.item")).otherwise(F.col("__code")).alias("code"), kind.alias("match_type"), F.when(has, F.round(F.col("x.c") * 100, 1)).otherwise(F.coalesce("score", F.lit(0.0))).alias("match_score"))
