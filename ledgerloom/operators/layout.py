"""Words on pages to columns, and layouts of headers compared with known ones.

Words are doc, page, word_no, text, x0, x1, top; columns are doc, page, col_no, field, x0, x1. Words of
pages without columns are left out; nulls in a coordinate leave a word without a column."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import header_similarity
from ..functions.text import cleaned

NUMERIC = ["rate", "mrp", "amount", "taxableAmount", "netAmount", "quantity", "freeQuantity", "discountPercent", "gstPercent"]
PAGE = ["doc", "page"]
_FIGURE, _LETTERS, _DATE = re.compile(r"[-+]?\d+(\.\d+)?%?"), re.compile(r"[A-Za-z\s()/+-]+"), re.compile(r"\d{1,2}[/.-]\d{2,4}")


@lru_cache(4096)
def kinds_of(text: str) -> tuple[bool, bool, bool]:
    """Whether a text is a figure, words or a date."""
    t = text.strip()
    return bool(_FIGURE.fullmatch(t)), bool(_LETTERS.fullmatch(t)), bool(_DATE.fullmatch(t))


def affinity_of(text: str, x0: float, x1: float, field: str | None, c0: float, c1: float) -> float:
    """_affinity() of one word against one column."""
    return affinity_to(kinds_of(text), x0, x1, field, c0, c1)


def affinity_to(kinds: tuple[bool, bool, bool], x0: float, x1: float, field: str | None, c0: float, c1: float) -> float:
    """affinity_of() of a word whose kinds are known."""
    width, middle = max(0.5, x1 - x0), (x0 + x1) / 2
    inside, away = c0 <= middle <= c1, abs(middle - (c0 + c1) / 2)
    field = field or ""
    digits, words, date = kinds
    kind = 0
    if words and width > 25 and (field in NUMERIC or field == "itemName"):
        kind = 20 if field == "itemName" else -40
    elif digits and (field in NUMERIC or field == "hsnCode"):
        kind = 15
    elif digits and field == "itemName" and not inside:
        kind = -15
    pull = max(0.0, 12 - away * 0.25) if digits and not inside and away < 40 else 0.0
    dated = 25 if field == "expiryDate" and date else 0
    return max(0.0, min(x1, c1) - max(x0, c0)) / width * 60 + 30 * inside - away * 0.15 + pull + kind + dated


def _affinity(w: Column, c: Column) -> Column:
    """Overlap, centre and kind of a word against a column; structs with x0, x1, text or field."""
    width = F.greatest(F.lit(0.5), w["x1"] - w["x0"])
    middle = (w["x0"] + w["x1"]) / 2
    inside, away = middle.between(c["x0"], c["x1"]), F.abs(middle - (c["x0"] + c["x1"]) / 2)
    overlap = F.greatest(F.lit(0.0), F.least(w["x1"], c["x1"]) - F.greatest(w["x0"], c["x0"])) / width
    t, field = F.trim(w["text"]), F.coalesce(c["field"], F.lit(""))
    digits, words, date = t.rlike(r"^[-+]?\d+(\.\d+)?%?$"), t.rlike(r"^[A-Za-z\s()/+-]+$"), t.rlike(r"^\d{1,2}[/.-]\d{2,4}$")
    kind = (
        F.when(words & (width > 25) & field.isin(*NUMERIC), -40).when(words & (width > 25) & (field == "itemName"), 20)
        .when(digits & field.isin(*NUMERIC, "hsnCode"), 15).when(digits & (field == "itemName") & ~inside, -15)
        .otherwise(0)
    )
    pull = F.when(digits & ~inside & (away < 40), F.greatest(F.lit(0.0), 12 - away * 0.25)).otherwise(0.0)
    return overlap * 60 + F.when(inside, 30).otherwise(0) - away * 0.15 + pull + kind + F.when(date & (field == "expiryDate"), 25).otherwise(0)


def assign_words(words: DataFrame, columns: DataFrame) -> DataFrame:
    """Words with col_no, field, score and ambiguous (a second column within 8 points, both above 10).

    A page's columns are one array beside each word: one join on the page, no word is repeated."""
    beside = columns.groupBy(*PAGE).agg(F.collect_list(F.struct("col_no", "field", F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1"))).alias("__cols"))
    word = F.struct(F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1"), F.col("text").alias("text"))
    ranked = F.array_sort(F.transform("__cols", lambda c: F.struct((-_affinity(F.col("__w"), c)).alias("below"), c["col_no"].alias("col_no"), c["field"].alias("field"))))
    df = words.join(beside, PAGE).withColumn("__w", word).withColumn("__r", F.when(F.col("x0").isNotNull() & F.col("x1").isNotNull(), ranked))
    first, second = F.try_element_at("__r", F.lit(1)), F.try_element_at("__r", F.lit(2))
    best, next_ = -first["below"], -second["below"]
    unclear = F.coalesce((best - next_ < 8) & (best > 10) & (next_ > 10), F.lit(False))
    return df.select(*words.columns, first["col_no"].alias("col_no"), first["field"].alias("field"), F.round(best, 6).alias("score"), unclear.alias("ambiguous"))


def cells_of(assigned: DataFrame) -> DataFrame:
    """doc, page, line_no, col_no, value: the words of each line and column, left to right."""
    parts = F.array_sort(F.collect_list(F.struct("x0", "word_no", "text")))
    return assigned.where("col_no is not null").groupBy(*PAGE, "line_no", "col_no").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("value"))


def with_lines(words: DataFrame, tolerance: float = 4.5) -> DataFrame:
    """Adds line_no: a line ends where the next word lies more than `tolerance` below the one before."""
    down = Window.partitionBy(*PAGE).orderBy("top", "x0", "word_no")
    opens = F.coalesce((F.col("top") - F.lag("top").over(down) > tolerance).cast("long"), F.lit(0))
    return words.withColumn("__o", opens).withColumn("line_no", F.sum("__o").over(down.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("__o")


def valleys(words: DataFrame, least: float = 0.0) -> DataFrame:
    """doc, page, x0, x1: stretches that no word covers, between the first and the last word, wider than `least`."""
    across = Window.partitionBy(*PAGE).orderBy("x0", "x1")
    reach = F.max("x1").over(across.rowsBetween(Window.unboundedPreceding, -1))
    df = words.where("x0 is not null and x1 is not null").select(*PAGE, reach.alias("left"), F.col("x0").alias("right"), "x1")
    return df.withColumn("x0", F.col("left")).where(F.col("right") - F.col("left") > least).select(*PAGE, "x0", F.col("right").alias("x1"))


def split_texts(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Cells of columns whose header has two or three words, and so many values in 0.6 of the filled cells
    or more, come apart: doc, row_no, col_no, part_no, header, value. Others have part_no 1 and stay."""
    gap = r"[\s/&]+"
    h = headers.select("doc", "col_no", "header", F.split(F.trim("header"), gap).alias("names"))
    df = cells.join(h, ["doc", "col_no"]).withColumn("parts", F.split(F.trim("value"), r"\s+"))
    fits = F.size("parts") == F.size("names")
    share = df.where("trim(value) <> ''").groupBy("doc", "col_no").agg(F.avg(fits.cast("int")).alias("share"))
    df = df.join(share, ["doc", "col_no"], "left").withColumn("apart", F.coalesce(F.size("names").between(2, 3) & (F.col("share") >= 0.6), F.lit(False)))
    pieces = F.transform("names", lambda n, i: F.struct((i + 1).alias("part_no"), n.alias("header"), F.when(fits, F.get("parts", i)).when(i == 0, F.col("value")).otherwise("").alias("value")))
    whole = F.array(F.struct(F.lit(1).alias("part_no"), F.col("header"), F.col("value")))
    return df.select("doc", "row_no", "col_no", F.explode(F.when(F.col("apart"), pieces).otherwise(whole)).alias("p")).select("doc", "row_no", "col_no", "p.*")


def signature(headers: Column) -> Column:
    """Sixteen hex digits that name a sequence of headers."""
    clean = F.transform(headers, cleaned)
    return F.substring(F.sha2(F.concat(F.array_join(clean, "|"), F.lit("_"), F.size(headers).cast("string")), 256), 1, 16)


def drift(documents: DataFrame, layouts: DataFrame) -> DataFrame:
    """doc, supplier, headers against layouts (supplier, layout_id, headers) of the same supplier: the best
    layout, its similarity and EXACT_MATCH, MINOR_DRIFT, MAJOR_DRIFT or NEW_LAYOUT; NEW_SUPPLIER without any.

    Each header sequence of a supplier is compared once, however many documents share it."""
    asked = documents.select("supplier", F.col("headers").alias("here")).distinct()
    pairs = asked.join(layouts.select("supplier", "layout_id", F.col("headers").alias("there")), "supplier")
    same = signature(F.col("here")) == signature(F.col("there"))
    pairs = pairs.withColumn("same", same).withColumn("similarity", F.when(F.col("same"), 1.0).otherwise(header_similarity(F.transform("here", cleaned), F.transform("there", cleaned))))
    best = pairs.groupBy("supplier", "here").agg(F.max_by(F.struct("layout_id", "similarity", "same"), F.struct("same", "similarity", F.negative(F.col("layout_id").cast("long")))).alias("b"))
    s = F.col("b.similarity")
    status = F.when(s.isNull(), "NEW_SUPPLIER").when(F.col("b.same"), "EXACT_MATCH").when(s >= 0.75, "MINOR_DRIFT").when(s >= 0.45, "MAJOR_DRIFT").otherwise("NEW_LAYOUT")
    return documents.join(best.withColumnRenamed("here", "headers"), ["supplier", "headers"], "left").select(*documents.columns, "b.layout_id", F.round(F.coalesce(s, F.lit(0.0)), 3).alias("similarity"), status.alias("drift"))


def learn(decided: DataFrame) -> DataFrame:
    """Layouts from decided documents (supplier, headers, confidence, decision, critical_mismatches, reviewed,
    seen): accepted ones of 80 or more without mismatches, and reviewed ones. supplier, signature, version
    (by first sight), headers, n_documents, first_seen, last_seen. Documents without a supplier teach nothing."""
    good = ((F.col("decision") == "AUTO_ACCEPT") & (F.col("confidence") >= 80) & (F.coalesce("critical_mismatches", F.lit(0)) == 0)) | F.coalesce("reviewed", F.lit(False))
    df = decided.where("supplier is not null").where(good).withColumn("signature", signature(F.col("headers")))
    found = df.groupBy("supplier", "signature").agg(F.min_by("headers", "seen").alias("headers"), F.count("*").alias("n_documents"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))
    return found.withColumn("version", F.row_number().over(Window.partitionBy("supplier").orderBy("first_seen", "signature")))
