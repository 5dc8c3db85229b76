"""Characters of a page to lines, and the line that names the supplier.

chars: doc, page, text, x0, x1, top, size, fontname. pages: doc, page, width, height, and the top of the table's header where
one was found (header_top, else null) and text, the page's text for want of a line. Nulls in text and font are empty, sizes of
null or 0 don't count, characters without a place are left out; of equal scores the upper line wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metadata import is_barcode, is_bold, name_confidence, seller_text, supplier_line_score, supplier_of_text
from ..functions.text import collapsed

LINE_GAP = 2.5
LEFT, ABOVE = 0.65, 0.28


def line_numbers(chars: DataFrame, gap: float = LINE_GAP) -> DataFrame:
    """chars with line (from 1): in the order of their tops a character joins the line while it is within `gap` of its running mean."""
    placed = chars.where("top is not null and x0 is not null")
    key = F.struct(F.bround("top", 1).alias("t"), F.col("x0").alias("x"), F.struct(*placed.columns).alias("c"))
    pages = placed.groupBy("doc", "page").agg(F.transform(F.array_sort(F.collect_list(key)), lambda k: k["c"]).alias("cs"))
    start = F.struct(F.lit(0).alias("line"), F.lit(0).alias("n"), F.lit(0.0).alias("mean"), F.array().cast("array<int>").alias("lines"))

    def step(s, c):
        top = c["top"].cast("double")
        near = (s["n"] > 0) & (F.abs(top - s["mean"]) <= gap)
        line, n = F.when(near, s["line"]).otherwise(s["line"] + 1), F.when(near, s["n"] + 1).otherwise(1)
        return F.struct(line.alias("line"), n.alias("n"), F.when(near, (s["mean"] * s["n"] + top) / (s["n"] + 1)).otherwise(top).alias("mean"), F.array_append(s["lines"], line).alias("lines"))

    numbered = pages.withColumn("lines", F.aggregate("cs", start, step)["lines"]).select(F.explode(F.arrays_zip("cs", "lines")).alias("z"))
    return numbered.select("z.cs.*", F.col("z.lines").alias("line"))


def line_figures(numbered: DataFrame) -> DataFrame:
    """A row for each line: its text, mean and greatest size, shares of bold and bar-code characters, and place."""
    sized = F.when(F.col("size") != 0, F.col("size").cast("double"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1", F.coalesce("text", F.lit("")).alias("t")))), lambda c: c["t"]), "")
    got = numbered.groupBy("doc", "page", "line").agg(
        text.alias("raw"), F.coalesce(F.avg(sized), F.lit(0.0)).alias("mean_size"), F.coalesce(F.max(sized), F.lit(0.0)).alias("max_size"), F.avg(is_bold(F.col("fontname")).cast("int")).alias("bold"), F.avg(is_barcode(F.col("fontname")).cast("int")).alias("barcode"),
        F.min("x0").cast("double").alias("x0"), F.max(F.coalesce("x1", "x0")).cast("double").alias("x1"), F.min("top").cast("double").alias("top"),
    )
    return got.withColumn("text", seller_text(collapsed(F.col("raw")))).withColumn("middle", (F.col("x0") + F.col("x1")) / 2)


def supplier_names(chars: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, page, name, confidence, score, source: of the lines above the table and left of its right third the one most like a
    supplier's name (LINE); of a weak one, or none, the likeliest line of the page's text (TEXT); else neither."""
    limit = F.when(F.col("header_top") > 40, F.col("header_top") - 2).otherwise(F.col("height") * ABOVE)
    frame = pages.select("doc", "page", F.coalesce("width", F.lit(1.0)).cast("double").alias("width"), F.coalesce("height", F.lit(1.0)).cast("double").alias("height"), limit.alias("limit"), "text")
    own = ["doc", "page", "text", "x0", "x1", "top", "size", "fontname"]
    upper = chars.select(*own).join(frame.select("doc", "page", "width", "limit"), ["doc", "page"]).where((F.col("top") <= F.col("limit")) & (F.col("x0") <= F.col("width") * LEFT)).select(*own)
    lines = line_figures(line_numbers(upper)).join(frame.select("doc", "page", "width", "height"), ["doc", "page"])
    score = supplier_line_score(*(F.col(c) for c in ("text", "max_size", "mean_size", "bold", "barcode", "top", "middle", "width", "height")))
    scored = lines.withColumn("score", score)
    best = scored.groupBy("doc", "page").agg(F.max_by(F.struct("text", "score"), F.when(F.col("score").isNotNull(), F.struct("score", -F.col("line")))).alias("b"))
    met = frame.join(best, ["doc", "page"], "left").select("doc", "page", F.col("b.text").alias("line"), F.col("b.score").alias("score"), supplier_of_text(F.col("text")).alias("other"))
    by_text = F.col("other").isNotNull() & (F.col("score").isNull() | (F.col("score") < 40))
    confidence = F.when(by_text, F.when(F.col("line").isNull(), 0.55).otherwise(0.65)).otherwise(name_confidence(F.col("score")))
    return met.select("doc", "page", F.when(by_text, F.col("other")).otherwise(F.col("line")).alias("name"), confidence.alias("confidence"), "score", F.when(by_text, "TEXT").when(F.col("line").isNotNull(), "LINE").otherwise("NONE").alias("source"))
