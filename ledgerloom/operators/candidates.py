"""Competing readings of a page as tables: several segmentations of its words, each scored, the best kept.

words: doc, page, text, x0, x1, top. rows: doc, page, candidate, table_no, row_no (from 0), cells. Null texts are left out, null
cells are empty. A page of which no candidate holds a usable table has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from . import rows as R
from .headers import fields_of

TABLE = ["doc", "page", "candidate", "table_no"]
HEADER_WITHIN, ROW_BONUS = 25, 80


def segment(words: DataFrame, gaps: list[float], line_gap: float = 4.0) -> DataFrame:
    """Rows of cells, once for each gap: words of a line stand in one cell while less than `gap` lies between them.
    Lines begin where a word is more than line_gap below the one above."""
    page = ["doc", "page"]
    lines = words.where("text is not null").withColumn("__new", F.coalesce(F.col("top") - F.lag("top").over(Window.partitionBy(*page).orderBy("top", "x0")) > line_gap, F.lit(False)).cast("int"))
    lines = lines.withColumn("row_no", F.sum("__new").over(Window.partitionBy(*page).orderBy("top", "x0").rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    # a page is dealt out once: how far a word stands from those before it is the same at every gap
    along = Window.partitionBy(*page, "row_no").orderBy("x0", "x1", "text")
    spaced = lines.select(*page, "row_no", "text", F.row_number().over(along).alias("at"), (F.col("x0") - F.max("x1").over(along.rowsBetween(Window.unboundedPreceding, -1))).alias("space"))
    one = spaced.groupBy(*page, "row_no").agg(F.array_sort(F.collect_list(F.struct("at", "text", "space"))).alias("words"))
    tried = F.array(*(F.struct(F.lit(k).alias("candidate"), cells_at("words", g).alias("cells")) for k, g in enumerate(gaps)))
    return one.select(*page, "row_no", F.explode(tried).alias("c")).select(*page, "c.candidate", F.lit(0).alias("table_no"), "row_no", "c.cells")


def cells_at(words: str, gap: float) -> Column:
    """Words of a line (text and the space before each, null for the first) as cells: a new one from each space of `gap` on."""
    state = lambda done, cell: F.struct(done.alias("done"), cell.alias("cell"))
    none = state(F.array().cast("array<string>"), F.lit(None).cast("string"))

    def step(s, w):
        far = F.coalesce(w["space"] >= float(gap), F.lit(False))
        return F.when(s["cell"].isNull(), state(s["done"], w["text"])).when(far, state(F.concat(s["done"], F.array(s["cell"])), w["text"])).otherwise(state(s["done"], F.concat(s["cell"], F.lit(" "), w["text"])))

    return F.aggregate(words, none, step, lambda s: F.concat(s["done"], F.array(s["cell"])))


def long_cell_penalty(longest: Column) -> Column:
    """Tables that fell into one row hold very long cells."""
    return F.when(longest >= 200, 80 + F.least(F.floor(longest / 20), F.lit(120))).when(longest >= 100, 30).otherwise(0)


def width_bonus(width: Column, expected: Column) -> Column:
    """How well a table's width fits that of the page before; 0 where none is expected."""
    off = F.abs(width - expected)
    return F.when(expected.isNull() | (expected == 0), 0).when(off == 0, 50).when(off <= 2, 35).when(off <= 4, 10).otherwise(-18 * off)


def score_tables(tables: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """A row for each table: its first header row, the place of the item column, fields, primary and continuation rows,
    the longest cell and score; null where the table is not usable. expected: doc and expected_columns."""
    ship(tables.sparkSession)
    shown, plain = F.transform("cells", lambda c: R.normal_cell(c, True)), R.normal_row(F.col("cells"))
    spaced = tables.select(*TABLE, "row_no", F.size("cells").alias("__width"), F.array_max(F.transform("cells", lambda c: F.length(F.coalesce(c, F.lit(""))))).alias("__longest"), F.when(F.col("row_no") < HEADER_WITHIN, shown).otherwise(F.array().cast("array<string>")).alias("__shown"), plain.alias("__plain"))
    # both readings of a row are told at once; headers by their joined lines, within the first rows
    told = spaced.withColumn("__told", fields_of(F.concat("__shown", "__plain"))).withColumn("__head", F.slice("__told", 1, F.size("__shown"))).withColumn("__fields", F.slice("__told", F.size("__shown") + 1, F.size("__plain")))
    told = told.select(*TABLE, "row_no", "__width", "__longest", "__plain", "__fields", "__head", F.when(R.is_header("__head"), F.col("row_no")).alias("__at"))
    own = Window.partitionBy(*TABLE)
    met = told.withColumn("__first", F.min_by("__head", "__at").over(own)).withColumn("header_row", F.min("__at").over(own))
    items = F.filter(F.transform("__first", lambda f, k: F.when(f == "itemName", k)), lambda k: k.isNotNull())
    met = met.withColumn("item_at", F.try_element_at(items, F.lit(-1)))
    body = F.coalesce(F.col("item_at").isNotNull() & (F.col("row_no") > F.col("header_row")) & (F.size("__plain") > 0), F.lit(False))
    met = met.withColumn("__body", body).withColumn("__item", F.when(F.col("__body"), R.is_item_row("__plain", "__fields", F.col("item_at"))))
    met = met.withColumn("__primary", F.col("__item") & R.begins_item(F.col("__plain"), F.col("item_at")))
    n_fields = F.size(F.array_distinct(F.filter(F.first("__first"), lambda f: f.isNotNull())))
    met = met.groupBy(*TABLE).agg(
        F.count("*").alias("n_rows"), F.min_by("__width", "row_no").alias("width"), F.coalesce(F.max("__longest"), F.lit(0)).alias("longest"), F.count_if("__body").alias("__n"), F.first("header_row").alias("header_row"),
        F.first("item_at").alias("item_at"), n_fields.alias("n_fields"), F.count_if("__primary").alias("n_primary"), F.count_if(~F.col("__primary") & F.col("__item")).alias("n_continued"),
    )
    told_of = ["header_row", "item_at", "n_fields", "n_primary", "n_continued"]  # of tables with rows below their header
    met = met.withColumns({c: F.when(F.col("__n") > 0, F.col(c)) for c in told_of})
    if expected is not None:
        met = met.join(expected.select("doc", "expected_columns"), "doc", "left")
    bonus = F.lit(0) if expected is None else width_bonus(F.col("width"), F.col("expected_columns"))
    score = F.col("n_primary") * 20 + F.col("n_fields") * 3 - F.col("n_continued") * 5 - long_cell_penalty(F.col("longest")) + F.least("n_rows", F.lit(ROW_BONUS)) + bonus
    usable = (F.col("n_rows") >= 2) & (F.col("n_primary") > 0)
    return met.select(*TABLE, "header_row", "item_at", "n_fields", "n_primary", "n_continued", "longest", "width", "n_rows", F.when(usable, score).cast("long").alias("score"))


def best_tables(tables: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """The tables of each page's best candidate, of equals the first: those with a positive score add up to the candidate's."""
    scored = score_tables(tables, expected).where("score > 0")
    pages = scored.withColumn("page_score", F.sum("score").over(Window.partitionBy("doc", "page", "candidate")))
    best = F.max(F.struct("page_score", -F.col("candidate"))).over(Window.partitionBy("doc", "page"))
    return pages.withColumn("__best", best).where(F.struct("page_score", -F.col("candidate")) == F.col("__best")).drop("__best")
