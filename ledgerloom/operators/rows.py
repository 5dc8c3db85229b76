"""Table rows of documents: sections, wrapped rows, page chrome. Rows are doc, row_no, cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.accounting import solve_rows
from ..functions.dates import let
from ..functions.fixed import CONTACT, FOOTER, HEADER_COMPANIONS, HEADER_PHRASES, LETTERHEAD, NOT_ITEM, REPEATED_HEADERS, RETURN_SECTION, SCHEME_SECTION, SECTION_META
from ..functions.text import any_of, cleaned, contains_any, footer_read, footer_shaped, row_reason
from ..session import ship
from .headers import fields_and_plain, match


def joined(cells: str = "cells"):
    return F.trim(F.array_join(F.filter(F.transform(cells, F.trim), lambda c: c != ""), " "))


def sections(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds section: what the last heading row said; rows before any are purchases."""
    low = F.lower(text)
    here = F.when(contains_any(low, RETURN_SECTION), "returns_adjusted").when(contains_any(low, SCHEME_SECTION), "scheme_items")
    upto = Window.partitionBy("doc").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("is_heading", here.isNotNull()).withColumn("section", F.coalesce(F.last(here, True).over(upto), F.lit("purchase_items")))


def merge_wrapped(rows: DataFrame, item: str = "item", primary: str = "is_primary") -> DataFrame:
    """One row for each primary row and those that continue it; item texts are joined."""
    upto = Window.partitionBy("doc").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    grouped = rows.withColumn("group_no", F.greatest(F.sum(F.col(primary).cast("int")).over(upto), F.lit(1)))
    parts = F.array_sort(F.collect_list(F.when(F.col(item) != "", F.struct("row_no", item))))
    return grouped.groupBy("doc", "group_no").agg(F.min("row_no").alias("row_no"), F.count("*").alias("n_rows"), F.array_join(F.transform(parts, lambda x: x[item]), " ").alias(item))


def with_reason(rows: DataFrame, text: str = "text", is_header=None) -> DataFrame:
    """Adds reason: why a row is no line item (null: it is one)."""
    return rows.withColumn("reason", row_reason(F.col(text), F.lit(False) if is_header is None else is_header))


def column_profile(cells: DataFrame) -> DataFrame:
    """Shares and sizes by column of doc, col_no, value. Equal values are counted first, so that each is dealt out and looked at once."""
    v, n = F.col("value"), F.col("n")
    counted = cells.groupBy("doc", "col_no", F.trim("value").alias("value")).agg(F.count("*").alias("n"))
    some, known = F.when(v != "", n), F.when(v.isNotNull(), n)
    passed = lambda p: F.coalesce(F.sum(F.when((v != "") & v.rlike(p), n)), F.when(F.sum(some).isNotNull(), 0))
    share = lambda p: (passed(p).cast("double") / F.sum(some)).alias
    return counted.groupBy("doc", "col_no").agg(
        F.sum(n).alias("n"), (F.coalesce(F.sum(some), F.when(F.sum(known).isNotNull(), 0)).cast("double") / F.sum(known)).alias("fill"), F.count_if(v != "").alias("n_distinct"), F.min(F.when(v != "", F.length(v))).alias("min_len"), F.max(F.length(v)).alias("max_len"),
        share(r"^\d+$")("int_share"), share(r"^\d+\.\d+$")("decimal_share"), share(r"[A-Za-z]{3,}")("text_share"), share(r"^(\d{4}|\d{6}|\d{8})$")("hsn_share"), share(r"^\d{1,2}[/-]\d{2,4}$")("expiry_share"), share(r"^(?=.*\d)(?=.*[A-Za-z])[A-Za-z0-9-]{3,14}$")("batch_share"),
    )


def serial_columns(cells: DataFrame) -> DataFrame:
    """Columns that hold one run of row numbers."""
    n = F.col("value").try_cast("int")
    got = cells.groupBy("doc", "col_no").agg(F.count("*").alias("n"), F.count(n).alias("k"), F.countDistinct(n).alias("d"), F.min(n).alias("lo"), F.max(n).alias("hi"))
    ok = (F.col("n") == F.col("k")) & (F.col("k") == F.col("d")) & (F.col("hi") - F.col("lo") + 1 == F.col("k")) & (F.col("lo") <= 5) & (F.col("hi") <= 500)
    return got.select("doc", "col_no", F.coalesce(ok, F.lit(False)).alias("is_serial"))


# ---- what a row of cells is. Rows are doc, row_no, cells; with_fields() adds what the cells say as headers.


def normal_cell(c, item: bool = False):
    """The first line of a cell (an item's lines as one); a word that stands twice once; null is empty."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r", "\n"), "\n"), F.trim), lambda x: x != "")
    text = F.array_join(lines, " ") if item else F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    words = F.split(F.trim(text), r"\s+")
    # what has no blank is one word on one line
    return F.when(~c.rlike(r"\s"), c).when((F.size(words) == 2) & (F.upper(words[0]) == F.upper(words[1])), words[0]).otherwise(text)


def normal_row(cells, item_at=None):
    """normal_cell of each cell; item_at: the place of the item."""
    at = F.lit(-1) if item_at is None else F.coalesce(item_at, F.lit(-1))
    return F.transform(cells, lambda c, k: F.when(k == at, normal_cell(c, True)).otherwise(normal_cell(c)))


def filled(cells):
    return F.size(F.filter(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))


_BLANK = r"[\s\x0b]*"
_TOLD = any_of([*FOOTER, *LETTERHEAD, *NOT_ITEM, *REPEATED_HEADERS, *HEADER_PHRASES, *RETURN_SECTION, *SCHEME_SECTION, "thousand", "hundred", "lakh", "crore", "page", "@", "www."])
WORDS = "|".join([_TOLD, *(x.replace(r"\b", "").replace(r"\s*", _BLANK) for x in (CONTACT, SECTION_META))]).replace(r"\ ", " ").replace(" ", " +")
"""What a row has, in lower case, of which any of the predicates below tells footers, letterheads, headings or repeated headers;
`terms` and `amount in words` are among the footers."""


def with_fields(rows: DataFrame) -> DataFrame:
    """Adds fields: the canonical field that each cell names as a header, or null; told in the rows, no text is dealt out. Adds plain:
    nothing in the row is of WORDS, so that the predicates below, where they are given it, need not look for them one by one."""
    ship(rows.sparkSession)
    return rows.withColumn("__told", fields_and_plain(F.col("cells"), WORDS)).select(*rows.columns, "__told.fields", "__told.plain")


def _unless(plain, told):
    """False where a row is plain."""
    return told if plain is None else F.when(plain, False).otherwise(told)


def is_header(fields="fields"):
    """Two canonical fields or more."""
    return F.size(F.array_distinct(F.filter(fields, lambda f: f.isNotNull()))) >= 2


def is_repeated_header(cells="cells", fields="fields"):
    return is_header(fields) | let(F.lower(joined(cells)), _header_read)


def _header_read(low):
    hits = sum((F.when(low.contains(w), 1).otherwise(0) for w in REPEATED_HEADERS), F.lit(0))
    return (contains_any(low, HEADER_PHRASES) & contains_any(low, HEADER_COMPANIONS)) | (hits >= 3)


def is_skippable(cells="cells", plain=None):
    said = lambda low: footer_read(low) | contains_any(low, LETTERHEAD) | low.rlike(r"\b(terms\s*&?\s*conditions|amount in words)\b")
    return (F.size(cells) == 0) | _unless(plain, let(F.lower(joined(cells)), said))


def _item(cells, item_at):
    return F.lit("") if item_at is None else F.coalesce(F.get(cells, item_at), F.lit(""))


def is_item_row(cells="cells", fields="fields", item_at=None, plain=None):
    """Three filled cells with an item of three letters, or four with another such cell that is no header."""
    cells, fields = (F.col(x) if isinstance(x, str) else x for x in (cells, fields))
    return _shaped(cells, fields, item_at) & ~_unless(plain, let(F.lower(joined(cells)), footer_read))


def _shaped(cells, fields, item_at=None):
    """What an item row is but for footers."""
    letters = F.exists(F.arrays_zip(cells.alias("c"), fields.alias("f")), lambda x: x["c"].rlike("[A-Za-z]{3,}") & x["f"].isNull())
    named = _item(cells, item_at).rlike("[A-Za-z]{3,}")
    return let(filled(cells), lambda n: (n >= 3) & (named | (letters & (n >= 4))))


def is_primary_row(cells="cells", fields="fields", item_at=None):
    cells = F.col(cells) if isinstance(cells, str) else cells
    return is_item_row(cells, fields, item_at) & begins_item(cells, item_at)


def begins_item(cells, item_at=None):
    """Whether an item row is a primary one: by the item, else by the first cells."""
    near = filled(F.slice(cells, 1, 3)) >= 2
    return near if item_at is None else F.when(item_at < F.size(cells), _item(cells, item_at).rlike("[A-Za-z]{3,}")).otherwise(near)


def is_product_row(cells="cells", fields="fields", item_at=None, plain=None):
    """A line of goods: digits, an item of two letters, and nothing that headers, footers or addresses say."""
    cells, fields = (F.col(x) if isinstance(x, str) else x for x in (cells, fields))

    def chrome(low):
        return contains_any(low, [*FOOTER, *LETTERHEAD, "@", "www."]) | footer_shaped(low) | _header_read(low) | low.rlike(CONTACT)

    other = F.filter(F.arrays_zip(cells.alias("c"), fields.alias("f")), lambda x: x["c"].rlike("[A-Za-z]{2,}") & x["f"].isNull())
    item = F.coalesce(F.try_element_at(F.transform(other, lambda x: x["c"]), F.lit(1)), F.lit("")) if item_at is None else _item(cells, item_at)
    named = let(item, lambda x: x.rlike("[A-Za-z]{2,}") & ~_unless(plain, contains_any(F.lower(x), LETTERHEAD + FOOTER + NOT_ITEM)))
    good = F.exists(cells, lambda c: F.coalesce(c.rlike(r"\d"), F.lit(False))) & named & ~is_header(fields) & ~_unless(plain, let(F.lower(joined(cells)), chrome))
    return good & (F.lit(True) if item_at is None else _shaped(cells, fields, item_at) & begins_item(cells, item_at))


def in_sections(rows: DataFrame) -> DataFrame:
    """Rows with fields -> those that a section takes, with section: goods, and after the first of a section
    whatever continues it. Headings, footers and lines about notes are left out."""
    plain = F.col("plain")
    marked = sections(rows.withColumn("__text", F.when(plain, F.when(filled("cells") > 0, "-").otherwise("")).otherwise(joined("cells"))).where("__text <> ''"), "__text")
    marked = marked.where(~F.col("is_heading") & ~_unless(plain, let(F.lower("__text"), lambda low: footer_read(low) | low.rlike(SECTION_META))))
    # no footers are left: an item row is told by its shape
    goods = _shaped(F.col("cells"), F.col("fields")) | is_product_row(plain=plain)
    upto = Window.partitionBy("doc", "section").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("__begun", F.max(goods.cast("int")).over(upto)).where("__begun = 1").drop("__begun", "__text", "is_heading")


def merge_rows(rows: DataFrame, width: int, item_at: int | None, numeric: list[int]) -> DataFrame:
    """Rows with fields -> one row for each primary row and those that continue it: item texts are joined, other cells
    taken from the first that has them. A row is primary with an item and a number in one of the numeric
    columns (in any two cells, where none is known); a document's first row always is."""
    at = None if item_at is None else F.lit(item_at)
    digits = lambda c: F.coalesce(c, F.lit("")).rlike(r"\d")
    number = F.size(F.filter("cells", digits)) >= 2
    if numeric:
        number = F.lit(False)
        for k in numeric:
            number = number | digits(F.get("cells", F.lit(k)))
    primary = number & is_item_row("cells", "fields", at, F.col("plain"))
    upto = Window.partitionBy("doc").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    grouped = rows.where(filled("cells") > 0).withColumn("group_no", F.greatest(F.sum(primary.cast("int")).over(upto), F.lit(1)))
    parts = grouped.groupBy("doc", "group_no").agg(F.min("row_no").alias("row_no"), F.count("*").alias("n_rows"), F.array_sort(F.collect_list(F.struct("row_no", "cells"))).alias("parts"))
    values = lambda k: F.filter(F.transform("parts", lambda p: F.trim(F.coalesce(F.get(p["cells"], F.lit(k)), F.lit("")))), lambda x: x != "")
    cell = lambda k: F.array_join(values(k), " ") if k == item_at else F.coalesce(F.try_element_at(values(k), F.lit(1)), F.lit(""))
    return parts.select("doc", "group_no", "row_no", "n_rows", F.array(*(cell(k) for k in range(width))).alias("cells"))


def logical_rows(rows: DataFrame, columns: list[str | None]) -> DataFrame:
    """Raw rows of tables whose columns are these fields -> solved line items of the purchase section."""
    place = {f: k for k, f in enumerate(columns) if f}
    amounts = [place[f] for f in ("quantity", "freeQuantity", "rate", "amount", "mrp", "taxableAmount", "netAmount") if f in place]
    bought = in_sections(with_fields(rows)).where("section = 'purchase_items'")
    merged = merge_rows(bought, len(columns), place.get("itemName"), amounts)
    return solve_rows(merged.select("doc", "group_no", "n_rows", *(F.nullif(F.col("cells")[k], F.lit("")).alias(f) for f, k in place.items())))


def project(rows: DataFrame, local: DataFrame, master: list[str]) -> DataFrame:
    """Rows of a page with headers of its own (doc, pos, header) in the order of a master header: by cleaned text,
    else by field, where the cell has a value; else empty."""
    own = match(local.select("doc", "pos", "header")).select("doc", F.col("pos").alias("at"), cleaned(F.col("header")).alias("word"), "field")
    wanted = rows.sparkSession.createDataFrame([(k, h) for k, h in enumerate(master)], "k int, header string")
    wanted = match(wanted).select("k", cleaned(F.col("header")).alias("w"), F.col("field").alias("f"))
    cells = rows.select("doc", "row_no", F.posexplode("cells").alias("at", "value")).join(own, ["doc", "at"])
    # the master has a few dozen columns
    met = cells.join(F.broadcast(wanted), (F.col("word") == F.col("w")) | (F.col("field") == F.col("f")))
    met = met.withColumn("tier", F.when(F.col("word") == F.col("w"), 0).otherwise(1)).where("value <> ''")
    best = met.groupBy("doc", "row_no", "k").agg(F.min(F.struct("tier", "at", "value")).alias("x"))
    by = best.groupBy("doc", "row_no").agg(F.map_from_entries(F.collect_list(F.struct("k", "x.value"))).alias("m"))
    all_rows = rows.select("doc", "row_no").join(by, ["doc", "row_no"], "left")
    return all_rows.select("doc", "row_no", F.array(*(F.coalesce(F.try_element_at("m", F.lit(k)), F.lit("")) for k in range(len(master)))).alias("cells"))
