"""Words with coordinates to rows, on made-up pages."""

import pytest

from ledgerloom.operators import pages
from ledgerloom.operators.pages import Page, Word

HEADS = [("Product", 30, 70), ("Name", 74, 100), ("Batch", 200, 230), ("Exp", 260, 280), ("Qty", 300, 320), ("Ra", 350, 362), ("te", 363, 372), ("Amount", 430, 470)]
LINES = [("AMARYL 1MG", "AM1029", "12/27", "10", "88.80", "888.00"), ("TELMA 40MG", "TL9921", "08/28", "20", "140.00", "2800.00"), ("DOLO 650", "D77", "01/29", "5", "30.00", "150.00"), ("PAN D", "P1", "02/27", "7", "9.50", "66.50")]
AT = [30, 200, 258, 305, 345, 432]


def page(lines=LINES, extra=()):
    out = [Word(t, x0, x1, 100, 108) for t, x0, x1 in HEADS] + [Word("GSTIN:", 30, 60, 40, 48), Word("27ABCDE1234F1Z5", 64, 150, 40, 48)]
    for k, line in enumerate(lines):
        for x, cell in zip(AT, line):
            for w in cell.split():
                out.append(Word(w, x, x + 5.0 * len(w), 120 + 14 * k, 128 + 14 * k))
                x += 5.0 * len(w) + 3
    return out + [Word(*x) for x in extra]


def test_fields_and_joined_headers():
    assert pages.field_of("M R P") == "mrp" and pages.field_of("Rack") is None and pages.field_of("S.No") is None and pages.field_of("Prodct Name") == "itemName"
    joined = [w.text for w in pages.joined_line([Word(t, a, b, 0, 8) for t, a, b in HEADS])]
    assert joined == ["ProductName", "Batch", "Exp", "Qty", "Rate", "Amount"]
    assert [w.text for w in pages.joined_line([Word("Pack", 0, 20, 0, 8), Word("Qty", 22, 36, 0, 8)])] == ["Pack", "Qty"]  # two fields


def test_table_of_a_page():
    got = Page.of(page(extra=[("Bank", 30, 60, 400, 408), ("ICICI", 64, 90, 400, 408)]), 612.0, 792.0)
    assert [c.field for c in got.columns] == ["itemName", "batchNo", "expiryDate", "quantity", "rate", "amount"]
    assert got.rows == [list(x) for x in LINES] and got.confidence > 0.9
    assert all(a.x1 == b.x0 and a.x0 < a.x1 for a, b in zip(got.columns, got.columns[1:]))


def test_no_header_and_empty_page():
    assert Page.of([], 612.0, 792.0).rows == []
    assert Page.of([Word("Phone:", 10, 40, 20, 28), Word("9876543210", 44, 99, 20, 28)], 612.0, 792.0).rows == []


def test_subcolumns():
    columns = [pages.Column("AMOUNT GST", None, 100, 200, 150), pages.Column("BATCH NO", "batchNo", 200, 260, 230)]
    rows = [[Word(f"{k}00.00", 105, 130, 10 * k, 8), Word("12%", 170, 185, 10 * k, 8), Word(f"B{k}", 205, 215, 10 * k, 8)] for k in range(1, 6)]
    got = pages.subcolumns(columns, rows)
    assert [(c.text, c.field, c.status) for c in got] == [("AMOUNT", "amount", "split"), ("GST", "gstPercent", "split"), ("BATCH NO", "batchNo", "clean")]


def test_unnamed_column_and_rulings():
    heads = [pages.Column("Item", "itemName", 20, 60, 40), pages.Column("Pack", "pack", 200, 230, 215)]
    body = [Word("x", 300, 320, 10 * k, 8) for k in range(4)]
    got = pages.boundaries(heads, 612.0, body, [180.0])
    assert [c.text for c in got] == ["Item", "Pack", "Unnamed_Col_2"] and got[0].x1 in (180.0, 196.0)


def test_page_rows(spark):
    rows = [(1, 1, w.text, *map(float, (w.x0, w.x1, w.top, w.bottom))) for w in page()] + [(2, 1, "nothing", 1.0, 5.0, 1.0, 9.0), (3, 1, None, 1.0, 2.0, 3.0, 4.0), (4, 1, "x", None, None, None, None)]
    words = spark.createDataFrame(rows, "doc long, page int, text string, x0 double, x1 double, top double, bottom double")
    sheets = spark.createDataFrame([(k, 1, 612.0, 792.0) for k in range(1, 5)], "doc long, page int, width double, height double")
    got = pages.page_rows(words, sheets).orderBy("row_no").collect()
    assert [r.cells for r in got] == [list(x) for x in LINES] and {r.doc for r in got} == {1}
    assert got[0].fields == ["itemName", "batchNo", "expiryDate", "quantity", "rate", "amount"]
    assert pages.page_rows(words.limit(0), sheets).collect() == []


@pytest.mark.parametrize("text,x0,x1,field", [("88.80", 10.0, 30.0, "rate"), ("TABLET", 5.0, 60.0, "rate"), ("TABLET", 5.0, 60.0, "itemName"), ("12/27", 90.0, 99.0, "expiryDate"), ("7", 130.0, 134.0, "itemName")])
def test_affinity_of_is_the_column_expression(spark, text, x0, x1, field):
    from pyspark.sql import functions as F

    from ledgerloom.operators import layout

    w = F.struct(F.lit(text).alias("text"), F.lit(x0).alias("x0"), F.lit(x1).alias("x1"))
    c = F.struct(F.lit(field).alias("field"), F.lit(20.0).alias("x0"), F.lit(100.0).alias("x1"))
    assert abs(spark.range(1).select(layout._affinity(w, c).alias("s")).first().s - layout.affinity_of(text, x0, x1, field, 20.0, 100.0)) < 1e-9
