"""Full accounting, totals, margins, rows, headers and state, on stated cases and edges."""

from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.functions import accounting, compare, metadata
from ledgerloom.operators import accuracy, headers, invoices, review, rows, state
from ledgerloom.sources import texts


def test_solved_rows(spark):
    names = ["quantity", "rate", "discountPercent", "cgstPercent", "sgstPercent", "gstPercent", "amount"]
    cases = [("10", "88.80", "10.00", "2.5", "2.5", None, "888.00"), ("9.50+.50", "60.62", "12.00", "2.5", "2.5", None, "575.89"), ("10", "100", "10", None, None, "5", "900.00"), ("10", "100", "0", None, None, "18", "1180.00"), ("10", None, "10", None, None, None, "888.00"), ("10", "88.80", "0", None, None, None, "8880.00"), (None,) * 7, ("10+ABC", "1", None, None, None, None, None)]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, " + ", ".join(f"{c} string" for c in names))
    got = accounting.solve_rows(df).orderBy("k").collect()
    assert [r.semantics for r in got][:6] == ["GROSS", "GROSS", "TAXABLE_PRE_GST", "NET_POST_GST", "GROSS", "MISMATCH"]
    assert [float(r.taxable_out) for r in got[:4]] == [799.20, 506.78, 900.0, 1000.0] and [float(r.net_out) for r in got[:4]] == [839.16, 532.12, 945.0, 1180.0]
    assert (float(got[1].quantity), float(got[1].free)) == (9.5, 0.5) and float(got[0].gst) == 5 and float(got[4].rate) == 88.8
    assert got[5].status == "MATHEMATICAL_MISMATCH" and got[5].confidence < 0.7 and len(got[5].discrepancies) >= 1
    assert got[6].semantics == "UNKNOWN" and got[7].discrepancies[0].status == "UNRESOLVED_COMPOUND"
    s = accounting.health(accounting.solve_rows(df)).first()
    assert (s.n_checked, s.n_mismatched) == (8, 1) and accounting.health(accounting.solve_rows(df.limit(0))).first().health == 1.0


def test_margins_and_totals(spark):
    d = lambda *x: tuple(None if v is None else Decimal(str(v)) for v in x)
    df = spark.createDataFrame([d(100, 80, 10, 0, 896), d(100, 80, 10, 2, 896), d(100, 95, 1, 0, 95), d(100, 115, 1, 0, 115), d(None, None, None, None, None)], ", ".join(f"{c} decimal(10,2)" for c in ("mrp", "rate", "quantity", "free", "net")))
    got = accounting.margins(df).collect()
    assert [r.margin_class for r in got] == ["STANDARD_RETAIL_MARGIN", "STANDARD_RETAIL_MARGIN", "LOW_RETAIL_MARGIN", "PRICE_INVERSION_ERROR", "STANDARD_RETAIL_MARGIN"]
    assert [float(r.unit_cost) for r in got[:2]] == [89.6, 74.67] and float(got[1].scheme_benefit) == 160 and float(got[0].margin) == 20
    line = "invoice int, " + ", ".join(f"{c} decimal(18,2)" for c in ("quantity", "free", "rate", "discount", "gst", "cgst", "sgst", "taxable", "net"))
    lines = spark.createDataFrame([(1, *d(10, 0, 100, 10, 12, None, None, 900, 1008)), (1, *d(10, 0, 100, 0, 12, None, None, 1000, 1120)), (2, *d(1, 0, 1500, 0, 12, None, None, None, None))], line)
    stated = spark.createDataFrame([(1, *d(1900, 228, 1.5, 0.5, 2130)), (2, *d(None, None, None, None, 2500))], "invoice int, " + ", ".join(f"{c} decimal(18,2)" for c in ("taxable", "gst", "tcs", "round_off", "total")))
    got = {r.invoice: r for r in invoices.reconcile_in_full(lines, stated).collect()}
    assert got[1].status == "RECONCILED_BALANCED" and float(got[1].total_delta) == 0 and (float(got[1].sum_taxable), float(got[1].sum_gst), float(got[1].sum_net)) == (1900, 228, 2128)
    assert got[2].status == "UNRECONCILED_MISMATCH" and float(got[2].total_delta) == 820


def test_wrapped_and_sectioned_rows(spark):
    table = [["Product", "Pack", "Batch", "Qty", "Rate", "Amount"], ["AMARYL 1 MG TABLET", "30'S", "AM1", "10+2", "88.80", "888.00"], ["(30'S PACK)", "", "", "", "", ""], ["ASTYMIN FORTE", "30'S", "A2", "5", "10.00", "50.00"], ["CAPSULES 30'S", "", "", "", "", ""], ["Grand Total", "", "", "", "", "938.00"], ["Sales Return", "", "", "", "", ""], ["DOLO 650", "15'S", "D1", "3", "2.00", "6.00"]]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(table)] + [(2, 0, ["", "", "", "", "", ""])], "doc int, row_no int, cells array<string>")
    got = rows.logical_rows(df, ["itemName", "pack", "batchNo", "quantity", "rate", "amount"]).orderBy("group_no").collect()
    assert [(r.itemName, float(r.quantity), float(r.free), r.n_rows) for r in got] == [("AMARYL 1 MG TABLET (30'S PACK)", 10, 2, 2), ("ASTYMIN FORTE CAPSULES 30'S", 5, 0, 2)]
    kinds = rows.with_fields(df).where("doc = 1").orderBy("row_no").select(rows.is_header().alias("h"), rows.is_repeated_header().alias("r"), rows.is_skippable(F.col("cells")).alias("s"), rows.is_product_row(item_at=F.lit(0)).alias("p")).collect()
    assert [r.h for r in kinds] == [True] + [False] * 7 and kinds[0].r and kinds[5].s and [k for k, r in enumerate(kinds) if r.p] == [1, 3, 7]
    cell = spark.createDataFrame([("PAN PAN",), ("a\r\nb",), (None,)], "c string").select(rows.normal_cell(F.col("c")).alias("x"), rows.normal_cell(F.col("c"), True).alias("y")).collect()
    assert [(r.x, r.y) for r in cell] == [("PAN", "PAN"), ("a", "a b"), ("", "")]


def test_projection_templates_and_choices(spark):
    page = spark.createDataFrame([(1, 1, ["5", "DOLO", "2.00"])], "doc int, row_no int, cells array<string>")
    local = spark.createDataFrame([(1, 0, "Qty"), (1, 1, "Item Name"), (1, 2, "PTR")], "doc int, pos int, header string")
    assert rows.project(page, local, ["Product Name", "Quantity", "Rate", "MRP"]).first().cells == ["DOLO", "5", "2.00", ""]
    odd = spark.createDataFrame([("Zork",), ("Rack",), (None,), ("",)], "header string")
    saved = spark.createDataFrame([("Zork", "mrp"), ("Rack", "mrp"), ("x", "old")], "header string, field string")
    assert {r.header: r.field for r in headers.match(odd, saved).collect()} == {"Zork": "mrp", "Rack": None, None: None, "": None}
    one = spark.createDataFrame([(["S.No", "Item\nName", "", "Item Name", "MRP"],)], "h array<string>")
    r = one.select(headers.options(F.col("h")).alias("o"), headers.named(F.col("h")).alias("n"), headers.chosen(F.col("h"), F.lit("item name")).alias("c")).first()
    assert r.o == ["", "Item Name", "MRP"] and r.n[2] == "Unnamed_Col_2" and r.c == "Item\nName"
    cells = spark.createDataFrame([(1, k, 0, v) for k, v in enumerate(["a", "", "a", "b", "c", "d"])], "doc int, row_no int, col_no int, value string")
    assert headers.samples(cells).first().samples == "a, b, c"


def test_stock_returns(spark):
    bought = spark.createDataFrame([(1, "PAN 40MG", "", "PN501", 10.0, 0.0, 1.0), (5, "AMARYL", "", "A", 10.0, 2.0, 1.0)], "seq long, product string, pack string, batch string, billed double, free double, rate double")
    back = spark.createDataFrame([(2, "PAN 40MG", "", 3.0), (3, "PAN 40MG", "none", 1.0), (4, "AMARYL", None, 4.0), (6, "AMARYL", "A", 99.0), (7, None, "A", 1.0)], "seq long, product string, batch string, quantity double")
    moves, stock = state.ingest_stock(bought, back)
    assert {r.product: r.stock for r in stock.collect()} == {"PAN 40MG": 7.0, "AMARYL": 0.0} and moves.count() == 4
    assert state.ingest_stock(bought.limit(0), back)[1].collect() == []


def test_matches_and_empty_tables(spark):
    pairs = [("a", "A ", "NORMALIZED"), (None, "", "EXACT"), (None, "x", "UNEXPECTED"), ("x", None, "MISSING"), ("TELMA 40 MG", "TELMA 40 MG TABLET", "NORMALIZED"), ("ab", "abc", "MISMATCH")]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "t string, p string")
    assert [r.m for r in df.select(compare.text_match(F.col("t"), F.col("p")).alias("m")).collect()] == [x for *_, x in pairs]
    n = spark.createDataFrame([("100", "100.4"), ("100", "101"), ("0", "0.05"), ("₹ 1,000", "1000%"), ("x", "1")], "t string, p string")
    assert [r.m for r in n.select(compare.number_match(F.col("t"), F.col("p")).alias("m")).collect()] == ["TOLERANCE", "MISMATCH", "TOLERANCE", "EXACT", "MISMATCH"]
    none = spark.createDataFrame([], "decision string, verified boolean, field_errors int, row_errors int")
    assert accuracy.auto_accept_safety(none).first().precision == 1.0
    docs = spark.createDataFrame([], "doc int, " + ", ".join(f"{c} string" for c in ("rate", "mrp", "quantity", "freeQuantity", "amount", "gstPercent", "batchNo", "expiryDate", "hsnCode")))
    assert review.column_swaps(docs).collect() == []


def test_texts(spark):
    files = spark.createDataFrame([("/a/x.csv", 'name,"q,ty"\n"A ""x""|",1\n\nB,2\n'), ("/a/y.tsv", "a\tb\r\n1\t2"), ("/a/z.csv", "")], "path string, content string")
    got = {r.path: r for r in texts.delimited(files).collect()}
    assert got["/a/x.csv"].markdown.split("\n")[4:] == ["| name | q,ty |", "| --- | --- |", '| A "x"\\| | 1 |', "| B | 2 |"] and (got["/a/x.csv"].n_rows, got["/a/x.csv"].n_columns) == (2, 2)
    assert got["/a/y.tsv"].n_columns == 2 and got["/a/z.csv"].n_rows == 0
    made = [r.markdown for r in texts.json_text(spark.createDataFrame([("/a/b.json", '{"k": [1, 2]}'), ("/a/l.json", "[1, 2, 3]"), ("/a/e.json", "{bad")], "path string, content string")).collect()]
    assert "Root Keys (1):** `k`" in made[0] and "Array with 3 items" in made[1] and made[2].startswith("# Error reading JSON")
    s = spark.createDataFrame([("SHREE MEDICAL AGENCIES GST INVOICE No 5",), ("ABC",)], "c string").select(metadata.seller_text(F.col("c")).alias("s")).collect()
    assert [r.s for r in s] == ["SHREE MEDICAL AGENCIES", "ABC"]
