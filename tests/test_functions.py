"""Column functions on written examples."""

from pyspark.sql import functions as F

from ledgerloom.functions import accounting, dates, fuzzy, quantities, text
from ledgerloom.operators import evaluation, headers, identities, rows, stock
from ledgerloom.plans.queries import MASTERS
from ledgerloom.sources import exports, files
from ledgerloom.streaming import inbox


def values(spark, inputs, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_schemes(spark):
    good = {"10+2": (10, 2), "1+0": (1, 0), "0+2": (0, 2), "9.50+.50": (9.5, 0.5), "2.500+.500": (2.5, 0.5), ".500+.250": (0.5, 0.25), "9.50 + .50": (9.5, 0.5), "10+2 Nos": (10, 2), "4+1'S": (4, 1), "10 + 2 TAB": (10, 2), "+2": (0, 2), "+.50": (0, 0.5), "10+O": (10, 0), "9.5O+.5O": (9.5, 0.5), "4+l": (4, 1), "l0+2": (10, 2), "10+Z": (10, 2)}
    assert [(y.billed, y.free) for y in values(spark, good, quantities.scheme)] == list(good.values())
    bad = ["ASTYMIN+FORTE", "10+ABC", "++", "+", "10", "", None]
    assert [y.is_compound for y in values(spark, bad, quantities.scheme)] == [False] * len(bad)
    assert values(spark, ["1,234.50 Rs", "-3", "x", None, ".5"], quantities.number) == [1234.5, -3.0, None, None, 0.5]


def test_expiry(spark):
    good = {"12/28": "12/2028 2028-12-31", "06-27": "06/2027 2027-06-30", "02/28": "02/2028 2028-02-29", "2029-08": "08/2029 2029-08-31", "15/09/2028": "09/2028 2028-09-30", "28/11": "11/2028 2028-11-30", "DEC-28": "12/2028 2028-12-31", "OCT/2027": "10/2027 2027-10-31", "15-MAY-2029": "05/2029 2029-05-31", "SEPT-26": "09/2026 2026-09-30", "JAN 28": "01/2028 2028-01-31", "AUG.2028": "08/2028 2028-08-31", "MARCH 2030": "03/2030 2030-03-31", "1228": "12/2028 2028-12-31", "0427": "04/2027 2027-04-30", "122028": "12/2028 2028-12-31", "202812": "12/2028 2028-12-31", "25/MAY/2029": "05/2029 2029-05-31"}
    assert [y and f"{y.mmyyyy} {y.iso}" for y in values(spark, good, dates.expiry)] == list(good.values())
    assert values(spark, ["", "none", None, "13/2011", "99"], dates.expiry) == [None] * 5
    as_of = F.lit("2026-10-01").cast("date")
    assert values(spark, ["12/2025", "12/2026", "02/2027", "12/2028", "x"], lambda c: dates.shelf_life(dates.expiry(c)["iso"], as_of)) == ["EXPIRED_STOCK", "CRITICAL_SHORT_EXPIRY", "SHORT_EXPIRY_RISK", "OPTIMAL_SHELF_LIFE", "UNKNOWN_EXPIRY"]


def test_accounting(spark):
    lines = [("10", "0", "88.80", "10", "5", "888.00"), ("9.5", "0.5", "60.62", "12", "5", "575.89"), ("10", None, "100", "10", "5", "900"), ("10", None, "100", "0", "18", "1180"), ("10", None, None, "10", None, "888"), ("10", None, "88.80", "0", None, "8880"), (None, None, None, None, None, None), ("10", None, "100", "0", None, None)]
    cols = ["quantity", "free", "rate", "discount", "gst", "amount"]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(lines)], "i int, " + ", ".join(f"{c} string" for c in cols))
    df = df.withColumns({c: F.col(c).cast("decimal(18,4)" if c in ("quantity", "free") else "decimal(10,2)") for c in cols}).withColumns({c: F.lit(None).cast("decimal(18,2)") for c in ("taxable", "net")})
    got = accounting.solve(df).orderBy("i").collect()
    assert [r.semantics for r in got] == ["GROSS", "GROSS", "TAXABLE_PRE_GST", "NET_POST_GST", "GROSS", "MISMATCH", "UNKNOWN", "DERIVED_GROSS"]
    assert [float(r.taxable_out) for r in got[:4]] == [799.20, 506.78, 900.0, 1000.0]
    assert [float(r.net_out) for r in got[:4]] == [839.16, 532.12, 945.0, 1180.0]
    assert float(got[4].rate) == 88.8 and got[5].confidence == 0.5 and got[5].status == "MATHEMATICAL_MISMATCH"
    assert values(spark, ["30049099", "3004", "84131900", "300", ""], accounting.hsn_status) == ["STANDARD_PHARMA_HSN", "STANDARD_PHARMA_HSN", "NON_STANDARD_CHAPTER", "INVALID_FORMAT", "MISSING_HSN"]


def test_text(spark):
    names = {"TELMA 40MG TAB 15S": "TELMA 40MG", "AUGMENTIN 625 DUO TABLETS 10S": "AUGMENTIN 625", "PAN-D CAPSULE (1X15)": "PAN D", "AZITHRAL 500 MG TABLET 5'S": "AZITHRAL 500MG", "DOLO 650 TABLETS": "DOLO 650"}
    assert values(spark, names, text.drug_name) == list(names.values())
    told = {"TOTAL B/F 12": "RUNNING_BF_CF_ROW", "Carried Forward": "RUNNING_BF_CF_ROW", "PAGE TOTAL 3": "PAGE_SUBTOTAL_ROW", "Page 2 of 3": "PAGE_CONTINUATION_CHROME", "Bank Name": "LETTERHEAD_OR_FOOTER_ROW", "AMARYL 1MG": None}
    assert values(spark, told, lambda c: text.row_reason(c, F.lit(False))) == list(told.values())
    assert values(spark, ["M R P", "Q T Y."], text.header_repaired) == ["MRP", "QTY"]


def test_headers(spark):
    heads = {"Product Name": "itemName", "M.R.P": "mrp", "Batch No.": "batchNo", "QTY": "quantity", "sch": "discountPercent", "S.No": None, "GST%": "gstPercent", "Rack": None}
    df = spark.createDataFrame([(1, i, h) for i, h in enumerate(heads)], "doc int, pos int, header string")
    assert {r.header: r.field for r in headers.match(df).collect()} == heads


def test_rows(spark):
    df = spark.createDataFrame([(1, 1, "AMARYL 1 MG", True), (1, 2, "TABLET", False), (1, 3, "Sales Return", True), (1, 4, "DOLO", True)], "doc int, row_no int, text string, is_primary boolean")
    assert [r.section for r in rows.sections(df).orderBy("row_no").collect()] == ["purchase_items", "purchase_items", "returns_adjusted", "returns_adjusted"]
    assert [r.item for r in rows.merge_wrapped(df.withColumnRenamed("text", "item")).orderBy("row_no").collect()] == ["AMARYL 1 MG TABLET", "Sales Return", "DOLO"]


def test_stock(spark):
    moves = [("a", 1, -5), ("a", 2, 10), ("a", 3, -3), ("a", 4, -20), ("a", 5, 4), ("b", 1, -1)]
    df = spark.createDataFrame(moves, "item string, seq int, delta int")
    assert [r.balance for r in stock.balances(df, "item").orderBy("item", "seq").collect()] == [10, 7, 0, 4]


def test_fuzzy(spark):
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
        return row[-1]

    for a, b in (("AMARYL", "AMRYL 1"), ("", "x"), ("abcabc", "acbbca"), ("same", "same")):
        assert fuzzy.common(a, b) == slow(a, b)
    assert fuzzy.token_sort("b a", "a b") == 100 and fuzzy.token_set("TELMA 40", "TELMA 40 MG") == 100 and fuzzy.partial("abc", "xxabcxx") == 100
    df = spark.createDataFrame([("AMARYL 1MG STRIP",), ("TELMA 40MG TAB",), ("DOLO 650 TABLET",), ("zzz",)], "name string")
    got = {r.name: r.code for r in identities.fuzzy_match(df, spark.createDataFrame(MASTERS, 'code string, item_name string'), block=2).collect()}
    assert got == {"AMARYL 1MG STRIP": "MED-1001", "TELMA 40MG TAB": "MED-1003", "DOLO 650 TABLET": "MED-1009", "zzz": None}
    one = spark.createDataFrame([(["a", "b", "c"], ["a", "c", "d"]), ([], ["a"])], "x array<string>, y array<string>").select(fuzzy.header_similarity(F.col("x"), F.col("y")).alias("s")).collect()
    assert [r.s for r in one] == [0.667, 0.0]


def test_evaluation(spark):
    df = spark.createDataFrame([(100, True), (95, False), (50, True), (49, None)], "confidence int, correct boolean")
    assert [r.n for r in evaluation.calibration(df).orderBy("bucket").collect()] == [1, 1, 0, 0, 0, 0, 2]


def test_exports(spark):
    df = spark.createDataFrame([(1, 1, "A & B", "B1", 10, 2, 5.0, 0.0, 10.0, 12.0, 0.0), (1, 2, " ", "B2", 1, 0, 1.0, 1.0, 0.0, 0.0, 1.0)], "invoice int, line_no int, item string, batch string, quantity int, free int, rate double, gross double, discount double, gst double, net double")
    [m] = exports.marg(df).collect()
    assert m.GROSS_AMOUNT == 50 and round(m.NET_AMOUNT, 2) == 50.4
    assert "A &amp; B" in exports.tally_xml(df).first().xml and "<ACTUALQTY> 12 Nos<" in exports.tally_xml(df).first().xml
    assert '"total_received_stock":12.0' in exports.canonical_json(df).first().json


def test_files_and_inbox(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.pdf", b"x"), ("b.PDF", b"x"), ("c.png", b""), ("d.txt", b"y")):
        (tmp_path / "in" / name).write_bytes(data)
    got = {r.path[-5:]: r.status for r in files.discover(spark, f"file://{tmp_path}/in").collect()}
    assert sorted(got.values()) == ["DUPLICATE", "NEW"]
    stream = inbox.first_seen(inbox.arrivals(spark, f"file://{tmp_path}/in"))
    decide = lambda df: df.withColumn("decision", F.when(F.col("path").endswith("txt"), "REVIEW").otherwise("AUTO"))
    inbox.watch(stream, decide, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    found = spark.read.option("basePath", f"{tmp_path}/out").parquet(f"{tmp_path}/out/batch=*")
    assert sorted(r.decision for r in found.collect()) == ["AUTO", "REVIEW"]
