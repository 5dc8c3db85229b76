"""Layout, inference, decisions, cell repair and office files on written examples."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import bleeding
from ledgerloom.operators import decisions, inference, layout
from ledgerloom.sources import sheets


@pytest.mark.parametrize("given, want", [
    ({"batchNo": "306DB251811/27"}, {"batchNo": "306DB2518", "expiryDate": "11/27"}),
    ({"batchNo": "B111/27", "expiryDate": "01/2029"}, {"batchNo": "B1", "expiryDate": "01/2029"}),
    ({"expiryDate": "11/2730049099"}, {"expiryDate": "11/27", "hsnCode": "30049099"}),
    ({"expiryDate": "11/2030049099"}, {"expiryDate": "11/20", "hsnCode": "30049099"}),
    ({"expiryDate": "11/2027 3004"}, {"expiryDate": "11/2027", "hsnCode": "3004"}),
    ({"expiryDate": "11/2027"}, {"expiryDate": "11/2027"}),
    ({"rate": "159.00 121.14"}, {"mrp": "159.00", "rate": "121.14"}),
    ({"quantity": "23+2"}, {"quantity": "23", "freeQuantity": "2"}),
    ({"quantity": "23+2", "freeQuantity": "5"}, {"quantity": "23", "freeQuantity": "5"}),
    ({"discountPercent": "-1.50 30049084"}, {"discountPercent": "-1.50", "hsnCode": "30049084"}),
    ({"hsnCode": "10.00 30049099"}, {"discountPercent": "10.00", "hsnCode": "30049099"}),
    ({"amount": "5 10.14 213.07"}, {"gstPercent": "5", "netAmount": "213.07"}),
    ({"amount": "1,000.00 18%"}, {"amount": "1000.00", "gstPercent": "18"}),
    ({"amount": "371.35 -1.50", "discountPercent": "12"}, {"amount": "371.35", "gstPercent": "12", "discountPercent": "-1.50"}),
    ({"discountPercent": "5.00 18.57"}, {"discountPercent": "5.00", "discountAmount": "18.57"}),
    ({"cgstPercent": "9% 9%"}, {"cgstPercent": "9", "sgstPercent": "9"}),
    ({"amount": ""}, {"amount": ""}),
    ({"amount": None, "mrp": "12.50"}, {"amount": None, "mrp": "12.50"}),
])
def test_bleeding(spark, given, want):
    df = spark.createDataFrame([tuple(given.values())], ", ".join(f"{c} string" for c in given)).withColumn("extra", F.lit(1))
    got = bleeding.repair(df).first().asDict()
    assert got["extra"] == 1
    assert {c: got[c] for c in want} == want


def test_words_to_columns(spark):
    columns = spark.createDataFrame([("d", 1, 0, "itemName", 0.0, 100.0), ("d", 1, 1, "quantity", 100.0, 140.0), ("d", 1, 2, None, 140.0, 200.0)], "doc string, page int, col_no int, field string, x0 double, x1 double")
    words = spark.createDataFrame([("d", 1, 1, "DOLO", 10.0, 40.0, 5.0), ("d", 1, 2, "650", 45.0, 60.0, 5.0), ("d", 1, 3, "12", 110.0, 120.0, 6.0), ("d", 1, 4, "x", None, None, 20.0), ("d", 1, 5, "99", 134.0, 146.0, 21.0), ("e", 1, 1, "lost", 0.0, 9.0, 1.0)], "doc string, page int, word_no int, text string, x0 double, x1 double, top double")
    got = layout.assign_words(layout.with_lines(words), columns)
    assert [(r.word_no, r.line_no, r.col_no, r.ambiguous) for r in got.orderBy("word_no").collect()] == [(1, 1, 0, False), (2, 1, 0, False), (3, 1, 1, False), (4, 2, None, False), (5, 2, 1, False)]
    assert {(r.line_no, r.col_no): r.value for r in layout.cells_of(got).collect()} == {(1, 0): "DOLO 650", (1, 1): "12", (2, 1): "99"}
    assert [(r.x0, r.x1) for r in layout.valleys(words.where("doc = 'd'"), 5.0).collect()] == [(60.0, 110.0), (120.0, 134.0)]
    assert layout.assign_words(words.limit(0), columns).count() == 0


def test_layouts(spark):
    seen = [("s", ["Item", "Qty"], 90.0, "AUTO_ACCEPT", 0, False, 1), ("s", ["item", "QTY."], 90.0, "AUTO_ACCEPT", 0, None, 5), ("s", ["Item", "Rate"], 50.0, "UNRESOLVED", 3, True, 3), ("s", ["No"], 90.0, "AUTO_ACCEPT", 1, False, 2), (None, ["Item"], 99.0, "AUTO_ACCEPT", 0, False, 1)]
    known = layout.learn(spark.createDataFrame(seen, "supplier string, headers array<string>, confidence double, decision string, critical_mismatches int, reviewed boolean, seen int"))
    assert [(r.version, r.headers, r.n_documents, r.last_seen) for r in known.orderBy("version").collect()] == [(1, ["Item", "Qty"], 2, 5), (2, ["Item", "Rate"], 1, 3)]
    docs = spark.createDataFrame([(1, "s", ["ITEM", "qty"]), (2, "s", ["Item", "Qty", "Rate"]), (3, "t", ["Item"]), (4, None, ["Item"]), (5, "s", ["Pack"])], "doc int, supplier string, headers array<string>")
    got = {r.doc: (r.layout_id, r.drift) for r in layout.drift(docs, known.withColumnRenamed("version", "layout_id")).collect()}
    assert got[1] == (1, "EXACT_MATCH") and got[2][1] in ("MINOR_DRIFT", "MAJOR_DRIFT") and got[3] == got[4] == (None, "NEW_SUPPLIER") and got[5][1] == "NEW_LAYOUT"


def _cells(spark):
    rows = [(f"DRUG {chr(65 + i)} TABLET", f"BX{i}7{i}", f"0{i + 1}/2028", str(10 * (i + 1) + i * i), f"{20 + i * 7}.50", f"{(10 * (i + 1) + i * i) * (20 + i * 7 + 0.5):.2f}", "30049099", str(i + 1), "", "18") for i in range(6)]
    return spark.createDataFrame([("d", i, k, v) for i, r in enumerate(rows) for k, v in enumerate(r)], "doc string, row_no int, col_no int, value string")


def test_inference(spark):
    cells = _cells(spark)
    known = spark.createDataFrame([("d", 3, "quantity")], "doc string, col_no int, field string")
    p = inference.profiles(cells)
    assert [(r.a, r.b, r.c) for r in inference.products(cells, p).collect()] == [(3, 4, 5)]
    assert [r.col_no for r in p.where("serial").collect()] == [7]
    scores = {(r.col_no, r.field): r.score for r in inference.candidates(cells, known, p).collect()}
    assert (7, "discountPercent") not in scores and (3, "quantity") not in scores
    assert scores[5, "amount"] > scores[4, "amount"]
    # a date could be a batch too, unless another column is known to be that
    assert {r.col_no: r.status for r in inference.infer(cells, known).collect()}[2] == "ambiguous"
    both = known.union(spark.createDataFrame([("d", 1, "batchNo")], known.schema))
    got = {r.col_no: (r.field, r.status) for r in inference.infer(cells, both).collect()}
    assert got[9] == ("gstPercent", "inferred")
    assert got[0] == ("itemName", "inferred") and got[2] == ("expiryDate", "inferred") and got[6] == ("hsnCode", "inferred")
    assert got[7] == (None, "unresolved") and 8 not in got and 3 not in got
    assert inference.infer(cells.limit(0), known).count() == 0


def _columns(spark, *rows):
    return spark.createDataFrame([("d", k, *r) for k, r in enumerate(rows)], "doc string, col_no int, header string, field string, status string")


def _decide(spark, columns, cells, **changed):
    values = {"n_rows": 6, "n_logical": 3, "health": 1.0, "critical_mismatches": 0, "similarity": 1.0, "drift": None, "identity_safe": True, "ambiguous_subcolumns": 0} | changed
    docs = spark.createDataFrame([("d", *values.values())], "doc string, n_rows int, n_logical int, health double, critical_mismatches int, similarity double, drift string, identity_safe boolean, ambiguous_subcolumns int")
    r = decisions.decide(docs, columns, decisions.field_quality(cells, columns)).first()
    return r.decision, r.blockers, r.confidence


def test_decisions(spark):
    known = "known_header"
    cells = _cells(spark).where("col_no in (0, 3, 4)").withColumn("col_no", F.when(F.col("col_no") == 0, 0).otherwise(F.col("col_no") - 2))
    columns = _columns(spark, ("Item", "itemName", known), ("Qty", "quantity", known), ("Rate", "rate", known))
    # .25 header + .15 * .95 + .25 values + .15 * .95 + .15 health + .05 similarity
    assert _decide(spark, columns, cells) == ("AUTO_ACCEPT", [], 98.5)
    assert _decide(spark, columns, cells, health=0.6)[:2] == ("REVIEW_REQUIRED", ["LOW_HEALTH"])
    assert _decide(spark, columns, cells, identity_safe=False, critical_mismatches=1)[:2] == ("REVIEW_REQUIRED", ["CRITICAL_MISMATCH", "IDENTITY_UNSAFE"])
    assert _decide(spark, columns, cells, n_rows=0)[1] == ["NO_ROWS"]
    assert _decide(spark, columns.where("col_no > 0"), cells)[:2] == ("UNRESOLVED", ["MISSING_MANDATORY"])
    assert _decide(spark, columns.limit(0), cells.limit(0), n_rows=None)[0] == "UNRESOLVED"
    twice = _columns(spark, ("Item", "itemName", known), ("Qty", "quantity", known), ("Rate", "rate", known), ("Sale", "rate", known))
    assert _decide(spark, twice, cells)[1] == ["DUPLICATE_FIELD"]
    assert [(r.field, r.headers) for r in decisions.duplicate_fields(twice).collect()] == [("rate", ["Rate", "Sale"])]
    spare = _columns(spark, ("Item", "itemName", known), ("Qty", "quantity", known), ("Rate", "rate", known), ("PTR", "rate", known))
    assert "DUPLICATE_FIELD" not in _decide(spark, spare, cells)[1]
    broken = cells.withColumn("value", F.when((F.col("row_no") == 2) & (F.col("col_no") == 1), "10+ABC").when((F.col("row_no") == 3) & (F.col("col_no") == 0), "TAB.").otherwise(F.col("value")))
    assert _decide(spark, columns, broken)[1] == ["MALFORMED_SCHEME", "TRUNCATED_ITEM"]
    empty = cells.withColumn("value", F.lit(None).cast("string"))
    assert {r.quality for r in decisions.field_quality(empty, columns).collect()} == {0.0}


def test_workbooks(spark):
    assert [sheets.letters(n) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    content = sheets.workbook(["name", "n"], [["a<b>&\x01", 1.5], [None, 2], ["", None]], ("n",))
    assert sheets.read_workbook(content) == [("Sheet1", 1, ["name", "n"]), ("Sheet1", 2, ["a<b>&", "1.5"]), ("Sheet1", 3, [None, "2"]), ("Sheet1", 5, ["TOTAL"])]
    assert b"SUM(B2:B4)" in zipfile.ZipFile(io.BytesIO(content)).read("xl/worksheets/sheet1.xml")
    assert sheets.read_workbook(sheets.workbook(["x"], [], ("x",))) == [("Sheet1", 1, ["x"])]
    word = io.BytesIO()
    with zipfile.ZipFile(word, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{sheets.WORD}"><w:body><w:p><w:r><w:t>one</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p/></w:body></w:document>')
    assert sheets.read_document(word.getvalue()) == ["one two"]
    lines = spark.createDataFrame([(1, "b", 2.0), (1, "a", None), (2, None, 1.0)], "doc int, name string, v double")
    made = sheets.workbooks(lines, "doc", ["name", "v"], ["name"], ("v",))
    rows = sheets.workbook_rows(made.select(F.col("doc").cast("string").alias("path"), "content"))
    assert [(r.path, r.row_no, r.cells) for r in rows.where("row_no > 1 and cells[0] <> 'TOTAL'").orderBy("path", "row_no").collect()] == [("1", 2, ["a"]), ("1", 3, ["b", "2.0"])]
    assert [r.markdown for r in sheets.markdown(spark.createDataFrame([("a|b\nc", None)], "x string, y int"), ["x", "y"]).collect()] == ["| a\\|b c |  |"]
