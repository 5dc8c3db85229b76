"""Steps whose shuffles or seconds grew too fast: what they deal out, and the same results."""

import random

from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from ledgerloom.functions import compare
from ledgerloom.functions.dates import MAYBE, expiry
from ledgerloom.functions.fuzzy import ratio
from ledgerloom.functions.quantities import NUMBER, mostly_number
from ledgerloom.llm import divergence
from ledgerloom.operators import accuracy, candidates, headers, inference, pages, review, stated
from ledgerloom.operators import rows as rows_
from ledgerloom.plans import accuracy as accuracy_
from ledgerloom.plans import tables as tables_
from ledgerloom.plans import texts


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _wide(spark):
    rows = [("d", [(0, "2"), (1, "3"), (2, "6.1")]), ("d", [(0, "4"), (1, "1,000"), (2, "4000")]), ("d", [(0, "5."), (1, "-2"), (2, "10")]), ("e", [(0, "7"), (0, "8"), (1, "2"), (2, "16")]), ("e", [(0, "3"), (1, ".5"), (2, "1.5")]), ("e", [(0, None), (1, ""), (2, "x")])]
    return spark.createDataFrame(rows, "doc string, cells array<struct<col_no: int, value: string>>")


def test_inference_deals_rows_out_once(spark):
    wide = _wide(spark)
    p = inference.profiles(wide)
    assert "Expand" not in _plan(p) and _plan(p).count("Exchange") == 1
    got = {(r.doc, r.a, r.b, r.c) for r in inference.products(wide, p).collect()}
    assert got == {("d", 0, 1, 2), ("e", 0, 1, 2)}
    assert {(r.doc, r.col_no): (r.n, r.n_distinct) for r in p.collect()} == {("d", 0): (3, 3), ("d", 1): (3, 3), ("d", 2): (3, 3), ("e", 0): (3, 3), ("e", 1): (2, 2), ("e", 2): (3, 2)}


def test_dates_are_told_before_they_are_read(spark):
    texts = ["MAY 29", "12/25", "/01-2030", "25/12/2028", "0428", "042028", "202804", "2a0b2c8d0e4", "900.00", "DRUG 500 MG", "13/77", "", "0025/4"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").rlike(MAYBE).alias("maybe"), expiry(F.col("t")).isNotNull().alias("read")).collect()
    assert {r.t for r in got if r.read} == {"MAY 29", "12/25", "/01-2030", "25/12/2028", "0428", "042028", "202804", "2a0b2c8d0e4", "0025/4"}
    assert all(r.maybe for r in got if r.read) and not any(r.maybe for r in got if r.t in ("900.00", "DRUG 500 MG", ""))


def test_values_are_counted_not_gathered(spark):
    rows = [("d", 0, "Exp", v) for v in ("01/26", "02-2027", " 03/26\t", "x", "__", "", None)] + [("d", 1, "zz", "12"), ("d", 1, "zz", "5"), ("d", 2, "Qty", "7"), ("e", 0, "Exp", None), ("e", 1, "HSN", "x"), ("e", 1, "HSN", "300490"), ("f", 0, None, "-1.5")]
    cells = spark.createDataFrame(rows, "doc string, col int, header string, value string")
    columns = cells.groupBy("doc", "col", "header").agg(F.collect_list("value").alias("values"))
    old = {tuple(r) for r in stated.classify_columns(columns).select("doc", "col", "header", "field", "by").collect()}
    got = stated.classify_cells(cells, "doc", "col")
    assert {tuple(r) for r in got.collect()} == old and ("d", 0, "Exp", "expiry_date", "CONTENT") in old
    assert "collect_list" not in _plan(got)


def test_mappings_meet_by_document(spark):
    predicted = spark.createDataFrame([("d", 1, "Qty.", "b"), ("d", 0, "QTY", "a"), ("d", 2, "Rate", None), ("d", 3, "", "z"), ("d", 4, "Rat", "r")], "doc string, pos long, header string, field string")
    expected = spark.createDataFrame([("d", 0, "Qty.", "b"), ("d", 1, "qty", "a"), ("d", 2, "Rate", "r"), ("d", 3, "Zone", None), ("e", 0, "Qty", "q")], "doc string, pos long, header string, field string")
    got = accuracy.compare_mappings(predicted, expected)
    assert {(r.doc, r.pos): r.predicted for r in got.collect()} == {("d", 0): "b", ("d", 1): "a", ("d", 2): "r", ("d", 3): None, ("e", 0): None}
    assert "Window" not in _plan(got) and "Broadcast" not in _plan(got)


def test_vouchers_are_read_twice_at_most(spark):
    plan = texts.tally_voucher_ledgers(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("XPath") == plan.count("XPathListEvaluator") == 2


def test_runs_are_sorted_by_terms_first(spark):
    sorted_by, sort = [], DataFrame.sortWithinPartitions
    try:
        DataFrame.sortWithinPartitions = lambda self, *c, **k: sorted_by.append(c) or sort(self, *c, **k)
        docs = spark.createDataFrame([("l", s, "b a") for s in "xyxy"] + [("m", "x", "a b a")] * 3, "lang string, source string, text string")
        got = {(r.lang, r.source, r.item): r.value for r in divergence.audit(docs).where("part = 'pair'").collect()}
    finally:
        DataFrame.sortWithinPartitions = sort
    assert {c[:2] for c in sorted_by} == {("term", "lang")} and got == {("l", "x", "y"): 0, ("l", "y", "x"): 0}


def test_headers_are_told_in_their_rows(spark):
    head, block = ["Item Name", "Batch", "Qty", None, "zz"], ["A\nB", "B1\nB2", "1\n2", "", "Qty"]
    rows = spark.createDataFrame([(1, 0, 0, 0, ["ACME", None]), (1, 0, 0, 1, head), (1, 0, 0, 2, head[:2]), (2, 0, 0, 0, block), (3, 0, 0, 0, []), (3, 0, 0, 1, None), (4, 0, 0, 5, head), (5, 0, 0, 0, ["Qty", "Qty.", "Quantity"])], "doc int, page int, table_no int, row_no int, cells array<string>")
    got = stated.header_rows(rows)
    plan = _plan(got)
    assert "explode" not in plan and plan.count("Exchange") == 1
    assert [(r.doc, r.row_no, r.fields) for r in got.collect()] == [(1, 1, {0: "product_name", 1: "batch_number", 2: "billed_qty"})]


def test_headers_are_scored_only_where_likeness_is_possible():
    words = [a for x in stated.STATED_ALIASES.values() for a in x] + ["", "12.50 99.10", "GOODS RATE", "zz", "Descripton", "Expirry", "M R P", "B1\nB2", "....", "S", "NO.", "QTYS", "AMOUNTS TAXABLE", "REMARKS", "RATE12"]

    def by_all(text):
        best, name = 0.0, None
        for field, aliases in stated.STATED_ALIASES.items():
            for a in aliases:
                if (score := ratio(text, a)) > best and score >= stated.LIKE:
                    best, name = score, field
        return name

    for w in words:
        for text in {w.upper(), w.upper()[1:], w.upper()[:-1], f"{w}X".upper(), f"1{w}0".upper()} - {""}:
            assert stated._likest(text) == by_all(text), text
    scored, own = [], stated.ratio
    try:
        stated.ratio = lambda a, b: scored.append(a) or own(a, b)
        assert stated.field_of("12.50\n99.10\n1.00") is None and not scored
    finally:
        stated.ratio = own


def test_plain_values_are_read_without_replacing(spark):
    """The shorter ways give what the whole ones do, and most values take them."""
    number, date = (lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(c), ",", ""), r"^[^\d.+-]+", ""), r"[^\d.]+$", "").try_cast("double")), r"^(\d{1,2})[/.-](\d{2,4})$"

    def day(c):
        s = F.regexp_replace(c, r"\s+", "")
        month, year = (F.regexp_extract(s, date, k).try_cast("int") for k in (1, 2))
        return F.when(month.isNotNull(), F.format_string("%02d/%02d", month, F.when(year > 2000, year % 100).otherwise(year))).otherwise(F.upper(s))

    def name(c):
        return F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.upper(c), r"\s+", " ")), r"--\d+%$", ""))

    texts = ["", " ", "12", "12.50", "-3", "+4", " 7 ", "\t8", "1,000.5", "Rs. 5/-", "5d", "5f", "0x1p3", "1e5", "1e999", "NaN", "Infinity", "-Infinity", ".5", "5.", "-", "5%", "--12%", None]
    texts += ["05/2026", "05/26", "5/26", "5-2026", "05.2000", "05/00", "12/1999", "12/026", "05 / 26", " 05/26", "05/26\n", "05/26 ", "13-2001\u0085", "a5/26", "99/9999", "05/2100", "5 5 / 2 6", "MAY 26", "00/20", "05/20001"]
    texts += ["Dolo 650", "dolo  650", "dolo\t650", " dolo ", "Dolo--12%", "dolo --5% ", "a--b", "straße x", "x  y", "x\x0by", "Dolo--12% "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for new, whole in ((compare.number_of, number), (compare.normal_date, day), (compare.normal_text, name)):
        got = df.select("t", new(F.col("t")).alias("new"), whole(F.col("t")).alias("old")).collect()
        assert not [tuple(r) for r in got if r.new != r.old]
    # a text that is read the short way never meets the replacing one, so that a null there shows
    short = {compare.number_of: "12.50", compare.normal_date: "05/2026", compare.normal_text: "Dolo 650"}
    replaced = F.regexp_replace
    try:
        F.regexp_replace = lambda c, *a: F.lit(None).cast("string")
        assert all(spark.range(1).select(f(F.lit(t)).alias("x")).first().x is not None for f, t in short.items())
    finally:
        F.regexp_replace = replaced


def test_values_of_a_kind_are_read_as_one_array(spark):
    fields = ["itemName", "quantity", "freeQuantity", "rate", "expiryDate", "batchNo"]
    rows = [("Dolo 650", "dolo 650 TAB", "10", "2", "2", "10", "1,000", "1004", "05/2026", "05-26", "B1", None), (None, "x", "5", "5.0", None, "", "9", "x", "B7", "05/26", "05/26", "B7")]
    df = spark.createDataFrame(rows, ", ".join(f"{x}_{f} string" for f in fields for x in "tp")).selectExpr("*", "cast(null as string) AS raw", "false AS is_extra")
    got = accuracy.evaluate_rows(df, fields)
    seen = [({m.field: m.match for m in r.matches}, r.mixed_up) for r in got.collect()]
    assert seen == [
        ({"itemName": "NORMALIZED", "quantity": "MISMATCH", "freeQuantity": "MISMATCH", "rate": "TOLERANCE", "expiryDate": "NORMALIZED", "batchNo": "MISSING"}, ["QUANTITY_FREE_SWAP"]),
        ({"quantity": "EXACT", "rate": "MISMATCH", "expiryDate": "MISMATCH", "batchNo": "MISMATCH"}, ["BATCH_EXPIRY_SWAP"]),
    ]
    assert "kind, text" not in _plan(got)  # no struct for each cell


def test_pages_are_dealt_out_once(spark):
    line = lambda y, *words: [(t, float(a), float(b), y) for t, a, b in words]
    page = line(10.0, ("Item", 0, 20), ("Name", 24, 40), ("Batch", 90, 110), ("Qty", 160, 170), ("Amount", 200, 240)) + line(30.0, ("DOLO", 0, 20), ("DOLO", 0, 20), ("B1", 90, 99), ("5", 160, 164), ("9.50", 200, 220))
    words = spark.createDataFrame([(d, 1, *w) for d in (1, 2) for w in page], "doc int, page int, text string, x0 double, x1 double, top double")
    tables = candidates.segment(words, [2.0, 8.0, 99.0])
    assert {(r.candidate, r.row_no): r.cells for r in tables.where("doc = 1").collect()}[1, 1] == ["DOLO DOLO", "B1", "5", "9.50"]
    best = candidates.best_tables(tables)
    # words by page, and rows and tables after Python, which leaves no partitioning
    assert _plan(best).count("Exchange") == 3 and "Join" not in _plan(best)
    assert [(r.doc, r.candidate, r.score, r.n_primary, r.item_at) for r in best.orderBy("doc").collect()] == [(d, 0, 20 + 3 * 4 + 2, 1, 0) for d in (1, 2)]


def test_fields_are_told_in_their_rows(spark):
    texts = ["M R P", "m. r. p.", " M\tR\nP ", "M\u00a0R P", "Q T Y Free", "S.No", "Rack", "Prodct Name", "Qty", "qty.", "AMOUNT GST", "900.00", "DRUG12 B3", "", " ", "12", "Item Name Batch Qty Rate Amount Disc GST", "Straße", "Rte", "R\u00e4te", "x" * 40, None]
    df = spark.createDataFrame([(1, 0, texts), (1, 1, []), (1, 2, None), (1, 2, ["Qty", None, "Qty"])], "doc int, row_no int, cells array<string>")
    got = rows_.with_fields(df)
    assert "Exchange" not in _plan(got) and _plan(got.where(rows_.is_header())).count("ArrowEvalPython") == 1
    want = {r.header: r.field for r in headers.match(spark.createDataFrame([(t,) for t in texts if t is not None], "header string")).collect()}
    found = [r.fields for r in got.collect()]
    assert dict(zip(texts, found[0])) == {**want, None: None} and sum(f is not None for f in found[0]) >= 7
    assert found[1:] == [[], None, ["quantity", None, "quantity"]]


def test_lines_that_cannot_be_headers_are_not_scored():
    dice = random.Random(1)
    texts = ["Product", "Batch", "Qty", "Rate", "Amount", "12", "9.50", "DRUG1", "GSTIN:", "Phone:", "9876543210", "Page", "Road", "B7"]
    scored, own = [], pages.header_score
    for n in range(300):
        lines = [[pages.Word(dice.choice(texts), 40.0 * k, 40.0 * k + dice.choice((20, 60)), 14.0 * y, 14.0 * y + 8) for k in range(dice.randint(0, 9))] for y in range(dice.randint(0, 12))]
        rated = [(own(x, lines[k + 1 :]), -k) for k, x in enumerate(lines) if x and x[0].top <= 100 * 0.65]
        score, at = max(rated, default=(0.0, 0))
        assert pages.best_header(lines, 100.0) == (score, -at)
    try:
        pages.header_score = lambda line, below: scored.append(line) or own(line, below)
        goods = [[pages.Word(t, x, x + 20.0, 120.0 + 14 * k, 128.0 + 14 * k) for t, x in (("DRUG1", 30.0), ("12", 200.0), ("9.50", 300.0), ("7", 350.0))] for k in range(20)]
        head = [pages.Word(t, x, x + 20.0, 100.0, 108.0) for t, x in (("Product", 30.0), ("Qty", 200.0), ("Rate", 300.0), ("Amount", 350.0))]
        assert pages.best_header([*goods[:2], head, *goods[2:]], 792.0)[1] == 2 and len(scored) == 1
    finally:
        pages.header_score = own


def test_texts_of_pages_are_scored_together():
    asked, own = [], headers.likest
    try:
        headers.likest = lambda x: asked.append(len(x)) or own(x)
        pages.learn(f"{t}{k}" for k in range(50) for t in ("ZZQ", "7.", "ZX "))
        line = [pages.Word(f"ZZQ{k}", 40.0 * k, 40.0 * k + 10, 1.0, 9.0) for k in range(8)]
        assert [w.text for w in pages.joined_line(line)] == [w.text for w in line]  # words apart are not put together
    finally:
        headers.likest = own
    assert asked == [100] and pages.field_of("Prodct Name") == "itemName"


def test_equal_values_are_profiled_once(spark):
    rows = [("d", 0, v) for v in ("12", "12", " 12 ", "", None, "1.5", "3004", "300490")] + [("d", 1, v) for v in ("05/26", "5-2026", "B12", "B12", "abc")] + [("e", 0, ""), ("e", 0, " "), ("f", 0, None)]
    cells = spark.createDataFrame(rows, "doc string, col_no int, value string")
    got = rows_.column_profile(cells)
    v = F.trim("value")
    share = lambda p: F.avg(F.when(v != "", v.rlike(p).cast("int")))
    tests = [r"^\d+$", r"^\d+\.\d+$", r"[A-Za-z]{3,}", r"^(\d{4}|\d{6}|\d{8})$", r"^\d{1,2}[/-]\d{2,4}$", r"^(?=.*\d)(?=.*[A-Za-z])[A-Za-z0-9-]{3,14}$"]
    want = cells.groupBy("doc", "col_no").agg(F.count("*"), F.avg((v != "").cast("int")), F.countDistinct(F.when(v != "", v)), F.min(F.when(v != "", F.length(v))), F.max(F.length(v)), *map(share, tests))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    # beside each value only its number is dealt out
    assert "avg(" not in _plan(got) and "avg(" in _plan(want)


def test_texts_of_columns_are_read_once(spark):
    texts = ["12", "-12.", "+.5", "1e5", "1d", "5f", " 7", "7 ", "7\n", "1,000", "Rs. 12.50/-", "", ".", "-", "NaN", "Infinity", "12.5.6", "--3", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = F.nullif(F.regexp_extract(F.regexp_replace("t", ",", ""), NUMBER, 0), F.lit("")).try_cast("double")
    assert not [tuple(r) for r in df.select("t", mostly_number(F.col("t")).alias("new"), whole.alias("old")).collect() if r.new != r.old]
    names = "rate mrp quantity freeQuantity amount gstPercent batchNo expiryDate hsnCode".split()
    rows = [("a", "200", "100", "0", "5", "12", "99", "05/2026", "B1", "3004"), ("b", "9", "10", "1", "0", "50", "12", "MAY 26", "300490", "06/26"), ("c", None, None, None, None, None, None, None, None, None)]
    got = review.column_swaps(spark.createDataFrame(rows, "doc string, " + ", ".join(f"{c} string" for c in names)))
    assert {r.doc: r.swaps for r in got.collect()} == {"a": ["rate <-> mrp", "quantity <-> freeQuantity", "amount <-> gstPercent", "batchNo <-> expiryDate"], "b": ["batchNo <-> expiryDate", "expiryDate <-> hsnCode"], "c": []}
    sums = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate [" in x]
    assert len(sums) == 1 and "regexp_" not in sums[0]


def test_rows_meet_whole(spark):
    fields = ["quantity", "rate", "itemName"]
    rows = lambda x: spark.createDataFrame(x, "doc string, row_no int, quantity string, rate string, itemName string")
    told = rows([("d", 0, "10", "9.52", "dolo 650"), ("d", 1, None, "x", "Dolo-650"), ("d", 2, "1", "1", "y"), ("e", 0, "5", None, None)])
    truth = rows([("d", 0, "10.0", "9.50", "DOLO  650"), ("d", 1, "3", "7", "dolo.650"), ("e", 0, "6", None, "z"), ("e", 1, "1", "1", "y")])
    cells = lambda df: df.select("doc", "row_no", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("c")).select("doc", "row_no", "c.*")
    got = accuracy.positional_rows(told, truth, fields)
    want = accuracy.positional_metrics(cells(told), cells(truth))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r.field: (r.exact, r.normalized, r.tolerance, r.incorrect, r.missing, r.unexpected) for r in got.collect()} == {"quantity": (0, 0, 1, 1, 2, 1), "rate": (0, 0, 1, 1, 1, 1), "itemName": (0, 2, 2, 0, 2, 1)}
    # cells are dealt out neither to meet nor for their kinds, and both sides of the query read the same lines
    assert _plan(got).index("Generate") < _plan(got).index("SortMergeJoin")
    plan = accuracy_.positional_field_metrics(spark, "/root/testdata/sf0.001")
    plan.collect()
    assert "ReusedExchange" in _plan(plan)


def test_rows_of_an_order_are_made_where_its_lines_are(spark):
    """Keys alone are so small that all work on their rows went to a task or two."""
    plan = tables_.row_predicates(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_linenumber") and plan.count("Relation [l_") == 1 and "Union" not in plan


def test_plain_rows_are_told_as_without_the_shortcut(spark):
    from ledgerloom.functions.fixed import FOOTER, HEADER_PHRASES, LETTERHEAD, NOT_ITEM, REPEATED_HEADERS, RETURN_SECTION, SCHEME_SECTION

    told = [*FOOTER, *LETTERHEAD, *NOT_ITEM, *REPEATED_HEADERS, *HEADER_PHRASES, *RETURN_SECTION, *SCHEME_SECTION, "five hundred rupees only", "page ...x", "page  2  of 3", "pan  no", "pin- 411", "a@b", "www.x", "state code", "cr no", "ack date", "terms & conditions"]
    odd = [[x.upper(), "B1", "3", "7.00"] for x in told] + [["", *x.split(" "), "5", None, "7"] for x in told] + [["GOODS TAB", x + " ", " 1", "2", "3"] for x in told]
    odd += [["DOLO TAB", "B1", "3", "7.00"], ["DOLO TAB", None, "x", ""], [None, None], [], ["ÉCLAIR TAB", "SUB", "TOTAL", "3"], ["CREDIT", "KIT", "9", "1"], ["Item Name", "Qty", "Rate", "5"], ["a", "billed", "rate", "7 x"]]
    df = rows_.with_fields(spark.createDataFrame([(1, k, x) for k, x in enumerate(odd)] + [(1, -1, None)], "doc int, row_no long, cells array<string>"))
    plain, cells = F.col("plain"), F.col("cells")
    pairs = [(rows_.is_skippable(cells), rows_.is_skippable(cells, plain)), (rows_.is_item_row(), rows_.is_item_row(plain=plain))]
    pairs += [(rows_.is_product_row(item_at=at), rows_.is_product_row(item_at=at, plain=plain)) for at in (None, F.lit(0))]
    got = df.select("plain", *(F.coalesce(x, F.lit(False)).alias(f"{side}{k}") for k, pair in enumerate(pairs) for side, x in zip("ab", pair))).collect()
    assert all(r[f"a{k}"] == r[f"b{k}"] for r in got for k in range(len(pairs)))
    assert sum(bool(r["plain"]) for r in got) == 5 and any(r["b3"] for r in got) and any(r["b0"] for r in got)


def test_workbooks_are_put_together_as_zipfile_does(spark):
    import io
    import zipfile

    from ledgerloom.plans import documents
    from ledgerloom.sources import sheets

    content = sheets.workbook(["a", "b<"], [["x&\x01", 1.5], [None, 2], ["é", True]], ("b<",), "T<1>")
    z = zipfile.ZipFile(io.BytesIO(content))
    assert z.testzip() is None
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as own:
        for i in z.infolist():
            own.writestr(zipfile.ZipInfo(i.filename, (1980, 1, 1, 0, 0, 0)), z.read(i))
    assert out.getvalue() == content and len(z.namelist()) == 6
    files = spark.createDataFrame([("f", content), ("g", sheets.workbook(["x"], [])), ("h", content)], "path string, content binary")
    got = sheets.workbook_rows(files, ends=True).where("row_no > first and row_no < last").collect()
    assert sorted((r.path, r.row_no) for r in got) == [(p, n) for p in "fh" for n in (2, 3, 4)]
    # the rows are not dealt out to find each sheet's last
    assert "Window" not in _plan(documents.workbook_cells(spark, "/root/testdata/sf0.001"))
