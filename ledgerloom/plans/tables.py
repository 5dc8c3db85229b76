"""Queries of table rows, headers, accounting in full and state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import accounting
from ..operators import headers, invoices, pages, rows, state
from .lines import line_items, table
from .queries import doubles, query

# ---- headers

_TEXTS = {
    "Item Description": "itemName", "M R P": "mrp", "Batch No.": "batchNo", "EXP": "expiryDate", "Qty.": "quantity", "Rate ": "rate", "P.T.R": "rate", "HSN/SAC": "hsnCode", "GST%": "gstPercent", "S.No": None, "Net Amount": "netAmount", "Rack": None,
    "Prodct Name": "itemName", "Qtyy": None, "Old MRP": None, "Disc Amt": None, "Manufacturr": "company", "Zone": None,
}
_VALUES = ", ".join(f"({k}, '{h}', {'NULL' if f is None else repr(f)})" for k, (h, f) in enumerate(_TEXTS.items()))


@query(f"WITH v AS (SELECT * FROM (VALUES {_VALUES}) t(k, header, field)) SELECT header, field, count(*) AS n FROM orders JOIN v ON o_custkey % {len(_TEXTS)} = k GROUP BY ALL")
def header_alias_match(spark, sf_dir):
    h = F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("o_custkey") % len(_TEXTS) + 1).cast("int"))
    df = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("pos"), h.alias("header"))
    return headers.match(df).groupBy("header", "field").agg(F.count("*").alias("n"))


# the headers of four layouts, and the fields they have after conflicts are settled
_LAYOUTS = [
    [("Item Name", "itemName"), ("PTR", None), ("RATE", "rate"), ("MRP", "mrp"), ("Unit", None), ("Pack", "pack")],
    [("Product", "itemName"), ("P.T.R", "rate"), ("Net Rate", None), ("Qty", None), ("Billed Qty", "quantity")],
    [("Amount", "amount"), ("Total", None), ("Disc%", "discountPercent"), ("Rack", None)],
    [("GST", None), ("Tax Rate", "gstPercent"), ("", None), ("Box", None), ("Size", None)],
]


@query("WITH v AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {p}, '{h}', {'NULL' if f is None else repr(f)})" for k, x in enumerate(_LAYOUTS) for p, (h, f) in enumerate(x)) + ") t(k, pos, header, field)) SELECT pos, header, field, count(*) AS n FROM orders JOIN v ON o_custkey % 4 = k GROUP BY ALL")
def header_conflicts(spark, sf_dir):
    cells = lambda x: F.array(*(F.struct(F.lit(p).alias("pos"), F.lit(h).alias("header")) for p, (h, _) in enumerate(x)))
    k = F.col("o_custkey") % 4
    spec = F.when(k == 0, cells(_LAYOUTS[0])).when(k == 1, cells(_LAYOUTS[1])).when(k == 2, cells(_LAYOUTS[2])).otherwise(cells(_LAYOUTS[3]))
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.explode(spec).alias("c")).select("doc", "c.*")
    return headers.resolve(df).groupBy("pos", "header", "field").agg(F.count("*").alias("n"))


# ---- rows

_COLUMNS = ["itemName", "batchNo", "quantity", "rate", "amount", None]


def _table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as table rows: a header, its lines, some of which wrap, a subtotal, and a return section. An order's rows are
    made where its lines are: keys alone are so small that Spark would put them, and all work on their rows, in a task or two."""
    li = line_items(spark, sf_dir).select("invoice", "line_no", "item", "batch", "quantity", "rate").repartition("invoice").groupBy("invoice", "line_no").agg(F.first("item").alias("item"), F.first("batch").alias("batch"), F.min("quantity").alias("q"), F.min("rate").alias("r"))
    text = lambda c: F.col(c).cast("string")
    cells = lambda *x: F.array(*(F.lit(v) if isinstance(v, str) else v for v in x))
    amount = F.round(F.col("q") * F.col("r"), 2).cast("decimal(18,2)").cast("string")
    own = F.struct((F.col("line_no") * 10).alias("row_no"), cells(F.col("item"), F.col("batch"), F.when(F.col("line_no") % 2 == 0, F.concat(F.col("q").cast("int").cast("string"), F.lit("+1"))).otherwise(text("q")), text("r"), amount, "").alias("cells"))
    more = F.struct((F.col("line_no") * 10 + 1).alias("row_no"), cells(F.concat(F.lit("(wrapped "), text("line_no"), F.lit(")")), "", "", "", "", F.col("batch")).alias("cells"))
    fixed = {0: ["Product Name", "Batch", "Qty", "Rate", "Amount", ""], 900: ["Sub Total", "", "", "", "99.00", ""], 910: ["Sales Return", "", "", "", "", ""], 920: ["OLDSTOCK TAB", "B1", "3", "7.00", "21.00", ""]}
    extra = F.array(*(F.struct(F.lit(k).alias("row_no"), cells(*v).alias("cells")) for k, v in fixed.items()))
    first = F.row_number().over(Window.partitionBy("invoice").orderBy("line_no")) == 1
    lines = F.when(F.col("line_no") % 3 == 0, F.array(own, more)).otherwise(F.array(own))
    found = li.withColumn("first", first).select(F.col("invoice").alias("doc"), F.explode(F.when(F.col("first"), F.concat(extra, lines)).otherwise(lines)).alias("x"))
    return found.select("doc", F.col("x.row_no").cast("long").alias("row_no"), "x.cells")


_TABLE = """WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS n, first(p_name) AS item, min(CAST(l_quantity AS DECIMAL(10,2))) AS q, min(CAST(p_retailprice AS DECIMAL(10,2))) AS r FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


@query(_TABLE + ", g AS (SELECT doc, n, n % 3 = 0 AS wrapped, CASE WHEN n % 2 = 0 THEN floor(q) ELSE q END AS billed, CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS free, r, CAST(round(q * r, 2) AS DECIMAL(18,2)) AS a FROM l) SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY n) AS group_no, CASE WHEN wrapped THEN 2 ELSE 1 END AS n_rows, wrapped, CAST(billed AS DOUBLE) AS quantity, CAST(free AS DOUBLE) AS free, CAST(r AS DOUBLE) AS rate, CAST(a AS DOUBLE) AS amount FROM g")
def logical_rows(spark, sf_dir):
    got = rows.logical_rows(_table_rows(spark, sf_dir), _COLUMNS)
    return doubles(got.select("doc", "group_no", "n_rows", F.col("itemName").contains("(wrapped").alias("wrapped"), "quantity", "free", "rate", "amount"), "quantity", "free", "rate", "amount")


@query(_TABLE + ", k AS (SELECT 'goods' AS kind, count(*) AS n FROM l UNION ALL SELECT 'wrapped', count(*) FILTER (n % 3 = 0) FROM l UNION ALL SELECT unnest(['header', 'footer', 'other', 'goods']), count(DISTINCT doc) FROM l) SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY kind")
def row_predicates(spark, sf_dir):
    df = rows.with_fields(_table_rows(spark, sf_dir))
    kind = F.when(rows.is_header(), "header").when(rows.is_skippable(F.col("cells"), F.col("plain")), "footer").when(rows.is_product_row(item_at=F.lit(0), plain=F.col("plain")), "goods").when(F.col("cells")[0].startswith("(wrapped"), "wrapped").otherwise("other")
    return df.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


# ---- accounting


@query(""", i AS (SELECT *, CAST(mrp * 100 AS BIGINT) AS m, CAST(rate * 100 AS BIGINT) AS r, CAST(net * 100 AS BIGINT) AS w, CAST(quantity + free AS BIGINT) AS u FROM lines), x AS (SELECT *, CASE WHEN m > 0 AND r > 0 THEN sign(m - r) * ((2 * abs(m - r) * 10000 + m) // (2 * m)) / 100.0 ELSE 0 END AS margin, CASE WHEN w > 0 AND u > 0 THEN ((2 * w + u) // (2 * u)) / 100.0 ELSE r / 100.0 END AS cost FROM i)
SELECT invoice, line_no, part, supplier, CAST(margin AS DOUBLE) AS margin, CAST(cost AS DOUBLE) AS unit_cost, CAST(round(free * rate, 2) AS DOUBLE) AS scheme_benefit, CAST(u AS DOUBLE) AS units, CASE WHEN m > 0 AND r > m THEN 'PRICE_INVERSION_ERROR' WHEN m > 0 AND margin < 10 THEN 'LOW_RETAIL_MARGIN' WHEN margin >= 25 THEN 'HIGH_MARGIN_PROMOTIONAL' ELSE 'STANDARD_RETAIL_MARGIN' END AS margin_class FROM x""")
def purchase_margins(spark, sf_dir):
    df = accounting.margins(line_items(spark, sf_dir))
    return doubles(df.select("invoice", "line_no", "part", "supplier", "margin", "unit_cost", "scheme_benefit", "units", "margin_class"), "margin", "unit_cost", "scheme_benefit", "units")


@query("""SELECT semantics, status, unread, apart, count(*) AS n, CAST(sum(q) AS DOUBLE) AS billed, CAST(sum(f) AS DOUBLE) AS free FROM (SELECT CASE WHEN a IS NULL THEN 'DERIVED_GROSS' WHEN abs(a - gr) <= greatest(0.10, gr * 0.015) THEN 'GROSS' ELSE 'MISMATCH' END AS semantics, CASE WHEN a IS NULL THEN 'DERIVED' WHEN abs(a - gr) <= 0.05 THEN 'EXACT_MATCH' WHEN abs(a - gr) <= greatest(0.10, gr * 0.015) THEN 'ROUNDING_DIFF' ELSE 'MATHEMATICAL_MISMATCH' END AS status, k = 3 AS unread, part % 2 = 0 AND gst > 0 AS apart, q, f
 FROM (SELECT *, line_no % 4 AS k, CASE WHEN line_no % 4 = 1 THEN 2 ELSE 0 END AS f, floor(quantity) AS q, round(floor(quantity) * rate, 2) AS gr, CASE line_no % 4 WHEN 0 THEN round(floor(quantity) * rate, 2) WHEN 1 THEN round(floor(quantity) * rate, 2) + 0.07 WHEN 2 THEN NULL ELSE round(floor(quantity) * rate, 2) * 3 END AS a FROM lines)) GROUP BY ALL""")
def scheme_row_accounting(spark, sf_dir):
    """Text cells: schemes in the quantity, amounts that fit, fit nearly, are missing or don't fit, half taxes that disagree."""
    k, q = F.col("line_no") % 4, F.floor("quantity").cast("string")
    gross = F.round(F.floor("quantity") * F.col("rate"), 2)
    half = (F.col("gst") / 2).cast("decimal(6,2)")
    cells = line_items(spark, sf_dir).select(
        F.when(k == 1, F.concat(q, F.lit("+2"))).when(k == 3, F.concat(q, F.lit("+ABC"))).otherwise(q).alias("quantity"), F.col("rate").cast("string").alias("rate"), F.col("gst").cast("string").alias("gstPercent"),
        F.when(F.col("part") % 2 == 0, half + half).otherwise(half).cast("string").alias("cgstPercent"), half.cast("string").alias("sgstPercent"), F.when(k == 0, gross).when(k == 1, gross + F.lit("0.07").cast("decimal(3,2)")).when(k == 3, gross * 3).cast("string").alias("amount"),
    )
    got = accounting.solve_rows(cells)
    has = lambda field, status: F.exists("discrepancies", lambda x: (x["field"] == field) & (x["status"] == status))
    return got.groupBy("semantics", "status", has("quantity", "UNRESOLVED_COMPOUND").alias("unread"), has("gstPercent", "MISMATCH").alias("apart")).agg(F.count("*").alias("n"), F.sum("quantity").cast("double").alias("billed"), F.sum("free").cast("double").alias("free"))


_FULL = ["gross", "taxable", "cgst", "sgst", "gst", "net", "billed", "free"]


@query(", h AS (SELECT *, CAST(round(tax * 0.5, 2) AS DECIMAL(18,2)) AS c FROM lines), s AS (SELECT invoice, sum(gross) AS sum_gross, sum(taxable) AS sum_taxable, sum(c) AS sum_cgst, sum(tax - c) AS sum_sgst, sum(tax) AS sum_gst, sum(net) AS sum_net, sum(quantity) AS sum_billed, sum(free) AS sum_free, count(*) AS n_lines FROM h GROUP BY invoice), j AS (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS total, CAST(o_custkey % 3 AS DECIMAL(18,2)) AS tcs FROM s LEFT JOIN orders ON invoice = o_orderkey) SELECT invoice, " + ", ".join(f"CAST(sum_{c} AS DOUBLE) AS sum_{c}" for c in _FULL) + ", CAST(0 AS DOUBLE) AS sum_igst, n_lines, CAST(sum_net + coalesce(tcs, 0) AS DOUBLE) AS expected_total, CAST(coalesce(abs(sum_net + tcs - total), 0) AS DOUBLE) AS total_delta, CAST(coalesce(abs(sum_taxable - 1000), 0) AS DOUBLE) AS taxable_delta, CASE WHEN total IS NULL THEN 'NO_INVOICE_SUMMARY_PRESENT' WHEN abs(sum_net + tcs - total) <= 1 THEN 'RECONCILED_BALANCED' WHEN abs(sum_net + tcs - total) <= 5 THEN 'MINOR_ROUNDING_VARIANCE' ELSE 'UNRECONCILED_MISMATCH' END AS status FROM j")
def grand_totals_in_full(spark, sf_dir):
    dec = lambda c: F.lit(c).cast("decimal(18,2)")
    lines = line_items(spark, sf_dir).select("invoice", "quantity", "free", "rate", "discount", "gst", dec(None).alias("cgst"), dec(None).alias("sgst"), dec(None).alias("taxable"), dec(None).alias("net"))
    stated = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("invoice"), dec("1000").alias("taxable"), dec(None).alias("gst"), (F.col("o_custkey") % 3).cast("decimal(18,2)").alias("tcs"), dec(None).alias("round_off"), F.col("o_totalprice").cast("decimal(18,2)").alias("total"))
    got = invoices.reconcile_in_full(lines, stated)
    names = [*(f"sum_{c}" for c in _FULL), "sum_igst", "expected_total", "total_delta", "taxable_delta"]
    return doubles(got.select("invoice", "n_lines", "status", *names), *names)


# ---- state


@query("WITH k AS (SELECT 'K' || CAST(s_suppkey AS VARCHAR) AS supplier_key, s_name AS supplier_name, 'G' || CAST(s_suppkey AS VARCHAR) AS gstin FROM supplier WHERE s_suppkey % 2 = 0), a AS (SELECT c_custkey AS seq, 'Supplier#' || lpad(CAST(c_custkey % 300 AS VARCHAR), 9, '0') AS name, 'g-' || CAST(c_custkey % 300 AS VARCHAR) AS g FROM customer), n AS (SELECT name, upper(replace(g, '-', '')) AS gstin, g, min(seq) AS seq FROM a GROUP BY ALL) SELECT supplier_key, supplier_name, gstin, 'KNOWN' AS status FROM k UNION ALL SELECT g, name, gstin, 'VERIFIED' FROM n WHERE gstin NOT IN (SELECT gstin FROM k) AND upper(name) NOT IN (SELECT upper(supplier_name) FROM k)")
def supplier_get_or_create(spark, sf_dir):
    s, c = F.col("s_suppkey"), F.col("c_custkey") % 300
    known = table(spark, sf_dir, "supplier").where(s % 2 == 0).select(F.concat(F.lit("K"), s.cast("string")).alias("supplier_key"), F.col("s_name").alias("supplier_name"), F.concat(F.lit("G"), s.cast("string")).alias("gstin"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), F.concat(F.lit("Supplier#"), F.lpad(c.cast("string"), 9, "0")).alias("supplier_name"), F.concat(F.lit("g-"), c.cast("string")).alias("gstin"))
    return state.get_or_create_suppliers(known, asked).drop("normalized_name")


@query("WITH i AS (SELECT l_partkey AS c, max_by(l_quantity, l_orderkey * 10 + l_linenumber) AS q FROM lineitem GROUP BY l_partkey) SELECT CAST(p_partkey AS VARCHAR) AS item_code, CASE WHEN q IS NULL THEN p_name ELSE 'new ' || CAST(CAST(q AS INTEGER) AS VARCHAR) END AS item_name, upper(CASE WHEN q IS NULL THEN p_name ELSE 'new ' || CAST(CAST(q AS INTEGER) AS VARCHAR) END) AS normalized_name FROM part LEFT JOIN i ON p_partkey = c")
def master_upsert(spark, sf_dir):
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("item_code"), F.col("p_name").alias("item_name"), F.lit("1").alias("pack"), F.lit("3004").alias("hsn"), F.lit(12.0).alias("gst"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("item_code"), F.concat(F.lit("new "), F.col("l_quantity").cast("int").cast("string")).alias("item_name"), F.lit("1").alias("pack"), F.lit("3004").alias("hsn"), F.lit(12.0).alias("gst"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return state.upsert_masters(known, items).select("item_code", "item_name", "normalized_name")


@query("WITH k AS (SELECT p_name AS alias, p_partkey % 4 AS supplier, min(p_partkey) AS item, CAST(2 AS BIGINT) AS matches FROM part GROUP BY ALL), l AS (SELECT p_name AS alias, CASE WHEN l_suppkey % 6 < 4 THEN l_suppkey % 6 END AS supplier, max_by(l_partkey, l_orderkey * 10 + l_linenumber) AS item, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) SELECT coalesce(k.alias, l.alias) AS alias, coalesce(k.supplier, l.supplier) AS supplier, CASE WHEN l.alias IS NULL THEN k.item ELSE l.item END AS item, CASE WHEN k.alias IS NULL THEN n ELSE matches + coalesce(n, 0) END AS matches FROM k FULL JOIN l ON k.alias = l.alias AND k.supplier IS NOT DISTINCT FROM l.supplier")
def alias_save(spark, sf_dir):
    part, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    known = part.groupBy(F.col("p_name").alias("alias"), (F.col("p_partkey") % 4).alias("supplier")).agg(F.min("p_partkey").alias("item"), F.lit(1.0).alias("confidence"), F.lit(2).cast("long").alias("matches"))
    learned = li.join(part, F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("p_name").alias("alias"), (F.col("l_suppkey") % 6).alias("supplier"), F.col("l_partkey").alias("item"), F.lit(0.9).alias("confidence"))
    some = spark.range(4).select(F.col("id").alias("supplier"))
    return state.save_aliases(known, learned, some, part.select(F.col("p_partkey").alias("item"))).select("alias", "supplier", "item", "matches")


_MOVES = "WITH e AS (SELECT event_id AS seq, user_id % 50 AS p, event_id % 3 AS b, event_id % 4 = 3 AS back, event_id % 5 = 0 AS any_batch, event_id % 9 + 1 AS q FROM events), r AS (SELECT seq, p, b, CAST(q AS DOUBLE) AS delta FROM e WHERE NOT back), f AS (SELECT p, b, min(seq) AS since FROM r GROUP BY ALL), x AS (SELECT e.seq, e.p, f.b, -CAST(q AS DOUBLE) AS delta, row_number() OVER (PARTITION BY e.seq ORDER BY since) AS k FROM e JOIN f ON e.p = f.p AND (e.b = f.b OR any_batch) AND since < e.seq WHERE back), m AS (SELECT seq, p, b, delta FROM r UNION ALL SELECT seq, p, b, delta FROM x WHERE k = 1), t AS (SELECT *, sum(delta) OVER (PARTITION BY p, b ORDER BY seq) AS s FROM m), z AS (SELECT *, s + greatest(0, max(-s) OVER (PARTITION BY p, b ORDER BY seq)) AS balance FROM t) "


@query(_MOVES + "SELECT 'P' || CAST(p AS VARCHAR) AS product, 'B' || CAST(b AS VARCHAR) AS batch, max_by(balance, seq) AS stock, count(*) AS n_moves, max(CASE WHEN delta > 0 THEN seq END) AS last_received FROM z GROUP BY p, b")
def stock_ingest(spark, sf_dir):
    return _ingested(spark, sf_dir)[1].drop("pack")


@query(_MOVES + "SELECT seq, 'P' || CAST(p AS VARCHAR) AS product, 'B' || CAST(b AS VARCHAR) AS batch, CASE WHEN delta > 0 THEN 'PURCHASE_RECEIPT' ELSE 'RETURN_DEDUCTION' END AS kind, delta, balance FROM z ORDER BY seq DESC LIMIT 100")
def last_stock_movements(spark, sf_dir):
    return state.movements(_ingested(spark, sf_dir)[0], 100).drop("pack")


@query(_MOVES + "SELECT count(DISTINCT seq % 40) AS invoices, count(*) FILTER (delta > 0) AS items, sum(CASE WHEN delta > 0 THEN delta END) AS units_added, count(*) FILTER (delta < 0) AS returns FROM z")
def stock_sync_totals(spark, sf_dir):
    return state.sync_totals(_ingested(spark, sf_dir)[0].withColumn("invoice", F.col("seq") % 40))


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = F.col("event_id")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    df = table(spark, sf_dir, "events").select(e.alias("seq"), name("P", F.col("user_id") % 50).alias("product"), F.lit("").alias("pack"), name("B", e % 3).alias("batch"), (e % 4 == 3).alias("back"), (e % 5 == 0).alias("any_batch"), (e % 9 + 1).cast("double").alias("q"))
    bought = df.where("not back").select("seq", "product", "pack", "batch", F.col("q").alias("billed"), F.lit(0.0).alias("free"), F.lit(1.0).alias("rate"))
    returned = df.where("back").select("seq", "product", F.when(F.col("any_batch"), "").otherwise(F.col("batch")).alias("batch"), F.col("q").alias("quantity"))
    return state.ingest_stock(bought, returned)


@query("WITH z AS (SELECT 1) SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') OR contains(lower(p_brand), 'a') ORDER BY p_name, p_partkey LIMIT 100")
def master_listing(spark, sf_dir):
    return state.listing(table(spark, sf_dir, "part"), [F.asc("p_name"), F.asc("p_partkey")], 100, "A", ("p_name", "p_brand")).select("p_partkey", "p_name")


# ---- pages

_HEADS = [("Product", 30, 70), ("Name", 74, 100), ("Batch", 200, 230), ("Exp", 260, 280), ("Qty", 300, 320), ("Ra", 350, 362), ("te", 363, 372), ("Amount", 430, 470)]
_CELL_AT = [30, 200, 258, 305, 345, 432]


@query("WITH z AS (SELECT p_partkey // 20 AS doc, row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) - 1 AS row_no, 'DRUG' || CAST(p_partkey AS VARCHAR) || '|B' || CAST(p_size AS VARCHAR) || '|' || lpad(CAST(p_size % 12 + 1 AS VARCHAR), 2, '0') || '/' || CAST(24 + p_size % 5 AS VARCHAR) || '|' || CAST(p_size AS VARCHAR) || '|' || CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS VARCHAR) || '|' || CAST(CAST(round(CAST(p_retailprice AS DECIMAL(10,2)) * p_size, 2) AS DECIMAL(18,2)) AS VARCHAR) AS cells FROM part) SELECT doc, row_no, cells, 'itemName|batchNo|expiryDate|quantity|rate|amount' AS fields FROM z")
def coordinate_tables(spark, sf_dir):
    """Parts on pages of twenty, as words with coordinates, read back as rows under fields."""
    k, size, price = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice").cast("decimal(10,2)")
    cells = [F.concat(F.lit("DRUG"), k.cast("string")), F.concat(F.lit("B"), size.cast("string")), F.concat(F.lpad((size % 12 + 1).cast("string"), 2, "0"), F.lit("/"), (24 + size % 5).cast("string")), size.cast("string"), price.cast("string"), F.round(price * size, 2).cast("decimal(18,2)").cast("string")]
    y = (k % 20 * 14 + 120).cast("double")
    word = lambda t, x0, x1, top: F.struct(t.alias("text"), x0.cast("double").alias("x0"), x1.cast("double").alias("x1"), top.cast("double").alias("top"), (top + 8).cast("double").alias("bottom"))
    part = table(spark, sf_dir, "part").select(F.floor(k / 20).alias("doc"), F.lit(1).alias("page"), *(c.alias(f"c{n}") for n, c in enumerate(cells)), y.alias("y"))
    body = part.select("doc", "page", F.explode(F.array(*(word(F.col(f"c{n}"), F.lit(x), F.lit(x) + F.length(f"c{n}") * 5, F.col("y")) for n, x in enumerate(_CELL_AT)))).alias("w"))
    sheets = part.select("doc", "page").distinct().select("doc", "page", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    head = sheets.select("doc", "page", F.explode(F.array(*(word(F.lit(t), F.lit(a), F.lit(b), F.lit(100.0)) for t, a, b in _HEADS))).alias("w"))
    got = pages.page_rows(body.unionByName(head).select("doc", "page", "w.*"), sheets)
    return got.select("doc", F.col("row_no").cast("long").alias("row_no"), F.array_join("cells", "|").alias("cells"), F.array_join("fields", "|").alias("fields"))
