"""One query for each group of operators, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import accounting, dates, quantities, text
from ..operators import evaluation, headers, identities, invoices, rows, runs, stock
from ..sources import exports
from .lines import LINES, line_items, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEY = ["invoice", "line_no", "part", "supplier"]


def query(sql: str | None = None):
    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql if sql.lstrip().startswith("WITH") else f"WITH {LINES} {sql}"
        return f

    return add


def doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in names})


# ---- accounting and tax

_SOLVED = """, s AS (SELECT *, CASE WHEN free > 0 THEN CAST(round((quantity + free) * rate, 2) AS DECIMAL(18,2)) END AS all_units FROM lines WHERE quantity > 0 AND rate > 0),
m AS (SELECT *, CASE WHEN abs(amount - gross) <= greatest(0.10, CAST(gross * 0.015 AS DECIMAL(18,4))) THEN 'GROSS' WHEN abs(amount - taxable) <= greatest(0.10, CAST(taxable * 0.015 AS DECIMAL(18,4))) THEN 'TAXABLE_PRE_GST'
 WHEN abs(amount - net) <= greatest(0.10, CAST(net * 0.015 AS DECIMAL(18,4))) THEN 'NET_POST_GST' WHEN abs(amount - all_units) <= greatest(0.10, CAST(all_units * 0.015 AS DECIMAL(18,4))) THEN 'TOTAL_QTY_GROSS' ELSE 'MISMATCH' END AS semantics FROM s) """


def solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = line_items(spark, sf_dir).withColumn("taxable", F.lit(None).cast("decimal(18,2)")).withColumn("net", F.lit(None).cast("decimal(18,2)"))
    return accounting.solve(df)


@query(_SOLVED + "SELECT semantics, CASE WHEN semantics = 'MISMATCH' THEN 'MATHEMATICAL_MISMATCH' WHEN d <= 0.05 THEN 'EXACT_MATCH' ELSE 'ROUNDING_DIFF' END AS status, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM (SELECT *, abs(amount - CASE semantics WHEN 'GROSS' THEN gross WHEN 'TAXABLE_PRE_GST' THEN taxable WHEN 'NET_POST_GST' THEN net ELSE all_units END) AS d FROM m) GROUP BY ALL")
def row_accounting_semantics(spark, sf_dir):
    return doubles(solved(spark, sf_dir).groupBy("semantics", "status").agg(F.count("*").alias("n"), F.sum("amount").alias("amount")), "amount")


@query("SELECT gst AS slab, count(*) AS n_lines, CAST(sum(taxable) AS DOUBLE) AS taxable, CAST(sum(h) AS DOUBLE) AS cgst, CAST(sum(tax - h) AS DOUBLE) AS sgst, CAST(0 AS DOUBLE) AS igst FROM (SELECT CAST(gst AS INTEGER) AS gst, taxable, tax, CAST(round(tax * 0.5, 2) AS DECIMAL(18,2)) AS h FROM lines) GROUP BY gst")
def slab_tax_summary(spark, sf_dir):
    df = line_items(spark, sf_dir).withColumn("stated_tax", F.col("tax")).withColumn("interstate", F.lit(False))
    return doubles(invoices.slab_summary(invoices.audit_lines(df)), "taxable", "cgst", "sgst", "igst")


@query("SELECT alert, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN raw_gst NOT IN (0, 5, 12, 18, 28) THEN 'NON_STATUTORY_SLAB' END, CASE WHEN abs(tax - e) > 0.10 THEN 'GST_AMOUNT_MISMATCH' END, CASE WHEN mrp > 0 AND rate > mrp THEN 'PRICE_INVERSION' END], lambda x: x IS NOT NULL)) AS alert FROM (SELECT *, CAST(round(taxable * raw_gst * 0.01, 2) AS DECIMAL(18,2)) AS e FROM lines)) GROUP BY alert")
def line_tax_alerts(spark, sf_dir):
    df = line_items(spark, sf_dir).withColumn("stated_tax", F.col("tax")).withColumn("gst", F.col("raw_gst")).withColumn("interstate", F.lit(False))
    return invoices.audit_lines(df).select(F.explode("alerts").alias("alert")).groupBy("alert").agg(F.count("*").alias("n"))


@query("SELECT supplier, CAST(sum(tax) AS DOUBLE) AS itc, count(*) AS n_lines FROM lines GROUP BY supplier")
def itc_claim_by_supplier(spark, sf_dir):
    return doubles(line_items(spark, sf_dir).groupBy("supplier").agg(F.sum("tax").alias("itc"), F.count("*").alias("n_lines")), "itc")


@query(", s AS (SELECT invoice, sum(gross) AS sum_gross, sum(taxable) AS sum_taxable, sum(tax) AS sum_tax, sum(net) AS sum_net, count(*) AS n_lines FROM lines GROUP BY invoice), o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS total FROM orders), j AS (SELECT *, sum_net - total AS delta FROM s LEFT JOIN o ON invoice = o_orderkey) SELECT invoice, CAST(sum_gross AS DOUBLE) AS sum_gross, CAST(sum_taxable AS DOUBLE) AS sum_taxable, CAST(sum_tax AS DOUBLE) AS sum_tax, CAST(sum_net AS DOUBLE) AS sum_net, n_lines, CAST(total AS DOUBLE) AS total, CAST(delta AS DOUBLE) AS delta, CASE WHEN total IS NULL THEN 'NO_INVOICE_SUMMARY_PRESENT' WHEN abs(delta) <= 1 THEN 'RECONCILED_BALANCED' WHEN abs(delta) <= 5 THEN 'MINOR_ROUNDING_VARIANCE' ELSE 'UNRECONCILED_MISMATCH' END AS status FROM j")
def grand_total_reconcile(spark, sf_dir):
    stated = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("invoice"), F.col("o_totalprice").cast("decimal(18,2)").alias("total"))
    got = invoices.reconcile(line_items(spark, sf_dir), stated)
    return doubles(got, "sum_gross", "sum_taxable", "sum_tax", "sum_net", "total", "delta")


@query("SELECT CASE WHEN mrp > 0 AND rate > mrp THEN 'PRICE_INVERSION_ERROR' WHEN mrp > 0 AND (mrp - rate) * 100 < mrp * 10 THEN 'LOW_RETAIL_MARGIN' WHEN mrp > 0 AND (mrp - rate) * 100 >= mrp * 25 THEN 'HIGH_MARGIN_PROMOTIONAL' ELSE 'STANDARD_RETAIL_MARGIN' END AS margin, count(*) AS n, CAST(sum(free * rate) AS DOUBLE) AS scheme_benefit FROM lines GROUP BY ALL")
def margin_classes(spark, sf_dir):
    df = line_items(spark, sf_dir).withColumn("margin", accounting.margin_class(F.col("rate"), F.col("mrp")))
    return doubles(df.groupBy("margin").agg(F.count("*").alias("n"), F.sum(F.col("free") * F.col("rate")).alias("scheme_benefit")), "scheme_benefit")


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN h = '' THEN 'MISSING_HSN' WHEN length(d) NOT IN (4, 6, 8) THEN 'INVALID_FORMAT' WHEN d[1:4] IN ('2106','3001','3002','3003','3004','3005','3006','3304','3305','3306','3401','3808','3822','9018','9019','9021') THEN 'STANDARD_PHARMA_HSN' ELSE 'NON_STANDARD_CHAPTER' END AS status FROM (SELECT h, regexp_replace(h, '\\D', '', 'g') AS d FROM (SELECT CASE WHEN p_partkey % 9 = 0 THEN '' ELSE CAST(2995 + p_partkey % 30 AS VARCHAR) || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.90' WHEN 2 THEN '9099' ELSE '9' END END AS h FROM part))) GROUP BY status".replace("SELECT status, count", "WITH z AS (SELECT 1) SELECT status, count", 1))
def hsn_validate(spark, sf_dir):
    k = F.col("p_partkey")
    h = F.when(k % 9 == 0, "").otherwise(F.concat((2995 + k % 30).cast("string"), F.when(k % 4 == 0, "").when(k % 4 == 1, ".90").when(k % 4 == 2, "9099").otherwise("9")))
    return table(spark, sf_dir, "part").select(accounting.hsn_status(h).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT invoice, line_no, part, supplier, CAST(amount AS DOUBLE) AS stated_net, CAST(net AS DOUBLE) AS computed_net, CAST(abs(amount - net) AS DOUBLE) AS discrepancy FROM lines WHERE abs(amount - net) > 1")
def suspicious_lines(spark, sf_dir):
    """Every line whose stated net (here its amount) is more than 1.0 from taxable plus tax."""
    df = line_items(spark, sf_dir).select(*KEY, F.col("amount").alias("stated_net"), "taxable", "tax")
    return doubles(invoices.suspicious(df).select(*KEY, "stated_net", "computed_net", "discrepancy"), "stated_net", "computed_net", "discrepancy")


# ---- quantities, dates and text

_RAW = """CASE CAST(l_quantity AS INTEGER) % 6 WHEN 0 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '+' || CAST(l_linenumber AS VARCHAR) WHEN 1 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' + ' || CAST(l_linenumber AS VARCHAR) || ' TAB' WHEN 2 THEN '+' || CAST(l_linenumber AS VARCHAR) || '.5' WHEN 3 THEN 'l' || CAST(l_linenumber AS VARCHAR) || '+O' WHEN 4 THEN '1,' || CAST(CAST(100 + l_quantity AS INTEGER) AS VARCHAR) || '.50 NOS' ELSE 'ASTYMIN+FORTE' END"""


def _raw_quantity():
    q, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string")
    k = F.col("l_quantity").cast("int") % 6
    return F.when(k == 0, F.concat(q, F.lit("+"), n)).when(k == 1, F.concat(q, F.lit(" + "), n, F.lit(" TAB"))).when(k == 2, F.concat(F.lit("+"), n, F.lit(".5"))).when(k == 3, F.concat(F.lit("l"), n, F.lit("+O"))).when(k == 4, F.concat(F.lit("1,"), (100 + F.col("l_quantity")).cast("int").cast("string"), F.lit(".50 NOS"))).otherwise("ASTYMIN+FORTE")


@query(r"WITH r AS (SELECT " + _RAW + r""" AS raw FROM lineitem), t AS (SELECT raw, regexp_replace(trim(regexp_replace(trim(replace(raw, ',', '')), '(?i)\s*(?:nos\.?|tab(?:let)?s?|caps?(?:ule)?s?|packs?|strips?|units?|[''`’]s)\b.*$', '')), '\s*\+\s*', '+', 'g') AS t FROM r),
s AS (SELECT raw, CASE WHEN NOT contains(raw, '+') THEN trim(replace(raw, ',', '')) WHEN regexp_matches(t, '^[0-9.OoIlZz]*\+[0-9.OoIlZz]+$') AND regexp_matches(translate(t, 'OoIlZz', '001122'), '^(?:\d+(?:\.\d+)?|\.\d+)?\+(?:\d+(?:\.\d+)?|\.\d+)$') THEN translate(t, 'OoIlZz', '001122') ELSE t END AS s FROM t)
SELECT raw, count(*) AS n, regexp_matches(s, '^(?:\d+(?:\.\d+)?|\.\d+)?\+(?:\d+(?:\.\d+)?|\.\d+)$') AS is_compound, CASE WHEN regexp_matches(s, '^(?:\d+(?:\.\d+)?|\.\d+)?\+(?:\d+(?:\.\d+)?|\.\d+)$') THEN coalesce(try_cast(nullif(split_part(s, '+', 1), '') AS DOUBLE), 0) END AS billed, CASE WHEN regexp_matches(s, '^(?:\d+(?:\.\d+)?|\.\d+)?\+(?:\d+(?:\.\d+)?|\.\d+)$') THEN try_cast(split_part(s, '+', 2) AS DOUBLE) END AS free,
try_cast(nullif(regexp_extract(replace(raw, ',', ''), '[-+]?(\d+\.?\d*|\.\d+)'), '') AS DOUBLE) AS first_number FROM s GROUP BY ALL""")
def scheme_tokenize(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").select(_raw_quantity().alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    s = raw.withColumn("s", quantities.scheme(F.col("raw")))
    return s.select("raw", "n", "s.is_compound", "s.billed", "s.free", quantities.number(F.col("raw")).alias("first_number"))


_MONTH = "CAST(month(d) AS VARCHAR)"


@query("WITH x AS (SELECT CAST(l_shipdate AS DATE) + INTERVAL 27 YEAR AS d, l_linenumber % 7 AS k FROM lineitem), r AS (SELECT last_day(d) AS iso, CASE k WHEN 0 THEN strftime(d, '%m/%y') WHEN 1 THEN strftime(d, '%m-%Y') WHEN 2 THEN strftime(d, '%Y-%m') WHEN 3 THEN strftime(d, '%d/%m/%Y') WHEN 4 THEN upper(strftime(d, '%b-%y')) WHEN 5 THEN strftime(d, '%m%Y') ELSE strftime(d, '%d/%B/%Y') END AS raw FROM x) SELECT raw, strftime(iso, '%m/%Y') AS mmyyyy, strftime(iso, '%Y-%m-%d') AS iso, count(*) AS n, (year(iso) - 2026) * 12 + month(iso) - 10 AS months, CASE WHEN (year(iso) - 2026) * 12 + month(iso) - 10 <= 0 THEN 'EXPIRED_STOCK' WHEN (year(iso) - 2026) * 12 + month(iso) - 10 < 3 THEN 'CRITICAL_SHORT_EXPIRY' WHEN (year(iso) - 2026) * 12 + month(iso) - 10 < 6 THEN 'SHORT_EXPIRY_RISK' WHEN (year(iso) - 2026) * 12 + month(iso) - 10 < 12 THEN 'ACCEPTABLE_SHELF_LIFE' ELSE 'OPTIMAL_SHELF_LIFE' END AS shelf_life FROM r GROUP BY ALL")
def expiry_and_shelf_life(spark, sf_dir):
    d, k = F.add_months(F.col("l_shipdate").cast("date"), 27 * 12), F.col("l_linenumber") % 7
    f = lambda p: F.date_format(d, p)
    raw = F.when(k == 0, f("MM/yy")).when(k == 1, f("MM-yyyy")).when(k == 2, f("yyyy-MM")).when(k == 3, f("dd/MM/yyyy")).when(k == 4, F.upper(f("MMM-yy"))).when(k == 5, f("MMyyyy")).otherwise(f("dd/MMMM/yyyy"))
    df = table(spark, sf_dir, "lineitem").select(raw.alias("raw")).groupBy("raw").agg(F.count("*").alias("n")).withColumn("e", dates.expiry(F.col("raw")))
    as_of = F.lit("2026-10-01").cast("date")
    return df.select("raw", "n", "e.mmyyyy", F.col("e.iso").cast("string").alias("iso"), dates.months_left(F.col("e.iso"), as_of).cast("long").alias("months"), dates.shelf_life(F.col("e.iso"), as_of).alias("shelf_life"))


@query(r"WITH n AS (SELECT p_partkey, p_name || CASE p_partkey % 5 WHEN 0 THEN ' 40 MG TAB 15S' WHEN 1 THEN '-FORTE CAPSULES (1X15)' WHEN 2 THEN ' 20GM OINTMENT' WHEN 3 THEN ' DUO  TABLETS, 10S' ELSE '' END AS raw FROM part), s AS (SELECT p_partkey, raw, regexp_replace(upper(trim(raw)), '(\d+)\s+(MG|GM|MCG|ML|IU|G|MG/ML)\b', '\1\2', 'g') AS s FROM n), t AS (SELECT p_partkey, raw, trim(regexp_replace(regexp_replace(regexp_replace(s, '[()\[\]{}/\\,:;*#@!?_-]', ' ', 'g'), '(?i)" + text.DOSAGE_NOISE.replace("'", "''") + r"', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM s) SELECT p_partkey, raw, CASE WHEN t <> '' THEN t ELSE upper(trim(raw)) END AS core FROM t")
def drug_name_normalize(spark, sf_dir):
    k = F.col("p_partkey") % 5
    raw = F.concat("p_name", F.when(k == 0, " 40 MG TAB 15S").when(k == 1, "-FORTE CAPSULES (1X15)").when(k == 2, " 20GM OINTMENT").when(k == 3, " DUO  TABLETS, 10S").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), text.drug_name(raw).alias("core"))


@query(r"WITH d AS (SELECT md5(text) AS h, text, doc_id FROM documents) SELECT doc_id, md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS clean_hash, greatest(1, length(text) // 4) AS tokens, h AS text_hash, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS run_no, count(*) OVER (PARTITION BY h) > 1 AND row_number() OVER (PARTITION BY h ORDER BY doc_id) > 1 AS is_duplicate FROM d")
def duplicate_documents(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", F.md5(text.cleaned(F.col("text"))).alias("clean_hash"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)).alias("tokens"), F.md5("text").alias("text_hash"))
    return runs.run_numbers(df, "text_hash", "doc_id").withColumn("is_duplicate", F.col("run_no") > 1)


@query(r"WITH t AS (SELECT o_orderkey, 'Inv GSTIN: ' || lpad(CAST(o_custkey % 37 AS VARCHAR), 2, '0') || 'ABCDE' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') || 'F1Z5 Net : 10.00 items Net : ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS t FROM orders) SELECT o_orderkey, nullif(regexp_extract(t, '\b(\d{2}[A-Z]{5}\d{4}[A-Z][A-Z0-9]Z[A-Z0-9])\b', 1), '') AS gstin, CAST(list_last(regexp_extract_all(t, 'Net : ([0-9.]+)', 1)) AS DOUBLE) AS grand_total FROM t")
def metadata_last_match(spark, sf_dir):
    t = F.concat(F.lit("Inv GSTIN: "), F.lpad((F.col("o_custkey") % 37).cast("string"), 2, "0"), F.lit("ABCDE"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"), F.lit("F1Z5 Net : 10.00 items Net : "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.found(t, text.GSTIN).alias("gstin"), text.last_found(t, "Net : ([0-9.]+)").cast("double").alias("grand_total"))


# ---- document rows

_EVENT_ROWS = "r AS (SELECT user_id AS doc, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS row_no, event_id, CASE WHEN event_id % 11 = 0 THEN 'Sales Return' WHEN event_id % 17 = 0 THEN 'Bonus Items' WHEN event_id % 13 = 0 THEN 'PAGE TOTAL 99' WHEN event_id % 19 = 0 THEN 'Total B/F 12' WHEN event_id % 23 = 0 THEN 'page 2 of 3' WHEN event_id % 29 = 0 THEN 'Bank Name X' ELSE 'item ' || event_type END AS text, event_type FROM events)"


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    t = F.when(i % 11 == 0, "Sales Return").when(i % 17 == 0, "Bonus Items").when(i % 13 == 0, "PAGE TOTAL 99").when(i % 19 == 0, "Total B/F 12").when(i % 23 == 0, "page 2 of 3").when(i % 29 == 0, "Bank Name X").otherwise(F.concat(F.lit("item "), F.col("event_type")))
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.row_number().over(by).cast("long").alias("row_no"), "event_id", t.alias("text"), "event_type")


@query("WITH " + _EVENT_ROWS + ", h AS (SELECT *, CASE WHEN text = 'Sales Return' THEN 'returns_adjusted' WHEN text = 'Bonus Items' THEN 'scheme_items' END AS here FROM r) SELECT event_id, coalesce(last_value(here IGNORE NULLS) OVER (PARTITION BY doc ORDER BY row_no ROWS UNBOUNDED PRECEDING), 'purchase_items') AS section FROM h")
def section_segmentation(spark, sf_dir):
    return rows.sections(event_rows(spark, sf_dir)).select("event_id", "section")


@query("WITH " + _EVENT_ROWS + ", x AS (SELECT CASE text WHEN 'PAGE TOTAL 99' THEN 'PAGE_SUBTOTAL_ROW' WHEN 'Total B/F 12' THEN 'RUNNING_BF_CF_ROW' WHEN 'page 2 of 3' THEN 'PAGE_CONTINUATION_CHROME' WHEN 'Bank Name X' THEN 'LETTERHEAD_OR_FOOTER_ROW' END AS reason FROM r) SELECT coalesce(reason, 'KEPT') AS reason, count(*) AS n FROM x GROUP BY ALL")
def continuation_filter_audit(spark, sf_dir):
    return rows.with_reason(event_rows(spark, sf_dir)).groupBy(F.coalesce("reason", F.lit("KEPT")).alias("reason")).agg(F.count("*").alias("n"))


@query("WITH " + _EVENT_ROWS + ", g AS (SELECT *, greatest(sum(CASE WHEN event_type = 'purchase' OR event_id % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY row_no ROWS UNBOUNDED PRECEDING), 1) AS group_no FROM r) SELECT doc, CAST(group_no AS BIGINT) AS group_no, min(row_no) AS row_no, count(*) AS n_rows, string_agg(text, ' ' ORDER BY row_no) AS item FROM g GROUP BY doc, group_no")
def wrapped_row_merge(spark, sf_dir):
    df = event_rows(spark, sf_dir).select("doc", "row_no", F.col("text").alias("item"), ((F.col("event_type") == "purchase") | (F.col("event_id") % 3 == 0)).alias("is_primary"))
    return rows.merge_wrapped(df)


@query("WITH c AS (SELECT l_suppkey AS doc, 0 AS col_no, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS value FROM lineitem UNION ALL SELECT l_suppkey, 1, strftime(l_shipdate, '%m/%Y') FROM lineitem UNION ALL SELECT l_suppkey, 2, l_returnflag || l_linestatus || CAST(l_partkey AS VARCHAR) FROM lineitem) SELECT doc, col_no, count(*) AS n, avg(CASE WHEN value <> '' THEN 1 ELSE 0 END) AS fill, count(DISTINCT value) AS n_distinct, CAST(min(length(value)) AS INTEGER) AS min_len, CAST(max(length(value)) AS INTEGER) AS max_len, avg(CAST(regexp_matches(value, '^\\d+$') AS INTEGER)) AS int_share, avg(CAST(regexp_matches(value, '^\\d+\\.\\d+$') AS INTEGER)) AS decimal_share, avg(CAST(regexp_matches(value, '[A-Za-z]{3,}') AS INTEGER)) AS text_share, avg(CAST(regexp_matches(value, '^(\\d{4}|\\d{6}|\\d{8})$') AS INTEGER)) AS hsn_share, avg(CAST(regexp_matches(value, '^\\d{1,2}[/-]\\d{2,4}$') AS INTEGER)) AS expiry_share, avg(CAST(regexp_matches(value, '^[A-Za-z0-9-]{3,14}$') AND regexp_matches(value, '\\d') AND regexp_matches(value, '[A-Za-z]') AS INTEGER)) AS batch_share FROM c GROUP BY doc, col_no")
def column_profile(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    cells = li.select(F.col("l_suppkey").alias("doc"), F.posexplode(F.array(F.col("l_quantity").cast("int").cast("string"), F.date_format("l_shipdate", "MM/yyyy"), F.concat("l_returnflag", "l_linestatus", F.col("l_partkey").cast("string")))).alias("col_no", "value"))
    return rows.column_profile(cells)


@query("WITH c AS (SELECT l_orderkey AS doc, CAST(l_linenumber AS INTEGER) AS v, 0 AS col_no FROM lineitem UNION ALL SELECT l_orderkey, CAST(l_quantity AS INTEGER), 1 FROM lineitem) SELECT doc, col_no, count(*) = count(DISTINCT v) AND max(v) - min(v) + 1 = count(*) AND min(v) <= 5 AND max(v) <= 500 AS is_serial FROM c GROUP BY doc, col_no")
def serial_column_detect(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.posexplode(F.array(F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"))).alias("col_no", "value"))
    return rows.serial_columns(cells)


@query("WITH x AS (SELECT o_custkey AS doc, o_orderkey AS pos, o_orderpriority AS field, CAST(o_totalprice AS DOUBLE) AS score FROM orders) SELECT doc, field, pos, score FROM (SELECT *, row_number() OVER (PARTITION BY doc, field ORDER BY score DESC, pos) AS r FROM x) WHERE r = 1")
def mapping_conflict_winner(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("field"), F.col("o_totalprice").cast("double").alias("score"))
    return headers.winners(df).select("doc", "field", "pos", "score")


# ---- identities, stock and evaluation


@query("WITH k AS (SELECT s_suppkey, 'G' || CAST(s_suppkey // 2 AS VARCHAR) AS gstin, s_name AS name FROM supplier), r AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'G' || CAST(c_custkey % 100 AS VARCHAR) END AS gstin, 'Supplier#' || lpad(CAST(c_custkey % 150 AS VARCHAR), 9, '0') AS name FROM customer), g AS (SELECT gstin, min(s_suppkey) AS a FROM k GROUP BY gstin), n AS (SELECT name, min(s_suppkey) AS b FROM k GROUP BY name) SELECT c_custkey, coalesce(a, b) AS s_suppkey, CASE WHEN a IS NOT NULL THEN 'gstin' WHEN b IS NOT NULL THEN 'name' END AS matched_by FROM r LEFT JOIN g USING (gstin) LEFT JOIN n USING (name)")
def supplier_identity_priority(spark, sf_dir):
    known = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("G"), F.floor(F.col("s_suppkey") / 2).cast("string")).alias("gstin"), F.col("s_name").alias("name"))
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("G"), (F.col("c_custkey") % 100).cast("string"))).alias("gstin"), F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 150).cast("string"), 9, "0")).alias("name"))
    return identities.by_priority(asked, known, ["gstin", "name"], "s_suppkey", "c_custkey")


@query("WITH a AS (SELECT p_name AS alias, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 5 END AS supplier, p_partkey AS item, (p_partkey % 7) / 7.0 AS confidence, p_partkey % 11 AS matches FROM part), n AS (SELECT DISTINCT p_name AS name, s AS supplier FROM part, (SELECT unnest(range(5)) AS s)), j AS (SELECT n.name, n.supplier, a.item, a.confidence, a.matches, coalesce(a.supplier = n.supplier, false) AS own FROM n JOIN a ON upper(n.name) = upper(a.alias)) SELECT name, supplier, item, CASE WHEN own THEN 'SUPPLIER_ALIAS' ELSE 'GLOBAL_ALIAS' END AS source FROM (SELECT *, row_number() OVER (PARTITION BY name, supplier ORDER BY own DESC, CASE WHEN own THEN confidence END DESC NULLS LAST, CASE WHEN own THEN matches END DESC NULLS LAST, matches DESC, confidence DESC, item) AS r FROM j) WHERE r = 1")
def alias_top1(spark, sf_dir):
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    aliases = part.select(F.col("p_name").alias("alias"), F.when(k % 3 != 0, k % 5).alias("supplier"), k.alias("item"), ((k % 7) / 7.0).alias("confidence"), (k % 11).alias("matches"))
    names = part.select(F.col("p_name").alias("name"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("supplier")).distinct()
    return identities.best_alias(names, aliases)


# fixed values: a few items of a product master
MASTERS = [("MED-1001", "AMARYL 1MG"), ("MED-1003", "TELMA 40MG"), ("MED-1009", "DOLO 650"), ("MED-1011", "PAN D"), ("MED-1012", "AUGMENTIN 625"), ("MED-1013", "AZITHRAL 500MG")]


_NAMES = {0: ("AMARYL 1MG STRIP", "MED-1001"), 1: ("TELMA 40 TABLETS (1X15)", "MED-1003"), 2: ("DOLO 650 TABLET", "MED-1009"), 3: ("PAN-D CAPSULE", "MED-1011")}


@query("WITH n AS (SELECT DISTINCT CASE p_partkey % 6 " + " ".join(f"WHEN {k} THEN '{n}'" for k, (n, _) in _NAMES.items()) + " ELSE p_name END AS name FROM part) SELECT name, CASE name " + " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in _NAMES.values()) + " END AS code, CASE WHEN name IN ('DOLO 650 TABLET', 'AMARYL 1MG STRIP', 'PAN-D CAPSULE', 'TELMA 40 TABLETS (1X15)') THEN 'EXACT_NAME_MATCH' ELSE 'UNRESOLVED' END AS match_type FROM n")
def fuzzy_master_match(spark, sf_dir):
    k = F.col("p_partkey") % 6
    n = F.col("p_name")
    for at, (name, _) in _NAMES.items():
        n = F.when(k == at, name).otherwise(n)
    masters = spark.createDataFrame(MASTERS, "code string, item_name string")
    return identities.fuzzy_match(table(spark, sf_dir, "part").select(n.alias("name")), masters).select("name", "code", "match_type")


# the scorers restated: the longest common subsequence by one bit for each character of a, row by row over b
_LCS = "length(a) - bit_count(list_reduce(list_prepend((1::HUGEINT << length(a)) - 1, list_transform(string_split(b, ''), lambda c: list_sum(list_transform(range(length(a)), lambda i: CASE WHEN a[i + 1] = c THEN 1::HUGEINT << i ELSE 0::HUGEINT END)))), lambda x, y: ((x + (x & y)) | (x & ~y)) & ((1::HUGEINT << length(a)) - 1)))"


@query("""WITH m AS (SELECT p_name AS item_name, CAST(min(p_partkey) AS VARCHAR) AS code FROM part GROUP BY p_name), n AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_name[2:] WHEN 1 THEN replace(p_name, 'e', 'ea') WHEN 2 THEN p_name || 'x' ELSE replace(replace(replace(p_name, 'a', 'q'), 'o', 'zz'), ' ', '') || 'yyyy' END AS name FROM part),
p AS (SELECT name, item_name, code, upper(name) AS u, upper(item_name) AS v, list_sort(string_split(upper(name), ' ')) AS x, list_sort(string_split(upper(item_name), ' ')) AS y FROM n CROSS JOIN m),
q AS (SELECT *, list_sort(list_intersect(x, y)) AS w, CASE WHEN length(u) <= length(v) THEN u ELSE v END AS sh, CASE WHEN length(u) <= length(v) THEN v ELSE u END AS lo FROM p),
s AS (SELECT *, array_to_string(w, ' ') AS ws, array_to_string(list_concat(w, list_filter(x, lambda t: NOT list_contains(w, t))), ' ') AS l, array_to_string(list_concat(w, list_filter(y, lambda t: NOT list_contains(w, t))), ' ') AS r FROM q),
z AS (SELECT name, item_name, code, contains(lo, sh) OR (len(w) > 0 AND len(w) IN (len(x), len(y))) AS whole, unnest([0, 0, 1, 1, 2, 2]) AS kind, unnest([array_to_string(x, ' '), l, ws, ws, lo[1:length(sh) - 1], lo[length(lo) - length(sh) + 2:]]) AS a, unnest([array_to_string(y, ' '), r, l, r, sh, sh]) AS b FROM s),
k AS (SELECT name, item_name, code, whole, kind, CASE WHEN a = '' THEN 0 ELSE 200.0 * (""" + _LCS + """) / (length(a) + length(b)) END AS ratio FROM z),
g AS (SELECT name, item_name, code, max(CASE WHEN whole THEN 100 WHEN kind = 2 AND ratio < 95 THEN 0 ELSE ratio END) AS score FROM k GROUP BY ALL),
f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, item_name, code) = 1)
SELECT name, CASE WHEN score >= 75 THEN code END AS code, CASE WHEN score >= 75 THEN round(score, 1) ELSE 0 END AS score, CASE WHEN score >= 99 THEN 'EXACT_NAME_MATCH' WHEN score >= 75 THEN 'FUZZY_MATCH' ELSE 'UNRESOLVED' END AS match_type FROM f""")
def fuzzy_part_match(spark, sf_dir):
    """Part names with a letter lost, doubled or added, or spoilt, against all part names."""
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    spoilt = F.concat(F.regexp_replace(F.regexp_replace(F.regexp_replace(n, "a", "q"), "o", "zz"), " ", ""), F.lit("yyyy"))
    name = F.when(k == 0, F.substring(n, 2, 99)).when(k == 1, F.regexp_replace(n, "e", "ea")).when(k == 2, F.concat(n, F.lit("x"))).otherwise(spoilt)
    part = table(spark, sf_dir, "part")
    return identities.fuzzy_match(part.select(name.alias("name")), part.groupBy(n.alias("item_name")).agg(F.min("p_partkey").cast("string").alias("code"))).select("name", "code", "score", "match_type")


@query("WITH p AS (SELECT p_partkey, p_partkey % 4 AS k, p_partkey % 3 AS supplier FROM part) SELECT p_partkey, CASE k WHEN 0 THEN CASE WHEN supplier = 1 THEN 'MED-1001' ELSE 'MED-1003' END WHEN 1 THEN 'MED-1009' WHEN 2 THEN 'MED-1011' END AS code, CASE k WHEN 0 THEN CASE WHEN supplier = 1 THEN 'SUPPLIER_ALIAS' ELSE 'GLOBAL_ALIAS' END WHEN 1 THEN 'EXACT_NAME_MATCH' WHEN 2 THEN 'GLOBAL_ALIAS' ELSE 'UNRESOLVED' END AS match_type FROM p")
def item_resolution(spark, sf_dir):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "TL40 TAB 15S").when(k == 1, "DOLO 650 TABLET").when(k == 2, "PANTOX  TABLETS").otherwise("  ")
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), (F.col("p_partkey") % 3).cast("int").alias("supplier"))
    aliases = spark.createDataFrame([("TL40 TAB 15S", 1, "MED-1001", 0.9, 1), ("TL40 TAB 15S", None, "MED-1003", 1.0, 5), ("PANTOX", None, "MED-1011", 1.0, 1)], "alias string, supplier int, item string, confidence double, matches int")
    masters = spark.createDataFrame(MASTERS, "code string, item_name string")
    return identities.resolve_items(rows, aliases, masters).select("p_partkey", "code", "match_type")


@query(", m AS (SELECT part, flag, row_number() OVER (PARTITION BY part ORDER BY shipped, invoice, line_no, supplier, quantity) AS seq, CASE WHEN flag = 'R' THEN -quantity ELSE quantity + free END AS delta FROM lines), s AS (SELECT *, max(CASE WHEN delta > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY part ORDER BY seq) AS started FROM m), t AS (SELECT *, sum(delta) OVER (PARTITION BY part ORDER BY seq) AS s FROM s WHERE started = 1), b AS (SELECT *, s + greatest(0, max(-s) OVER (PARTITION BY part ORDER BY seq)) AS balance FROM t) SELECT part, CAST(max_by(balance, seq) AS DOUBLE) AS stock, count(*) AS n_moves FROM b GROUP BY part")
def stock_balance_clamped(spark, sf_dir):
    by = Window.partitionBy("part").orderBy("shipped", "invoice", "line_no", "supplier", "quantity")
    delta = F.when(F.col("flag") == "R", -F.col("quantity")).otherwise(F.col("quantity") + F.col("free"))
    moves = line_items(spark, sf_dir).select("part", F.row_number().over(by).alias("seq"), delta.alias("delta"))
    return doubles(stock.inventory(moves, "part"), "stock")


@query("WITH z AS (SELECT 1) SELECT p_partkey, p_name, CAST(p_retailprice AS DOUBLE) AS p_retailprice FROM part WHERE contains(lower(p_name), 'steel') OR contains(lower(p_brand), 'brand#1') ORDER BY p_retailprice DESC, p_partkey LIMIT 200")
def stock_top_search(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    found = part.where(F.lower("p_name").contains("steel") | F.lower("p_brand").contains("brand#1"))
    return found.orderBy(F.desc("p_retailprice"), "p_partkey").limit(200).select("p_partkey", "p_name", "p_retailprice")


_TRUTH = "c AS (SELECT unnest(['quantity', 'rate']) AS field, unnest([CAST(quantity AS DOUBLE), CAST(rate AS DOUBLE)]) AS expected, unnest([CASE WHEN line_no % 4 <> 0 THEN CAST(quantity AS DOUBLE) END, CASE WHEN part % 5 = 0 THEN CAST(mrp AS DOUBLE) ELSE CAST(rate AS DOUBLE) END]) AS predicted FROM lines)"


@query(", " + _TRUTH + ", s AS (SELECT field, count(*) FILTER (abs(predicted - expected) <= greatest(0.05, abs(expected) * 0.01)) AS tp, count(predicted) AS n_predicted, count(expected) AS n_expected FROM c GROUP BY field) SELECT *, tp / n_predicted AS precision, tp / n_expected AS recall, 2 * (tp / n_predicted) * (tp / n_expected) / (tp / n_predicted + tp / n_expected) AS f1 FROM s")
def field_prf1(spark, sf_dir):
    d = lambda c: F.col(c).cast("double")
    cell = F.array(F.struct(F.lit("quantity").alias("field"), d("quantity").alias("expected"), F.when(F.col("line_no") % 4 != 0, d("quantity")).alias("predicted")), F.struct(F.lit("rate").alias("field"), d("rate").alias("expected"), F.when(F.col("part") % 5 == 0, d("mrp")).otherwise(d("rate")).alias("predicted")))
    cells = line_items(spark, sf_dir).select(F.explode(cell).alias("c")).select("c.*")
    return evaluation.field_scores(cells.withColumn("same", evaluation.within(F.col("predicted"), F.col("expected"), 0.05, 0.01)))


@query("WITH b AS (SELECT * FROM (VALUES (0, 0, 50), (1, 50, 60), (2, 60, 70), (3, 70, 80), (4, 80, 90), (5, 90, 95), (6, 95, 100)) t(bucket, lo, hi)), s AS (SELECT o_custkey % 101 AS confidence, o_orderstatus = 'F' AS correct FROM orders) SELECT bucket, lo, hi, count(correct) AS n, avg(CAST(correct AS INTEGER)) AS accuracy FROM b LEFT JOIN s ON confidence >= lo AND (confidence < hi OR (hi = 100 AND confidence = 100)) GROUP BY ALL")
def confidence_calibration(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 101).alias("confidence"), (F.col("o_orderstatus") == "F").alias("correct"))
    return evaluation.calibration(df)


@query("WITH z AS (SELECT 1) SELECT o_orderstatus AS expected, o_orderpriority AS predicted, count(*) AS n FROM orders GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("expected"), F.col("o_orderpriority").alias("predicted")))


@query(None)
def greedy_row_match(spark, sf_dir):
    df = line_items(spark, sf_dir).select(F.col("invoice").alias("doc"), F.row_number().over(Window.partitionBy("invoice").orderBy("line_no", "part", "supplier")).alias("row_no"), F.col("item"), "batch")
    truth = df.withColumn("batch", F.when(F.col("row_no") % 3 == 0, F.lit("X")).otherwise(F.col("batch")))
    return evaluation.greedy_match(df, truth)


@query("SELECT item AS \"ITEM_NAME\", batch AS \"BATCH_NO\", CAST(quantity AS DOUBLE) AS \"QTY\", CAST(free AS DOUBLE) AS \"FREE_QTY\", CAST(rate AS DOUBLE) AS \"PURCHASE_RATE\", CAST(gross AS DOUBLE) AS \"GROSS_AMOUNT\", CAST(net AS DOUBLE) AS \"NET_AMOUNT\" FROM lines WHERE trim(item) <> ''")
def marg_export(spark, sf_dir):
    cols = ["QTY", "FREE_QTY", "PURCHASE_RATE", "GROSS_AMOUNT", "NET_AMOUNT"]
    return doubles(exports.marg(line_items(spark, sf_dir)).select("ITEM_NAME", "BATCH_NO", *cols), *cols)


@query(None)
def canonical_json_export(spark, sf_dir):
    return exports.canonical_json(line_items(spark, sf_dir))


@query(None)
def tally_xml_export(spark, sf_dir):
    return exports.tally_xml(line_items(spark, sf_dir))


from . import accuracy, documents, memory, stated, tables, texts  # noqa: E402, F401 (register their queries)
