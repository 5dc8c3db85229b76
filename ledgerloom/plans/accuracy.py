"""Queries of evaluation: rows and cells against the truth, mappings, documents and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compare
from ..operators import accuracy
from .lines import LINES, line_items, table
from .queries import query

FIELDS = ["itemName", "batchNo", "expiryDate", "quantity", "freeQuantity", "rate", "mrp", "amount", "gstPercent", "discountPercent"]

# truth and extraction of each line: what the extraction gets wrong depends on the line's number
_PAIRS = """v AS (SELECT invoice, line_no % 7 AS k, part % 2 AS odd, item, batch, strftime(shipped + INTERVAL 27 YEAR, '%m/%Y') AS e1, strftime(shipped + INTERVAL 27 YEAR, '%m-%y') AS e2, strftime(shipped + INTERVAL 27 YEAR, '%m/%y') AS e3, CAST(quantity AS VARCHAR) AS q, CAST(free AS VARCHAR) AS f, CAST(rate AS VARCHAR) AS r, CAST(mrp AS VARCHAR) AS m,
 CAST(gross AS VARCHAR) AS a, CAST(gross + 0.05 AS VARCHAR) AS a2, CAST(gst AS VARCHAR) AS g, CAST(discount AS VARCHAR) AS d, quantity, free, rate, mrp, gross, gst, discount FROM lines),
x AS (SELECT *, CASE k WHEN 1 THEN lower(item) || ' ' WHEN 2 THEN item || ' TAB' ELSE item END AS p_item, CASE WHEN k = 5 THEN e1 ELSE batch END AS p_batch, CASE WHEN k = 5 THEN batch WHEN odd = 1 THEN e2 ELSE e1 END AS p_exp, CASE WHEN k = 3 THEN f ELSE q END AS p_q, CASE WHEN k = 3 THEN q ELSE f END AS p_f,
 CASE WHEN k = 4 THEN m ELSE r END AS p_r, CASE WHEN k = 4 THEN r ELSE m END AS p_m, CASE WHEN k = 6 THEN g WHEN odd = 1 THEN a2 ELSE a END AS p_a, CASE WHEN k <> 0 THEN g END AS p_g, d AS p_d FROM v),
n AS (SELECT *, CAST(p_q AS DOUBLE) AS nq, CAST(p_f AS DOUBLE) AS nf, CAST(p_r AS DOUBLE) AS nr, CAST(p_m AS DOUBLE) AS nm, CAST(p_a AS DOUBLE) AS na, CAST(p_g AS DOUBLE) AS ng, CAST(d AS DOUBLE) AS nd, CAST(quantity AS DOUBLE) AS tq, CAST(free AS DOUBLE) AS tf, CAST(rate AS DOUBLE) AS tr, CAST(mrp AS DOUBLE) AS tm, CAST(gross AS DOUBLE) AS ta, CAST(gst AS DOUBLE) AS tg FROM x),
c AS (SELECT *, CASE WHEN trim(p_item) = trim(item) THEN 'EXACT' WHEN upper(trim(p_item)) = upper(item) OR (length(item) > 5 AND contains(upper(p_item), upper(item))) THEN 'NORMALIZED' ELSE 'MISMATCH' END AS c_item, CASE WHEN p_batch = batch THEN 'EXACT' ELSE 'MISMATCH' END AS c_batch,
 CASE WHEN p_exp = e1 THEN 'EXACT' WHEN p_exp = e2 THEN 'NORMALIZED' ELSE 'MISMATCH' END AS c_exp, CASE WHEN nq = tq THEN 'EXACT' WHEN abs(nq - tq) <= 0.01 THEN 'TOLERANCE' ELSE 'MISMATCH' END AS c_q, CASE WHEN nf = tf THEN 'EXACT' WHEN abs(nf - tf) <= 0.01 THEN 'TOLERANCE' ELSE 'MISMATCH' END AS c_f,
 CASE WHEN nr = tr THEN 'EXACT' WHEN abs(tr - nr) <= 0.05 OR abs(tr - nr) / tr <= 0.005 THEN 'TOLERANCE' ELSE 'MISMATCH' END AS c_r, CASE WHEN nm = tm THEN 'EXACT' WHEN abs(tm - nm) <= 0.05 OR abs(tm - nm) / tm <= 0.005 THEN 'TOLERANCE' ELSE 'MISMATCH' END AS c_m,
 CASE WHEN na = ta THEN 'EXACT' WHEN abs(ta - na) <= 0.1 OR (ta <> 0 AND abs(ta - na) / abs(ta) <= 0.005) THEN 'TOLERANCE' ELSE 'MISMATCH' END AS c_a, CASE WHEN ng IS NULL THEN 'MISSING' ELSE 'EXACT' END AS c_g, 'EXACT' AS c_d FROM n),
s AS (SELECT *, [c_item, c_batch, c_exp, c_q, c_f, c_r, c_m, c_a, c_g, c_d] AS every, [c_item, c_q, c_r, c_a] AS crit, [c_r, c_m, c_d, c_g, c_a] AS fin, nq * nr AS gr, nq * nr * (1 - nd / 100) AS le, nq * nr * (1 - nd / 100) * (1 + coalesce(ng, 0) / 100) AS tx,
 greatest(1e-9 * greatest(abs(nq), abs(tf)), 0.01) AS z1, list_filter([CASE WHEN abs(nq - tf) <= 0.01 AND abs(nf - tq) <= 0.01 AND tq <> tf THEN 'QUANTITY_FREE_SWAP' END, CASE WHEN abs(nr - tm) <= 0.05 AND abs(nm - tr) <= 0.05 AND tr <> tm THEN 'RATE_MRP_SWAP' END, CASE WHEN k = 5 THEN 'BATCH_EXPIRY_SWAP' END, CASE WHEN abs(na - tg) <= 0.05 AND NOT abs(na - ta) <= 0.05 THEN 'AMOUNT_GST_CONFUSION' END], lambda y: y IS NOT NULL) AS mixed FROM c),
e AS (SELECT *, len(list_filter(every, lambda y: y IN ('EXACT', 'NORMALIZED', 'TOLERANCE'))) AS n_good, len(list_filter(crit, lambda y: y NOT IN ('EXACT', 'NORMALIZED', 'TOLERANCE'))) AS n_bad,
 CASE WHEN abs(na - gr) <= greatest(0.2, 0.01 * greatest(abs(na), abs(gr))) OR abs(na - le) <= greatest(0.2, 0.01 * greatest(abs(na), abs(le))) OR abs(na - tx) <= greatest(0.2, 0.01 * greatest(abs(na), abs(tx))) THEN 'ACCOUNTING_CONSISTENT' ELSE 'ACCOUNTING_INCONSISTENT' END AS accounting FROM s)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with t_<field>, p_<field>, raw and is_extra."""
    df = line_items(spark, sf_dir).withColumn("k", F.col("line_no") % 7).withColumn("odd", F.col("part") % 2 == 1)
    text, k = (lambda c: F.col(c).cast("string")), F.col("k")
    q, f, r, m, a, g = (text(c) for c in ("quantity", "free", "rate", "mrp", "gross", "gst"))
    more = (F.col("gross") + F.lit("0.05").cast("decimal(3,2)")).cast("string")
    on = lambda p: F.date_format(F.add_months("shipped", 27 * 12), p)
    true = {"itemName": F.col("item"), "batchNo": F.col("batch"), "expiryDate": on("MM/yyyy"), "quantity": q, "freeQuantity": f, "rate": r, "mrp": m, "amount": a, "gstPercent": g, "discountPercent": text("discount")}
    got = {
        "itemName": F.when(k == 1, F.concat(F.lower("item"), F.lit(" "))).when(k == 2, F.concat("item", F.lit(" TAB"))).otherwise(F.col("item")),
        "batchNo": F.when(k == 5, on("MM/yyyy")).otherwise(F.col("batch")), "expiryDate": F.when(k == 5, F.col("batch")).when(F.col("odd"), on("MM-yy")).otherwise(on("MM/yyyy")),
        "quantity": F.when(k == 3, f).otherwise(q), "freeQuantity": F.when(k == 3, q).otherwise(f), "rate": F.when(k == 4, m).otherwise(r), "mrp": F.when(k == 4, r).otherwise(m),
        "amount": F.when(k == 6, g).when(F.col("odd"), more).otherwise(a), "gstPercent": F.when(k != 0, g), "discountPercent": text("discount"),
    }
    return df.select("invoice", "line_no", "part", *(true[c].alias(f"t_{c}") for c in FIELDS), *(got[c].alias(f"p_{c}") for c in FIELDS), F.lit(None).cast("string").alias("raw"), F.lit(False).alias("is_extra"))


_WITH = f"WITH {LINES}, {_PAIRS}"


@query(_WITH + " SELECT field, match, count(*) AS n FROM (SELECT unnest(['itemName', 'batchNo', 'expiryDate', 'quantity', 'freeQuantity', 'rate', 'mrp', 'amount', 'gstPercent', 'discountPercent']) AS field, unnest(every) AS match FROM e) GROUP BY ALL")
def typed_cell_comparison(spark, sf_dir):
    df = accuracy.evaluate_rows(pairs(spark, sf_dir), FIELDS)
    return accuracy.matches(df).groupBy("field", "match").agg(F.count("*").alias("n"))


@query(_WITH + " SELECT kind, count(*) AS n FROM (SELECT unnest(mixed) AS kind FROM e) GROUP BY kind")
def swap_detection(spark, sf_dir):
    df = accuracy.evaluate_rows(pairs(spark, sf_dir), FIELDS)
    return accuracy.mix_ups(df).groupBy("kind").agg(F.count("*").alias("n"))


@query(_WITH + ", r AS (SELECT *, CASE WHEN n_bad > 0 THEN 'CRITICAL_FIELD_ERROR' WHEN n_good = 10 THEN 'FULLY_CORRECT' ELSE 'PARTIALLY_CORRECT' END AS classification, CASE WHEN n_bad > 0 AND len(list_filter(mixed, lambda y: y LIKE '%\\_SWAP' ESCAPE '\\')) > 0 THEN 'SEMANTIC_MAPPING' WHEN n_bad > 0 THEN 'LOGICAL_SUBCOLUMN_SPLIT' WHEN n_good = 10 THEN NULL ELSE 'VALUE_NORMALIZATION' END AS root_cause FROM e) SELECT classification, root_cause, accounting, count(*) AS n, CAST(sum(n_good) AS BIGINT) AS n_correct FROM r GROUP BY ALL")
def row_evaluation(spark, sf_dir):
    df = accuracy.evaluate_rows(pairs(spark, sf_dir), FIELDS)
    return df.groupBy("classification", "root_cause", "accounting").agg(F.count("*").alias("n"), F.sum("n_correct").alias("n_correct"))


@query(_WITH + ", d AS (SELECT invoice AS doc, count(*) AS n_rows, 100.0 * sum(n_good) / sum(10) AS overall, 100.0 * sum(4 - n_bad) / sum(4) AS critical, 100.0 * sum(len(list_filter(fin, lambda y: y IN ('EXACT', 'NORMALIZED', 'TOLERANCE')))) / sum(5) AS financial, sum(CASE WHEN accounting = 'ACCOUNTING_CONSISTENT' THEN 1 ELSE 0 END) AS ok FROM e GROUP BY invoice), o AS (SELECT d.*, CASE o_orderstatus WHEN 'F' THEN 'AUTO_ACCEPT' WHEN 'O' THEN 'REVIEW_REQUIRED' ELSE 'UNRESOLVED' END AS decision, CAST(o_custkey % 101 AS DOUBLE) AS confidence FROM d JOIN orders ON doc = o_orderkey) SELECT doc, decision, confidence, n_rows, overall, critical, financial, CASE WHEN ok / n_rows >= 0.7 THEN 'ACCOUNTING_CONSISTENT' WHEN ok = 0 THEN 'ACCOUNTING_INCONSISTENT' ELSE 'AMBIGUOUS_ACCOUNTING' END AS accounting, CASE WHEN decision <> 'AUTO_ACCEPT' THEN 'INSUFFICIENT_GROUND_TRUTH' WHEN confidence >= 90 AND critical >= 95 AND financial >= 85 THEN 'AUTO_ACCEPT_SAFE' ELSE 'AUTO_ACCEPT_UNSAFE' END AS safety FROM o")
def document_field_accuracy(spark, sf_dir):
    df = accuracy.evaluate_rows(pairs(spark, sf_dir), FIELDS).withColumnRenamed("invoice", "doc")
    return accuracy.document_accuracy(df.join(documents(spark, sf_dir).select("doc", "decision", "confidence"), "doc"))


@query(_WITH + """, rr AS (SELECT *, CASE WHEN n_bad > 0 THEN 'CRITICAL_FIELD_ERROR' WHEN n_good = 10 THEN 'FULLY_CORRECT' ELSE 'PARTIALLY_CORRECT' END AS class, CASE o_orderstatus WHEN 'F' THEN 'AUTO_ACCEPT' WHEN 'O' THEN 'REVIEW_REQUIRED' ELSE 'UNRESOLVED' END AS decision, o_custkey % 101 AS confidence FROM e JOIN orders ON invoice = o_orderkey),
told AS (SELECT unnest(['Rows', 'Rows', 'Rows', 'Rows', 'Rows', 'Rows', 'Cells', 'Cells', 'Cells', 'Accounting', 'Documents', 'Documents', 'Documents', 'Documents', 'Documents', 'Documents']) AS section, unnest(['rows', 'fully_correct', 'partially_correct', 'critical_field_error', 'extra_row', 'mixed_up', 'overall', 'critical', 'financial', 'consistent', 'documents', 'auto_accept', 'review_required', 'unresolved', 'failed', 'least_confidence']) AS label, unnest(range(1, 17)) AS line_no,
unnest([count(*)::DOUBLE, count(*) FILTER (class = 'FULLY_CORRECT'), count(*) FILTER (class = 'PARTIALLY_CORRECT'), count(*) FILTER (class = 'CRITICAL_FIELD_ERROR'), 0, count(*) FILTER (len(mixed) > 0), 100.0 * sum(n_good) / (10 * count(*)), 100.0 * sum(4 - n_bad) / (4 * count(*)), 100.0 * sum(len(list_filter(fin, lambda y: y IN ('EXACT', 'NORMALIZED', 'TOLERANCE')))) / (5 * count(*)), 100.0 * count(*) FILTER (accounting = 'ACCOUNTING_CONSISTENT') / count(*), count(DISTINCT invoice), count(DISTINCT invoice) FILTER (decision = 'AUTO_ACCEPT'), count(DISTINCT invoice) FILTER (decision = 'REVIEW_REQUIRED'), count(DISTINCT invoice) FILTER (decision = 'UNRESOLVED'), 0, min(confidence)]) AS value FROM rr)
SELECT section, CAST(line_no AS INTEGER) AS line_no, label, value FROM told""")
def evaluation_run(spark, sf_dir):
    """The whole evaluation: rows, cells, accounting and documents."""
    df = accuracy.evaluate_rows(pairs(spark, sf_dir), FIELDS).withColumnRenamed("invoice", "doc")
    return accuracy.run_evaluation(df.join(documents(spark, sf_dir).select("doc", "decision", "confidence"), "doc"))


@query(_WITH + """, t AS (SELECT row_number() OVER () AS id, k, every[4:5] AS x, q, p_q, r, p_r, item, p_item FROM e), u AS (SELECT unnest(['quantity', 'rate', 'itemName']) AS field, unnest([q, r, item]) AS t, unnest([CASE WHEN k <> 1 THEN p_q END, p_r, p_item]) AS p FROM t),
w AS (SELECT *, p = t AS exact, upper(trim(p)) = upper(trim(t)) AS norm, CASE field WHEN 'quantity' THEN abs(try_cast(p AS DOUBLE) - try_cast(t AS DOUBLE)) <= 0.01 WHEN 'rate' THEN abs(try_cast(p AS DOUBLE) - try_cast(t AS DOUBLE)) <= greatest(0.05, abs(try_cast(t AS DOUBLE)) * 0.005) ELSE false END AS near FROM u),
m AS (SELECT field, count(*) FILTER (exact) AS exact, count(*) FILTER (norm) AS normalized, count(*) FILTER (norm OR near) AS tolerance, count(*) FILTER (p IS NOT NULL AND NOT (norm OR near)) AS incorrect, count(*) FILTER (p IS NULL) AS missing, 0 AS unexpected FROM w GROUP BY field),
f AS (SELECT *, CASE WHEN field = 'itemName' THEN normalized ELSE tolerance END AS tp FROM m), g AS (SELECT *, tp / (tp + incorrect) AS precision, tp / (tp + missing) AS recall FROM f) SELECT field, exact, normalized, tolerance, incorrect, missing, unexpected, precision, recall, 2 * precision * recall / (precision + recall) AS f1 FROM g""")
def positional_field_metrics(spark, sf_dir):
    df = pairs(spark, sf_dir).withColumn("k", F.col("line_no") % 7).withColumn("row_no", F.xxhash64("line_no", "part", *[f"t_{c}" for c in FIELDS]))
    names = ["quantity", "rate", "itemName"]
    side = lambda x: F.struct(*(F.col(f"{x}_{f}").alias(f) for f in names))
    # rows are numbered once for both sides: each reads the same lines
    df = df.groupBy("invoice", "row_no").agg(F.first(F.struct(F.col("k"), side("p").alias("p"), side("t").alias("t"))).alias("line"), F.count("*").alias("n"))
    df = df.select(F.col("invoice").alias("doc"), "row_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"), "line").withColumn("row_no", F.xxhash64("row_no", "copy"))
    told = df.select("doc", "row_no", F.when(F.col("line.k") != 1, F.col("line.p.quantity")).alias("quantity"), "line.p.rate", "line.p.itemName")
    return accuracy.positional_rows(told, df.select("doc", "row_no", "line.t.*"), names)


@query("SELECT supplier AS doc, CAST(sum(n) AS BIGINT) AS duplicate_rows FROM (SELECT supplier, upper(item) AS i, upper(batch) AS b, rate, count(*) - 1 AS n FROM lines GROUP BY ALL) GROUP BY supplier")
def duplicate_row_count(spark, sf_dir):
    return accuracy.duplicate_rows(line_items(spark, sf_dir).select(F.col("supplier").alias("doc"), "item", "batch", "rate"))


_EXPECTED = [("Qty.", "quantity"), ("M R P", "mrp"), ("Batch No", "batchNo"), ("AMOUNT GST", "amount"), ("S.No", None), ("Rack", None), ("Rate", "rate"), ("Net Amount", "netAmount")]
_PREDICTED = [("qty", "quantity"), ("M R P", None), ("BATCHNO", "batchNo"), ("Amount", "amount"), ("S.No", "pack"), ("Rack", "company"), ("Rate", "mrp"), ("Net", "netAmount")]


def _values(rows):
    q = lambda v: "NULL" if v is None else f"'{v}'"
    return ", ".join(f"({k}, {q(h)}, {q(f)})" for k, (h, f) in enumerate(rows))


@query(f"""WITH x AS (SELECT * FROM (VALUES {_values(_EXPECTED)}) t(pos, header, field)), p AS (SELECT * FROM (VALUES {_values(_PREDICTED)}) t(p_pos, p_header, p_field)), o AS (SELECT o_orderkey AS doc, o_custkey % 8 AS lost FROM orders),
j AS (SELECT doc, pos, header, field, p_pos, p_field, upper(regexp_replace(header, '[^A-Za-z0-9]', '', 'g')) AS a, upper(regexp_replace(p_header, '[^A-Za-z0-9]', '', 'g')) AS b, p_header FROM o CROSS JOIN x LEFT JOIN p ON p_pos <> lost),
t AS (SELECT *, CASE WHEN p_field IS NULL THEN NULL WHEN header = p_header THEN 0 WHEN a = b THEN 1 WHEN b <> '' AND (starts_with(a, b) OR starts_with(b, a)) THEN 2 END AS tier FROM j), k AS (SELECT *, row_number() OVER (PARTITION BY doc, pos ORDER BY tier NULLS LAST, p_pos) AS k FROM t),
r AS (SELECT header, field AS expected, CASE WHEN tier IS NOT NULL THEN p_field END AS predicted FROM k WHERE k = 1) SELECT header, expected, predicted, CASE WHEN predicted IS NOT DISTINCT FROM expected THEN NULL WHEN starts_with(upper(header), 'S.') THEN 'AUXILIARY_COLUMN' WHEN expected IS NULL THEN 'UNMAPPED_NON_CANONICAL_COLUMN' WHEN header = 'M R P' THEN 'HEADER_RECONSTRUCTION' WHEN header = 'AMOUNT GST' THEN 'LOGICAL_SUBCOLUMN_SPLIT' WHEN predicted IS NOT NULL THEN 'SEMANTIC_MAPPING' ELSE 'TRUE_COLUMN_BOUNDARY_ERROR' END AS root_cause, count(*) AS n FROM r GROUP BY ALL""")
def mapping_root_causes(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_custkey") % 8).alias("lost"))
    spec = lambda rows: F.array(*(F.struct(F.lit(k).cast("long").alias("pos"), F.lit(h).alias("header"), F.lit(f).cast("string").alias("field")) for k, (h, f) in enumerate(rows)))
    predicted = docs.select("doc", F.filter(spec(_PREDICTED), lambda c: c["pos"] != F.col("lost")).alias("columns"))
    got = accuracy.compare_columns(predicted, docs.select("doc", spec(_EXPECTED).alias("columns")))
    return got.groupBy("header", "expected", "predicted", "root_cause").agg(F.count("*").alias("n"))


# ---- documents

_DOCS = """WITH d AS (SELECT o_orderkey AS doc, CASE o_orderstatus WHEN 'F' THEN 'AUTO_ACCEPT' WHEN 'O' THEN 'REVIEW_REQUIRED' ELSE 'UNRESOLVED' END AS decision, CAST(o_custkey % 101 AS DOUBLE) AS confidence, o_custkey % 5 <> 0 AS verified, o_custkey % 3 AS field_errors, o_custkey % 4 AS row_errors,
 list_filter([CASE WHEN o_custkey % 3 > 0 THEN 'rate' END, CASE WHEN o_custkey % 3 = 2 THEN 'mrp' END, CASE WHEN o_orderkey % 7 = 0 THEN 'quantity' END], lambda x: x IS NOT NULL) AS notes, o_orderpriority AS cause, 'S' || CAST(o_custkey % 20 AS VARCHAR) AS supplier, CASE WHEN o_custkey % 6 > 0 THEN 'G' || CAST(o_custkey % 25 AS VARCHAR) END AS gstin, CASE WHEN o_custkey % 9 > 0 THEN 'L' || CAST(o_custkey % 40 AS VARCHAR) END AS layout,
 o_orderkey % 10 = 0 AS is_duplicate, o_orderkey % 13 AS n_rows, o_custkey % 8 AS seconds FROM orders) """


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions and notes on each document."""
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    decision = F.when(F.col("o_orderstatus") == "F", "AUTO_ACCEPT").when(F.col("o_orderstatus") == "O", "REVIEW_REQUIRED").otherwise("UNRESOLVED")
    notes = F.array_compact(F.array(F.when(c % 3 > 0, "rate"), F.when(c % 3 == 2, "mrp"), F.when(o % 7 == 0, "quantity")))
    name = lambda p, k: F.concat(F.lit(p), (c % k).cast("string"))
    return table(spark, sf_dir, "orders").select(
        o.alias("doc"), decision.alias("decision"), (c % 101).cast("double").alias("confidence"), (c % 5 != 0).alias("verified"), (c % 3).alias("field_errors"), (c % 4).alias("row_errors"), notes.alias("notes"), F.col("o_orderpriority").alias("cause"),
        name("S", 20).alias("supplier"), F.when(c % 6 > 0, name("G", 25)).alias("gstin"), F.when(c % 9 > 0, name("L", 40)).alias("layout"), (o % 10 == 0).alias("is_duplicate"), (o % 13).alias("n_rows"), (c % 8).alias("seconds"),
    )


@query(_DOCS + "SELECT count(*) AS n_auto, count(*) FILTER (verified) AS n_verified, count(*) FILTER (verified AND field_errors = 0 AND row_errors = 0) AS n_correct, count(*) FILTER (verified AND field_errors > 0) AS n_field_errors, count(*) FILTER (verified AND row_errors > 0) AS n_row_errors, round(count(*) FILTER (verified AND field_errors = 0 AND row_errors = 0) / count(*) FILTER (verified), 4) AS precision, round((count(*) FILTER (verified) - count(*) FILTER (verified AND field_errors = 0 AND row_errors = 0)) / count(*) FILTER (verified), 4) AS error_rate FROM d WHERE decision = 'AUTO_ACCEPT'")
def auto_accept_safety(spark, sf_dir):
    return accuracy.auto_accept_safety(documents(spark, sf_dir))


@query(_DOCS + "SELECT entry, count(*) AS n FROM (SELECT unnest(notes) AS entry FROM d WHERE decision = 'REVIEW_REQUIRED') GROUP BY entry")
def review_triggers(spark, sf_dir):
    return accuracy.ranked(documents(spark, sf_dir).where("decision = 'REVIEW_REQUIRED'"), "notes")


@query(_DOCS + "SELECT cause AS entry, count(*) AS n FROM d WHERE decision = 'UNRESOLVED' GROUP BY cause")
def unresolved_causes(spark, sf_dir):
    return accuracy.ranked(documents(spark, sf_dir).where("decision = 'UNRESOLVED'").withColumn("causes", F.array("cause")), "causes")


@query("WITH c AS (SELECT CASE l_linenumber % 4 WHEN 0 THEN 'rate' WHEN 1 THEN 'mrp' WHEN 2 THEN '' ELSE 'quantity' END AS o, CASE l_partkey % 3 WHEN 0 THEN 'mrp' WHEN 1 THEN 'rate' ELSE 'amount' END AS x FROM lineitem) SELECT o || ' -> ' || x AS pattern, count(*) AS n FROM c WHERE o <> '' AND o <> x GROUP BY ALL")
def correction_patterns(spark, sf_dir):
    n, p = F.col("l_linenumber") % 4, F.col("l_partkey") % 3
    made = table(spark, sf_dir, "lineitem").select(F.when(n == 0, "rate").when(n == 1, "mrp").when(n == 2, "").otherwise("quantity").alias("original"), F.when(p == 0, "mrp").when(p == 1, "rate").otherwise("amount").alias("corrected"))
    return accuracy.correction_patterns(made)


@query(_DOCS + ", p AS (SELECT DISTINCT coalesce(supplier, gstin) AS who, coalesce(layout, 'default_layout') AS l FROM d) SELECT count(DISTINCT supplier) AS suppliers, count(DISTINCT gstin) AS gstins, count(DISTINCT coalesce(layout, 'default_layout')) AS layouts, (SELECT count(*) / count(DISTINCT who) FROM p) AS layouts_per_supplier FROM d")
def layout_diversity(spark, sf_dir):
    return accuracy.layout_diversity(documents(spark, sf_dir))


@query(_DOCS + "SELECT supplier, gstin, cause AS category, count(*) AS n, round(avg(CASE WHEN decision = 'AUTO_ACCEPT' THEN 1 ELSE 0 END) * 100, 1) AS auto_pct, round(avg(CASE WHEN decision = 'REVIEW_REQUIRED' THEN 1 ELSE 0 END) * 100, 1) AS review_pct, round(avg(confidence), 2) AS mean_confidence, min(confidence) AS least_confidence FROM d GROUP BY ALL")
def supplier_report(spark, sf_dir):
    return accuracy.supplier_report(documents(spark, sf_dir).withColumnRenamed("cause", "category"))


@query(_DOCS + ", c AS (SELECT CASE doc % 5 WHEN 0 THEN 'SEMANTIC_MAPPING' WHEN 1 THEN 'ROW_RECONSTRUCTION' WHEN 2 THEN 'LOGICAL_SUBCOLUMN_SPLIT' WHEN 3 THEN 'HEADER_RECONSTRUCTION' ELSE 'OTHER' END AS root_cause FROM d), g AS (SELECT root_cause, count(*) AS n FROM c GROUP BY ALL), p AS (SELECT *, round(n * 100 / sum(n) OVER (), 1) AS pct FROM g) SELECT row_number() OVER (ORDER BY n DESC, root_cause) AS priority, CASE root_cause WHEN 'LOGICAL_SUBCOLUMN_SPLIT' THEN 'Logical Sub-Column Splitting' WHEN 'HEADER_RECONSTRUCTION' THEN 'Header Reconstruction & Word Joining' WHEN 'SEMANTIC_MAPPING' THEN 'Semantic Column Inference & Disambiguation' ELSE 'Row Line Aggregation & Continuation Handling' END AS area, root_cause, n, pct FROM p WHERE root_cause <> 'OTHER'")
def recommendations(spark, sf_dir):
    k = F.col("doc") % 5
    cause = F.when(k == 0, "SEMANTIC_MAPPING").when(k == 1, "ROW_RECONSTRUCTION").when(k == 2, "LOGICAL_SUBCOLUMN_SPLIT").when(k == 3, "HEADER_RECONSTRUCTION").otherwise("OTHER")
    return accuracy.recommendations(documents(spark, sf_dir).groupBy(cause.alias("root_cause")).agg(F.count("*").alias("n")))


@query(_DOCS + "SELECT count(*) AS documents, count(*) FILTER (decision = 'AUTO_ACCEPT') AS auto_accept, count(*) FILTER (decision = 'REVIEW_REQUIRED') AS review_required, count(*) FILTER (decision = 'UNRESOLVED') AS unresolved, count(*) FILTER (decision = 'FAILED') AS failed, count(*) FILTER (is_duplicate) AS duplicates, CAST(sum(n_rows) AS BIGINT) AS n_rows, sum(seconds) / greatest(count(*), 1) AS seconds_per_document FROM d")
def batch_kpis(spark, sf_dir):
    return accuracy.batch_kpis(documents(spark, sf_dir))


@query("WITH c AS (SELECT o_orderpriority AS field, CASE o_custkey % 4 WHEN 0 THEN 'KNOWN' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'NOT_PRESENT' ELSE 'AMBIGUOUS' END AS state FROM orders) SELECT field, count(*) FILTER (state = 'KNOWN') AS known, count(*) FILTER (state = 'UNKNOWN') AS unknown, count(*) FILTER (state = 'NOT_PRESENT') AS not_present, count(*) FILTER (state = 'AMBIGUOUS') AS ambiguous FROM c GROUP BY field")
def presence_matrix(spark, sf_dir):
    k = F.col("o_custkey") % 4
    cells = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("field"), F.when(k == 0, "KNOWN").when(k == 1, "UNKNOWN").when(k == 2, "NOT_PRESENT").otherwise("AMBIGUOUS").alias("state"))
    return accuracy.presence_matrix(cells, ["KNOWN", "UNKNOWN", "NOT_PRESENT", "AMBIGUOUS"])


@query("SELECT field, count(*) AS n, round(avg(CASE WHEN trim(coalesce(value, '')) <> '' THEN 1 ELSE 0 END) * 100, 2) AS populated_pct FROM (SELECT unnest(['itemName', 'quantity', 'rate']) AS field, unnest([CASE WHEN part % 4 = 0 THEN ' ' ELSE item END, CASE WHEN line_no % 3 > 0 THEN CAST(quantity AS VARCHAR) END, CAST(rate AS VARCHAR)]) AS value FROM lines) GROUP BY field")
def critical_field_population(spark, sf_dir):
    cell = F.array(*(F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in (("itemName", F.when(F.col("part") % 4 == 0, " ").otherwise(F.col("item"))), ("quantity", F.when(F.col("line_no") % 3 > 0, F.col("quantity").cast("string"))), ("rate", F.col("rate").cast("string")))))
    return accuracy.population(line_items(spark, sf_dir).select(F.col("invoice").alias("doc"), F.explode(cell).alias("c")).select("doc", "c.*"))


_FLAGS = "WITH h AS (SELECT o_orderkey AS doc, CASE o_custkey % 4 WHEN 0 THEN ['PACK QTY FREE', 'MRP', 'Unnamed_Col_2'] WHEN 1 THEN ['PT', 'R', 'AMOUNT GST'] WHEN 2 THEN ['Item', 'Rate'] ELSE ['MRP RATE', 'Qty'] END AS headers, o_custkey % 3 > 0 AS m, o_custkey % 5 > 0 AS r, o_custkey % 7 > 0 AS s, true AS g, o_custkey % 6 AS n FROM orders) "


@query(_FLAGS + ", j AS (SELECT *, upper(array_to_string(headers, ' ')) AS t FROM h), f AS (SELECT array_to_string(list_sort(list_filter([CASE WHEN list_has_any(headers, ['PT', 'R']) THEN 'split_headers' END, CASE WHEN contains(t, 'UNNAMED') THEN 'unnamed_columns' END, CASE WHEN regexp_matches(t, '\\b(PACK\\s+QTY|QTY\\s+FREE|AMOUNT\\s+GST|MRP\\s+RATE)\\b') THEN 'multiple_logical_values_in_cell' END, CASE WHEN contains(t, 'QTY FREE') THEN 'quantity_free_merged' END, CASE WHEN contains(t, 'AMOUNT GST') THEN 'amount_gst_merged' END, CASE WHEN NOT m THEN 'missing_mrp' END, CASE WHEN NOT r THEN 'missing_rate' END, CASE WHEN NOT s THEN 'missing_hsn' END, CASE WHEN n > 2 THEN 'multiline_product_names' END], lambda x: x IS NOT NULL)), ',') AS flags FROM j) SELECT flags, count(*) AS n FROM f GROUP BY flags")
def difficult_layout_flags(spark, sf_dir):
    c = F.col("o_custkey")
    heads = F.when(c % 4 == 0, F.array(*map(F.lit, ("PACK QTY FREE", "MRP", "Unnamed_Col_2")))).when(c % 4 == 1, F.array(*map(F.lit, ("PT", "R", "AMOUNT GST")))).when(c % 4 == 2, F.array(*map(F.lit, ("Item", "Rate")))).otherwise(F.array(*map(F.lit, ("MRP RATE", "Qty"))))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), heads.alias("headers"), (c % 3 > 0).alias("has_mrp"), (c % 5 > 0).alias("has_rate"), (c % 7 > 0).alias("has_hsn"), F.lit(True).alias("has_gst"), (c % 6).alias("n_long_names"))
    return accuracy.difficult_layout(docs).groupBy(F.array_join("flags", ",").alias("flags")).agg(F.count("*").alias("n"))


@query(r"""WITH r AS (SELECT l_linenumber % 6 AS k, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q, CAST(l_shipdate AS DATE) + INTERVAL 27 YEAR AS s FROM lineitem), x AS (SELECT CASE k WHEN 0 THEN '-' || q || '.50' WHEN 1 THEN q || '.00%' WHEN 2 THEN '0' WHEN 3 THEN 'Rs ' || q ELSE q END AS raw, CASE k WHEN 0 THEN strftime(s, '%m/%y') WHEN 1 THEN upper(strftime(s, '%b-%y')) WHEN 2 THEN 'no date' ELSE strftime(s, '%m-%Y') END AS day, strftime(s, '%d-%m-%Y') AS bill, k, strftime(s, '%Y-%m') AS ym FROM r)
SELECT raw, day, bill, CAST(CASE WHEN raw = '0' THEN 0 WHEN k = 1 THEN round(1000 * CAST(replace(raw, '%', '') AS DECIMAL(18,4)) / 100, 2) ELSE abs(CAST(regexp_replace(raw, '[^0-9.-]', '', 'g') AS DECIMAL(18,4))) END AS DOUBLE) AS off, CASE WHEN k = 2 THEN 'NO DATE' ELSE ym END AS month, CASE k WHEN 1 THEN day WHEN 2 THEN 'NODATE' ELSE strftime(strptime('01/' || ym, '%d/%Y-%m'), '%m/%y') END AS short, bill[7:10] || bill[4:5] || bill[1:2] AS voucher, abs(CAST(regexp_extract(raw, '[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)') AS DOUBLE)) AS percent, count(*) AS n FROM x GROUP BY ALL""")
def stated_values(spark, sf_dir):
    """Discounts, expiry months, voucher dates and percentages as printed, read."""
    k, q = F.col("l_linenumber") % 6, F.col("l_quantity").cast("int").cast("string")
    on = lambda p: F.date_format(F.add_months(F.col("l_shipdate").cast("date"), 27 * 12), p)
    raw = F.when(k == 0, F.concat(F.lit("-"), q, F.lit(".50"))).when(k == 1, F.concat(q, F.lit(".00%"))).when(k == 2, "0").when(k == 3, F.concat(F.lit("Rs "), q)).otherwise(q)
    day = F.when(k == 0, on("MM/yy")).when(k == 1, F.upper(on("MMM-yy"))).when(k == 2, "no date").otherwise(on("MM-yyyy"))
    df = table(spark, sf_dir, "lineitem").select(raw.alias("raw"), day.alias("day"), on("dd-MM-yyyy").alias("bill")).groupBy("raw", "day", "bill").agg(F.count("*").alias("n"))
    c = F.col
    return df.select("raw", "day", "bill", compare.stated_discount(c("raw"), F.lit(1000).cast("decimal(18,2)")).cast("double").alias("off"), compare.month_of_expiry(c("day")).alias("month"), compare.normal_date(c("day")).alias("short"), compare.voucher_date(c("bill")).alias("voucher"), compare.signless_percent(c("raw")).alias("percent"), "n")
