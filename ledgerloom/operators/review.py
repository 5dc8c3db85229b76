"""Human review of mappings, and mix-ups of whole columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import expiry
from ..functions.fixed import GST_RATES
from ..functions.quantities import mostly_number
from ..functions.text import identity_status


def sessions(documents: DataFrame, columns: DataFrame) -> DataFrame:
    """documents: doc, supplier_name, gstin, name_confidence, decision, confidence; columns: doc, header, field, status
    -> a session for each document that waits for review, with its unresolved headers."""
    open_ = (F.col("field").isNull()) | F.col("status").isin("unresolved", "ambiguous")
    left = columns.groupBy("doc").agg(F.array_sort(F.collect_list(F.when(open_, F.col("header")))).alias("unresolved"), F.count("*").alias("n_headers"))
    safe = identity_status(F.col("supplier_name"), F.col("gstin"), F.col("name_confidence"))
    made = documents.join(left, "doc", "left").withColumn("identity", safe)
    return made.select(F.sha2(F.col("doc").cast("string"), 256).substr(1, 12).alias("review_id"), "doc", "identity", "decision", "confidence", F.coalesce("unresolved", F.array().cast("array<string>")).alias("unresolved"), F.coalesce("n_headers", F.lit(0)).alias("n_headers"), F.lit("PENDING_REVIEW").alias("review_status"))


def corrections(columns: DataFrame, proposed: DataFrame) -> DataFrame:
    """columns and proposed: doc, header, field -> the headers whose field a person changed: doc, header, old_field,
    new_field, status. A header that nobody proposes a field for loses its own."""
    # Spark takes a distinct key of many documents for small, and would send it through the driver
    asked = proposed.select("doc").distinct()
    p = proposed.select("doc", "header", F.col("field").alias("new_field"))
    met = columns.join(asked.hint("merge"), "doc", "left_semi").join(p.hint("merge"), ["doc", "header"], "left").where(~F.col("field").eqNullSafe(F.col("new_field")))
    return met.select("doc", "header", F.col("field").alias("old_field"), "new_field", F.when(F.col("new_field").isNotNull(), "user_confirmed").otherwise("unresolved").alias("status"))


def outcomes(sessions_: DataFrame, proposed: DataFrame, checks: DataFrame) -> DataFrame:
    """checks: doc, critical_mismatches, contradictions after the correction -> with status and review_status:
    rejected with a field twice, without the mandatory fields, or with contradictions in over half the
    headers (and over one); with warnings where any mismatch or contradiction is left."""
    fields = proposed.where("field is not null").groupBy("doc").agg(F.collect_set("field").alias("set"), F.count("*").alias("n"))
    df = sessions_.join(fields, "doc").join(checks, "doc", "left")
    twice = F.size("set") < F.col("n")
    mandatory = F.array_contains("set", "itemName") & (F.array_contains("set", "quantity") | F.array_contains("set", "amount"))
    contrary, mismatches = F.coalesce("contradictions", F.lit(0)), F.coalesce("critical_mismatches", F.lit(0))
    rejected = twice | ~mandatory | (contrary > F.greatest(F.lit(1.0), F.col("n_headers") * 0.5))
    warned = (mismatches > 0) | (contrary > 0)
    status = F.when(rejected, "CORRECTION_REJECTED").when(warned, "CORRECTION_HAS_WARNINGS").otherwise("CORRECTION_VALIDATED")
    review = F.when(rejected, "REVIEW_NOT_CONFIRMED").when(warned, "REVIEW_CONFIRMED_WITH_WARNINGS").otherwise("REVIEW_CONFIRMED")
    error = F.when(twice, "DUPLICATE_FIELD_ASSIGNMENT")
    kept = [c for c in sessions_.columns if c not in ("status", "review_status", "error_type")]
    return df.select(*kept, status.alias("status"), review.alias("review_status"), error.alias("error_type"))


def committable(reviewed: DataFrame) -> DataFrame:
    """Adds committed and reason: only confirmed reviews of suppliers that are surely known enter layout memory."""
    unsafe = F.col("identity").isin("SUPPLIER_IDENTITY_REVIEW_REQUIRED", "NO_IDENTITY")
    confirmed = F.col("review_status").isin("REVIEW_CONFIRMED", "REVIEW_CONFIRMED_WITH_WARNINGS")
    reason = F.when(unsafe, "UNSAFE_IDENTITY").when(~confirmed, "NOT_CONFIRMED")
    return reviewed.withColumn("reason", reason).withColumn("committed", reason.isNull())


def column_swaps(rows: DataFrame) -> DataFrame:
    """doc and text columns rate, mrp, quantity, freeQuantity, amount, gstPercent, batchNo, expiryDate, hsnCode ->
    doc, swaps: the pairs of columns that hold each other's values."""
    money = ["rate", "mrp", "quantity", "freeQuantity", "amount", "gstPercent"]
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    # each text is read once, in a projection of its own: its number, or whether it is a date
    told = lambda c: F.coalesce(text(c).rlike(r"\d{1,2}[/-]\d{2,4}") | expiry(text(c)).isNotNull(), F.lit(False))
    rows = rows.select("doc", *(mostly_number(F.col(c)).alias(c) for c in money), *(told(c).alias(f"__dated_{c}") for c in ("batchNo", "expiryDate", "hsnCode")), *(text(c).alias(c) for c in ("batchNo", "expiryDate", "hsnCode")))
    n, dated, has = F.col, (lambda c: F.col(f"__dated_{c}")), (lambda c: F.col(c).isNotNull())
    share = lambda test, of: F.coalesce(F.try_divide(F.sum((test & of).cast("int")), F.sum(of.cast("int"))), F.lit(0.0))
    priced = F.coalesce((n("rate") > 0) & (n("mrp") > 0), F.lit(False))
    tests: dict[str, Column] = {
        "rate <-> mrp": share(F.coalesce(n("rate") > n("mrp") * 1.05, F.lit(False)), priced) >= 0.8,
        "quantity <-> freeQuantity": (F.count_if(F.coalesce(n("quantity") > 0, F.lit(False))) == 0) & (F.count_if(F.coalesce(n("freeQuantity") > 0, F.lit(False))) > 0),
        "amount <-> gstPercent": (share(F.coalesce(n("amount").isin(*GST_RATES), F.lit(False)), n("amount").isNotNull()) >= 0.9) & (F.max(n("amount")) <= 28) & (F.max(n("gstPercent")) > 50),
        "batchNo <-> expiryDate": (share(dated("batchNo"), has("batchNo")) >= 0.8) & (share(dated("expiryDate"), has("expiryDate")) <= 0.2),
        "expiryDate <-> hsnCode": (share(F.coalesce(F.col("expiryDate").rlike(r"^(30|21|38|90)(\d{2}|\d{4}|\d{6})$"), F.lit(False)), has("expiryDate")) >= 0.8) & (share(dated("hsnCode"), has("hsnCode")) >= 0.8),
    }
    return rows.groupBy("doc").agg(F.array_compact(F.array(*(F.when(test, name) for name, test in tests.items()))).alias("swaps"))
