"""How far a document's columns can be trusted, and whether it is accepted, reviewed or left unresolved.

Columns are doc, col_no, header, field, status; cells are doc, row_no, col_no, value. A null or empty
value is a missing one; a column without cells has quality zero; a document without columns or rows is
still decided (UNRESOLVED)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import expiry
from ..functions.fixed import FORM_ONLY, HSN_STARTS
from ..functions.quantities import number, scheme

MONEY = ["rate", "mrp", "amount", "taxableAmount", "netAmount"]
AUTO, REVIEW = 80.0, 55.0


def _valid(field: Column, v: Column) -> tuple[Column, Column]:
    """Whether a value fits its field, and whether it is odd (neither means that it contradicts)."""
    n, s = number(v), scheme(v)
    digits = F.regexp_replace(v, r"\D", "")
    code = digits.rlike(r"^\d{4,8}$")
    good_code = code & F.substring(digits, 1, 2).isin(*HSN_STARTS, "98")
    ok = (
        F.when(field == "quantity", (s["billed"] > 0) | (n >= 0))
        .when(field == "freeQuantity", (s["free"] > 0) | (n >= 0))
        .when(field.isin(*MONEY), n >= 0)
        .when(field == "discountPercent", n.between(-100, 100))
        .when(field.isin("gstPercent", "cgstPercent", "sgstPercent"), n.between(0, 35))
        .when(field == "expiryDate", expiry(F.regexp_replace(v, r"\s+", "")).isNotNull() | v.rlike(r"\d{1,2}\s*[-/.]\s*\d{1,4}"))
        .when(field == "hsnCode", good_code)
        .when(field == "batchNo", (F.length(v) >= 2) & ~v.rlike(r"^\d{1,2}[/-]\d{2,4}$"))
        .when(field == "itemName", (F.length(v) >= 2) & ~v.rlike(r"^\d+(\.\d+)?$"))
        .otherwise(True)
    )
    odd = F.when(field == "quantity", n > 50000).when(field == "freeQuantity", n > 5000).when(field.isin("rate", "mrp"), n == 0).when(field == "hsnCode", code & ~good_code)
    return F.coalesce(ok, F.lit(False)), F.coalesce(odd, F.lit(False))


def field_quality(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """One row for each mapped column: shares present and valid, contradictions, odd values, quality from 0 to 1."""
    v = F.trim("value")
    mapped = columns.where("field is not null").select("doc", "col_no", "field")
    df = cells.select("doc", "col_no", F.when(v != "", v).alias("v")).join(mapped, ["doc", "col_no"], "right")
    ok, odd = _valid(F.col("field"), F.col("v"))
    has = F.col("v").isNotNull()
    malformed = F.col("field").isin("quantity", "freeQuantity") & F.col("v").contains("+") & ~scheme(F.col("v"))["is_compound"]
    form = (F.col("field") == "itemName") & F.col("v").rlike(FORM_ONLY) & (F.length(F.regexp_replace("v", "[^A-Za-z]", "")) <= 12)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    got = df.groupBy("doc", "col_no", "field").agg(
        F.count("*").alias("n"), F.count("v").alias("n_present"), count(has & ok).alias("n_valid"), count(has & ~ok & ~((F.col("field") == "hsnCode") & odd)).alias("contradictions"), count(has & odd).alias("odd"), count(malformed).alias("malformed_schemes"), count(form).alias("form_only"),
    )
    present, valid = F.col("n_present") / F.greatest("n", F.lit(1)), F.col("n_valid") / F.greatest("n_present", F.lit(1))
    quality = F.least(F.lit(1.0), F.greatest(F.lit(0.0), valid * 0.6 + present * 0.4 - F.col("contradictions") * 0.1))
    return got.withColumns({"present": F.round(present, 3), "valid": F.round(valid, 3), "quality": F.when(F.col("n_present") > 0, F.round(quality, 3)).otherwise(0.0)})


def duplicate_fields(columns: DataFrame) -> DataFrame:
    """Fields that more than one column of a document claims, with the claiming headers in column order."""
    heads = F.transform(F.array_sort(F.collect_list(F.struct("col_no", "header"))), lambda x: x["header"])
    return columns.where("field is not null").groupBy("doc", "field").agg(F.count("*").alias("n"), heads.alias("headers")).where("n > 1")


def decide(documents: DataFrame, columns: DataFrame, quality: DataFrame) -> DataFrame:
    """Documents with confidence (0 to 100), blockers and decision.

    documents: doc, n_rows, n_logical (columns after splitting; null: not known), health (0 to 1, null: 1),
    critical_mismatches, similarity (to a known layout; null: 0.9), drift (incompatible_layout blocks),
    identity_safe (null: nothing to attach), ambiguous_subcolumns. Repeated claims of auxiliary fields
    block too, unless one header names a second price or pack (old, box, outer, PTR)."""
    spare = F.upper("header").rlike("OLD|PREV|BOX|OUTER|PTR|PUR")
    claims = columns.where("field is not null").groupBy("doc", "field").agg(F.count("*").alias("k"), F.max(spare).alias("spare"))
    repeats = claims.where((F.col("k") > 1) & (F.col("field").isin("itemName", "quantity", "amount") | ~F.coalesce("spare", F.lit(False)))).groupBy("doc").agg(F.array_sort(F.collect_list("field")).alias("repeated"))
    is_field = lambda f: F.max(F.coalesce(F.col("field").isin(f), F.lit(False)))
    cols = columns.groupBy("doc").agg(F.count("*").alias("n_columns"), F.count("field").alias("n_mapped"), F.count_if((F.col("status") == "known_header") & F.col("field").isNotNull()).alias("n_known"), F.count_if(F.col("status") == "ambiguous").alias("n_ambiguous"), is_field("itemName").alias("has_item"), F.greatest(is_field("quantity"), is_field("amount")).alias("has_value"))
    values = quality.groupBy("doc").agg(F.avg("quality").alias("values"), F.sum("contradictions").alias("contradictions"), F.sum("malformed_schemes").alias("malformed"), F.sum("form_only").alias("form_only"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    df = documents.join(cols, "doc", "left").join(values, "doc", "left").join(repeats, "doc", "left")
    health, n_rows, no = F.coalesce("health", F.lit(1.0)), zero("n_rows"), F.lit(False)
    header = (zero("n_known") + (zero("n_mapped") - zero("n_known")) * 0.8) / F.greatest(zero("n_columns"), F.lit(1))
    contradiction, ambiguity = F.least(F.lit(0.3), zero("contradictions") * 0.05), F.least(F.lit(0.25), zero("n_ambiguous") * 0.08)
    score = header * 0.25 + F.when(F.col("n_logical") == F.col("n_columns"), 0.95).otherwise(0.8) * 0.15 + F.coalesce("values", F.lit(0.5)) * 0.25 + F.when(n_rows < 5, n_rows / 5).otherwise(0.95) * 0.15 + health * 0.15 + F.coalesce("similarity", F.lit(0.9)) * 0.05
    df = df.withColumn("confidence", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score - contradiction - ambiguity)) * 100, 1)).withColumn("mandatory", F.coalesce(F.col("has_item") & F.col("has_value"), no))
    blockers = {
        "MISSING_MANDATORY": ~F.col("mandatory"), "DUPLICATE_FIELD": F.size(F.coalesce("repeated", F.array())) > 0, "AMBIGUOUS_SUBCOLUMN": zero("ambiguous_subcolumns") > 0, "CRITICAL_MISMATCH": zero("critical_mismatches") > 0, "LOW_HEALTH": (health < 0.7) & (n_rows >= 3),
        "CONTRADICTIONS": contradiction > 0.05, "AMBIGUOUS_MAPPING": ambiguity > 0.05, "IDENTITY_UNSAFE": F.col("identity_safe") == False, "INCOMPATIBLE_LAYOUT": F.col("drift") == "incompatible_layout", "NO_ROWS": n_rows == 0,  # noqa: E712
        "LOW_CONFIDENCE": F.col("confidence") < AUTO, "MALFORMED_SCHEME": zero("malformed") > 0, "TRUNCATED_ITEM": zero("form_only") > 0,
    }
    df = df.withColumn("blockers", F.array_compact(F.array(*(F.when(F.coalesce(c, no), k) for k, c in blockers.items()))))
    decision = F.when(F.size("blockers") == 0, "AUTO_ACCEPT").when(F.col("mandatory") & (F.col("confidence") >= REVIEW), "REVIEW_REQUIRED").otherwise("UNRESOLVED")
    return df.withColumn("decision", decision).select(*documents.columns, "confidence", "blockers", "decision")
