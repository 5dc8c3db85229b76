"""Invoice totals against their lines, and tax audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.accounting import money, percent_of, slab


def reconciliation_status(delta: Column, stated: Column) -> Column:
    d = F.abs(delta)
    return F.when(stated.isNull(), "NO_INVOICE_SUMMARY_PRESENT").when(d <= 1, "RECONCILED_BALANCED").when(d <= 5, "MINOR_ROUNDING_VARIANCE").otherwise("UNRECONCILED_MISMATCH")


def reconcile(lines: DataFrame, stated: DataFrame) -> DataFrame:
    """lines: invoice, gross, taxable, tax, net; stated: invoice, total. Partial sums before the shuffle."""
    sums = lines.groupBy("invoice").agg(*[F.sum(c).alias(f"sum_{c}") for c in ("gross", "taxable", "tax", "net")], F.count("*").alias("n_lines"))
    both = sums.join(stated, "invoice", "left").withColumn("delta", F.col("sum_net") - F.col("total"))
    return both.withColumn("status", reconciliation_status(F.col("delta"), F.col("total")))


def reconcile_in_full(lines: DataFrame, stated: DataFrame) -> DataFrame:
    """lines: invoice, quantity, free, rate, discount, gst, cgst, sgst (percentages), taxable, net (null: computed);
    stated: invoice, taxable, gst, tcs, round_off, total, each may be null -> nine sums and a count for each
    invoice, the differences from what is stated, and the status.

    Taxes come from the two halves where both are stated, else half and half from the whole. The expected
    total is the net sum plus TCS and rounding."""
    zero = F.lit(0).cast("decimal(18,2)")
    on = lambda c, p: F.coalesce(percent_of(c, F.col(p)), zero)
    df = lines.withColumn("gross", money(F.coalesce(F.col("quantity") * F.col("rate"), zero)))
    df = df.withColumn("taxable", F.when(F.col("taxable") > 0, F.col("taxable")).otherwise(F.col("gross") - on(F.col("gross"), "discount")).cast("decimal(18,2)"))
    halves = (F.col("cgst") > 0) & (F.col("sgst") > 0)
    whole = on(F.col("taxable"), "gst")
    half = money(whole * F.lit("0.5").cast("decimal(2,1)"))
    df = df.withColumn("c", F.when(halves, on(F.col("taxable"), "cgst")).otherwise(half)).withColumn("s", F.when(halves, on(F.col("taxable"), "sgst")).otherwise(whole - half))
    df = df.withColumn("g", F.col("c") + F.col("s")).withColumn("net", F.when(F.col("net") > 0, F.col("net")).otherwise(F.col("taxable") + F.col("g")).cast("decimal(18,2)"))
    sums = {"gross": "gross", "taxable": "taxable", "cgst": "c", "sgst": "s", "gst": "g", "net": "net", "billed": "quantity", "free": "free"}
    every = df.groupBy("invoice").agg(*(F.sum(F.coalesce(c, zero)).alias(f"sum_{n}") for n, c in sums.items()), F.sum(zero).alias("sum_igst"), F.count("*").alias("n_lines"))
    t = stated.select("invoice", *(F.col(c).alias(f"stated_{c}") for c in ("taxable", "gst", "tcs", "round_off", "total")))
    both = every.join(t, "invoice", "left").withColumn("expected_total", F.col("sum_net") + F.coalesce("stated_tcs", zero) + F.coalesce("stated_round_off", zero))
    delta = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)), zero)
    both = both.withColumn("taxable_delta", delta("sum_taxable", "stated_taxable")).withColumn("gst_delta", delta("sum_gst", "stated_gst")).withColumn("total_delta", delta("expected_total", "stated_total"))
    return both.withColumn("status", reconciliation_status(F.col("total_delta"), F.col("stated_total")))


def suspicious(lines: DataFrame, tolerance: str = "1.00") -> DataFrame:
    """Lines whose stated net differs from taxable plus tax by more than the tolerance; with the
    computed net and the difference. Lines that state no net are never suspicious."""
    df = lines.withColumn("computed_net", F.col("taxable") + F.col("tax"))
    return df.withColumn("discrepancy", F.abs(F.col("stated_net") - F.col("computed_net"))).where(F.col("discrepancy") > F.lit(tolerance).cast("decimal(18,2)"))


def audit_lines(lines: DataFrame) -> DataFrame:
    """lines: taxable, gst, stated_tax, rate, mrp, interstate -> expected tax, its split and alerts."""
    df = lines.withColumn("expected_tax", percent_of(F.col("taxable"), F.col("gst"))).withColumn("slab", slab(F.col("gst")))
    half = money(F.col("expected_tax") * F.lit("0.5").cast("decimal(2,1)"))
    df = df.withColumn("cgst", F.when(F.col("interstate"), F.lit(0).cast("decimal(18,2)")).otherwise(half))
    df = df.withColumn("sgst", F.when(F.col("interstate"), F.lit(0).cast("decimal(18,2)")).otherwise(F.col("expected_tax") - half))
    df = df.withColumn("igst", F.when(F.col("interstate"), F.col("expected_tax")).otherwise(F.lit(0).cast("decimal(18,2)")))
    alerts = F.array_compact(F.array(F.when(F.col("slab").isNull(), "NON_STATUTORY_SLAB"), F.when(F.abs(F.col("stated_tax") - F.col("expected_tax")) > F.lit("0.10").cast("decimal(3,2)"), "GST_AMOUNT_MISMATCH"), F.when((F.col("mrp") > 0) & (F.col("rate") > F.col("mrp")), "PRICE_INVERSION")))
    return df.withColumn("alerts", alerts).withColumn("is_compliant", F.size("alerts") == 0)


def slab_summary(audited: DataFrame, *by: str) -> DataFrame:
    """Sums by statutory slab (null: other rates), with any further keys."""
    return audited.groupBy(*by, "slab").agg(F.count("*").alias("n_lines"), *[F.sum(c).alias(c) for c in ("taxable", "cgst", "sgst", "igst")])
