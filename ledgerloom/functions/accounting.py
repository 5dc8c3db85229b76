"""Line accounting, margins and tax checks, on decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bleeding import repair
from .fixed import GST_SLABS, PHARMA_CHAPTERS
from .quantities import number, scheme_read, scheme_text


def money(c: Column) -> Column:
    return F.round(c, 2).cast("decimal(18,2)")


def percent_of(c: Column, percent: Column) -> Column:
    return money(c * percent * F.lit("0.01").cast("decimal(3,2)"))


def near(a: Column, b: Column, relative: str, least: str = "0.10") -> Column:
    """|a - b| within the larger of `least` and a share of b."""
    return F.abs(a - b) <= F.greatest(F.lit(least).cast("decimal(18,4)"), (b * F.lit(relative).cast("decimal(4,3)")).cast("decimal(18,4)"))


def solve(df: DataFrame, preferred: str = "AUTO") -> DataFrame:
    """Adds candidates and the meaning of `amount`, and fills rate, taxable and net. A preferred meaning (GROSS,
    TAXABLE_PRE_GST or NET_POST_GST) is taken where it fits at all.

    df: quantity, free, rate, discount, gst, amount, taxable, net as decimals; each may be null.
    """
    zero = F.lit(0).cast("decimal(18,2)")
    q, a = F.col("quantity"), F.col("amount")
    rate = F.when((F.coalesce("rate", zero) <= 0) & (q > 0) & (a > 0), money(F.try_divide(a, q))).otherwise(F.col("rate"))
    df = df.withColumn("rate", rate)
    known = (F.col("quantity") > 0) & (F.col("rate") > 0)
    df = df.withColumn("gross", F.when(known, money(F.col("quantity") * F.col("rate"))))
    df = df.withColumn("pre_tax", F.col("gross") - percent_of(F.col("gross"), F.coalesce("discount", zero)))
    df = df.withColumn("post_tax", F.col("pre_tax") + percent_of(F.col("pre_tax"), F.coalesce("gst", zero)))
    df = df.withColumn("all_units", F.when(known & (F.col("free") > 0), money((F.col("quantity") + F.col("free")) * F.col("rate"))))
    meanings = (("GROSS", "gross"), ("TAXABLE_PRE_GST", "pre_tax"), ("NET_POST_GST", "post_tax"), ("TOTAL_QTY_GROSS", "all_units"))
    semantics = F.when(F.col("gross").isNull(), "UNKNOWN").when(a.isNull(), "DERIVED_GROSS")
    for name, c in sorted(meanings, key=lambda x: x[0] != preferred):
        semantics = semantics.when(near(a, F.col(c), "0.015"), name)
    df = df.withColumn("semantics", semantics.otherwise("MISMATCH"))
    meant = F.coalesce(*[F.when(F.col("semantics") == n, F.col(c)) for n, c in meanings])
    status = F.when(F.col("semantics") == "UNKNOWN", "VALID").when(F.col("semantics") == "DERIVED_GROSS", "DERIVED").when(F.col("semantics") == "MISMATCH", "MATHEMATICAL_MISMATCH").when(F.abs(a - meant) <= F.lit("0.05").cast("decimal(3,2)"), "EXACT_MATCH").otherwise("ROUNDING_DIFF")
    taxable = F.coalesce("taxable", F.when(F.col("semantics") == "TAXABLE_PRE_GST", a), "pre_tax", a - percent_of(a, F.coalesce("discount", zero)))
    off = F.col("taxable").isNotNull() & ~near(F.col("taxable"), F.col("pre_tax"), "0.020")
    df = df.withColumn("status", status).withColumn("taxable_out", taxable)
    net = F.coalesce("net", F.when(F.col("semantics") == "NET_POST_GST", a), F.col("taxable_out") + percent_of(F.col("taxable_out"), F.coalesce("gst", zero)))
    expected = F.col("taxable_out") + percent_of(F.col("taxable_out"), F.col("gst"))
    off = F.coalesce(off, F.lit(False)) | F.coalesce(F.col("net").isNotNull() & ~near(F.col("net"), expected, "0.020"), F.lit(False))
    return df.withColumn("net_out", net).withColumn("confidence", F.when(F.col("semantics") == "MISMATCH", 0.5).when(off, 0.75).otherwise(1.0)).withColumn("amount", F.coalesce("amount", "gross"))


def solve_rows(df: DataFrame, preferred: str = "AUTO") -> DataFrame:
    """Text cells of line items (quantity, freeQuantity, rate, discountPercent, amount, taxableAmount, netAmount,
    gstPercent, cgstPercent, sgstPercent, mrp; missing ones are empty) -> solve()'s columns, the repaired cells
    and discrepancies (field, status), after cells that ran together are taken apart and schemes are read.

    A scheme in the quantity gives billed and free units; one in the free quantity gives the free units, and
    billed ones where there are none. The tax rate is the stated one, else that of the two halves."""
    cells = ["quantity", "freeQuantity", "rate", "discountPercent", "amount", "taxableAmount", "netAmount", "gstPercent", "cgstPercent", "sgstPercent", "mrp"]
    df = df.withColumns({c: F.lit(None).cast("string") for c in cells if c not in df.columns})
    raw = {c: F.col(f"raw_{c}") for c in ("quantity", "freeQuantity")}
    df = df.withColumns({f"raw_{c}": F.col(c) for c in raw})
    df = repair(df)
    # texts are read once, in projections of their own; what follows works on numbers
    whole = lambda c: F.round(c, 4).cast("decimal(18,4)")
    read = ["quantity", "freeQuantity", "rate", "discountPercent", "gstPercent", "cgstPercent", "sgstPercent", "mrp"]
    df = df.withColumns({**{f"__n_{c}": whole(number(F.col(c))) for c in read}, **{f"__n_{c}": money(number(F.col(c))) for c in ("amount", "taxableAmount", "netAmount")}, **{f"__s_{c}": scheme_text(x) for c, x in raw.items()}})
    df = df.withColumns({f"__s_{c}": scheme_read(F.col(f"__s_{c}")) for c in raw})
    n, q, f = (lambda c: F.col(f"__n_{c}")), F.col("__s_quantity"), F.col("__s_freeQuantity")
    billed = F.when(q["is_compound"], whole(q["billed"])).otherwise(n("quantity"))
    free = F.when(f["is_compound"], whole(f["free"])).when(q["is_compound"], whole(q["free"])).otherwise(F.coalesce(n("freeQuantity"), F.lit(0).cast("decimal(18,4)")))
    billed = F.coalesce(billed, F.when(f["is_compound"] & (f["billed"] > 0), whole(f["billed"])))
    halves = F.when(F.coalesce("cgstPercent", "sgstPercent").isNotNull(), F.coalesce(n("cgstPercent"), F.lit(0)) + F.coalesce(n("sgstPercent"), F.lit(0)))
    apart = n("gstPercent").isNotNull() & n("cgstPercent").isNotNull() & n("sgstPercent").isNotNull() & (F.abs(halves - n("gstPercent")) > F.lit("0.05").cast("decimal(3,2)"))
    unread = F.coalesce(raw["quantity"].contains("+"), F.lit(False)) & ~q["is_compound"]
    small = lambda c: c.cast("decimal(12,4)")
    df = df.withColumns({
        "__quantity": small(billed), "__free": small(free), "__rate": small(n("rate")), "__discount": n("discountPercent").cast("decimal(7,4)"), "__gst": F.coalesce(n("gstPercent"), halves).cast("decimal(7,4)"),
        "__amount": n("amount"), "__taxable": n("taxableAmount"), "__net": n("netAmount"), "__mrp": small(n("mrp")), "__apart": F.coalesce(apart, F.lit(False)), "__unread": unread,
    })
    own = ["quantity", "free", "rate", "discount", "gst", "amount", "taxable", "net", "mrp"]
    kept = [c for c in df.columns if c not in own and not c.startswith("__") and c not in ("rate", "amount", "mrp", "quantity")]
    df = solve(df.select(*kept, *(F.col(f"__{c}").alias(c) for c in own), "__apart", "__unread"), preferred)
    wrong = lambda test, field, status: F.when(test, F.struct(F.lit(field).alias("field"), F.lit(status).alias("status")))
    off = lambda c, want: F.coalesce(F.col(c).isNotNull() & ~near(F.col(c), want, "0.020"), F.lit(False))
    expected = F.col("taxable_out") + percent_of(F.col("taxable_out"), F.col("gst"))
    found_wrong = F.array_compact(F.array(wrong(F.col("__unread"), "quantity", "UNRESOLVED_COMPOUND"), wrong(F.col("__apart"), "gstPercent", "MISMATCH"), wrong(F.col("semantics") == "MISMATCH", "amount", "MISMATCH"), wrong(off("taxable", F.col("pre_tax")), "taxableAmount", "MISMATCH"), wrong(off("net", expected), "netAmount", "MISMATCH")))
    return df.withColumn("discrepancies", found_wrong).drop("__apart", "__unread", "raw_quantity", "raw_freeQuantity")


def health(solved: DataFrame, *by: str) -> DataFrame:
    """Checked, valid and mismatched rows of solve_rows(), and the share of valid ones (1 without rows)."""
    bad = (F.col("status") == "MATHEMATICAL_MISMATCH") | F.exists("discrepancies", lambda x: x["status"] == "MISMATCH")
    s = solved.groupBy(*by).agg(F.count("*").alias("n_checked"), F.count_if(~bad).alias("n_valid"), F.count_if(bad).alias("n_mismatched"))
    return s.withColumn("health", F.round(F.coalesce(F.try_divide("n_valid", "n_checked"), F.lit(1.0)), 3))


def margins(df: DataFrame) -> DataFrame:
    """Adds margin (percent of MRP), unit_cost, scheme_benefit, units and margin_class.

    df: mrp, rate, quantity, free, net as decimals; nulls are zero. A unit costs net over all units, without
    a net amount billed units at their rate over all, without units the rate."""
    zero = F.lit(0).cast("decimal(18,4)")
    mrp, rate, billed, free, net = (F.coalesce(F.col(c).cast("decimal(18,4)"), zero) for c in ("mrp", "rate", "quantity", "free", "net"))
    units = billed + free
    margin = F.when((mrp > 0) & (rate > 0), F.round((mrp - rate) * 100 / mrp, 2)).otherwise(0).cast("decimal(18,2)")
    cost = F.when((net > 0) & (units > 0), money(net / units)).when((rate > 0) & (units > 0), money(billed * rate / units)).otherwise(money(rate))
    return df.withColumns({"margin": margin, "unit_cost": cost, "scheme_benefit": money(free * rate), "units": units}).withColumn("margin_class", F.when((mrp > 0) & (rate > mrp), "PRICE_INVERSION_ERROR").when((mrp > 0) & (F.col("margin") < 10), "LOW_RETAIL_MARGIN").when(F.col("margin") >= 25, "HIGH_MARGIN_PROMOTIONAL").otherwise("STANDARD_RETAIL_MARGIN"))


def margin_class(rate: Column, mrp: Column) -> Column:
    """PRICE_INVERSION_ERROR, LOW_RETAIL_MARGIN (< 10 %), HIGH_MARGIN_PROMOTIONAL (25 % or more) or STANDARD_RETAIL_MARGIN."""
    share = (mrp - rate) * 100
    return F.when((mrp > 0) & (rate > mrp), "PRICE_INVERSION_ERROR").when((mrp > 0) & (share < mrp * 10), "LOW_RETAIL_MARGIN").when((mrp > 0) & (share >= mrp * 25), "HIGH_MARGIN_PROMOTIONAL").otherwise("STANDARD_RETAIL_MARGIN")


def hsn_status(c: Column) -> Column:
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(c.isNull() | (c == ""), "MISSING_HSN").when(~F.length(digits).isin(4, 6, 8), "INVALID_FORMAT").when(F.substring(digits, 1, 4).isin(PHARMA_CHAPTERS), "STANDARD_PHARMA_HSN").otherwise("NON_STANDARD_CHAPTER")


def slab(gst: Column) -> Column:
    """The statutory slab within 0.01, or null."""
    return F.coalesce(*[F.when(F.abs(gst - s) < F.lit("0.01").cast("decimal(3,2)"), F.lit(s)) for s in GST_SLABS])
