"""Line items of invoices, derived from the order tables; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.accounting import money, percent_of
from ..functions.fixed import GST_SLABS
from ..session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """invoice, line_no, item, batch, quantity, free, rate, mrp, discount, gst, amount and more.

    What `amount` means depends on the line's number: gross, taxable, net, all units, or neither."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    dec = lambda c, p="decimal(10,2)": F.col(c).cast(p) if isinstance(c, str) else c.cast(p)
    df = li.join(part, F.col("l_partkey") == F.col("p_partkey"))
    df = df.select(
        F.col("l_orderkey").alias("invoice"), F.col("l_linenumber").alias("line_no"), F.col("p_name").alias("item"), F.concat("l_returnflag", "l_linestatus", F.col("l_partkey").cast("string")).alias("batch"), F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"),
        dec("l_quantity").alias("quantity"), dec(F.col("l_quantity") % 3).alias("free"), dec("p_retailprice").alias("rate"), dec("l_extendedprice").alias("extended"),
        dec(F.round(F.col("l_discount") * 100), "decimal(5,2)").alias("discount"), F.element_at(F.array(*map(F.lit, GST_SLABS)), F.round(F.col("l_tax") * 100).cast("int") % 5 + 1).cast("decimal(5,2)").alias("gst"), F.round(F.col("l_tax") * 100).cast("decimal(5,2)").alias("raw_gst"),
        F.col("l_shipdate").cast("date").alias("shipped"), F.col("l_returnflag").alias("flag"),
    )
    df = df.withColumn("mrp", money(F.col("rate") * (F.lit("0.95").cast("decimal(5,2)") + (F.col("part") % 40).cast("decimal(5,2)") * F.lit("0.01").cast("decimal(3,2)"))))
    df = df.withColumn("gross", money(F.col("quantity") * F.col("rate")))
    df = df.withColumn("taxable", (F.col("gross") - percent_of(F.col("gross"), F.col("discount"))).cast("decimal(18,2)"))
    df = df.withColumn("tax", percent_of(F.col("taxable"), F.col("gst"))).withColumn("net", (F.col("taxable") + F.col("tax")).cast("decimal(18,2)"))
    kind = F.col("line_no") % 5
    amount = F.when(kind == 0, F.col("gross")).when(kind == 1, F.col("taxable")).when(kind == 2, F.col("net")).when(kind == 3, money((F.col("quantity") + F.col("free")) * F.col("rate"))).otherwise(F.col("extended").cast("decimal(18,2)"))
    return df.withColumn("amount", amount)


LINES = """
l0 AS (SELECT l_orderkey AS invoice, l_linenumber AS line_no, p_name AS item, l_returnflag || l_linestatus || CAST(l_partkey AS VARCHAR) AS batch, l_suppkey AS supplier, l_partkey AS part,
 CAST(l_quantity AS DECIMAL(10,2)) AS quantity, CAST(l_quantity % 3 AS DECIMAL(10,2)) AS free, CAST(p_retailprice AS DECIMAL(10,2)) AS rate, CAST(l_extendedprice AS DECIMAL(10,2)) AS extended,
 CAST(round(l_discount * 100) AS DECIMAL(5,2)) AS discount, CAST([0, 5, 12, 18, 28][CAST(round(l_tax * 100) AS INTEGER) % 5 + 1] AS DECIMAL(5,2)) AS gst, CAST(round(l_tax * 100) AS DECIMAL(5,2)) AS raw_gst, CAST(l_shipdate AS DATE) AS shipped, l_returnflag AS flag
 FROM lineitem JOIN part ON l_partkey = p_partkey),
l1 AS (SELECT *, CAST(round(rate * (CAST(0.95 AS DECIMAL(5,2)) + CAST(part % 40 AS DECIMAL(5,2)) * CAST(0.01 AS DECIMAL(3,2))), 2) AS DECIMAL(18,2)) AS mrp, CAST(round(quantity * rate, 2) AS DECIMAL(18,2)) AS gross FROM l0),
l2 AS (SELECT *, CAST(gross - CAST(round(gross * discount * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS taxable FROM l1),
l3 AS (SELECT *, CAST(round(taxable * gst * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS tax FROM l2),
l4 AS (SELECT *, CAST(taxable + tax AS DECIMAL(18,2)) AS net FROM l3),
lines AS (SELECT *, CASE line_no % 5 WHEN 0 THEN gross WHEN 1 THEN taxable WHEN 2 THEN net WHEN 3 THEN CAST(round((quantity + free) * rate, 2) AS DECIMAL(18,2)) ELSE CAST(extended AS DECIMAL(18,2)) END AS amount FROM l4)
"""
