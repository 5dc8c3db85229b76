"""Run numbers of documents that are seen again, without gathering a frequent document in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_numbers(rows: DataFrame, key: str, order: str, block: int = 4096) -> DataFrame:
    """Adds run_no: 1 for the first of each key in ascending order, and so on; null keys are a key too.

    order: a whole number, unique within a key. Rows are numbered within blocks of `block` consecutive
    orders, and blocks are shifted by the counts of those before them, so that no window sees more
    than a block's rows or a key's blocks."""
    at = F.floor(F.col(order) / block)
    named = rows.withColumn("__block", at).withColumn("__key", F.coalesce(F.xxhash64(key), F.lit(0)))
    # a key that has one block only needs no shift; partial counts are combined before they are sent
    sizes = named.groupBy("__key", key, "__block").agg(F.count("*").alias("__n"))
    upto = Window.partitionBy("__key", key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(upto), F.lit(0))).where("__before > 0").select(F.col("__key").alias("__k"), F.col(key).alias("__v"), F.col("__block").alias("__b"), "__before")
    inside = Window.partitionBy("__key", key, "__block").orderBy(order)
    numbered = named.withColumn("run_no", F.row_number().over(inside).cast("long"))
    same = (F.col("__key") == F.col("__k")) & F.col(key).eqNullSafe(F.col("__v")) & F.col("__block").eqNullSafe(F.col("__b"))
    out = numbered.join(sizes, same, "left").withColumn("run_no", F.col("run_no") + F.coalesce("__before", F.lit(0)))
    return out.select(*rows.columns, "run_no")
