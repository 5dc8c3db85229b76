"""Stock balances from an append-only ledger of movements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def balances(moves: DataFrame, *key: str) -> DataFrame:
    """moves: key, seq, delta. Adds balance after each: returns never take it below zero.

    With S the running sum from the first receipt on, the clamped balance is S + max(0, max of -S so
    far): two running aggregates instead of a recursion."""
    by = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    live = moves.withColumn("started", F.max((F.col("delta") > 0).cast("int")).over(by)).where("started = 1").drop("started")
    live = live.withColumn("sum", F.sum("delta").over(by))
    return live.withColumn("balance", F.col("sum") + F.greatest(F.lit(0), F.max(-F.col("sum")).over(by))).drop("sum")


def inventory(moves: DataFrame, *key: str) -> DataFrame:
    """The last balance of each item."""
    return balances(moves, *key).groupBy(*key).agg(F.max_by("balance", "seq").alias("stock"), F.count("*").alias("n_moves"))


def search(stock: DataFrame, text: str, columns: list[str], order: list, limit: int = 200) -> DataFrame:
    """Rows with the text in any of the columns, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(text.lower()), F.lit(False))
    return stock.where(hit).orderBy(*order).limit(limit)
