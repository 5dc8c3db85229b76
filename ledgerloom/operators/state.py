"""State tables as frames: suppliers, masters, aliases, stock and its movements.

Each operator takes the table as it stands and what arrives, and returns the table as it will be;
the caller writes it. Arrivals have seq, the order in which they come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapsed
from .stock import balances


def upper_name(c: Column) -> Column:
    return F.upper(collapsed(c))


def gstin_key(c: Column) -> Column:
    """Upper-case letters and digits of a tax number; null where there are none."""
    return F.nullif(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""), F.lit(""))


def get_or_create_suppliers(known: DataFrame, asked: DataFrame) -> DataFrame:
    """known: supplier_key, supplier_name, gstin; asked: seq, supplier_name, gstin -> known and new suppliers, each
    with its status. One is known by its gstin, else by its key, else by its name; new ones that agree
    in one of these with an earlier new one are that one."""
    k = known.select("supplier_key", "supplier_name", "gstin", upper_name(F.col("supplier_name")).alias("normalized_name"), F.lit("KNOWN").alias("status"))
    key = F.coalesce(F.nullif("gstin", F.lit("")), F.nullif("supplier_name", F.lit("")), F.lit("UNKNOWN"))
    new = asked.select("seq", key.alias("supplier_key"), "supplier_name", gstin_key(F.col("gstin")).alias("gstin"), upper_name(F.col("supplier_name")).alias("normalized_name"))
    for c, at in (("gstin", gstin_key(F.col("gstin"))), ("supplier_key", F.col("supplier_key")), ("normalized_name", F.col("normalized_name"))):
        there = k.select(at.alias("__k")).where("__k is not null").distinct()
        new = new.join(there, F.col(c) == F.col("__k"), "left_anti")
        # the first arrival with a value stands for all with it
        first = new.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("seq").alias("__first"))
        new = new.join(first, c, "left").where(F.col("__first").isNull() | (F.col("seq") == F.col("__first"))).drop("__first")
    return k.unionByName(new.select("supplier_key", "supplier_name", "gstin", "normalized_name", F.lit("VERIFIED").alias("status")))


def upsert_masters(known: DataFrame, items: DataFrame) -> DataFrame:
    """item_code, item_name, pack, hsn, gst (items with seq): the last arrival of a code replaces it."""
    last = items.groupBy("item_code").agg(F.max_by(F.struct("item_name", "pack", "hsn", "gst"), "seq").alias("x")).select("item_code", "x.*")
    kept = known.select("item_code", "item_name", "pack", "hsn", "gst").join(last, "item_code", "left_anti")
    return kept.unionByName(last).withColumn("normalized_name", upper_name(F.col("item_name")))


def save_aliases(known: DataFrame, learned: DataFrame, suppliers: DataFrame, masters: DataFrame) -> DataFrame:
    """alias, supplier, item, confidence, matches (learned: with seq and without matches): an alias that its
    supplier has already counts one match more each time and takes the last item and confidence. Suppliers
    and items that don't exist become null. suppliers: supplier; masters: item."""
    there = learned.join(suppliers.select(F.col("supplier").alias("__s")).distinct(), F.col("supplier") == F.col("__s"), "left").withColumn("supplier", F.col("__s")).drop("__s")
    there = there.join(masters.select(F.col("item").alias("__i")).distinct(), F.col("item") == F.col("__i"), "left").withColumn("item", F.col("__i")).drop("__i")
    last = there.groupBy("alias", "supplier").agg(F.max_by(F.struct("item", "confidence"), "seq").alias("x"), F.count("*").alias("n"))
    a, b = known.alias("a"), last.alias("b")
    met = a.join(b, (F.col("a.alias") == F.col("b.alias")) & F.col("a.supplier").eqNullSafe(F.col("b.supplier")), "full")
    was, now = F.col("a.alias").isNotNull(), F.col("b.alias").isNotNull()
    pick = lambda c: F.when(now, F.col(f"b.x.{c}")).otherwise(F.col(f"a.{c}"))
    return met.select(
        F.coalesce("a.alias", "b.alias").alias("alias"), F.coalesce("a.supplier", "b.supplier").alias("supplier"), pick("item").alias("item"), pick("confidence").alias("confidence"),
        F.when(was, F.coalesce("a.matches", F.lit(1)) + F.coalesce("b.n", F.lit(0))).otherwise(F.col("b.n")).cast("long").alias("matches"),
    ).withColumn("normalized_alias", upper_name(F.col("alias")))


def ingest_stock(receipts: DataFrame, returns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """receipts: seq, product, pack, batch, billed, free, rate; returns: seq, product, batch (null or blank: any),
    quantity -> (movements with the balance after each, inventory).

    A return goes to the product's batch, or without one to its first batch to arrive; it never takes a
    balance below zero, and without anything received before it goes nowhere."""
    key = ["product", "pack", "batch"]
    name = lambda c: F.coalesce(collapsed(F.col(c)), F.lit(""))
    bought = receipts.select("seq", *(name(c).alias(c) for c in key), (F.coalesce("billed", F.lit(0)) + F.coalesce("free", F.lit(0))).alias("delta"), F.lit("PURCHASE_RECEIPT").alias("kind")).where("product <> ''")
    first = bought.groupBy(*key).agg(F.min("seq").alias("since"))
    back = returns.select(F.col("seq").alias("at"), name("product").alias("p"), name("batch").alias("b"), F.col("quantity")).where("p <> '' and quantity > 0")
    met = back.join(first, (F.col("p") == F.col("product")) & ((F.col("b") == F.col("batch")) | (F.col("b") == "")) & (F.col("since") < F.col("at")))
    chosen = met.withColumn("k", F.row_number().over(Window.partitionBy("at", "p").orderBy("since"))).where("k = 1")
    sent = chosen.select(F.col("at").alias("seq"), *key, (-F.col("quantity")).alias("delta"), F.lit("RETURN_DEDUCTION").alias("kind"))
    moves = balances(bought.unionByName(sent), *key)
    stock = moves.groupBy(*key).agg(F.max_by("balance", "seq").alias("stock"), F.count("*").alias("n_moves"), F.max(F.when(F.col("kind") == "PURCHASE_RECEIPT", F.col("seq"))).alias("last_received"))
    return moves, stock


def movements(moves: DataFrame, limit: int = 100, **equal) -> DataFrame:
    """The last movements, newest first; equal: columns and the value each must have."""
    for c, v in equal.items():
        moves = moves.where(F.col(c) == v)
    return moves.orderBy(F.desc("seq")).limit(limit)


def listing(rows: DataFrame, order: list[Column], limit: int, search: str | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """Rows in order, at most limit, with the searched text in one of the columns whatever the case."""
    if search:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.lower(F.col(c)).contains(search.lower()), F.lit(False))
        rows = rows.where(hit)
    return rows.orderBy(*order).limit(limit)


def sync_totals(moves: DataFrame) -> DataFrame:
    """invoice, kind, delta -> one row: invoices, receipts, units added and returns of a batch."""
    bought = F.col("kind") == "PURCHASE_RECEIPT"
    return moves.agg(F.countDistinct("invoice").alias("invoices"), F.count_if(bought).alias("items"), F.coalesce(F.sum(F.when(bought, F.col("delta"))), F.lit(0)).alias("units_added"), F.count_if(~bought).alias("returns"))
