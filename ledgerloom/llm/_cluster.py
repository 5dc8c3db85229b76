"""Shared tables, and links to components, for operators that run in several steps."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and all runs on this machine."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    own = getattr(spark, "_ledgerloom_dir", None)
    if own is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        own = f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}"
        spark.sparkContext.setCheckpointDir(own)
        spark._ledgerloom_dir = own
    return own


class Scratch:
    """Tables of one run of an operator, in a folder of their own that all machines see.

    They stay until remove(): frames that operators return read them. Those made within owned() are
    also removed by release(), which a pipeline calls when it has written what it read."""

    made: list[Scratch] = []
    owner: bool = False

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        if Scratch.owner:
            Scratch.made.append(self)

    @classmethod
    @contextmanager
    def owned(cls):
        """Tables made here belong to the caller, who releases them."""
        before, cls.owner = cls.owner, True
        try:
            yield
        finally:
            cls.owner = before

    def save(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """Writes df once and returns a frame that reads it: lost executors cost no recomputation."""
        at = f"{self.path}/{name}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def remove(self) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        if self in Scratch.made:
            Scratch.made.remove(self)

    @classmethod
    def release(cls, spark: SparkSession, docs: DataFrame) -> None:
        """Removes the tables made within owned() by this application, but for those that docs still reads."""
        used = docs.inputFiles()
        plain = lambda x: x.split(":", 1)[-1].lstrip("/")
        for x in list(cls.made):
            if x.spark.sparkContext is spark.sparkContext and not any(plain(f).startswith(plain(x.path) + "/") for f in used):
                x.remove()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sieve(names: DataFrame, bits: int) -> np.ndarray:
    """A bit for each hash of a name; 2**bits bits, whatever the input."""
    at = F.shiftrightunsigned("name", 64 - bits)
    parts = names.groupBy(F.shiftright(at, 6).alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(name, {64 - bits}) % 64 as int)))").alias("b"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    got = parts.toArrow()
    out[got.column("w").to_numpy()] = got.column("b").to_numpy().astype(np.uint64)
    return out


def hot(counted: DataFrame, key: str, n: str, total: int, parts: int = 1000) -> list:
    """The keys that hold a share of over 1 / parts of the total (and over 64): fewer than `parts`, whatever the input."""
    return [r[0] for r in counted.where(F.col(n) > max(64, total // parts)).select(key).collect()]


SALTS = 32


def join_salted(many: DataFrame, few: DataFrame, key: str, frequent: list, spread: str) -> DataFrame:
    """many joined with few by key, which few has once; rows of frequent keys are dealt to SALTS parts by
    the column `spread`. Joined by merging: `few` grows with the input, and a broadcast of it would be held by the driver."""
    if not frequent:
        return many.join(few.hint("merge"), key)
    often = F.col(key).isin(frequent)
    left = many.withColumn("__salt", F.when(often, F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int"))
    right = few.withColumn("__salt", F.explode(F.when(often, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right.hint("merge"), [key, "__salt"]).drop("__salt")


def components(scratch: Scratch, links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component: its smallest node) of undirected links (a, b), by alternating
    large-star and small-star steps. A node's least neighbour comes from a combining aggregate and
    goes back to its links by a join; links of a node with over a thousandth of all are spread
    over parts by their other end, so that no star fills a task. Each round is a written table.
    Nodes without links don't appear."""
    links = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = scratch.save(links, f"{name}-0")
    seen, k, total = None, 0, links.count()

    def with_least(rows: DataFrame) -> DataFrame:
        low = rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        return join_salted(rows, low.select("a", "m"), "a", hot(low, "a", "n", total), "b")

    while True:
        k += 1
        both = with_least(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        large = both.where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        small = with_least(large).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        links = scratch.save(small, f"{name}-{k}")
        total, *now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if [total, *now] == seen:
            break
        seen = [total, *now]
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
