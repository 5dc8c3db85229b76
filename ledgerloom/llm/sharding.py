"""Size-tiered compaction of shards under versioned manifests.

Arrivals are appended as small immutable shards (one run for each value of an arrival column).
Compaction sorts runs into tiers by size (each `fanout` times the one below), takes the runs of a
tier in order and merges neighbours until they fill `target_bytes`; a run over twice that is
split by id. Only these are rewritten, each new shard by a task of its own. Each change writes a new
manifest (a table of shards with rows and bytes) and commits it: a file that names the manifest is
written aside and renamed to the version's number, which fails where that exists. Readers see the
old version or the new one, whole, and of two writers one gets Conflict and has to try again. Shard
names carry the version that made them, so no two shards of a store share a name.

A version is read by one scan over the folders that it uses, joined with the names of its shards. Names of up to `PLAN_ROWS`
shards are broadcast. All data go through DataFrame operations; only commits and vacuum touch the file
system otherwise. Prefix sums of sizes go block by block, so that no task sees all runs.

A null arrival or id goes to run -1; null texts have zero bytes. Repeated rows are kept. Texts of any
length are taken whole; a shard has at least one row, however long. Empty tables give an empty manifest.
Columns named `shard`, `run` or `folder` are replaced; no other name clashes. All appends to a store
have the columns of the first.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET_BYTES, BASE_BYTES, FANOUT = 64 << 20, 256 << 10, 4
BLOCK_RUNS, MOST_TASKS = 4096, 20_000
PLAN_ROWS = 200_000
"""Shards whose names are broadcast to the rows; more meet them by Spark's own choice of a join."""
MANIFEST = "shard string, folder string, run long, tier int, rows long, bytes long"
OWN = ("shard", "run", "folder")


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    """A folder of shards and manifests."""

    def __init__(self, spark: SparkSession, path: str, size: str = "text", key: str = "doc_id"):
        self.spark, self.path, self.size, self.key = spark, path.rstrip("/"), size, key
        jvm = spark.sparkContext._jvm
        self._at = lambda x: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}")
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- versions

    def _names(self, folder: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._at(folder))) if self._fs.exists(self._at(folder)) else []

    def versions(self) -> list[int]:
        return [int(x) for x in self._names("commits")]

    def manifest(self, version: int | None = None) -> DataFrame:
        """shard, folder, run (of the first arrival in it), tier, rows, bytes."""
        known = self.versions()
        version = known[-1] if version is None else version
        if version not in known:
            raise ValueError(f"no version {version}")
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{self._get(f'commits/{version:012d}')}")

    def commit(self, shards: DataFrame, version: int) -> None:
        """Writes a manifest and makes it the given version, or raises Conflict."""
        name = f"{version:012d}-{uuid.uuid4().hex[:12]}"
        shards.coalesce(1).write.parquet(f"{self.path}/manifests/{name}")
        self._put(f"commits/{version:012d}", name, f"version {version} exists")

    def _put(self, name: str, value: str, exists: str) -> None:
        """Writes a small file that is seen whole or not at all; Conflict where it exists."""
        aside = f"aside/{uuid.uuid4().hex}"
        out = self._fs.create(self._at(aside), False)
        out.writeUTF(value)
        out.close()
        self._fs.mkdirs(self._at(name).getParent())
        jvm = self.spark.sparkContext._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            # without the option to overwrite, this fails where the target exists
            files.rename(self._at(aside), self._at(name), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self._fs.delete(self._at(aside), False)
            if "AlreadyExists" in str(e):
                raise Conflict(exists) from e
            raise

    def _get(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def _next(self) -> int:
        return (self.versions() or [0])[-1] + 1

    # ---- data

    def _schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self._get("schema")))

    def _bytes(self) -> Column:
        return F.coalesce(F.octet_length(self.size), F.lit(0)).cast("long")

    def tier(self, size: Column) -> Column:
        return F.floor(F.log(F.greatest(size / BASE_BYTES, F.lit(1.0))) / F.log(F.lit(float(FANOUT))) + 1e-9).cast("int")

    def _scan(self, shards: DataFrame) -> DataFrame:
        """The rows of some shards, with run, folder and shard."""
        folders = sorted(r.folder for r in shards.select("folder").distinct().toLocalIterator())
        schema = self._schema().add("run", "long").add("folder", "string").add("shard", "string")
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/data/folder={x}" for x in folders))

    def _written(self, rows: DataFrame, folder: str) -> DataFrame:
        """Writes rows by their shard; the manifest's rows of what is written."""
        rows.write.partitionBy("shard").option("compression", "zstd").parquet(f"{self.path}/data/folder={folder}")
        own = self.spark.read.schema(rows.select(*[c for c in rows.columns if c != "shard"], "shard").schema).parquet(f"{self.path}/data/folder={folder}")
        new = own.groupBy("shard").agg(F.min("run").alias("run"), F.count("*").alias("rows"), F.sum(self._bytes()).alias("bytes"))
        return new.select("shard", F.lit(folder).alias("folder"), "run", self.tier(F.col("bytes")).alias("tier"), "rows", "bytes")

    def append(self, rows: DataFrame, arrival: Column) -> int:
        """Adds each arrival as a shard of its own; returns the new version."""
        version, folder = self._next(), uuid.uuid4().hex[:12]
        run = F.coalesce(arrival.cast("long"), F.lit(-1))
        own = [c for c in rows.columns if c not in OWN]
        if not self._fs.exists(self._at("schema")):
            try:
                self._put("schema", rows.select(*own).schema.json(), "a schema exists")
            except Conflict:
                pass  # another first writer's; it is compared below
        if sorted(own) != sorted(self._schema().names):
            raise ValueError(f"the store has columns {self._schema().names}")
        # files of a run come from the tasks that hold its rows: nothing is shuffled
        named = rows.select(*own, run.alias("run")).withColumn("shard", F.format_string(f"v{version}-run-%d", "run"))
        new = self._written(named, folder)
        self.commit(new if version == 1 else self.manifest(version - 1).unionByName(new), version)
        return version

    def plan(self, version: int | None = None, target_bytes: int = TARGET_BYTES) -> DataFrame:
        """shard, folder -> into, pieces, bin_no: what compaction would rewrite, and into what."""
        version = self.versions()[-1] if version is None else version
        runs = self.manifest(version).where((F.col("bytes") < target_bytes) | (F.col("bytes") > 2 * target_bytes))
        runs = runs.withColumn("block", F.floor(F.col("run") / BLOCK_RUNS))
        ahead = runs.groupBy("tier", "block").agg(F.sum("bytes").alias("size"))
        ahead = ahead.withColumn("ahead", F.coalesce(F.sum("size").over(Window.partitionBy("tier").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
        inside = Window.partitionBy("tier", "block").orderBy("run", "shard", "folder").rowsBetween(Window.unboundedPreceding, -1)
        runs = runs.withColumn("before", F.coalesce(F.sum("bytes").over(inside), F.lit(0))).join(ahead, ["tier", "block"])
        runs = runs.withColumn("bin", F.floor((F.col("before") + F.col("ahead")) / target_bytes))
        bins = runs.groupBy("tier", "bin").agg(F.count("*").alias("n"), F.sum("bytes").alias("size"))
        bins = bins.withColumn("pieces", F.greatest(F.lit(1), F.floor(F.col("size") / target_bytes)).cast("int")).where("n > 1 or pieces > 1")
        return runs.join(bins, ["tier", "bin"]).select("shard", "folder", F.format_string(f"v{version + 1}-t%d-%d", "tier", "bin").alias("into"), "pieces")

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with their run, folder and shard."""
        shards = self.manifest(version)
        return self._scan(shards).join(self._sent(shards.select("folder", "shard"), shards.count()), ["folder", "shard"], "left_semi")

    def _sent(self, small: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(small) if rows <= PLAN_ROWS else small

    def compact(self, target_bytes: int = TARGET_BYTES) -> int:
        """Merges runs of a tier; returns the new version (or the last, if nothing is to be done)."""
        version = self._next()
        name, folder = f"plans/{uuid.uuid4().hex[:12]}", uuid.uuid4().hex[:12]
        planned = self.plan(version - 1, target_bytes)
        planned.write.parquet(f"{self.path}/{name}")
        planned = self.spark.read.schema(planned.schema).parquet(f"{self.path}/{name}")
        # each new shard gets a number, by which it has a task of its own
        bins = planned.groupBy("into", "pieces").agg(F.count("*").alias("n"))
        shards, rewritten = bins.agg(F.sum("pieces"), F.sum("n")).first()
        if not shards:
            return version - 1
        inside = Window.partitionBy("wide").orderBy("into").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("wide", F.pmod(F.xxhash64("into"), F.lit(64))).withColumn("first", F.coalesce(F.sum("pieces").over(inside), F.lit(0)))
        widths = bins.groupBy("wide").agg(F.sum("pieces").alias("sum")).withColumn("start", F.coalesce(F.sum("sum").over(Window.orderBy("wide").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        bins = bins.join(F.broadcast(widths.select("wide", "start")), "wide")  # 64 rows
        steps = planned.join(bins.select(F.col("into").alias("name"), (F.col("start") + F.col("first")).alias("number")), F.col("into") == F.col("name"))
        steps = steps.select("folder", "shard", F.struct("into", "pieces", "number").alias("__step"))
        tasks = min(int(shards), MOST_TASKS)
        # rows are shuffled once, to their new shards
        rows = self._scan(planned).join(self._sent(steps, rewritten), ["folder", "shard"])
        piece = F.coalesce(F.pmod(F.col(self.key), F.col("__step.pieces")), F.lit(0)).cast("int")
        shard = F.when(F.col("__step.pieces") > 1, F.concat("__step.into", F.format_string(".%d", piece))).otherwise(F.col("__step.into"))
        own = [*self._schema().names, "run"]
        rows = rows.repartitionById(tasks, F.pmod(F.col("__step.number") + piece, F.lit(tasks)).cast("int"))
        new = self._written(rows.select(*own, shard.alias("shard")), folder)
        kept = self.manifest(version - 1).join(planned.select("shard", "folder"), ["shard", "folder"], "left_anti").select(*new.columns)
        self.commit(kept.unionByName(new), version)
        self._fs.delete(self._at(name), True)
        return version

    def vacuum(self, keep: int = 1, older_than: float = 24 * 3600.0) -> list[str]:
        """Deletes versions but the last `keep`, with their manifests, and data folders that none of these uses. A folder that no
        version ever used may belong to a writer who has not committed yet, and goes only once
        nothing was added to it for `older_than` seconds."""
        known = self.versions()
        last = known[-keep:]
        folders = lambda versions: {r.folder for v in versions for r in self.manifest(v).select("folder").distinct().toLocalIterator()}
        used, dropped = folders(last), folders(known[:-keep])
        gone = []
        for x in self._fs.listStatus(self._at("data")) if self._fs.exists(self._at("data")) else []:
            name = x.getPath().getName().partition("=")[2]
            if name not in used and (name in dropped or time.time() - x.getModificationTime() / 1000 > older_than):
                self._fs.delete(x.getPath(), True)
                gone.append(name)
        for v in known[:-keep]:
            name = self._get(f"commits/{v:012d}")
            self._fs.delete(self._at(f"commits/{v:012d}"), False)
            self._fs.delete(self._at(f"manifests/{name}"), True)
        return gone
