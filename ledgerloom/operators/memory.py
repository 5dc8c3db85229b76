"""Layout memory with versions: profiles that several writers change, each commit with its history and audit events.

A commit writes what changed to a folder of its own and then creates the file of the next version, which names
it; who finds that file there already has a conflict and changes nothing. The state at a version is, for each layout of a
supplier, its last change up to then. Folders that no version names are leftovers of conflicts.

Layouts (layout.learn): supplier, signature, headers, n_documents, first_seen, last_seen, version. Nulls in supplier or signature
are not taken. Empty updates make no version."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import cleaned

PROFILES = "supplier string, signature string, headers array<string>, version int, n_documents long, first_seen string, last_seen string, memory_version long, action string"
EVENTS = "event_type string, supplier string, signature string, event_data string, memory_version long"


class VersionConflict(RuntimeError):
    """Another writer committed first."""


class LayoutMemory:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/versions"))

    def version(self) -> int:
        """The last version; 0 before any commit."""
        found = self._fs.listStatus(self._path(f"{self.path}/versions"))
        return max((int(x.getPath().getName().split(".")[0]) for x in found if x.getPath().getName().endswith(".json") and x.getLen()), default=0)

    def _folders(self, version: int | None) -> list[str]:
        upto = self.version() if version is None else version
        if not upto:
            return []
        rows = self.spark.read.schema("version long, folder string").json(f"{self.path}/versions/*.json").where(F.col("version") <= upto)
        return [f"{self.path}/{r.folder}" for r in rows.orderBy("version").collect()]  # a row a commit

    def _read(self, kind: str, schema: str, version: int | None) -> DataFrame:
        folders = self._folders(version)
        return self.spark.read.schema(schema).parquet(*(f"{x}/{kind}" for x in folders)) if folders else self.spark.createDataFrame([], schema)

    def history(self, version: int | None = None) -> DataFrame:
        """Every change of every layout up to a version."""
        return self._read("profiles", PROFILES, version)

    def audit(self, version: int | None = None) -> DataFrame:
        return self._read("audit", EVENTS, version)

    def profiles(self, version: int | None = None) -> DataFrame:
        """The layouts as they are at a version (the last by default)."""
        last = self.history(version).groupBy("supplier", "signature").agg(F.max_by(F.struct("headers", "version", "n_documents", "first_seen", "last_seen", "memory_version", "action"), "memory_version").alias("x"))
        return last.select("supplier", "signature", "x.*")

    def commit(self, learned: DataFrame, expected: int, source: str = "documents") -> int:
        """Adds layouts to the memory as it was at version `expected`: known signatures gain documents, others become the supplier's
        next versions in the order they were seen. The new version; VersionConflict if another writer was first."""
        if (now := self.version()) != expected:
            raise VersionConflict(f"the memory is at version {now}, not {expected}")
        new, folder = expected + 1, f"changes/{uuid.uuid4().hex}"
        text = lambda c: F.col(c).cast("string")
        told = learned.where("supplier is not null and signature is not null").groupBy("supplier", "signature").agg(F.min_by("headers", "first_seen").alias("headers"), F.sum("n_documents").alias("n"), F.min(text("first_seen")).alias("first"), F.max(text("last_seen")).alias("last"))
        known = self.profiles(expected).select("supplier", "signature", F.col("headers").alias("old_headers"), F.col("version").alias("old_version"), F.col("n_documents").alias("old_n"), F.col("first_seen").alias("old_first"), F.col("last_seen").alias("old_last"))
        upto = known.groupBy("supplier").agg(F.max("old_version").alias("upto"))
        met = told.join(known, ["supplier", "signature"], "left").join(upto, "supplier", "left")
        is_new = F.col("old_version").isNull()
        at = F.row_number().over(Window.partitionBy("supplier", is_new).orderBy("first", "signature"))
        changed = met.select(
            "supplier", "signature", F.coalesce("old_headers", "headers").alias("headers"), F.coalesce("old_version", F.coalesce("upto", F.lit(0)) + at).cast("int").alias("version"), (F.coalesce("old_n", F.lit(0)) + F.col("n")).cast("long").alias("n_documents"),
            F.least("old_first", "first").alias("first_seen"), F.greatest("old_last", "last").alias("last_seen"), F.lit(new).cast("long").alias("memory_version"), F.when(is_new, "CREATED").otherwise("UPDATED").alias("action"),
        )
        changed.write.parquet(f"{self.path}/{folder}/profiles")
        written = self.spark.read.schema(PROFILES).parquet(f"{self.path}/{folder}/profiles")
        if written.isEmpty():
            return expected
        data = F.to_json(F.struct(F.lit(source).alias("source"), "version", "n_documents", "last_seen"))
        written.select(F.concat(F.lit("LAYOUT_"), "action").alias("event_type"), "supplier", "signature", data.alias("event_data"), "memory_version").write.parquet(f"{self.path}/{folder}/audit")
        self._claim(new, folder)
        return new

    def _claim(self, version: int, folder: str) -> None:
        """Creates the version's file if nobody has: by a link on a local file system, whose create() isn't exclusive, else
        by a create that may not overwrite."""
        name, text = f"{self.path}/versions/{version:012d}.json", json.dumps({"version": version, "folder": folder})
        taken = VersionConflict(f"version {version} was committed by another writer")
        if self._fs.getScheme() == "file":
            at = self._path(name).toUri().getPath()
            own = f"{at}.{uuid.uuid4().hex}"
            with open(own, "w") as f:
                f.write(text)
            try:
                os.link(own, at)
            except FileExistsError:
                raise taken from None
            finally:
                os.unlink(own)
            return
        at = self._path(name)
        try:
            out = self._fs.create(at, False)
        except Exception as e:  # the file is there
            if self._fs.exists(at):
                raise taken from e
            raise
        out.write(bytearray(text.encode()))
        out.close()


def changes_between_versions(profiles: DataFrame) -> DataFrame:
    """profiles with supplier, version and headers -> with new and missing: the cleaned headers that the supplier's version before did not have,
    and those that it alone had, in their order. The first version has neither."""
    df = profiles.withColumn("__h", F.transform("headers", cleaned))
    before = F.lag("__h").over(Window.partitionBy("supplier").orderBy("version"))
    df = df.withColumn("__b", before)
    out = lambda a, b: F.when(F.col("__b").isNotNull(), F.array_except(a, b)).otherwise(F.array().cast("array<string>"))
    return df.withColumns({"new": out(F.col("__h"), F.col("__b")), "missing": out(F.col("__b"), F.col("__h"))}).drop("__h", "__b")


def export_profiles(suppliers: DataFrame, profiles: DataFrame) -> DataFrame:
    """suppliers (supplier, supplier_name, gstin) with layout_profiles: a map of their layouts by signature, each with version, headers,
    counts and what changed against the version before; empty for suppliers without any. profile_version is the number of layouts."""
    told = changes_between_versions(profiles)
    layout = F.struct("version", "headers", F.size("headers").alias("n_columns"), "n_documents", "first_seen", "last_seen", "new", "missing")
    by = told.groupBy("supplier").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("version", "signature", layout.alias("layout")))), lambda x: F.struct(x["signature"], x["layout"]))).alias("layout_profiles"), F.sum("n_documents").alias("n_documents"), F.max("last_seen").alias("last_seen"))
    met = suppliers.join(by, "supplier", "left")
    return met.withColumn("profile_version", F.when(F.col("layout_profiles").isNull(), 0).otherwise(F.size("layout_profiles")))


def layouts_of(profiles: DataFrame, supplier: str) -> DataFrame:
    """A supplier's layouts, oldest version first."""
    return profiles.where(F.col("supplier") == supplier).orderBy("version")


def events_of(audit: DataFrame, supplier: str) -> DataFrame:
    """A supplier's audit events in the order of the commits."""
    return audit.where(F.col("supplier") == supplier).orderBy("memory_version", "event_type", "signature")
