"""A fixed benchmark against the files that are there, and its true values.

manifest: filename, sha256, supplier_name, gstin, expected_rows. files: filename, sha256. Hashes are compared in lower case;
a name without a hash on either side has changed. A name that stands in a table more than once counts as changed unless all its hashes agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = ("KNOWN", "UNKNOWN", "NOT_PRESENT", "AMBIGUOUS")
MANIFEST = "benchmark_version string, documents array<struct<filename: string, sha256: string, supplier_name: string, gstin: string, expected_rows: long>>"
TRUTH = "documents array<struct<document_id: string, filename: string, sha256: string, rows: array<struct<row_index: long, fields: map<string, struct<value: string, state: string>>>>>>"


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The documents of manifests at a path, with their version."""
    data = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return data.select(F.col("benchmark_version").alias("version"), F.explode("documents").alias("d")).select("version", "d.*")


def load_truth(spark: SparkSession, path: str) -> DataFrame:
    """True cells of ground-truth files: document_id, filename, sha256, row_index, field, value, state. A cell without a state is
    KNOWN where it has a value, and one of another state than STATES is UNKNOWN; only KNOWN cells keep their value."""
    data = spark.read.schema(TRUTH).option("multiLine", True).json(path)
    rows = data.select(F.explode("documents").alias("d")).select("d.document_id", "d.filename", "d.sha256", F.explode("d.rows").alias("r"))
    cells = rows.select("document_id", "filename", "sha256", "r.row_index", F.explode("r.fields").alias("field", "c"))
    state = F.coalesce(F.upper("c.state"), F.when(F.col("c.value").isNotNull(), "KNOWN").otherwise("UNKNOWN"))
    cells = cells.withColumn("state", F.when(state.isin(*STATES), state).otherwise("UNKNOWN"))
    return cells.select("document_id", "filename", "sha256", "row_index", "field", F.when(F.col("state") == "KNOWN", F.col("c.value")).alias("value"), "state")


def save_truth(cells: DataFrame, path: str) -> None:
    """True cells as JSON, a document a line, in the form that load_truth() reads; what stood there is replaced."""
    fields = cells.groupBy("document_id", "filename", "sha256", "row_index").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.struct("value", "state"))))).alias("fields"))
    docs = fields.groupBy("document_id", "filename", "sha256").agg(F.transform(F.sort_array(F.collect_list(F.struct("row_index", F.map_entries("fields").alias("e")))), lambda r: F.struct(r["row_index"].alias("row_index"), F.map_from_entries(r["e"]).alias("fields"))).alias("rows"))
    docs.select(F.array(F.struct("document_id", "filename", "sha256", "rows")).alias("documents")).write.mode("overwrite").json(path)


def verify_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """filename, status (VERIFIED, CHANGED, MISSING, UNEXPECTED), expected_sha256, actual_sha256 and what the manifest says of the document."""
    one = lambda df, name: df.groupBy("filename").agg(F.min(F.lower("sha256")).alias(name), (F.countDistinct(F.lower("sha256")) + F.max(F.col("sha256").isNull().cast("int"))).alias(f"n_{name}"))
    told = manifest.groupBy("filename").agg(F.min("supplier_name").alias("supplier_name"), F.min("gstin").alias("gstin"), F.min("expected_rows").alias("expected_rows"))
    met = one(manifest, "expected").join(told, "filename").join(one(files, "actual"), "filename", "full")
    same = (F.col("expected") == F.col("actual")) & (F.col("n_expected") == 1) & (F.col("n_actual") == 1)
    status = F.when(F.col("n_expected").isNull(), "UNEXPECTED").when(F.col("n_actual").isNull(), "MISSING").when(F.coalesce(same, F.lit(False)), "VERIFIED").otherwise("CHANGED")
    return met.select("filename", status.alias("status"), F.col("expected").alias("expected_sha256"), F.col("actual").alias("actual_sha256"), "supplier_name", "gstin", "expected_rows")


def summary(verified: DataFrame, documents: int | None = None) -> DataFrame:
    """One row: passed, counts by status and the rows expected of verified documents. Files that no manifest names don't
    fail it; fewer or more named documents than `documents` do."""
    n = lambda s: F.count_if(F.col("status") == s)
    df = verified.agg(n("VERIFIED").alias("verified"), n("CHANGED").alias("changed"), n("MISSING").alias("missing"), n("UNEXPECTED").alias("unexpected"), F.coalesce(F.sum(F.when(F.col("status") == "VERIFIED", F.col("expected_rows"))), F.lit(0)).alias("expected_rows"))
    right = (F.col("changed") == 0) & (F.col("missing") == 0) & (F.col("verified") > 0)
    if documents is not None:
        right = right & (F.col("verified") == documents)
    return df.withColumn("passed", right).withColumn("status", F.when(right, "PASS").otherwise("GOLDEN_BENCHMARK_INTEGRITY_FAILURE"))
