"""Documents in folders, by any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = "*.{pdf,PDF,png,PNG,jpg,JPG,jpeg,JPEG,tiff,TIFF,webp,WEBP}"


def discover(spark: SparkSession, path: str, recursive: bool = True, kinds: str = KINDS) -> DataFrame:
    """path, size, sha256 and status of each file; later ones with equal bytes are DUPLICATE.

    Spark's reader has no rows for empty files, so these are never taken for documents."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", kinds).load(path)
    rows = found.select("path", "modificationTime", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    again = F.row_number().over(Window.partitionBy("sha256").orderBy("modificationTime", "path")) > 1
    return rows.withColumn("status", F.when(again, "DUPLICATE").otherwise("NEW"))


def scanned(pages: DataFrame, least: int = 40) -> DataFrame:
    """doc, text by page -> whether a document has so little text that it must be scanned."""
    return pages.groupBy("doc").agg((F.avg(F.length(F.coalesce("text", F.lit("")))) < least).alias("is_scanned"))
