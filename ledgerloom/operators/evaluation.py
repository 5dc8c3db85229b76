"""Comparison of extracted values with the truth."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = [0, 50, 60, 70, 80, 90, 95, 100]


def within(predicted: Column, expected: Column, absolute: float, relative: float) -> Column:
    """Whether two numbers agree within the larger of the tolerances."""
    return F.abs(predicted - expected) <= F.greatest(F.lit(absolute), F.abs(expected) * relative)


def field_scores(cells: DataFrame) -> DataFrame:
    """cells: field, expected, predicted, same -> precision, recall and F1 of each field."""
    tp = F.sum(F.coalesce(F.col("same"), F.lit(False)).cast("int"))
    got, due = F.count("predicted"), F.count("expected")
    s = cells.groupBy("field").agg(tp.alias("tp"), got.alias("n_predicted"), due.alias("n_expected"))
    p, r = F.try_divide("tp", "n_predicted"), F.try_divide("tp", "n_expected")
    return s.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def calibration(scored: DataFrame) -> DataFrame:
    """scored: confidence (0-100), correct -> counts and accuracy of half-open buckets; the last is closed."""
    spark = scored.sparkSession
    bounds = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(zip(BUCKETS, BUCKETS[1:]))], "bucket int, lo int, hi int")
    place = F.lit(None).cast("int")
    for i, lo in enumerate(BUCKETS[:-1]):
        place = F.when(F.col("confidence") >= lo, i).otherwise(place)
    found = scored.withColumn("bucket", place).groupBy("bucket").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("int")).alias("accuracy"))
    return bounds.join(found, "bucket", "left").select("bucket", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), "accuracy")


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("expected", "predicted").agg(F.count("*").alias("n"))


def greedy_match(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """doc, row_no, item, batch of both sides -> (row_no, truth_no), each truth row once: two points for
    an item that holds the other, two for equal batches, at least two in all; in the rows' order.

    The choice depends on those before it, so a document's rows go through one call; documents are small."""

    def choose(left: list, right: list) -> list[dict]:
        free, out = list(right), []
        for x in left:
            points = [2 * bool(x["item"] and y["item"] and (x["item"] in y["item"] or y["item"] in x["item"])) + 2 * bool(x["batch"] and x["batch"] == y["batch"]) for y in free]
            if points and max(points) >= 2:
                y = free.pop(points.index(max(points)))
                out.append({"row_no": x["row_no"], "truth_no": y["row_no"], "points": max(points)})
        return out

    @F.pandas_udf("array<struct<row_no: int, truth_no: int, points: int>>")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([choose(x, y) for x, y in zip(left, right)])

    gather = lambda df, name: df.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(F.col("row_no").cast("int").alias("row_no"), "item", "batch"))).alias(name))
    both = gather(rows, "left").join(gather(truth, "right"), "doc")
    return both.select("doc", F.explode(run("left", "right")).alias("m")).select("doc", "m.*")
