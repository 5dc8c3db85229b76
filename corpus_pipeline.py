"""Corpus cleaning in five stages over `documents`.

A stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a frame;
each result is written as Parquet and read again as the next stage's docs. All but the last return
the columns of documents.

Null and empty texts pass every stage (they are near-duplicates of each other, so one of them
stays). Of repeated rows one stays. Texts of any length are taken whole. Empty tables give empty results.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, decontam, lines, simhash, toxicity
from ledgerloom.llm._cluster import Scratch
from ledgerloom.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def owning(stage):
    """The stage, as owner of the tables its operators make: they go when a later stage begins, but for
    those that its docs still read. Frames made by other callers of the operators are left alone."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        Scratch.release(ship(spark), docs)
        with Scratch.owned():
            return stage(spark, docs, sf_dir)

    return run


@owning
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go; it learns from `labels`."""
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.classify(docs, model).where("predicted = 0").select(*COLUMNS)


@owning
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that stood earlier go; a document left with nothing stays, empty."""
    found = lines.deduplicate(docs.select(*COLUMNS), outputs=("kept", "n_removed"))
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


@owning
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id (null is
    before all). Groups that share ids are told apart by their fingerprints."""
    docs = docs.select(*COLUMNS).withColumn("__h", F.coalesce(F.xxhash64("text"), F.lit(0))).withColumn("__i", F.coalesce(F.col("doc_id"), F.lit(-(2**63))))
    found = simhash.near_duplicates(docs, doc_id="__i", also=("__h",), group="__g")
    kept = found.groupBy("__g").agg(F.min(F.struct("doc_id", "__h")).alias("k")).select(F.col("k.doc_id").alias("__i"), F.col("k.__h").alias("__h"))
    same = Window.partitionBy("__i", "__h").orderBy("__i")
    rows = docs.join(kept.hint("merge"), ["__i", "__h"], "left_semi").withColumn("__n", F.row_number().over(same))
    return rows.where("__n = 1").select(*COLUMNS)


@owning
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    found = decontam.contamination(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("size(items) = 0").select(*COLUMNS)


@owning
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and proof that they decode to the text."""
    import public_tokenizers

    outputs = ("ids", "n_tokens", "ids_sha256", "decoded_sha256")
    found = bpe.encode_decode(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, outputs=outputs)
    return found.select("doc_id", "lang", "source", *outputs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a table in the shared folder."""
    out = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = out.save(stage(spark, docs, sf_dir), f"{k}")
    return docs
