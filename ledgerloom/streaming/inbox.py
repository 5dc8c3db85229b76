"""A folder of arriving documents as a stream: hashed, deduplicated, routed by decision."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def arrivals(spark: SparkSession, path: str, kinds: str = "*") -> DataFrame:
    """Files as they are put into place (by an atomic rename), with their hashes; empty ones are left out."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", kinds).load(path)
    return found.where("length > 0").select("path", F.col("modificationTime").alias("seen"), "length", F.sha2("content", 256).alias("sha256"))


def first_seen(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """The first of files with equal contents, within a watermark that bounds the state."""
    return stream.withWatermark("seen", delay).dropDuplicatesWithinWatermark(["sha256"])


def watch(stream: DataFrame, decide: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Writes each batch under its decision (decide adds a column `decision`). Without an interval it
    takes what is there and ends; a batch's folder is overwritten when the batch is run again."""

    def write(batch: DataFrame, number: int) -> None:
        decide(batch).write.mode("overwrite").partitionBy("decision").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


# ---- files that may still be written: sweeps of a folder, state by file, duplicates over all history

SWEEP = "path string, length long, at timestamp"


def sweep(spark: SparkSession, folder: str, listing: str, kinds: str = "*") -> int:
    """Lists a folder's files and their sizes as one more file of `listing`, of which ready() makes a stream; the
    contents aren't read. A folder with no files gives nothing. Returns the number of files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", kinds).option("recursiveFileLookup", True).load(folder)
    rows = found.select("path", "length", F.current_timestamp().alias("at")).coalesce(1)
    rows.write.mode("append").parquet(listing)
    return rows.count()


def sweeps(spark: SparkSession, listing: str, per_batch: int = 1) -> DataFrame:
    """The listings as a stream, one sweep a batch, in the order they were written."""
    return spark.readStream.schema(SWEEP).option("maxFilesPerTrigger", per_batch).parquet(listing)


def _settled(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, done = state.get if state.exists else (-1, False)
    out = []
    for length, at in sorted((int(n), t) for p in parts for n, t in zip(p["length"], p["at"])):
        if length != last:
            done = False
        elif length > 0 and not done:
            done = True
            out.append((key[0], length, at))
        last = length
    state.update((last, done))
    yield pd.DataFrame(out, columns=["path", "length", "at"])


def ready(stream: DataFrame) -> DataFrame:
    """Files whose size was the same, and not 0, in two sweeps one after the other: each once, and again when it has grown and
    come to rest anew. One row of state a path."""
    return stream.groupBy("path").applyInPandasWithState(_settled, SWEEP, "last long, done boolean", "append", GroupStateTimeout.NoTimeout)


def with_contents(batch: DataFrame) -> DataFrame:
    """path, length, at of ready files -> with sha256; a file that has gone meanwhile is left out."""
    paths = [r.path for r in batch.select("path").distinct().collect()]  # those of one batch, as Spark's own file source lists them
    spark = batch.sparkSession
    if not paths:
        return batch.withColumn("sha256", F.lit(None).cast("string")).limit(0)
    found = spark.read.format("binaryFile").option("ignoreMissingFiles", True).load(paths)
    return batch.join(found.select("path", F.sha2("content", 256).alias("sha256")), "path")


def against_history(batch: DataFrame, history: DataFrame) -> DataFrame:
    """Adds is_duplicate: whether an earlier file, in the history or before it in the batch, has the same contents."""
    known = history.select("sha256").distinct().withColumn("__known", F.lit(True))
    first = F.row_number().over(Window.partitionBy("sha256").orderBy("at", "path"))
    return batch.withColumn("__k", first).join(known, "sha256", "left").withColumn("is_duplicate", F.col("__known").isNotNull() | (F.col("__k") > 1)).drop("__k", "__known")


HISTORY = "sha256 string, path string, at timestamp, batch int"


class Inbox:
    """Sweeps taken to results: ready files hashed, held against all history, decided, written under their decision.

    decide adds `decision` (text) to the rows. A batch that runs again overwrites its own folders, and is not its own history.
    Listeners get each batch's results and number. metrics() are totals over the batches of this object."""

    def __init__(self, spark: SparkSession, listing: str, out: str, checkpoint: str, decide: Callable[[DataFrame], DataFrame]):
        self.spark, self.listing, self.out, self.checkpoint, self.decide = spark, listing, out, checkpoint, decide
        self.listeners: list[Callable[[DataFrame, int], None]] = []
        self.totals: dict[str, int] = {}
        self.query: StreamingQuery | None = None

    def add_listener(self, listener: Callable[[DataFrame, int], None]) -> None:
        self.listeners.append(listener)

    def history(self, before: int | None = None) -> DataFrame:
        """Every file taken so far (before a batch)."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.out}/history")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], HISTORY)
        rows = self.spark.read.schema(HISTORY).parquet(f"{self.out}/history")
        return rows if before is None else rows.where(F.col("batch") < before)

    def _take(self, batch: DataFrame, number: int) -> None:
        marked = against_history(with_contents(batch), self.history(number))
        done = f"{self.out}/results/batch={number}"
        self.decide(marked).write.mode("overwrite").parquet(done)
        rows = self.spark.read.parquet(done)
        rows.select("sha256", "path", "at").write.mode("overwrite").parquet(f"{self.out}/history/batch={number}")
        for r in rows.groupBy("decision").agg(F.count("*").alias("n"), F.count_if("is_duplicate").alias("d")).collect():  # a row a decision
            for k, n in ((r.decision, r.n), ("duplicates", r.d), ("scanned", r.n)):
                self.totals[k] = self.totals.get(k, 0) + n
        for f in self.listeners:
            f(rows, number)

    def start(self, interval: str | None = None) -> StreamingQuery:
        """Takes the listings that are there and ends, or with an interval goes on until stopped."""
        writer = ready(sweeps(self.spark, self.listing)).writeStream.foreachBatch(self._take).option("checkpointLocation", self.checkpoint).outputMode("append")
        self.query = (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
        return self.query

    def metrics(self) -> dict[str, int | bool]:
        return {"is_running": bool(self.query and self.query.isActive), "scanned": 0, "duplicates": 0, **self.totals}


class Counters(StreamingQueryListener):
    """Rows and batches of every streaming query of the session, by its id; register with spark.streams.addListener()."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.rows[str(p.id)] = self.rows.get(str(p.id), 0) + p.numInputRows
        self.batches[str(p.id)] = self.batches.get(str(p.id), 0) + 1

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended[str(event.id)] = event.exception


def moved_to(decision: Column, folders: dict[str, str], other: str, path: Column, taken: Column) -> Column:
    """Where a file goes by its decision: the folder's path with the file's name, with a number before the ending where that
    name is taken there already (taken: how many before it are called so)."""
    name = F.element_at(F.split(path, "/"), -1)
    stem, ending = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    folder = F.coalesce(*(F.when(decision == k, F.lit(v)) for k, v in folders.items()), F.lit(other))
    return F.concat(folder, F.lit("/"), F.when(taken > 0, F.concat(stem, F.lit("_"), taken.cast("string"), ending)).otherwise(name))
