"""Tables that grow with the input stay off the driver."""

from pyspark.sql import functions as F

from ledgerloom.llm import _cluster, simhash


def test_simhash_broadcasts_no_table(spark, monkeypatch):
    plans = []
    save = _cluster.Scratch.save

    def kept(self, df, name, *by):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return save(self, df, name, *by)

    monkeypatch.setattr(_cluster.Scratch, "save", kept)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("one two three four five "), F.col("id").cast("string"))).alias("text"))
    got = simhash.near_duplicates(docs)
    plans.append(got._jdf.queryExecution().sparkPlan().toString())
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)
    empty = got.where("doc_id % 3 = 0")
    assert empty.count() == 100 and empty.select("component_id").distinct().collect() == [(0,)]
