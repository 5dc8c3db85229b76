"""No table of documents goes through the driver."""

from ledgerloom.operators import review


def test_corrections_broadcast_nothing(spark):
    columns = spark.createDataFrame([(1, "Qty", "rate"), (1, "Product", "itemName"), (2, "Qty", "rate")], "doc long, header string, field string")
    proposed = spark.createDataFrame([(1, "Qty", "quantity")], "doc long, header string, field string")
    got = review.corrections(columns, proposed)
    assert "Broadcast" not in got._jdf.queryExecution().sparkPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == [(1, "Product", "itemName", None, "unresolved"), (1, "Qty", "rate", "quantity", "user_confirmed")]
