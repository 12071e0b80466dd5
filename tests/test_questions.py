"""Every benchmark item is asked, and answered where something passes the floor."""

from test_operators import DATA, QUERIES


def test_every_item_is_answered(spark):
    asked = {r.item_id for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id").collect()}
    assert {r.q_id for r in QUERIES["hybrid_retrieve"](spark, DATA).select("q_id").collect()} == asked
    assert {r.q_id for r in QUERIES["dense_topk"](spark, DATA).select("q_id").distinct().collect()} == asked
