"""Joins of near-dedup that must not move the rows of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.llm import minhash


def test_rows_of_near_nodes_are_found_without_moving_the_others(spark, monkeypatch):
    node = F.unhex(F.md5(F.col("id").cast("string")))
    rows = spark.range(2000).select(node.alias("node"), (F.col("id") % 16).alias("tree"))
    near = spark.range(100).select(node.alias("node"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = minhash._of_nodes(rows, near)
        assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(minhash, "BROADCAST_BYTES", 0)
        merged = minhash._of_nodes(rows, near)
        assert "hashpartitioning" in merged._jdf.queryExecution().executedPlan().toString()
        assert found.count() == merged.count() == 100
        assert found.exceptAll(merged).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
