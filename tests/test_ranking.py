from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from revlens.functions.ranking import sorted_stage, tile_starts, tiles_by_measure


def sample(spark, rows):
    return spark.range(rows).select(
        F.col("id").alias("key"),
        (F.col("id") * 7919 % 13).cast("decimal(18,4)").alias("value"),
        (F.col("id") * 31 % 101).alias("other"),
    )


@pytest.mark.parametrize("rows", [0, 1, 3, 5, 7, 13, 400])
def test_tiles_equal_the_plain_window(spark, store, rows):
    frame = store.save(sample(spark, rows), "frame")
    tiles = tiles_by_measure(store, frame, "key", ["value", "other"], 5, "order")
    for measure in ("value", "other"):
        plain = F.ntile(5).over(Window.orderBy(measure, "key"))
        both = frame.select(tiles[measure].alias("ours"), plain.alias("plain"))
        assert both.count() == rows
        assert both.where("ours <> plain").count() == 0


@pytest.mark.parametrize("rows, tiles", [(n, 5) for n in range(0, 23)] + [(4, 4), (100, 7)])
def test_tile_starts_follow_ntile_sizes(rows, tiles):
    sizes = [rows // tiles + (1 if tile < rows % tiles else 0) for tile in range(tiles)]
    starts = [sum(sizes[:tile]) + 1 for tile in range(1, tiles) if sizes[tile]]
    assert tile_starts(rows, tiles) == starts


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_row_numbers_and_running_sums_equal_the_plain_window(spark, store, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        frame = sample(spark, 1000).repartition(7)
        order = [F.col("value").desc(), F.col("key").asc()]
        ordered = sorted_stage(store, frame, order, "ordered", total="value")
        table = ordered.table.select(
            "*", ordered.row_number().alias("rank"), ordered.running_sum("value").alias("running")
        )
        window = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        wrong = table.select(
            "rank",
            "running",
            F.row_number().over(Window.orderBy(*order)).alias("plain_rank"),
            F.sum("value").over(window).alias("plain_running"),
        ).where("rank <> plain_rank OR running <> plain_running")
        assert wrong.count() == 0
        assert ordered.rows == 1000
        parts = table.select(F.shiftright("_position", 33)).distinct().count()
        assert parts == (1 if coalesce == "true" else 4)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_value_filling_a_third_of_the_rows_is_split_by_the_tie_break(spark, store):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.range(3000).select(
            F.col("id").alias("key"),
            F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("value"),
        )
        ordered = sorted_stage(store, frame, [F.col("value").asc(), F.col("key").asc()], "hot")
        hot = ordered.table.where("value = 5").select(F.shiftright("_position", 33)).distinct()
        assert hot.count() > 1
        numbered = ordered.numbered("rank")
        assert numbered.agg(F.count_distinct("rank"), F.max("rank")).first() == (3000, 3000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
