"""What keeps the driver's memory bounded where lookups have very many rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from shop import raw_frame
from test_scale import plan_of

from revlens.config import DUPLICATE_KEY
from revlens.functions import joins
from revlens.operators import cleaning

LARGE = 1 << 30


def test_a_lookup_of_many_short_rows_is_not_broadcast(spark):
    # 24 MB of values, so far within a bound in bytes
    lookup = spark.range(joins.BROADCAST_ROWS + 1).select(F.hex("id").alias("code"), F.col("id").alias("value"))
    frame = spark.range(10).select(F.hex("id").alias("key"))
    for found in (
        joins.attach(frame, lookup, F.col("key"), "code", LARGE, ["key"]),
        frame.join(joins.broadcast_within(lookup, LARGE).hint("merge"), F.col("key") == F.col("code")),
    ):
        assert "SortMergeJoin" in plan_of(found) and "BroadcastHashJoin" not in plan_of(found)
    few = lookup.where("value < 5")
    assert "BroadcastHashJoin" in plan_of(joins.attach(frame, few, F.col("key"), "code", LARGE, ["key"]))


@pytest.fixture
def no_rows(monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)


def test_keys_close_together_are_looked_up_in_arrays(spark, store, no_rows):
    keys = [-513, -512, -1, 0, 1, 511, 512, 1600]
    rows = [(key, None if key == 1 else key * 10, key % 7) for key in keys] + [(None, 5, 5)]
    lookup = store.save(spark.createDataFrame(rows, "code bigint, value bigint, mark int"), "lookup")
    frame = spark.createDataFrame(
        [(n, key) for n, key in enumerate([*keys, 512, 2, -2, 10**12, None])], "id int, key bigint"
    )
    joined = joins.attach(frame, lookup, F.col("key"), "code", LARGE, ["id"])
    plan = plan_of(joined)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    expected = {row[0]: row[1:] for row in rows if row[0] is not None}
    found = {row["id"]: (row["key"], row["value"], row["mark"]) for row in joined.collect()}
    assert joined.columns == ["id", "key", "value", "mark"] and len(found) == frame.count()
    assert all((value, mark) == expected.get(key, (None, None)) for key, value, mark in found.values())


@pytest.mark.parametrize("keys", [[n << 40 for n in range(20000)], [1, 2, 2]], ids=["far apart", "twice"])
def test_other_keys_are_merged(spark, store, no_rows, keys):
    lookup = store.save(spark.createDataFrame([(key, key) for key in keys], "code bigint, value bigint"), "lookup")
    frame = spark.createDataFrame([(keys[0],), (keys[2],), (None,)], "key bigint")
    joined = joins.attach(frame, lookup, F.col("key"), "code", LARGE, ["key"])
    assert "SortMergeJoin" in plan_of(joined)
    assert joined.where("value <=> key").count() == joined.count() == 2 + keys.count(keys[2])


def test_rows_without_a_key_stay_where_most_have_none(spark, store):
    n = F.col("id")
    frame = store.save(spark.range(1000).select("id", F.when(n % 9 == 0, n % 50).alias("key")), "frame")
    lookup = store.save(spark.range(40).select(n.alias("code"), (n * 10).alias("value"), F.lit(1).alias("rows")), "few")
    moved = joins.attach(frame, lookup, F.col("key"), "code", 0, ["id"], weight="rows")
    stayed = joins.attach(frame, lookup, F.col("key"), "code", 0, ["id"], weight="rows", keyless_stay=True)
    assert stayed.columns == moved.columns and "Union" in plan_of(stayed)
    assert stayed.exceptAll(moved).count() == moved.exceptAll(stayed).count() == 0


def test_the_filter_lets_every_hash_through_and_few_others(spark, store):
    frame = spark.range(20000).withColumn("mark", F.xxhash64("id"))
    hashes = store.save(frame.where("id % 10 = 0").select("mark"), "hashes")
    bits = joins.filter_bits(2000, LARGE)
    blocks = store.save(joins.hash_filter(hashes, "mark", bits), "blocks")
    assert blocks.count() == bits // (64 * joins.BLOCK)
    flagged = joins.flag_hashes(frame, F.col("mark"), blocks, bits, "hit")
    assert flagged.columns == ["id", "mark", "hit"]
    assert flagged.where("id % 10 = 0 AND NOT hit").count() == 0
    assert flagged.where("id % 10 <> 0 AND hit").count() < 0.05 * 18000


def test_a_filter_never_passes_its_bound():
    assert joins.filter_bits(0, LARGE) == 64 * joins.BLOCK
    assert joins.filter_bits(10**7, LARGE) == 8 * joins.FILTER_BYTES
    assert joins.filter_bits(10**9, LARGE) == joins.filter_bits(5, 0) == 0
    assert joins.filter_bits(1000, 1 << 20) <= 8 << 20


def test_repeated_hashes_are_not_broadcast_one_by_one(spark, settings, store):
    rows = [{"Invoice": str(n)} for n in range(300)]
    lines = cleaning.normalise_columns(raw_frame(spark, *rows, *rows), settings)
    folded = cleaning.fold_copies(lines, DUPLICATE_KEY, settings, store)
    assert spark.read.parquet(store.path("repeated_marks")).count() == 300
    assert spark.read.parquet(store.path("mark_filter")).count() == 1
    assert "repeated_marks" not in plan_of(folded)
    assert {row["invoice_no"]: row["copies"] for row in folded.collect()} == {str(n): 2 for n in range(300)}
