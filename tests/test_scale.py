"""What the plans must look like, and results when one key holds a third of all rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from revlens.config import DUPLICATE_KEY
from revlens.functions.joins import attach
from revlens.operators import cleaning
from revlens.operators.star import (
    build_dim_customer,
    build_dim_product,
    build_lines,
    build_star,
)
from revlens.plans import marts as M
from revlens.plans import quality, reports


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def hot_raw(spark, rows=3000):
    """A third of the lines are copies of one line; another third belongs to one customer."""
    n = F.col("id")
    hot = n % 3 == 0
    return spark.range(rows).select(
        F.when(hot, "1").otherwise(F.concat(F.lit("9"), (n / 7).cast("int").cast("string"))).alias("Invoice"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("s"), (n % 50).cast("string"))).alias("StockCode"),
        F.when(n % 5 != 0, F.concat(F.lit("text "), (n % 4).cast("string"))).alias("Description"),
        F.when(hot, 1).otherwise(n % 9 + 1).cast("bigint").alias("Quantity"),
        F.lit("2010-12-01 08:26:31").cast("timestamp_ntz").alias("InvoiceDate"),
        F.lit("2.55").cast("decimal(18,4)").alias("Price"),
        F.when(n % 3 == 1, 7).when(n % 4 != 0, n % 40 + 10).cast("bigint").alias("Customer ID"),
        F.lit("France").alias("Country"),
        n.alias("source_ordinal"),
    )


@pytest.fixture(scope="module")
def built(spark, settings):
    from revlens.sources.stages import StageStore

    store = StageStore(spark)
    result = cleaning.clean(hot_raw(spark), settings, store)
    star = build_star(result.numbered, settings, store)
    return result, star, M.Marts(star, settings, store)


def test_copies_collapse_before_the_shuffle(spark, settings):
    lines = cleaning.normalise_columns(hot_raw(spark), settings)
    deduped = cleaning.drop_exact_duplicates(lines, DUPLICATE_KEY)
    plan = plan_of(deduped)
    assert plan.count("Exchange") == 1
    assert plan.index("partial_min_by") > plan.index("Exchange")
    copies = deduped.where("stock_code = 'HOT'").collect()
    assert [(row["copies"], row["source_ordinal"]) for row in copies] == [(1000, 0)]


def test_accounting_holds_with_hot_copies(built):
    row = quality.row_accounting(built[0]).first()
    assert row["raw_rows"] == 3000 and row["deduped_rows"] >= 999 and row["balances"] == 1


def test_nothing_large_meets_in_one_partition(built, settings):
    _, star, marts = built
    for frame in (
        M.order_heads(star, settings),
        M.product_totals(star, settings),
        M.return_leakage(marts.order_heads, marts.product_totals),
        star.fact_sales,
        star.dim_customer,
        star.dim_product,
        marts.mart_rfm,
        marts.mart_product_pareto,
    ):
        assert "SinglePartition" not in plan_of(frame)
        assert "Cartesian" not in plan_of(frame) and "NestedLoop" not in plan_of(frame)


def test_summaries_fold_before_the_shuffle_and_read_only_their_columns(built, settings):
    _, star, _ = built
    plan = plan_of(M.order_heads(star, settings))
    assert plan.count("Exchange") == 1 and "partial_sum" in plan
    assert "PushedFilters: [In(line_type" in plan
    schema = plan[plan.index("ReadSchema") :]
    assert "unit_price" not in schema and "stock_code" not in schema


def test_the_fact_needs_no_shuffle_to_read(built):
    _, star, _ = built
    assert "Exchange" not in plan_of(star.fact_sales)


def test_dimensions_are_broadcast_only_within_the_bound(built, settings, store):
    result, star, _ = built
    parts = (
        result.numbered,
        build_dim_customer(result.numbered, settings, store).keys,
        build_dim_product(result.numbered, store).keys,
        star.dim_country,
    )
    assert "SortMergeJoin" not in plan_of(build_lines(*parts, settings))
    tight = build_lines(*parts, settings.with_values(broadcast_bytes=0))
    plan = plan_of(tight)
    # still broadcast: the markets, bounded by the region map, and the few hot keys of each lookup
    assert plan.count("SortMergeJoin") == 2 and plan.count("BroadcastHashJoin") == 3
    wide = build_lines(*parts, settings)
    assert tight.exceptAll(wide).count() == 0 and tight.count() == wide.count()


def test_a_hot_key_fills_no_partition_of_a_merge_join(spark, store):
    # key 1 holds half of the rows, a quarter has no key, adaptive splitting is off
    n = F.col("id")
    frame = spark.range(8000).select(
        "id", F.when(n % 2 == 0, 1).when(n % 4 == 1, n % 5000 + 2).cast("bigint").alias("key")
    )
    counts = frame.where("key IS NOT NULL").groupBy("key").count()
    lookup = store.save(
        counts.select(F.col("key").alias("code"), (F.col("key") * 10).alias("value"), F.col("count").alias("rows")),
        "lookup",
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = attach(frame, lookup, F.col("key"), "code", 0, ["id"], weight="rows")
        assert "SortMergeJoin" in plan_of(joined) and joined.columns == ["id", "key", "value"]
        assert joined.where("value <=> key * 10").count() == 8000
        sizes = [row["count"] for row in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 2500
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_empty_keys_are_dealt_out(spark):
    frame = spark.range(4000).select(
        "id", F.when(F.col("id") % 2 == 0, F.col("id") % 100).alias("key")
    )
    lookup = spark.range(100).select(F.col("id").alias("code"), (F.col("id") * 10).alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = attach(frame, lookup, F.col("key"), "code", 0, ["id"])
        assert joined.columns == ["id", "key", "value"]
        assert joined.where("key IS NULL AND value IS NOT NULL").count() == 0
        assert joined.where("value <=> key * 10").count() == 4000
        sizes = (
            joined.where("key IS NULL").groupBy(F.spark_partition_id()).count().collect()
        )
        assert len(sizes) == 4 and max(row["count"] for row in sizes) < 800
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_reversals_take_one_aggregation_and_no_join(built, settings):
    _, star, _ = built
    plan = plan_of(reports.same_day_reversals(star, settings))
    assert "Join" not in plan and plan.count("FileScan") == 1


def test_worst_leaks_limit_each_grain_before_the_shuffle(built):
    plan = plan_of(reports.worst_leaks(built[2].mart_return_leakage))
    assert "WindowGroupLimit" in plan


def test_profile_reads_one_column_per_branch(spark, settings, built, store):
    raw = store.save(hot_raw(spark), "raw")
    plan = plan_of(quality.column_profile(quality.audit_view(raw, settings)))
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert len(scans) == 8 and all(line.split("ReadSchema: struct<")[1].count(":") == 1 for line in scans)


def test_hot_customer_and_hot_code_give_whole_results(built, settings):
    result, _, marts = built
    kept = result.kept.collect()
    hot = [row for row in kept if row["customer_id"] == 7]
    row = marts.mart_rfm.where("customer_id = 7").first()
    assert row["frequency"] == len({r["invoice_no"] for r in hot if not r["is_cancellation"]})
    assert row["monetary"] == sum(r["line_revenue"] for r in hot)
    assert marts.mart_rfm.count() == len({r["customer_id"] for r in kept if r["customer_id"]})
    totals = {r["stock_code"]: r for r in marts.product_totals.collect()}
    assert totals["HOT"]["units"] == 1


def test_distinct_customers_and_orders_expand_no_rows(built, settings):
    _, star, marts = built
    heads = marts.order_heads
    for frame in (M.revenue_trend(heads, settings), M.country_performance(heads, settings)):
        assert "Expand" not in plan_of(frame)


def test_customers_are_counted_across_bitmaps_and_null_groups(spark):
    rows = [("a", key) for key in (1, 1, 32768, 32769, 70000)] + [(None, 5), (None, 5), (None, 6)]
    heads = spark.createDataFrame(rows, "place string, customer_key bigint")
    measures = spark.createDataFrame([("a", 1), (None, 2), ("nobody", 3)], "place string, size int")
    found = M.with_customers(measures, heads, "place", "customers").collect()
    assert {tuple(row) for row in found} == {("a", 1, 4), (None, 2, 2), ("nobody", 3, 0)}
