"""What keeps bytes, memory and seconds a line the same on larger tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from shop import raw_frame, transactions_frame
from test_scale import hot_raw, plan_of

from revlens.config import DUPLICATE_KEY
from revlens.functions import columns as C
from revlens.operators import cleaning
from revlens.operators.star import Dimensions, build_star, date_key
from revlens.plans import marts as M
from revlens.sources.stages import WRITERS_SETTING


def folds(spark, settings, store, raw):
    lines = cleaning.normalise_columns(raw, settings)
    whole = cleaning.drop_exact_duplicates(lines, DUPLICATE_KEY).drop("source_ordinal")
    return whole, cleaning.fold_copies(lines, DUPLICATE_KEY, settings, store)


@pytest.mark.parametrize("bound", [0, 1 << 20])
def test_copies_fold_alike_whether_few_lines_move_or_all(spark, settings, store, bound):
    whole, folded = folds(spark, settings.with_values(broadcast_bytes=bound), store, hot_raw(spark))
    assert folded.columns and set(folded.columns) == set(whole.columns)
    folded = folded.select(*whole.columns)
    assert folded.exceptAll(whole).count() == whole.exceptAll(folded).count() == 0


def test_lines_without_copies_stay_where_they_are(spark, settings, store):
    raw = raw_frame(spark, *[{"Invoice": str(n)} for n in range(50)], {"Invoice": "3"})
    whole, folded = folds(spark, settings, store, raw)
    assert "Exchange hashpartitioning" in plan_of(whole)
    assert "Exchange hashpartitioning" not in plan_of(folded)
    assert store.spark.read.parquet(store.path("folded_copies")).count() == 1
    assert {row["invoice_no"]: row["copies"] for row in folded.collect()}["3"] == 2


def test_columns_that_follow_from_others_are_added_behind_the_sort(spark, settings, store):
    result = cleaning.clean(hot_raw(spark), settings, store)
    plan = plan_of(result.transactions())
    exchange = next(line for line in plan.splitlines() if "Exchange rangepartitioning" in line)
    below = plan[plan.index(exchange) :]
    schema = below[below.index("ReadSchema") :]
    assert "line_revenue" not in schema and "is_cancellation" not in schema
    assert result.transactions().exceptAll(result.kept).count() == 0


def test_a_dimension_is_there_without_the_fact(spark, settings, store):
    numbered = cleaning.clean(hot_raw(spark), settings, store).numbered
    dimensions = Dimensions(numbered, settings, store)
    assert dimensions.dim_date.count() == 1
    assert not {"customers", "products", "fact_lines"} & set(store._saves)
    assert dimensions.star().fact_sales.count() == numbered.count()


def test_orders_of_a_code_are_counted_apart_from_its_sums(spark, settings, store):
    rows = [
        {"invoice_no": "A1"},
        {"invoice_no": "A1", "quantity": 2},
        {"invoice_no": "A2"},
        {"invoice_no": "CA3", "stock_code": "BACK", "quantity": -1, "is_cancellation": True},
    ]
    star = build_star(transactions_frame(spark, *rows), settings, store)
    totals = M.product_totals(star, settings)
    grouped = [line for line in plan_of(totals).splitlines() if "HashAggregate(keys" in line and "invoice_no" in line]
    assert grouped and not any("sum" in line for line in grouped)
    assert {row["stock_code"]: row["orders"] for row in totals.collect()} == {"SKU1": 2, "BACK": 0}


def test_a_landing_of_known_folders_leaves_the_session_as_it_was(spark, store):
    before = spark.conf.get(WRITERS_SETTING, None)
    saved = store.save(spark.range(9).withColumn("part", F.col("id") % 3), "dealt", ["part"], folders=3)
    assert saved.count() == 9 and saved.where("part = 1").count() == 3
    assert spark.conf.get(WRITERS_SETTING, None) == before


def test_texts_between_visible_characters_are_stripped_alike(spark):
    texts = ["", " ", "a", " a", "a ", " a b ", "é", "é ", "a\x7f", "a　", "\x1fa", "a b", None]
    frame = spark.createDataFrame([(text,) for text in texts], "text string")
    odd = frame.where(~C.stripped(F.col("text")).eqNullSafe(F.btrim("text", F.lit(C.WHITESPACE))))
    assert odd.collect() == []


def test_months_and_days_are_those_of_the_format(spark):
    days = [(dt.datetime(2011, 1, 9, 23, 59),), (dt.datetime(999, 12, 31),), (None,)]
    frame = spark.createDataFrame(days, "ts timestamp_ntz")
    row = frame.select(
        F.count_if(~C.year_month(F.col("ts")).eqNullSafe(F.date_format("ts", "yyyy-MM"))).alias("months"),
        F.count_if(~date_key(F.col("ts")).eqNullSafe(F.date_format("ts", "yyyyMMdd").cast("int"))).alias("days"),
    ).first()
    assert tuple(row) == (0, 0)
