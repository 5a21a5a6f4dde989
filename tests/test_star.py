from __future__ import annotations

import datetime as dt

import pytest
from shop import TRANSACTION_DEFAULT, hand_tables, transactions_frame
from pyspark.sql import functions as F

from revlens import schemas
from revlens.operators.star import LINE_COLUMNS, build_star, calendar, star_from_tables

ROWS = [
    {"invoice_no": "A1"},
    {"invoice_no": "A1", "stock_code": "POST", "line_type": "shipping", "unit_price": "4"},
    {"invoice_no": "A2", "customer_id": None, "invoice_ts": "2010-12-05 10:00"},
    {"invoice_no": "CA3", "quantity": -1, "is_cancellation": True, "invoice_ts": "2010-12-06 10:00"},
    {"invoice_no": "A4", "stock_code": "M", "line_type": "adjustment", "invoice_ts": "2011-01-01 10:00"},
    {
        "invoice_no": "A5",
        "customer_id": 200,
        "country": "France",
        "description": "MUG",
        "stock_code": "SKU2",
        "invoice_ts": "2011-01-09 10:00",
    },
]


@pytest.fixture
def star(spark, settings, store):
    return build_star(transactions_frame(spark, *ROWS), settings, store)


def test_calendar_is_contiguous_and_knows_weekends(star):
    days = star.dim_date.orderBy("date_key").collect()
    assert len(days) == 40
    assert (days[0]["date_key"], days[-1]["date_key"]) == (20101201, 20110109)
    saturday = next(day for day in days if day["date_key"] == 20101204)
    assert (saturday["day_of_week"], saturday["is_weekend"], saturday["day_name"]) == (6, 1, "Saturday")
    assert (saturday["quarter"], saturday["month_name"], saturday["year_month"]) == (4, "December", "2010-12")
    first = next(day for day in days if day["date_key"] == 20110101)
    assert first["iso_week"] == 52


def test_guests_point_to_the_unknown_member(star):
    customers = star.dim_customer.orderBy("customer_key").collect()
    assert [(row["customer_key"], row["customer_id"], row["is_guest"]) for row in customers] == [
        (-1, None, 1),
        (1, 100, 0),
        (2, 200, 0),
    ]
    guest = star.fact_sales.where("invoice_no = 'A2'").first()
    assert guest["customer_key"] == -1


def test_tenure_counts_elapsed_days_over_all_line_types(spark, settings, store):
    star = build_star(
        transactions_frame(
            spark,
            {"invoice_ts": "2010-12-01 23:59"},
            {"invoice_no": "B", "invoice_ts": "2010-12-02 00:01"},
            {"invoice_no": "C", "customer_id": 7, "invoice_ts": "2010-12-01 10:00"},
            {"invoice_no": "D", "customer_id": 7, "stock_code": "M", "line_type": "adjustment",
             "invoice_ts": "2010-12-04 10:00"},
        ),
        settings,
        store,
    )
    tenure = {row["customer_id"]: row["tenure_days"] for row in star.dim_customer.collect()}
    assert (tenure[100], tenure[7]) == (0, 3)


def test_modal_attributes_break_ties_alphabetically(spark, settings, store):
    star = build_star(
        transactions_frame(
            spark,
            {"invoice_no": "1", "description": "B", "country": "USA"},
            {"invoice_no": "2", "description": "A", "country": "France"},
            {"invoice_no": "3", "description": None, "country": "USA"},
            {"invoice_no": "4", "description": None, "country": "France"},
        ),
        settings,
        store,
    )
    assert star.dim_product.first()["description"] == "A"
    assert star.dim_customer.where("is_guest = 0").first()["home_country"] == "France"


def test_fact_is_keyed_in_sort_order_and_keeps_the_contract(star):
    rows = star.fact_sales.orderBy("sale_key").collect()
    assert [row["sale_key"] for row in rows] == [1, 2, 3, 4, 5, 6]
    assert [row["invoice_no"] for row in rows] == ["A1", "A1", "A2", "A4", "A5", "CA3"]
    assert [(f.name, f.dataType) for f in star.fact_sales.schema] == [
        (f.name, f.dataType) for f in schemas.FACT_SALES
    ]
    for name, schema in (
        ("dim_date", schemas.DIM_DATE),
        ("dim_customer", schemas.DIM_CUSTOMER),
        ("dim_product", schemas.DIM_PRODUCT),
        ("dim_country", schemas.DIM_COUNTRY),
    ):
        found = star.tables()[name].schema
        assert [(f.name, f.dataType) for f in found] == [(f.name, f.dataType) for f in schema]


def test_shuffled_transactions_give_the_same_keys(spark, settings, store, star):
    shuffled = transactions_frame(spark, *reversed(ROWS)).repartition(4)
    again = build_star(shuffled, settings, store.within("again"))
    for name, table in star.tables().items():
        assert sorted(map(str, table.collect())) == sorted(map(str, again.tables()[name].collect()))


def test_a_lookup_past_the_broadcast_bound_gives_the_same_star(spark, settings, store, star):
    tight = settings.with_values(broadcast_bytes=0)
    again = build_star(transactions_frame(spark, *ROWS), tight, store.within("merge"))
    assert again.lines.orderBy("sale_key").collect() == star.lines.orderBy("sale_key").collect()


def test_a_code_with_two_line_types_raises(spark, settings, store):
    rows = [{"invoice_no": "1"}, {"invoice_no": "2", "line_type": "shipping"}]
    with pytest.raises(ValueError, match="more than one line type.*SKU1"):
        build_star(transactions_frame(spark, *rows), settings, store)


def test_a_market_without_a_region_raises(spark, settings, store):
    with pytest.raises(ValueError, match="no region.*Atlantis"):
        build_star(transactions_frame(spark, {"country": "Atlantis"}), settings, store)


def test_counts_name_every_table(star):
    assert {row["table_name"]: row["rows"] for row in star.counts.collect()} == {
        "dim_date": 40,
        "dim_customer": 3,
        "dim_product": 4,
        "dim_country": 2,
        "fact_sales": 6,
    }


def test_star_from_tables_widens_and_drops_orphans(spark, settings):
    tables = hand_tables(spark)
    orphan = tables["fact_sales"].limit(1).withColumn("product_key", F.lit(99).cast("bigint"))
    tables["fact_sales"] = tables["fact_sales"].unionByName(orphan)
    star = star_from_tables(tables, settings)
    assert star.lines.columns == list(LINE_COLUMNS)
    assert star.lines.count() == tables["fact_sales"].count() - 1
    again = star_from_tables(tables, settings.with_values(broadcast_bytes=0))
    assert sorted(map(str, again.lines.collect())) == sorted(map(str, star.lines.collect()))


def test_leap_day_and_year_end(spark):
    bounds = spark.range(1).select(
        F.lit("2012-02-28 23:00").cast("timestamp_ntz").alias("a"),
        F.lit("2012-03-01 00:00").cast("timestamp_ntz").alias("b"),
    )
    days = [row["date"] for row in calendar(bounds, "a", "b").orderBy("date").collect()]
    assert days == [dt.date(2012, 2, 28), dt.date(2012, 2, 29), dt.date(2012, 3, 1)]
    assert TRANSACTION_DEFAULT["quantity"] == 1


def test_all_offending_codes_are_named(spark, settings, store):
    rows = [
        {"invoice_no": f"{code}{kind}", "stock_code": f"T{code:02}", "line_type": kind}
        for code in range(50)
        for kind in ("product", "shipping")
    ]
    with pytest.raises(ValueError, match="50 stock codes.*'T00'") as refused:
        build_star(transactions_frame(spark, *rows), settings, store)
    path = str(refused.value).rsplit(" ", 1)[1]
    assert spark.read.parquet(path).count() == 50


def test_tied_lines_keep_their_keys_in_any_layout(spark, settings, store):
    rows = [{"country": "France" if at % 2 else "Ireland", "customer_id": at} for at in range(40)]
    frame = transactions_frame(spark, *rows)
    keys = [
        {
            row["customer_id"]: row["sale_key"]
            for row in build_star(given, settings, store).lines.select("customer_id", "sale_key").collect()
        }
        for given in (frame, frame.repartition(7).orderBy(F.rand(3)))
    ]
    assert keys[0] == keys[1] and len(set(keys[0].values())) == 40
