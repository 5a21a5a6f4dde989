from __future__ import annotations

from decimal import Decimal

import pytest
from shop import HAND_KEYS, hand_tables, transactions_frame
from pyspark.sql import functions as F

from revlens.config import SEGMENTS
from revlens.operators.star import build_star, star_from_tables
from revlens.plans.marts import Marts


def test_trend_reconciles_and_covers_the_months(hand_marts):
    rows = hand_marts.mart_revenue_trend.orderBy("year_month").collect()
    assert [row["year_month"] for row in rows] == [f"2012-0{month}" for month in range(3, 9)]
    assert sum(row["gross_revenue"] for row in rows) == 2233
    assert sum(row["returns"] for row in rows) == -60
    assert sum(row["net_revenue"] for row in rows) == 2173


def test_trend_steps_ratios_and_guest_rules(hand_marts):
    rows = {row["year_month"]: row for row in hand_marts.mart_revenue_trend.collect()}
    march, june, july = rows["2012-03"], rows["2012-06"], rows["2012-07"]
    assert march["net_revenue_mom_delta"] is None and march["net_revenue_mom_pct"] is None
    # April 337 after March 432
    delta = rows["2012-04"]["net_revenue"] - march["net_revenue"]
    assert delta == -95
    assert rows["2012-04"]["net_revenue_mom_delta"] == delta
    assert rows["2012-04"]["net_revenue_mom_pct"] == pytest.approx(
        100 * -95 / 432
    )
    # the guest order counts as an order, not as a customer
    assert (june["orders"], june["active_customers"]) == (7, 6)
    assert june["aov"] == pytest.approx(605 / 7)
    assert july["return_rate_pct"] == pytest.approx(100 * 60 / 195)


def test_rfm_scores_every_customer_and_fills_every_segment(hand_marts):
    rows = {row["customer_key"]: row for row in hand_marts.mart_rfm.collect()}
    assert set(rows) == HAND_KEYS
    assert {row["segment"] for row in rows.values()} == set(SEGMENTS)
    assert (rows[1]["recency_days"], rows[1]["r_score"]) == (0, 5)
    assert rows[12]["r_score"] == 1
    assert rows[1]["rfm_cell"] == f"{rows[1]['r_score']}{rows[1]['f_score']}{rows[1]['m_score']}"
    # shipping counts towards money, the adjustment does not; a refund pulls a customer down
    assert rows[1]["monetary"] == Decimal(472)
    assert (rows[4]["monetary"], rows[4]["frequency"]) == (Decimal(200), 4)


def test_recency_counts_calendar_days(spark, settings, store):
    star = build_star(
        transactions_frame(
            spark,
            {"invoice_ts": "2010-12-01 23:59"},
            {"invoice_no": "M", "stock_code": "M", "line_type": "adjustment", "customer_id": None,
             "invoice_ts": "2010-12-02 00:01"},
        ),
        settings,
        store,
    )
    row = Marts(star, settings, store).mart_rfm.first()
    # the last day of all facts counts, adjustments and guests included
    assert row["recency_days"] == 1


def test_a_customer_with_cancellations_only_is_not_scored(spark, settings, store):
    star = build_star(
        transactions_frame(
            spark,
            {},
            {"invoice_no": "CX", "customer_id": 9, "quantity": -1, "is_cancellation": True},
        ),
        settings,
        store,
    )
    marts = Marts(star, settings, store)
    assert [row["customer_id"] for row in marts.mart_rfm.collect()] == [100]
    # the market mart still counts that customer
    assert marts.mart_country_performance.first()["customers"] == 2
    assert marts.mart_revenue_trend.first()["active_customers"] == 1


def test_cohorts(hand_marts):
    cells = {
        (row["cohort_month"], row["month_offset"]): row
        for row in hand_marts.mart_cohort_retention.collect()
    }
    cell = cells["2012-03", 2]
    assert (cell["cohort_size"], cell["active_customers"], cell["retention_pct"]) == (5, 4, 80.0)
    assert all(cells[key]["retention_pct"] == 100.0 for key in cells if key[1] == 0)
    # a cohort has a cell for every month to the end of the calendar, empty ones included
    assert {offset for month, offset in cells if month == "2012-04"} == set(range(5))
    assert cells["2012-06", 1]["active_customers"] == 0


def test_cohort_spine_reaches_months_without_sales(spark, settings, store):
    star = build_star(
        transactions_frame(
            spark,
            {"invoice_ts": "2010-11-01 10:00"},
            {"invoice_no": "B", "stock_code": "M", "line_type": "adjustment",
             "invoice_ts": "2011-02-01 10:00"},
        ),
        settings,
        store,
    )
    rows = Marts(star, settings, store).mart_cohort_retention.orderBy("month_offset").collect()
    assert [(row["month_offset"], row["active_customers"]) for row in rows] == [
        (0, 1), (1, 0), (2, 0), (3, 0)
    ]


def test_pareto_ranks_goods_only_and_ends_at_100(hand_marts):
    rows = hand_marts.mart_product_pareto.orderBy("revenue_rank").collect()
    assert [row["stock_code"] for row in rows] == ["LAMP", "RUG"]
    assert [row["net_revenue"] for row in rows] == [1533, 618]
    assert rows[-1]["cumulative_share_pct"] == pytest.approx(100.0)
    assert rows[0]["orders"] == 21 and rows[0]["units"] == 20
    # the stock code that crosses 80% is in the band
    assert [row["in_top_80_band"] for row in rows] == [1, 1]


def test_pareto_with_a_total_of_zero_has_no_shares(spark, settings, store):
    star = build_star(
        transactions_frame(
            spark, {}, {"invoice_no": "C1", "quantity": -1, "is_cancellation": True}
        ),
        settings,
        store,
    )
    row = Marts(star, settings, store).mart_product_pareto.first()
    assert row["revenue_share_pct"] is None and row["in_top_80_band"] == 0


def test_leakage_grains_reconcile(hand_marts):
    sums = hand_marts.mart_return_leakage.groupBy("grain").agg(
        F.sum("gross_revenue").alias("gross"), F.sum("returns").alias("returns"),
        F.sum("return_lines").alias("lines"),
    )
    assert {row["grain"]: (row["gross"], row["returns"], row["lines"]) for row in sums.collect()} == {
        "month": (2233, -60, 1),
        "country": (2233, -60, 1),
        "product": (2233, -60, 1),
    }
    products = {row["grain_value"] for row in
                hand_marts.mart_return_leakage.where("grain = 'product'").collect()}
    assert products == {"LAMP", "RUG", "FRT"}


def test_markets_rank_by_gross(hand_marts):
    rows = hand_marts.mart_country_performance.orderBy("revenue_rank").collect()
    assert [(row["country"], row["revenue_rank"], row["customers"]) for row in rows] == [
        ("Canada", 1, 7),
        ("Japan", 2, 5),
    ]
    assert rows[1]["returns"] == 0 and rows[1]["return_rate_pct"] == 0.0


def test_an_invoice_over_two_markets_and_months_counts_once_in_each(spark, settings, store):
    star = build_star(
        transactions_frame(
            spark,
            {},
            {"stock_code": "SKU2", "country": "France", "invoice_ts": "2011-01-02 10:00"},
            {"stock_code": "SKU3", "country": "France"},
        ),
        settings,
        store,
    )
    marts = Marts(star, settings, store)
    assert [row["orders"] for row in marts.mart_revenue_trend.collect()] == [1, 1]
    assert [row["orders"] for row in marts.mart_country_performance.collect()] == [1, 1]
    assert marts.mart_rfm.first()["frequency"] == 1


def test_marts_do_not_depend_on_the_layout_of_the_fact(spark, settings, store, hand_marts):
    tables = hand_tables(spark)
    tables["fact_sales"] = tables["fact_sales"].orderBy(F.rand(5)).repartition(6)
    again = Marts(star_from_tables(tables, settings), settings, store).tables()
    for name, mart in hand_marts.tables().items():
        assert sorted(map(str, mart.collect())) == sorted(map(str, again[name].collect())), name


def test_an_empty_fact_gives_empty_marts(spark, settings, store):
    tables = hand_tables(spark)
    tables["fact_sales"] = tables["fact_sales"].where("false")
    for mart in Marts(star_from_tables(tables, settings), settings, store).tables().values():
        assert mart.count() == 0
