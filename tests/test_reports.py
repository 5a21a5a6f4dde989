from __future__ import annotations

import json

import pytest
from shop import transactions_frame
from pyspark.sql import functions as F

from revlens.operators.star import build_star
from revlens.plans import dashboard, reports
from revlens.sources.sinks import json_text


@pytest.fixture(scope="module")
def payload(hand_star, hand_marts):
    return dashboard.payload(hand_star, hand_marts)


def test_payload_has_every_section_and_is_plain_json(payload):
    assert set(payload) == {
        "meta",
        "kpis",
        "revenue_trend",
        "countries",
        "regions",
        "rfm_segments",
        "rfm_matrix",
        "cohort",
        "pareto",
        "same_day_reversals",
        "segment_rollup",
        "return_driver_rollup",
        "top_products",
        "return_drivers",
    }
    text = json_text(payload)
    assert text.endswith("}\n") and json.loads(text)["kpis"]["orders"] == 35


def test_headline_figures_agree_with_the_marts(payload, hand_marts):
    kpis = payload["kpis"]
    assert (kpis["gross_revenue"], kpis["returns"], kpis["net_revenue"]) == (2233.0, -60.0, 2173.0)
    assert kpis["gross_revenue"] + kpis["returns"] == kpis["net_revenue"]
    assert kpis["return_rate_pct"] == pytest.approx(6000 / 2233, abs=1e-4)
    assert kpis["active_customers"] == 12
    assert kpis["repeat_purchase_rate_pct"] == 75.0
    assert kpis["latest_month"] == "2012-08"
    assert payload["meta"]["period"] == {"start": "2012-03", "end": "2012-08"}


def test_segments_and_matrix_cover_every_customer(payload):
    assert sum(cell["customers"] for cell in payload["rfm_matrix"]) == 12
    assert sum(row["customers"] for row in payload["rfm_segments"]) == 12
    assert sum(row["customer_share_pct"] for row in payload["rfm_segments"]) == pytest.approx(100, abs=0.01)


def test_curve_keeps_its_ends(payload):
    ranks = [point["revenue_rank"] for point in payload["pareto"]["curve"]]
    assert ranks == [1, 2] and payload["pareto"]["total_skus"] == 2


def test_curve_is_thinned(spark):
    pareto = spark.range(1, 1002).select(
        F.col("id").alias("revenue_rank"), (F.col("id") / 10.01).alias("cumulative_share_pct")
    )
    ranks = [row["revenue_rank"] for row in reports.pareto_curve(pareto, 240).collect()]
    assert ranks == [1, *range(4, 1001, 4), 1001]


def test_year_on_year_windows_include_both_ends(hand_marts, settings):
    windows = settings.with_values(recent_year=("2012-07", "2012-08"), prior_year=("2012-03", "2012-04"))
    row = reports.kpi_year_on_year(hand_marts.mart_revenue_trend, windows).first()
    months = {r["year_month"]: float(r["net_revenue"]) for r in hand_marts.mart_revenue_trend.collect()}
    assert row["recent_year_net"] == months["2012-07"] + months["2012-08"]
    assert row["prior_year_net"] == months["2012-03"] + months["2012-04"]
    empty = reports.kpi_year_on_year(hand_marts.mart_revenue_trend, settings.with_values(
        recent_year=("1999-01", "1999-12"), prior_year=("1998-01", "1998-12"))).first()
    assert empty["revenue_yoy_pct"] is None


REVERSAL_ROWS = [
    {"invoice_no": "1", "quantity": 5},
    {"invoice_no": "C2", "quantity": -5, "is_cancellation": True},
    # a second cancellation of the same sale counts too
    {"invoice_no": "C3", "quantity": -5, "is_cancellation": True, "invoice_ts": "2010-12-01 23:00"},
    # another day, another quantity, another customer: genuine returns
    {"invoice_no": "C4", "quantity": -5, "is_cancellation": True, "invoice_ts": "2010-12-02 09:00"},
    {"invoice_no": "C5", "quantity": -4, "is_cancellation": True},
    {"invoice_no": "C6", "quantity": -5, "is_cancellation": True, "customer_id": 7},
    # guests share one key and so match each other
    {"invoice_no": "7", "quantity": 2, "customer_id": None},
    {"invoice_no": "C8", "quantity": -2, "is_cancellation": True, "customer_id": None},
    # an adjustment is no sale
    {"invoice_no": "9", "quantity": 3, "stock_code": "M", "line_type": "adjustment"},
    {"invoice_no": "C10", "quantity": -3, "stock_code": "M", "line_type": "adjustment", "is_cancellation": True},
    # two equal kept lines against one cancellation, and a kept line with a negative quantity
    {"invoice_no": "11", "quantity": 1, "stock_code": "X"},
    {"invoice_no": "12", "quantity": 1, "stock_code": "X"},
    {"invoice_no": "C13", "quantity": -1, "stock_code": "X", "is_cancellation": True},
    {"invoice_no": "14", "quantity": -6, "stock_code": "Y"},
    {"invoice_no": "C15", "quantity": 6, "stock_code": "Y", "is_cancellation": True},
]


def test_same_day_reversals_equal_a_pairwise_search(spark, settings, store):
    star = build_star(transactions_frame(spark, *REVERSAL_ROWS), settings, store)
    lines = [row for row in star.lines.collect() if row["line_type"] in settings.net_line_types]
    kept = {
        (row["customer_key"], row["product_key"], row["invoice_ts"].date(), row["quantity"])
        for row in lines
        if not row["is_cancellation"]
    }
    cancelled = [row for row in lines if row["is_cancellation"]]
    undone = [
        row
        for row in cancelled
        if (row["customer_key"], row["product_key"], row["invoice_ts"].date(), -row["quantity"]) in kept
    ]
    value = sum(row["line_revenue"] for row in undone)
    row = reports.same_day_reversals(star, settings).first()
    assert (row["lines"], row["value"]) == (len(undone), float(value)) == (5, -70.0)
    whole = sum(row["line_revenue"] for row in cancelled)
    assert row["share_of_returns_pct"] == pytest.approx(float(100 * value / whole), abs=0.01)


def test_no_reversal_leaves_the_value_empty(hand_star, settings):
    row = reports.same_day_reversals(hand_star, settings).first()
    assert (row["lines"], row["value"], row["share_of_returns_pct"]) == (0, None, None)


def test_adjusted_rate_takes_reversals_out(spark):
    trend = spark.sql(
        "SELECT 1000.0000BD AS gross_revenue, -100.0000BD AS returns, 900.0000BD AS net_revenue"
    )
    reversals = spark.sql("SELECT 3 AS lines, -60.0D AS value")
    row = reports.adjusted_return_rate(trend, reversals).first()
    assert (row["return_rate_pct"], row["genuine_return_rate_pct"]) == (10.0, 4.0)
    none = reports.adjusted_return_rate(trend, reversals.withColumn("value", F.lit(None).cast("double")))
    assert none.first()["genuine_return_rate_pct"] == 10.0


def test_market_filter_selects_region_and_size(hand_marts):
    markets = hand_marts.mart_country_performance
    assert reports.visible_markets(markets).count() == 2
    assert [r["country"] for r in reports.visible_markets(markets, top=1).collect()] == ["Canada"]
    assert [r["country"] for r in reports.visible_markets(markets, "Asia", 5).collect()] == ["Japan"]


def test_cohort_depth(hand_marts):
    cells = reports.cohort_to_depth(hand_marts.mart_cohort_retention, 1).collect()
    assert {row["month_offset"] for row in cells} == {0, 1}


def test_products_and_segments_re_sort(spark, hand_marts):
    products = spark.sql(
        "SELECT * FROM VALUES (1L, 'A', 5), (2L, 'B', 9), (3L, 'C', 9) t(revenue_rank, stock_code, units)"
    )
    placed = reports.products_by(products, "units").collect()
    assert [row["stock_code"] for row in placed] == ["B", "C", "A"]
    segments = reports.rfm_segments(hand_marts.mart_rfm)
    sizes = [row["customers"] for row in reports.segments_by(segments, "customers").collect()]
    assert sizes == sorted(sizes, reverse=True)


def test_rounding_is_half_up_at_the_decimal_tie(spark):
    from revlens.functions.columns import rounded

    frame = spark.sql("SELECT 7.145D AS a, 2.675D AS b, -7.145D AS c, CAST(NULL AS DOUBLE) AS d")
    row = frame.select(*[rounded(F.col(name), 2).alias(name) for name in "abcd"]).first()
    assert tuple(row) == (7.15, 2.68, -7.15, None)
