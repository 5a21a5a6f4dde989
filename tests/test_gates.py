from __future__ import annotations

from dataclasses import replace
from decimal import Decimal

import pytest
from shop import raw_frame
from pyspark.sql import functions as F

from revlens.operators.cleaning import clean
from revlens.operators.star import build_star
from revlens.plans import gates
from revlens.plans.marts import Marts


class Spoiled:
    """Marts with one of them replaced."""

    def __init__(self, marts, **changes):
        self._marts = marts
        self.__dict__.update(changes)

    def __getattr__(self, name):
        return getattr(self._marts, name)


def found(report):
    return {row["gate"]: row["violations"] for row in report.collect() if row["violations"]}


@pytest.fixture(scope="module")
def small(spark, settings):
    from revlens.sources.stages import StageStore

    store = StageStore(spark)
    rows = [
        {"Invoice": str(100 + n), "StockCode": f"S{n % 3}", "Customer ID": n % 4 or None,
         "Country": "France", "Quantity": n % 5 + 1}
        for n in range(12)
    ]
    result = clean(raw_frame(spark, *rows), settings, store)
    star = build_star(result.numbered, settings, store)
    return result, star, Marts(star, settings, store)


def test_a_sound_run_passes(small):
    report = gates.gate_report(*small)
    assert set(found(report)) <= {"segments_missing"}
    gates.assert_gates(report)
    with pytest.raises(RuntimeError, match="segments_missing"):
        gates.assert_gates(report, advisory=())


def test_the_hand_star_passes_every_mart_gate(hand_star, hand_marts):
    report = gates.mart_gates(hand_star, hand_marts)
    assert found(report) == {}
    gates.assert_gates(report, advisory=())


def test_lost_rows_are_found(small):
    result, _, _ = small
    short = replace(result, lines=result.lines.where("sale_key > 2"))
    assert found(gates.clean_gates(short)) == {"rows_unaccounted": 2}


@pytest.mark.parametrize("key", list(gates.KEYS))
def test_orphans_are_counted_by_line(small, settings, key):
    result, star, _ = small
    fact = star.fact_sales.withColumn(
        key, F.when(F.col("sale_key") <= 3, F.lit(99999).cast(star.fact_sales.schema[key].dataType)).otherwise(F.col(key))
    )
    report = gates.star_gates(result, replace(star, fact_sales=fact), settings)
    assert found(report) == {f"orphan_{key}": 3}


def test_null_keys_rows_and_revenue_are_checked(small, settings):
    result, star, _ = small
    nulled = star.fact_sales.withColumn(
        "product_key", F.when(F.col("sale_key") > 1, F.col("product_key"))
    )
    assert found(gates.star_gates(result, replace(star, fact_sales=nulled), settings)) == {
        "null_keys": 1
    }
    short = star.fact_sales.where("sale_key > 1")
    assert found(gates.star_gates(result, replace(star, fact_sales=short), settings)) == {
        "fact_rows_differ": 1,
        "fact_revenue_differs": 1,
    }


def test_line_type_and_region_gates(small, settings):
    result, star, _ = small
    torn = replace(
        result,
        lines=result.lines.withColumn(
            "line_type", F.when(F.col("sale_key") == 1, "shipping").otherwise(F.col("line_type"))
        ),
    )
    homeless = replace(
        star, dim_country=star.dim_country.withColumn("region", F.lit(None).cast("string"))
    )
    assert found(gates.star_gates(torn, homeless, settings)) == {
        "codes_with_two_line_types": 1,
        "markets_without_region": 1,
    }


@pytest.mark.parametrize(
    "column, value, broken",
    [
        ("r_score", F.lit, "scores_out_of_range"),
        ("segment", None, "customers_without_segment"),
        ("segment", "Strangers", "segments_unexpected"),
    ],
)
def test_rfm_gates(hand_marts, column, value, broken):
    kind = hand_marts.mart_rfm.schema[column].dataType
    bad = F.lit(9 if value is F.lit else value).cast(kind)
    spoiled = hand_marts.mart_rfm.withColumn(
        column, F.when(F.col("customer_key") == 1, bad).otherwise(F.col(column))
    )
    report = found(gates.rfm_gates(Spoiled(hand_marts, mart_rfm=spoiled)))
    assert report[broken] == 1


def test_rfm_membership_gates(hand_marts):
    rfm = hand_marts.mart_rfm
    twice = rfm.unionAll(rfm.where("customer_key = 1"))
    report = found(gates.rfm_gates(Spoiled(hand_marts, mart_rfm=twice)))
    assert report == {"customers_scored_twice": 1, "scored_customers_differ": 1}
    short = rfm.where("segment <> 'Lost'")
    report = found(gates.rfm_gates(Spoiled(hand_marts, mart_rfm=short)))
    assert report["segments_missing"] == 1 and report["scored_customers_differ"] >= 1


def test_cohort_gates(hand_marts):
    spoiled = hand_marts.mart_cohort_retention.withColumn(
        "retention_pct", F.col("retention_pct") - 1
    ).withColumn("active_customers", F.col("active_customers") + 1)
    report = found(gates.cohort_gates(Spoiled(hand_marts, mart_cohort_retention=spoiled)))
    assert set(report) == {"cohorts_not_starting_at_100", "cells_above_cohort_size"}


def test_pareto_gates(hand_marts):
    share = F.col("cumulative_share_pct")
    spoiled = hand_marts.mart_product_pareto.withColumn(
        "cumulative_share_pct", F.when(F.col("revenue_rank") == 2, share - 50).otherwise(share)
    )
    report = found(gates.pareto_gates(Spoiled(hand_marts, mart_product_pareto=spoiled)))
    assert report == {"curve_not_ending_at_100": 1, "curve_falls_at_profit": 1}
    loss = spoiled.withColumn("net_revenue", -F.col("net_revenue"))
    report = found(gates.pareto_gates(Spoiled(hand_marts, mart_product_pareto=loss)))
    assert "curve_falls_at_profit" not in report


def test_total_gates(hand_star, hand_marts, settings):
    trend = hand_marts.mart_revenue_trend.where("year_month <> '2012-07'")
    report = found(gates.total_gates(hand_star, Spoiled(hand_marts, mart_revenue_trend=trend)))
    assert set(report) == {f"trend_{n}_differs" for n in ("gross_revenue", "returns", "net_revenue")}
    market = hand_marts.mart_country_performance.where("country = 'Japan'")
    report = found(gates.total_gates(hand_star, Spoiled(hand_marts, mart_country_performance=market)))
    assert set(report) == {"country_gross_differs"}


def test_audited_totals(hand_star, hand_marts, settings):
    right = {"gross_revenue": Decimal("2233"), "returns": Decimal("-60"), "net_revenue": Decimal("2173")}
    audited = Spoiled(hand_marts, settings=settings.with_values(expected_totals=right))
    assert found(gates.total_gates(hand_star, audited)) == {}
    wrong = right | {"returns": Decimal("-60.02")}
    audited = Spoiled(hand_marts, settings=settings.with_values(expected_totals=wrong))
    assert found(gates.total_gates(hand_star, audited)) == {"audited_returns_differs": 1}


def test_line_types_of_a_code_are_compared_without_sorting_lines(spark):
    rows = [("A", "product"), ("A", "test"), ("A", "test"), ("B", "product"), ("B", None), (None, "product"), (None, "test")]
    lines = spark.createDataFrame(rows, "stock_code string, line_type string")
    torn = gates.torn_codes(lines)
    plan = torn._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan
    assert torn.first()["codes_with_two_line_types"] == 2


def test_the_gates_of_the_star_sort_no_lines(small, monkeypatch):
    result, star, marts = small
    monkeypatch.setattr(gates, "orphan_gates", lambda *_: gates._regions(star))
    report = gates.star_gates(result, star, marts.settings, written=True)
    assert "SortAggregate" not in report._jdf.queryExecution().executedPlan().toString()
