"""The dashboard document: every section is a small report, collected and nested."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from revlens.operators.star import Star
from revlens.plans import reports
from revlens.plans.marts import Marts


# what a section holds: all rows of its report, or the one row there is
ROWS, ONE = "rows", "one"


def sections(star: Star, marts: Marts) -> list[tuple[str, str, DataFrame]]:
    """(section, shape, report) of the whole document; a dotted section is nested."""
    settings = marts.settings
    trend, countries = marts.mart_revenue_trend, marts.mart_country_performance
    rfm, pareto, leakage = marts.mart_rfm, marts.mart_product_pareto, marts.mart_return_leakage
    months = reports.period(trend).withColumnsRenamed({"start_month": "start", "end_month": "end"})
    latest = reports.kpi_latest(trend).withColumnRenamed("year_month", "latest_month")
    return [
        ("meta.period", ONE, months),
        ("kpis", ONE, reports.kpi_totals(trend)),
        ("kpis", ONE, reports.kpi_customers(rfm)),
        ("kpis", ONE, reports.kpi_year_on_year(trend, settings)),
        ("kpis", ONE, latest.select("latest_month", "revenue_mom_pct")),
        ("revenue_trend", ROWS, reports.trend_panel(trend)),
        ("countries", ROWS, reports.country_panel(countries)),
        ("regions", ROWS, reports.region_panel(countries)),
        ("rfm_segments", ROWS, reports.rfm_segments(rfm)),
        ("rfm_matrix", ROWS, reports.rfm_matrix(rfm)),
        ("cohort", ROWS, reports.cohort_panel(marts.mart_cohort_retention)),
        ("pareto.curve", ROWS, reports.pareto_curve(pareto, settings.pareto_curve_points)),
        ("pareto", ONE, reports.pareto_band(pareto)),
        ("same_day_reversals", ONE, reports.same_day_reversals(star, settings)),
        ("segment_rollup", ONE, reports.segment_rollup(rfm, settings.slipping_segments)),
        ("return_driver_rollup", ONE, reports.return_driver_rollup(leakage, settings.top_leakage)),
        ("top_products", ROWS, reports.top_products(pareto, settings.top_products).drop("revenue_rank")),
        ("return_drivers", ROWS, reports.return_drivers(leakage, settings.top_leakage)),
    ]


def payload(star: Star, marts: Marts) -> dict[str, Any]:
    """Rows that reach the driver are bounded by months, markets, segments, cohorts, the curve's
    points and the fixed top lists."""
    settings = marts.settings
    document: dict[str, Any] = {
        "meta": {"currency": settings.currency, "currency_symbol": settings.currency_symbol}
    }
    for section, shape, report in sections(star, marts):
        found = [row.asDict() for row in report.collect()]
        *outer, name = section.split(".")
        place = document
        for step in outer:
            place = place.setdefault(step, {})
        if shape == ROWS:
            place[name] = found
        else:
            place.setdefault(name, {}).update(found[0])
    return document
