"""Every registered query over the test tables, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions.columns import with_double_money
from revlens.operators import cleaning
from revlens.plans import gates, quality, reports, sqlviews
from revlens.testbed.binding import PARTS, Workspace, workspace

Query = Callable[[Workspace], DataFrame]
SEASON = (9, 11)
REGION = "ASIA"
TOP_MARKETS = 3
COHORT_DEPTH = 12


def _audit(w: Workspace) -> DataFrame:
    return quality.audit_view(w.raw, w.settings)


def _plain(frame: DataFrame) -> DataFrame:
    return frame.drop(cleaning.ORDINAL, cleaning.COPIES)


def _cancellations(w: Workspace) -> DataFrame:
    flagged = cleaning.flag_cancellations(w.normalised, w.settings.cancellation_prefix)
    return flagged.groupBy("is_cancellation").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("line_revenue").alias("revenue")
    )


def _line_types(w: Workspace) -> DataFrame:
    classified = cleaning.classify_line_type(w.normalised, w.settings)
    return classified.groupBy("line_type", "stock_code").agg(F.count(F.lit(1)).alias("lines"))


def _gate_report(w: Workspace) -> DataFrame:
    return gates.gate_report(w.cleaned, w.star, w.marts, written=True)


def _adjusted(w: Workspace) -> DataFrame:
    return reports.adjusted_return_rate(w.marts.mart_revenue_trend, w.reversals)


def _sql(text: str) -> Query:
    def query(w: Workspace) -> DataFrame:
        sqlviews.register(w.spark, w.marts)
        return w.spark.sql(text)

    return query


def _published_star(w: Workspace) -> DataFrame:
    return w.loaded.star.lines.groupBy("year_month", "region", "line_type").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"), F.sum("line_revenue").alias("revenue")
    )


# the measure that each mart is summed up by
MART_TOTALS = {
    "mart_revenue_trend": "net_revenue",
    "mart_rfm": "monetary",
    "mart_cohort_retention": "active_customers",
    "mart_product_pareto": "net_revenue",
    "mart_return_leakage": "net_revenue",
    "mart_country_performance": "net_revenue",
}


def _published_marts(w: Workspace) -> DataFrame:
    marts = w.loaded.marts.tables()
    sums = [
        marts[name].agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(total).cast("decimal(38,4)")).alias("total")).select(
            F.lit(name).alias("mart"), "rows", "total"
        )
        for name, total in MART_TOTALS.items()
    ]
    return reduce(DataFrame.unionAll, sums)


QUERIES: dict[str, Query] = {
    # sources and cleaning
    "src_raw_union": lambda w: quality.raw_union(w.raw),
    "clean_normalise": lambda w: _plain(w.normalised),
    "clean_backfill": lambda w: _plain(
        cleaning.backfill_description(w.normalised, w.settings, w.store.within("backfill"))
    ),
    "clean_dedup": lambda w: cleaning.drop_exact_duplicates(
        w.normalised, w.settings.duplicate_key
    ).drop(cleaning.ORDINAL),
    "clean_cancellations": _cancellations,
    "clean_line_type": _line_types,
    "clean_quarantine": lambda w: w.cleaned.quarantine(),
    "clean_kept": lambda w: w.cleaned.kept.groupBy("line_type", "is_cancellation").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("quantity").alias("units"),
        F.sum("line_revenue").alias("revenue"),
    ),
    "clean_transactions": lambda w: w.cleaned.transactions(),
    # data-quality report
    "dq_reconciliation": lambda w: quality.row_accounting(w.cleaned),
    "dq_rule_counts": lambda w: quality.rule_counts(w.cleaned),
    "dq_revenue": lambda w: quality.revenue_block(w.cleaned),
    "dq_line_types": lambda w: quality.line_types(w.cleaned.kept),
    "dq_guests": lambda w: quality.guests(w.cleaned.kept),
    "dq_nulls": lambda w: quality.null_counts(w.cleaned.kept),
    "dq_date_range": lambda w: quality.date_range(w.cleaned.kept),
    "dq_quarantine_reasons": lambda w: quality.quarantine_reasons(w.cleaned.quarantined),
    # audit of the raw union
    "audit_readiness": lambda w: quality.readiness_figures(_audit(w), PARTS),
    "audit_column_profile": lambda w: quality.column_profile(_audit(w)),
    "audit_quality_flags": lambda w: quality.quality_flags(_audit(w), w.settings),
    "audit_revenue_month": lambda w: quality.revenue_by_month(_audit(w)),
    "audit_revenue_country": lambda w: quality.revenue_by_country(_audit(w)),
    "audit_stock_codes": lambda w: quality.stock_code_evidence(_audit(w), w.settings),
    # star
    "dim_date": lambda w: w.dimensions.dim_date,
    "dim_customer": lambda w: w.dimensions.customers.table,
    "dim_product": lambda w: w.dimensions.products.table,
    "dim_country": lambda w: w.dimensions.dim_country,
    "fact_sales": lambda w: w.star.fact_sales,
    "star_counts": lambda w: w.star.counts,
    "published_star": _published_star,
    "published_marts": _published_marts,
    # marts
    "mart_revenue_trend": lambda w: w.marts.mart_revenue_trend,
    "mart_rfm": lambda w: w.marts.mart_rfm,
    "mart_cohort_retention": lambda w: w.marts.mart_cohort_retention,
    "mart_product_pareto": lambda w: w.marts.mart_product_pareto,
    "mart_return_leakage": lambda w: w.marts.mart_return_leakage,
    "mart_country_performance": lambda w: w.marts.mart_country_performance,
    "gate_report": _gate_report,
    # business questions
    "q_top_markets": lambda w: reports.top_markets(w.marts.mart_country_performance),
    "q_segments": lambda w: reports.segments_valued(w.marts.mart_rfm),
    "q_bands": lambda w: reports.band_against_tail(w.marts.mart_product_pareto),
    "q_worst_leaks": lambda w: reports.worst_leaks(w.marts.mart_return_leakage),
    # headline figures
    "kpi_totals": lambda w: reports.kpi_totals(w.marts.mart_revenue_trend),
    "kpi_customers": lambda w: reports.kpi_customers(w.marts.mart_rfm),
    "kpi_yoy": lambda w: reports.kpi_year_on_year(w.marts.mart_revenue_trend, w.settings),
    "kpi_latest": lambda w: reports.kpi_latest(w.marts.mart_revenue_trend),
    "period": lambda w: reports.period(w.marts.mart_revenue_trend),
    # panels
    "panel_trend": lambda w: reports.trend_panel(w.marts.mart_revenue_trend),
    "panel_countries": lambda w: reports.country_panel(w.marts.mart_country_performance),
    "panel_regions": lambda w: reports.region_panel(w.marts.mart_country_performance),
    "panel_cohort": lambda w: reports.cohort_panel(w.marts.mart_cohort_retention),
    "rfm_matrix": lambda w: reports.rfm_matrix(w.marts.mart_rfm),
    "rfm_segments": lambda w: reports.rfm_segments(w.marts.mart_rfm),
    "segment_rollup": lambda w: reports.segment_rollup(
        w.marts.mart_rfm, w.settings.slipping_segments
    ),
    "pareto_curve": lambda w: reports.pareto_curve(
        w.marts.mart_product_pareto, w.settings.pareto_curve_points
    ),
    "pareto_band": lambda w: reports.pareto_band(w.marts.mart_product_pareto),
    "same_day_reversals": lambda w: w.reversals,
    "return_driver_rollup": lambda w: reports.return_driver_rollup(
        w.marts.mart_return_leakage, w.settings.top_leakage
    ),
    "return_drivers": lambda w: reports.return_drivers(
        w.marts.mart_return_leakage, w.settings.top_leakage
    ),
    "top_products": lambda w: reports.top_products(
        w.marts.mart_product_pareto, w.settings.top_products
    ),
    "top_products_by_units": lambda w: reports.products_by(
        reports.top_products(w.marts.mart_product_pareto, w.settings.top_products), "units"
    ),
    "mom_series": lambda w: reports.mom_series(w.marts.mart_revenue_trend),
    "market_filter": lambda w: reports.visible_markets(
        w.marts.mart_country_performance, REGION, TOP_MARKETS
    ),
    "segments_by_customers": _sql("SELECT * FROM segments_by(measure => 'customers')"),
    "sql_market_filter": _sql(f"SELECT * FROM market_filter(region => '{REGION}', top => {TOP_MARKETS})"),
    "sql_cohort_depth": _sql(f"SELECT * FROM cohort_depth(depth => {COHORT_DEPTH})"),
    "sql_products_by_units": _sql("SELECT * FROM products_by(measure => 'units')"),
    "cohort_depth": lambda w: reports.cohort_to_depth(w.marts.mart_cohort_retention, COHORT_DEPTH),
    # documented figures
    "adjusted_return_rate": _adjusted,
    "retention_curve": lambda w: reports.retention_curve(w.marts.mart_cohort_retention),
    "negative_skus": lambda w: reports.negative_skus(w.marts.mart_product_pareto),
    "return_rate_outliers": lambda w: reports.return_rate_outliers(
        w.marts.mart_country_performance
    ),
    "season_share": lambda w: reports.season_share(w.marts.mart_revenue_trend, *SEASON),
}


def _bound(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    def call(spark: SparkSession, folder: str) -> DataFrame:
        shared = workspace(spark, folder)
        # a stage is written once even when queries are called from several threads
        with shared.lock:
            return with_double_money(query(shared))

    return call


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bound(query) for name, query in QUERIES.items()}
