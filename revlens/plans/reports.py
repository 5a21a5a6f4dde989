"""Report queries: thin selections over the marts, every one a small frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.config import Settings
from revlens.functions import columns as C
from revlens.operators.star import Star
from revlens.plans.marts import is_cancelled, is_kept, sales_lines


def _count() -> Column:
    return F.count(F.lit(1))


def _mean(column: str) -> Column:
    """Average formed from an exact sum, so the order of the rows cannot show."""
    return C.ratio(F.sum(column), F.count(column))


# The four business questions


def top_markets(countries: DataFrame, rows: int = 10) -> DataFrame:
    """First markets by rank; the share is taken over all markets, not just the ones shown."""
    whole = countries.agg(F.sum("net_revenue")).scalar()
    return (
        countries.orderBy("revenue_rank", "country")
        .limit(rows)
        .select(
            "revenue_rank",
            "country",
            "region",
            C.money(F.col("gross_revenue")).alias("gross_revenue"),
            C.money(F.col("returns")).alias("returns"),
            C.money(F.col("net_revenue")).alias("net_revenue"),
            C.rounded(C.percent(F.col("net_revenue"), whole), 2).alias("pct_of_net_revenue"),
            "orders",
            "customers",
            C.money(F.col("aov")).alias("aov"),
            C.rounded(F.col("return_rate_pct"), 2).alias("return_rate_pct"),
        )
    )


def _segment_sums(rfm: DataFrame) -> DataFrame:
    return rfm.groupBy("segment").agg(
        _count().alias("customers"),
        F.sum("monetary").alias("net"),
        _mean("recency_days").alias("mean_recency"),
        _mean("frequency").alias("mean_orders"),
        _mean("monetary").alias("mean_net"),
    )


def _of_all(column: str) -> Column:
    """Share of the total over all rows; only for frames of a few rows."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return C.rounded(C.percent(F.col(column), F.sum(column).over(everything)), 2)


def segments_valued(rfm: DataFrame) -> DataFrame:
    """Customers, revenue and averages per segment, with shares of the whole book."""
    return (
        _segment_sums(rfm)
        .select(
            "segment",
            "customers",
            _of_all("customers").alias("pct_of_customers"),
            C.money(F.col("net")).alias("net_revenue"),
            _of_all("net").alias("pct_of_net_revenue"),
            C.rounded(F.col("mean_recency"), 1).alias("avg_days_since_order"),
            C.rounded(F.col("mean_orders"), 1).alias("avg_orders"),
            C.money(F.col("mean_net")).alias("avg_net_revenue"),
        )
        .orderBy(F.col("net_revenue").desc(), "segment")
    )


def band_against_tail(pareto: DataFrame) -> DataFrame:
    """Stock codes, units and revenue inside the 80% band against those outside it."""
    bands = pareto.groupBy("in_top_80_band").agg(
        _count().alias("skus"),
        F.sum("units").alias("units"),
        F.sum("net_revenue").alias("net"),
        _mean("net_revenue").alias("mean_net"),
    )
    return bands.orderBy(F.col("in_top_80_band").desc()).select(
        F.when(F.col("in_top_80_band") == 1, "first 80% of revenue")
        .otherwise("the long tail")
        .alias("band"),
        "skus",
        _of_all("skus").alias("pct_of_skus"),
        "units",
        C.money(F.col("net")).alias("net_revenue"),
        _of_all("net").alias("pct_of_net_revenue"),
        C.money(F.col("mean_net")).alias("avg_net_revenue_per_sku"),
    )


def worst_leaks(leakage: DataFrame, rows: int = 5) -> DataFrame:
    """Per grain, the rows that returned the most; the name breaks ties."""
    place = F.row_number().over(Window.partitionBy("grain").orderBy("returns", "grain_value"))
    return (
        leakage.where("gross_revenue > 0")
        .withColumn("leak_rank", place.cast("bigint"))
        .where(F.col("leak_rank") <= rows)
        .select(
            "grain",
            "leak_rank",
            "grain_value",
            C.money(F.col("gross_revenue")).alias("gross_revenue"),
            C.money(F.col("returns")).alias("returns"),
            C.rounded(F.col("return_rate_pct"), 2).alias("return_rate_pct"),
            "return_lines",
        )
        .orderBy("grain", "leak_rank")
    )


# Headline figures


def kpi_totals(trend: DataFrame) -> DataFrame:
    """Totals of the monthly mart; an order seen in two months counts in both."""
    return trend.agg(
        F.sum("gross_revenue").alias("gross"),
        F.sum("returns").alias("back"),
        F.sum("net_revenue").alias("net"),
        F.sum("orders").alias("orders"),
    ).select(
        C.money(F.col("gross")).alias("gross_revenue"),
        C.money(F.col("back")).alias("returns"),
        C.money(F.col("net")).alias("net_revenue"),
        "orders",
        C.rounded(C.percent(-F.col("back"), F.col("gross")), 4).alias("return_rate_pct"),
        C.rounded(C.ratio(F.col("gross"), F.col("orders")), 2).alias("aov"),
    )


def kpi_customers(rfm: DataFrame) -> DataFrame:
    return rfm.agg(
        _count().alias("active_customers"),
        C.money(_mean("monetary")).alias("average_clv"),
        C.rounded(C.percent(F.count_if(F.col("frequency") > 1), _count()), 2).alias(
            "repeat_purchase_rate_pct"
        ),
    )


def kpi_year_on_year(trend: DataFrame, settings: Settings) -> DataFrame:
    """Net revenue of the two configured month windows and the growth between them."""
    month = F.col("year_month")
    sums = trend.agg(
        F.sum(F.when(month.between(*settings.recent_year), F.col("net_revenue"))).alias("recent"),
        F.sum(F.when(month.between(*settings.prior_year), F.col("net_revenue"))).alias("prior"),
    )
    growth = C.percent(F.col("recent") - F.col("prior"), F.col("prior"))
    return sums.select(
        C.money(F.col("recent")).alias("recent_year_net"),
        C.money(F.col("prior")).alias("prior_year_net"),
        C.rounded(growth, 2).alias("revenue_yoy_pct"),
    )


def kpi_latest(trend: DataFrame) -> DataFrame:
    return (
        trend.orderBy(F.col("year_month").desc())
        .limit(1)
        .select("year_month", C.rounded(F.col("net_revenue_mom_pct"), 2).alias("revenue_mom_pct"))
    )


def period(trend: DataFrame) -> DataFrame:
    return trend.agg(
        F.min("year_month").alias("start_month"), F.max("year_month").alias("end_month")
    )


# Customer panels


def rfm_matrix(rfm: DataFrame) -> DataFrame:
    return (
        rfm.groupBy("r_score", "f_score")
        .agg(_count().alias("customers"), C.money(F.sum("monetary")).alias("net_revenue"))
        .orderBy("r_score", "f_score")
    )


def rfm_segments(rfm: DataFrame) -> DataFrame:
    return (
        _segment_sums(rfm)
        .select(
            "segment",
            "customers",
            C.money(F.col("net")).alias("net_revenue"),
            C.money(F.col("mean_net")).alias("average_value"),
            C.rounded(F.col("mean_recency"), 1).alias("average_recency_days"),
            C.rounded(F.col("mean_orders"), 1).alias("average_orders"),
            _of_all("net").alias("revenue_share_pct"),
            _of_all("customers").alias("customer_share_pct"),
        )
        .orderBy(F.col("net_revenue").desc(), "segment")
    )


def segments_by(segments: DataFrame, measure: str) -> DataFrame:
    return segments.orderBy(F.col(measure).desc(), "segment")


def segment_rollup(rfm: DataFrame, slipping: Sequence[str]) -> DataFrame:
    slips = F.col("segment").isin(list(slipping))
    return rfm.agg(
        C.money(F.sum("monetary")).alias("attributable_revenue"),
        F.count_if(slips).alias("slipping_customers"),
        C.money(C.sum_when(slips, F.col("monetary"))).alias("slipping_revenue"),
    )


def cohort_panel(cohorts: DataFrame) -> DataFrame:
    return cohorts.select(
        "cohort_month",
        "month_offset",
        "cohort_size",
        "active_customers",
        C.rounded(F.col("retention_pct"), 2).alias("retention_pct"),
    ).orderBy("cohort_month", "month_offset")


def cohort_to_depth(cohorts: DataFrame, depth: int) -> DataFrame:
    """Cells up to `depth` months after the first purchase."""
    return cohort_panel(cohorts.where(F.col("month_offset") <= depth))


def retention_curve(cohorts: DataFrame) -> DataFrame:
    """Mean retention at each month offset over the cohorts that reach it."""
    return (
        cohorts.groupBy("month_offset")
        .agg(
            _count().alias("cohorts"),
            # the percentages carry four decimals, so they add up exactly as decimals
            C.rounded(
                C.ratio(F.sum(F.col("retention_pct").cast("decimal(18,4)")), _count()), 4
            ).alias("avg_retention_pct"),
        )
        .orderBy("month_offset")
    )


# Product panels


def pareto_curve(pareto: DataFrame, points: int) -> DataFrame:
    """About `points` evenly spaced ranks of the running share, plus the first and the last."""
    rank = F.col("revenue_rank")
    counted = pareto.select("revenue_rank", "cumulative_share_pct").withColumn(
        "total", pareto.agg(F.max("revenue_rank")).scalar()
    )
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("total") / F.lit(points)))
    return (
        counted.where((rank % step == 0) | (rank == 1) | (rank == F.col("total")))
        .select(
            "revenue_rank",
            C.rounded(F.col("cumulative_share_pct"), 3).alias("cumulative_share_pct"),
        )
        .orderBy("revenue_rank")
    )


def pareto_band(pareto: DataFrame) -> DataFrame:
    """Where the running share first reaches 80%, and the size of the band that carries it."""
    banded = F.col("in_top_80_band") == 1
    return pareto.agg(
        _count().alias("total_skus"),
        F.min(F.when(F.col("cumulative_share_pct") >= 80.0, F.col("revenue_rank"))).alias(
            "rank_at_80"
        ),
        F.count_if(banded).alias("band_skus"),
        C.money(F.sum(F.when(banded, F.col("net_revenue")))).alias("band_net_revenue"),
    ).select(
        "*",
        F.coalesce(
            C.rounded(C.percent(F.col("band_skus"), F.col("total_skus")), 2), F.lit(0.0)
        ).alias("band_share_pct"),
        (F.col("total_skus") - F.col("band_skus")).alias("tail_skus"),
    )


def top_products(pareto: DataFrame, rows: int) -> DataFrame:
    return (
        pareto.where(F.col("revenue_rank") <= rows)
        .select(
            "revenue_rank",
            "stock_code",
            "description",
            C.money(F.col("net_revenue")).alias("net_revenue"),
            "units",
            "orders",
        )
        .orderBy("revenue_rank")
    )


def products_by(products: DataFrame, measure: str) -> DataFrame:
    """The same leading products in another order, with their place in it."""
    place = F.row_number().over(Window.orderBy(F.col(measure).desc(), "revenue_rank"))
    return products.withColumn("place", place.cast("bigint")).orderBy("place")


def negative_skus(pareto: DataFrame) -> DataFrame:
    """Stock codes that lost money over the whole period."""
    return pareto.where("net_revenue < 0").agg(
        _count().alias("skus"), C.money(F.sum("net_revenue")).alias("net_revenue")
    )


def return_drivers(leakage: DataFrame, rows: int) -> DataFrame:
    return (
        _leading_returns(leakage, rows)
        .select(
            F.col("grain_value").alias("stock_code"),
            C.money(F.col("returns")).alias("returns"),
            C.rounded(F.col("return_rate_pct"), 2).alias("return_rate_pct"),
            "return_lines",
        )
        .orderBy("returns", "stock_code")
    )


def return_driver_rollup(leakage: DataFrame, rows: int) -> DataFrame:
    """What the leading return drivers add up to, and their share of all product returns."""
    whole = leakage.where("grain = 'product'").agg(F.sum("returns")).scalar()
    return (
        _leading_returns(leakage, rows)
        .agg(F.sum("returns").alias("leading"))
        .select(
            C.money(F.col("leading")).alias("returns"),
            C.rounded(C.percent(F.col("leading"), whole), 2).alias("share_of_returns_pct"),
        )
    )


def _leading_returns(leakage: DataFrame, rows: int) -> DataFrame:
    return (
        leakage.where("grain = 'product' AND returns < 0")
        .orderBy("returns", "grain_value")
        .limit(rows)
    )


def same_day_reversals(star: Star, settings: Settings) -> DataFrame:
    """Cancelled lines that take back a sale made on the same day.

    A cancelled line counts when some kept line of the same customer, product and day carries the
    opposite quantity. Turning a cancelled line's sign round puts it under the same grouping key as
    the sale it undoes, so one aggregation finds the pairs and no line is ever matched with another.
    """
    sign = F.when(is_cancelled(), -F.col("quantity")).otherwise(F.col("quantity"))
    groups = (
        sales_lines(star, settings)
        .groupBy("customer_key", "product_key", F.to_date("invoice_ts").alias("day"), sign.alias("sold"))
        .agg(
            F.count_if(is_kept()).alias("sales"),
            F.count_if(is_cancelled()).alias("cancelled"),
            C.sum_when(is_cancelled(), F.col("line_revenue")).alias("value"),
        )
    )
    undone = F.col("sales") > 0
    return groups.agg(
        F.coalesce(F.sum(F.when(undone, F.col("cancelled"))), F.lit(0).cast("bigint")).alias("lines"),
        F.sum(F.when(undone & (F.col("cancelled") > 0), F.col("value"))).alias("undone"),
        F.sum("value").alias("whole"),
    ).select(
        "lines",
        C.money(F.col("undone")).alias("value"),
        C.rounded(C.percent(F.col("undone"), F.col("whole")), 2).alias("share_of_returns_pct"),
    )


def adjusted_return_rate(trend: DataFrame, reversals: DataFrame) -> DataFrame:
    """The return rate once same-day reversals no longer count as returns."""
    undone = reversals.select(F.coalesce(F.col("value"), F.lit(0.0)).cast("decimal(28,2)")).scalar()
    sums = trend.agg(F.sum("gross_revenue").alias("gross"), F.sum("returns").alias("back"))
    genuine = F.col("back") - F.col("undone")
    return sums.withColumn("undone", undone).select(
        C.money(F.col("gross")).alias("gross_revenue"),
        C.money(F.col("back")).alias("returns"),
        C.money(F.col("undone")).alias("reversals"),
        C.money(genuine).alias("genuine_returns"),
        C.rounded(C.percent(-F.col("back"), F.col("gross")), 4).alias("return_rate_pct"),
        C.rounded(C.percent(-genuine, F.col("gross")), 4).alias("genuine_return_rate_pct"),
    )


# Trend and market panels


def trend_panel(trend: DataFrame) -> DataFrame:
    return trend.select(
        "year_month",
        C.money(F.col("gross_revenue")).alias("gross_revenue"),
        C.money(F.col("returns")).alias("returns"),
        C.money(F.col("net_revenue")).alias("net_revenue"),
        "orders",
        "active_customers",
        C.money(F.col("aov")).alias("aov"),
        C.rounded(F.col("return_rate_pct"), 2).alias("return_rate_pct"),
        C.rounded(F.col("net_revenue_mom_pct"), 2).alias("net_revenue_mom_pct"),
    ).orderBy("year_month")


def mom_series(trend: DataFrame) -> DataFrame:
    """Month-on-month steps; the last month is flagged because it may be partial."""
    last = trend.agg(F.max("year_month")).scalar()
    return (
        trend.where(F.col("net_revenue_mom_pct").isNotNull())
        .select(
            "year_month",
            C.rounded(F.col("net_revenue_mom_pct"), 2).alias("net_revenue_mom_pct"),
            (F.col("year_month") == last).cast("int").alias("is_partial"),
        )
        .orderBy("year_month")
    )


def season_share(trend: DataFrame, first_month: int, last_month: int) -> DataFrame:
    """Net revenue of a range of calendar months, over all years, as a share of the total."""
    month = F.substring("year_month", 6, 2).cast("int")
    return trend.agg(
        F.sum(F.when(month.between(first_month, last_month), F.col("net_revenue"))).alias("season"),
        F.sum("net_revenue").alias("whole"),
    ).select(
        C.money(F.col("season")).alias("season_net_revenue"),
        C.rounded(C.percent(F.col("season"), F.col("whole")), 2).alias("season_share_pct"),
    )


def country_panel(countries: DataFrame) -> DataFrame:
    return countries.select(
        "country",
        "region",
        C.money(F.col("gross_revenue")).alias("gross_revenue"),
        C.money(F.col("net_revenue")).alias("net_revenue"),
        "orders",
        "customers",
        C.money(F.col("aov")).alias("aov"),
        C.rounded(F.col("return_rate_pct"), 2).alias("return_rate_pct"),
        "revenue_rank",
    ).orderBy("revenue_rank", "country")


def region_panel(countries: DataFrame) -> DataFrame:
    """Regions add up their markets: a customer of two markets counts in both."""
    return (
        countries.groupBy("region")
        .agg(
            C.money(F.sum("net_revenue")).alias("net_revenue"),
            F.sum("customers").alias("customers"),
        )
        .orderBy(F.col("net_revenue").desc(), "region")
    )


def visible_markets(countries: DataFrame, region: str = "all", top: int = 0) -> DataFrame:
    """The market panel for one region (or all), cut to the first `top` rows; 0 keeps all."""
    panel = country_panel(countries)
    if region != "all":
        panel = panel.where(F.col("region") == region)
    return panel.limit(top) if top > 0 else panel


def return_rate_outliers(countries: DataFrame, minimum_orders: int = 100) -> DataFrame:
    return (
        countries.where(F.col("orders") >= minimum_orders)
        .select(
            "country",
            "orders",
            C.rounded(F.col("return_rate_pct"), 2).alias("return_rate_pct"),
        )
        .orderBy(F.col("return_rate_pct").desc(), "country")
    )
