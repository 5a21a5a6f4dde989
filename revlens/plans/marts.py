"""The six marts, computed from two staged summaries of the sales lines.

`order_heads` holds one row per invoice (and month, customer, market), `product_totals` one per
stock code. The lines are scanned once for each; every mart then works on the far smaller summary.
Money stays an exact decimal here and turns into a double only on output.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.config import Settings
from revlens.functions import columns as C
from revlens.functions.ranking import sorted_stage, tiles_by_measure
from revlens.operators.star import Star
from revlens.sources.stages import StageStore

TILES = 5
BAND_PCT = 80.0
MART_NAMES = (
    "mart_revenue_trend",
    "mart_rfm",
    "mart_cohort_retention",
    "mart_product_pareto",
    "mart_return_leakage",
    "mart_country_performance",
)


def is_kept() -> Column:
    return F.col("is_cancellation") == 0


def is_cancelled() -> Column:
    return F.col("is_cancellation") == 1


def kept_orders() -> Column:
    return F.count_distinct(F.when(is_kept(), F.col("invoice_no")))


def with_customers(measures: DataFrame, heads: DataFrame, grain: str, name: str) -> DataFrame:
    """`measures`, one row per `grain`, with the number of distinct customers of `heads` as `name`.

    Customer keys are dense, so a group is a few bitmaps of 32,768 keys each, filled in the tasks
    before they move. A second distinct count beside the one of orders would expand every row instead.
    """
    bits = heads.groupBy(grain, F.bitmap_bucket_number("customer_key").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("customer_key")).alias("bits")
    )
    counted = bits.groupBy(grain).agg(F.sum(F.bitmap_count("bits")).alias(name))
    # groups only from here on; stacking them lets a null group meet its like
    rest = [item for item in measures.columns if item != grain]
    stacked = measures.unionByName(counted, allowMissingColumns=True)
    return stacked.groupBy(grain).agg(
        *[F.max(item).alias(item) for item in rest], F.coalesce(F.max(name), F.lit(0).cast("bigint")).alias(name)
    )


def return_rate() -> Column:
    return C.percent(-F.col("returns"), F.col("gross_revenue"))


def sales_lines(star: Star, settings: Settings) -> DataFrame:
    return star.lines.where(F.col("line_type").isin(list(settings.net_line_types)))


def order_heads(star: Star, settings: Settings) -> DataFrame:
    """Sales lines folded to one row per invoice, month, customer and market."""
    grain = [
        "year_month",
        "invoice_no",
        "is_cancellation",
        "customer_key",
        "customer_id",
        "country",
        "region",
    ]
    return (
        sales_lines(star, settings)
        .groupBy(*grain)
        .agg(
            F.sum("line_revenue").alias("revenue"),
            F.max("invoice_ts").alias("last_ts"),
            F.count(F.lit(1)).alias("lines"),
        )
    )


def product_totals(star: Star, settings: Settings) -> DataFrame:
    """Sales lines folded to one row per stock code.

    Orders are counted apart, over code and invoice alone: counted beside the sums, every invoice of a code
    would carry all of them through the tasks.
    """
    grain = ["product_key", "stock_code", "line_type"]
    lines = sales_lines(star, settings)
    sums = lines.groupBy(*grain).agg(
        C.sum_when(is_kept(), F.col("line_revenue")).alias("gross_revenue"),
        C.sum_when(is_cancelled(), F.col("line_revenue")).alias("returns"),
        F.sum("quantity").alias("units"),
        F.sum("is_cancellation").cast("bigint").alias("return_lines"),
    )
    bought = lines.where(is_kept() & F.col("invoice_no").isNotNull()).select("product_key", "invoice_no").distinct()
    orders = bought.groupBy(F.col("product_key").alias("bought_key")).agg(F.count(F.lit(1)).alias("orders"))
    return sums.join(orders, F.col("product_key").eqNullSafe(F.col("bought_key")), "left").select(
        *grain,
        "gross_revenue",
        "returns",
        "units",
        "return_lines",
        F.coalesce("orders", F.lit(0).cast("bigint")).alias("orders"),
    )


def revenue_trend(heads: DataFrame, settings: Settings) -> DataFrame:
    known = F.col("customer_key") != settings.unknown_customer_key
    measures = heads.groupBy("year_month").agg(
        C.sum_when(is_kept(), F.col("revenue")).alias("gross_revenue"),
        C.sum_when(is_cancelled(), F.col("revenue")).alias("returns"),
        F.sum("revenue").alias("net_revenue"),
        kept_orders().alias("orders"),
    )
    monthly = with_customers(measures, heads.where(is_kept() & known), "year_month", "active_customers")
    # the window spans months only
    previous = F.lag("net_revenue").over(Window.orderBy("year_month"))
    return (
        monthly.withColumn("previous_net_revenue", previous)
        .withColumn("net_revenue_mom_delta", F.col("net_revenue") - F.col("previous_net_revenue"))
        .select(
            "year_month",
            "gross_revenue",
            "returns",
            "net_revenue",
            "orders",
            "active_customers",
            C.ratio(F.col("gross_revenue"), F.col("orders")).alias("aov"),
            return_rate().alias("return_rate_pct"),
            "net_revenue_mom_delta",
            C.percent(F.col("net_revenue_mom_delta"), F.col("previous_net_revenue")).alias(
                "net_revenue_mom_pct"
            ),
        )
    )


def segment_of(r: Column, f: Column, m: Column) -> Column:
    """The first rule that holds names the segment."""
    return (
        F.when((r >= 4) & (f >= 4), "Champions")
        .when((r >= 3) & (f >= 3), "Loyal")
        .when(r >= 3, "Potential Loyalist")
        .when((f >= 4) & (m >= 4), "Cannot Lose Them")
        .when(f >= 3, "At Risk")
        .when(r == 2, "Hibernating")
        .otherwise("Lost")
    )


def rfm(heads: DataFrame, star: Star, settings: Settings, store: StageStore) -> DataFrame:
    as_of = star.lines.agg(F.to_date(F.max("invoice_ts"))).scalar()
    customers = (
        heads.where(F.col("customer_key") != settings.unknown_customer_key)
        .groupBy("customer_key", "customer_id")
        .agg(
            F.max(F.when(is_kept(), F.col("last_ts"))).alias("last_purchase_ts"),
            kept_orders().alias("frequency"),
            F.sum("revenue").alias("monetary"),
        )
        .where(F.col("last_purchase_ts").isNotNull())
    )
    measured = store.save(
        customers.select(
            "customer_key",
            "customer_id",
            F.datediff(as_of, F.to_date("last_purchase_ts")).cast("bigint").alias("recency_days"),
            "frequency",
            "monetary",
        ),
        "rfm_measured",
    )
    tiles = tiles_by_measure(
        store,
        measured,
        "customer_key",
        ["recency_days", "frequency", "monetary"],
        TILES,
        "rfm_order",
    )
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return measured.select(
        "*",
        # the fewer days since the last order, the better the score
        (F.lit(TILES + 1) - tiles["recency_days"]).cast("bigint").alias("r_score"),
        tiles["frequency"].cast("bigint").alias("f_score"),
        tiles["monetary"].cast("bigint").alias("m_score"),
    ).select("*", F.concat(r, f, m).alias("rfm_cell"), segment_of(r, f, m).alias("segment"))


def cohort_retention(heads: DataFrame, star: Star, settings: Settings) -> DataFrame:
    """Cohort by month grid. Each customer contributes one bounded set of active months."""
    customers = (
        heads.where(is_kept() & (F.col("customer_key") != settings.unknown_customer_key))
        .groupBy("customer_key")
        .agg(F.collect_set("year_month").alias("months"))
    )
    active = (
        customers.select(F.array_min("months").alias("cohort_month"), F.explode("months").alias("month"))
        .groupBy("cohort_month", "month")
        .agg(F.count(F.lit(1)).alias("customers"))
    )
    # from here on there are only months against months
    calendar = star.dim_date.agg(F.array_sort(F.collect_set("year_month"))).scalar()
    cohorts = active.groupBy("cohort_month").agg(
        F.map_from_entries(F.collect_list(F.struct("month", "customers"))).alias("by_month")
    )
    cells = cohorts.withColumn("calendar", calendar).select(
        "cohort_month",
        F.explode(F.filter("calendar", lambda month: month >= F.col("cohort_month"))).alias("month"),
        F.col("by_month")[F.col("cohort_month")].alias("cohort_size"),
        "by_month",
    )
    offset = C.month_index(F.col("month")) - C.month_index(F.col("cohort_month"))
    return cells.select(
        "cohort_month",
        offset.cast("bigint").alias("month_offset"),
        "cohort_size",
        F.coalesce(F.col("by_month")[F.col("month")], F.lit(0).cast("bigint")).alias(
            "active_customers"
        ),
    ).withColumn(
        "retention_pct", C.rounded(C.percent(F.col("active_customers"), F.col("cohort_size")), 4)
    )


def product_pareto(totals: DataFrame, star: Star, store: StageStore) -> DataFrame:
    """The catalogue in revenue order with its running share; goods only."""
    goods = totals.where("line_type = 'product'").select(
        "product_key",
        "stock_code",
        (F.col("gross_revenue") + F.col("returns")).cast("decimal(28,4)").alias("net_revenue"),
        "units",
        "orders",
    )
    ordered = sorted_stage(
        store,
        goods,
        [F.col("net_revenue").desc(), F.col("product_key").asc()],
        "pareto_order",
        total="net_revenue",
    )
    whole = F.lit(ordered.sum_offsets[-1]).cast("decimal(38,4)")
    ranked = ordered.table.select(
        "*",
        ordered.row_number().alias("revenue_rank"),
        ordered.running_sum("net_revenue").alias("running_revenue"),
    )
    share, running = F.col("revenue_share_pct"), F.col("cumulative_share_pct")
    shared = ranked.select(
        "product_key",
        "stock_code",
        "net_revenue",
        "units",
        "orders",
        "revenue_rank",
        C.percent(F.col("net_revenue"), whole).alias("revenue_share_pct"),
        C.percent(F.col("running_revenue"), whole).alias("cumulative_share_pct"),
    )
    # judged by the share before it, so the row that reaches 80% is inside
    in_band = F.when(running - share < BAND_PCT, 1).otherwise(0)
    return shared.join(star.dim_product.select("product_key", "description"), "product_key").select(
        "product_key",
        "stock_code",
        "description",
        "net_revenue",
        "units",
        "orders",
        "revenue_rank",
        "revenue_share_pct",
        "cumulative_share_pct",
        in_band.alias("in_top_80_band"),
    )


def return_leakage(heads: DataFrame, totals: DataFrame) -> DataFrame:
    """Gross, returns and return lines by month, by market and by stock code."""
    by_head = heads.groupingSets(
        [["year_month"], ["country"]], "year_month", "country"
    ).agg(
        F.grouping("year_month").alias("is_country"),
        C.sum_when(is_kept(), F.col("revenue")).alias("gross_revenue"),
        C.sum_when(is_cancelled(), F.col("revenue")).alias("returns"),
        F.sum(F.when(is_cancelled(), F.col("lines")).otherwise(0)).alias("return_lines"),
    )
    measures = ["gross_revenue", "returns", "return_lines"]
    stacked = by_head.select(
        F.when(F.col("is_country") == 1, "country").otherwise("month").alias("grain"),
        F.when(F.col("is_country") == 1, F.col("country"))
        .otherwise(F.col("year_month"))
        .alias("grain_value"),
        *measures,
    ).unionByName(
        totals.select(F.lit("product").alias("grain"), F.col("stock_code").alias("grain_value"), *measures)
    )
    return stacked.select(
        "grain",
        "grain_value",
        "gross_revenue",
        "returns",
        (F.col("gross_revenue") + F.col("returns")).alias("net_revenue"),
        return_rate().alias("return_rate_pct"),
        "return_lines",
    )


def country_performance(heads: DataFrame, settings: Settings) -> DataFrame:
    # any sales line makes a customer of the market, whereas the trend asks for a kept one
    known = F.col("customer_key") != settings.unknown_customer_key
    measures = heads.groupBy(F.struct("country", "region").alias("market")).agg(
        C.sum_when(is_kept(), F.col("revenue")).alias("gross_revenue"),
        C.sum_when(is_cancelled(), F.col("revenue")).alias("returns"),
        F.sum("revenue").alias("net_revenue"),
        kept_orders().alias("orders"),
    )
    buyers = heads.where(known).withColumn("market", F.struct("country", "region"))
    markets = with_customers(measures, buyers, "market", "customers").select("market.*", "*").drop("market")
    # the window spans markets only, which the region map bounds
    place = F.rank().over(Window.orderBy(F.col("gross_revenue").desc())).cast("bigint")
    return markets.select(
        "*",
        C.ratio(F.col("gross_revenue"), F.col("orders")).alias("aov"),
        return_rate().alias("return_rate_pct"),
        place.alias("revenue_rank"),
    )


class Marts:
    """The marts over one star, each evaluated once into a stage table on first use."""

    def __init__(self, star: Star, settings: Settings, store: StageStore) -> None:
        self.star = star
        self.settings = settings
        self.store = store

    @classmethod
    def from_tables(
        cls, star: Star, settings: Settings, store: StageStore, tables: Mapping[str, DataFrame]
    ) -> Marts:
        """Marts that are there already; only the summaries below them would be computed, if asked for."""
        marts = cls(star, settings, store)
        for name in MART_NAMES:
            marts.__dict__[name] = tables[name]
        return marts

    @cached_property
    def order_heads(self) -> DataFrame:
        return self.store.save(order_heads(self.star, self.settings), "order_heads")

    @cached_property
    def product_totals(self) -> DataFrame:
        return self.store.save(product_totals(self.star, self.settings), "product_totals")

    @cached_property
    def mart_revenue_trend(self) -> DataFrame:
        return self._staged("mart_revenue_trend", revenue_trend(self.order_heads, self.settings))

    @cached_property
    def mart_rfm(self) -> DataFrame:
        return self._staged(
            "mart_rfm", rfm(self.order_heads, self.star, self.settings, self.store)
        )

    @cached_property
    def mart_cohort_retention(self) -> DataFrame:
        return self._staged(
            "mart_cohort_retention", cohort_retention(self.order_heads, self.star, self.settings)
        )

    @cached_property
    def mart_product_pareto(self) -> DataFrame:
        return self._staged(
            "mart_product_pareto", product_pareto(self.product_totals, self.star, self.store)
        )

    @cached_property
    def mart_return_leakage(self) -> DataFrame:
        return self._staged(
            "mart_return_leakage", return_leakage(self.order_heads, self.product_totals)
        )

    @cached_property
    def mart_country_performance(self) -> DataFrame:
        return self._staged(
            "mart_country_performance", country_performance(self.order_heads, self.settings)
        )

    def tables(self) -> Mapping[str, DataFrame]:
        return {name: getattr(self, name) for name in MART_NAMES}

    def _staged(self, name: str, frame: DataFrame) -> DataFrame:
        return self.store.save(frame, name)
