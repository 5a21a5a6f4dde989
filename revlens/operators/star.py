"""Star-schema builders: calendar, customers, products, markets and the sales fact."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens import schemas
from revlens.config import Settings
from revlens.functions import columns as C
from revlens.functions.joins import attach
from revlens.functions.modal import modal_of
from revlens.functions.ranking import sorted_stage
from revlens.operators.cleaning import SALE_KEY, number_sales
from revlens.sources.stages import StageStore

LINE_COLUMNS = (
    "sale_key",
    "invoice_no",
    "date_key",
    "year_month",
    "invoice_ts",
    "customer_key",
    "customer_id",
    "product_key",
    "stock_code",
    "line_type",
    "country_key",
    "country",
    "region",
    "quantity",
    "unit_price",
    "line_revenue",
    "is_cancellation",
)


# the keys of the fact and the dimensions they lead to
FACT_KEYS = {
    "date_key": "dim_date",
    "customer_key": "dim_customer",
    "product_key": "dim_product",
    "country_key": "dim_country",
}


def date_key(ts: Column) -> Column:
    return (F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)).cast("int")


def calendar(bounds: DataFrame, first: str, last: str) -> DataFrame:
    """Every day between the two timestamps of a one-row frame, both days included."""
    days = bounds.select(
        F.explode(F.sequence(F.to_date(first), F.to_date(last), F.expr("interval 1 day"))).alias("date")
    )
    weekday = (F.weekday("date") + 1).cast("int")
    return days.select(
        date_key(F.col("date")).alias("date_key"),
        "date",
        F.year("date").alias("year"),
        F.quarter("date").alias("quarter"),
        F.month("date").alias("month"),
        F.date_format("date", "MMMM").alias("month_name"),
        C.year_month(F.col("date")).alias("year_month"),
        F.weekofyear("date").alias("iso_week"),
        weekday.alias("day_of_week"),
        F.date_format("date", "EEEE").alias("day_name"),
        (weekday >= 6).cast("int").alias("is_weekend"),
    )


def build_dim_date(lines: DataFrame) -> DataFrame:
    bounds = lines.agg(F.min("invoice_ts").alias("first"), F.max("invoice_ts").alias("last"))
    return calendar(bounds.where("first IS NOT NULL"), "first", "last")


def customer_spans(lines: DataFrame) -> DataFrame:
    """First and last purchase and home market of every identified customer."""
    per_market = (
        lines.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id", "country")
        .agg(
            F.min("invoice_ts").alias("first_ts"),
            F.max("invoice_ts").alias("last_ts"),
            F.count(F.lit(1)).alias("lines"),
        )
    )
    return per_market.groupBy("customer_id").agg(
        F.min("first_ts").alias("first_purchase_ts"),
        F.max("last_ts").alias("last_purchase_ts"),
        modal_of("country", "lines").alias("home_country"),
        F.sum("lines").alias("lines"),
    )


@dataclass(frozen=True)
class KeyedDimension:
    """A dimension, and the lookup from natural to surrogate key with the lines behind each key."""

    table: DataFrame
    keys: DataFrame


def build_dim_customer(lines: DataFrame, settings: Settings, store: StageStore) -> KeyedDimension:
    """Identified customers keyed 1..n by id, plus the unknown member guests point to."""
    ordered = sorted_stage(
        store, customer_spans(lines), [F.col("customer_id").asc()], "customers"
    )
    numbered = ordered.numbered("customer_key")
    # elapsed whole days, unlike the calendar days recency is measured in
    tenure = F.extract(F.lit("DAY"), F.col("last_purchase_ts") - F.col("first_purchase_ts"))
    known = numbered.select(
        "customer_key",
        "customer_id",
        "first_purchase_ts",
        "last_purchase_ts",
        tenure.cast("int").alias("tenure_days"),
        "home_country",
        F.lit(0).alias("is_guest"),
    )
    unknown = {
        "customer_key": F.lit(settings.unknown_customer_key).cast("bigint"),
        "is_guest": F.lit(1),
    }
    guest = store.spark.range(1).select(
        *[
            unknown.get(item.name, F.lit(None)).cast(item.dataType).alias(item.name)
            for item in schemas.DIM_CUSTOMER.fields
        ]
    )
    table = store.save(guest.unionByName(known), "dim_customer")
    keys = numbered.select(
        F.col("customer_id").alias("dim_id"), F.col("customer_key").alias("known_key"), "lines"
    )
    return KeyedDimension(table, keys)


def refuse_any(offending: DataFrame, what: str, store: StageStore) -> None:
    """Raise if there is any row; the message has their number, the first and where all of them are."""
    count = offending.count()
    if count:
        listed = offending.orderBy(*offending.columns)
        store.save(listed, "refused")
        first = listed.first()[0]
        raise ValueError(f"{count} {what}, the first {first!r}, all under {store.path('refused')}")


def build_dim_product(lines: DataFrame, store: StageStore) -> KeyedDimension:
    """One row per stock code; a code seen under two line types is an error."""
    counted = lines.groupBy("stock_code", "description", "line_type").agg(
        F.count(F.lit(1)).alias("lines")
    )
    codes = counted.groupBy("stock_code").agg(
        modal_of("description", "lines").alias("description"),
        F.min("line_type").alias("line_type"),
        F.max("line_type").alias("other_type"),
        F.sum("lines").alias("lines"),
    )
    ordered = sorted_stage(store, codes, [F.col("stock_code").asc_nulls_last()], "products")
    torn = ordered.table.where(F.col("line_type") != F.col("other_type"))
    refuse_any(torn.select("stock_code"), "stock codes with more than one line type", store)
    numbered = ordered.numbered("product_key")
    table = numbered.select("product_key", "stock_code", "description", "line_type")
    keys = numbered.select(F.col("stock_code").alias("dim_code"), "product_key", "lines")
    return KeyedDimension(table, keys)


def build_dim_country(lines: DataFrame, regions: Mapping[str, str], store: StageStore) -> DataFrame:
    """One row per market with its region; a market without a region is an error.

    The check bounds this dimension by the size of the region map, which is what makes it safe to
    number in one window and to broadcast.
    """
    markets = lines.select("country").distinct()
    lookup = F.create_map(*[F.lit(item) for pair in regions.items() for item in pair])
    placed = store.save(markets.withColumn("region", lookup[F.col("country")]), "markets")
    refuse_any(placed.where(F.col("region").isNull()).select("country"), "markets with no region", store)
    key = F.row_number().over(Window.orderBy("country")).cast("bigint")
    return placed.select(key.alias("country_key"), "country", "region")


def build_lines(
    numbered: DataFrame,
    customer_keys: DataFrame,
    product_keys: DataFrame,
    dim_country: DataFrame,
    settings: Settings,
) -> DataFrame:
    """The fact at full width.

    Line type, month, market and customer id ride along, so no mart joins a dimension back on.
    """
    bound, spread = settings.broadcast_bytes, [SALE_KEY]
    keyed = attach(
        numbered, product_keys, F.col("stock_code"), "dim_code", bound, spread, weight="lines"
    )
    keyed = attach(
        keyed, customer_keys, F.col("customer_id"), "dim_id", bound, spread, weight="lines"
    )
    keyed = keyed.join(F.broadcast(dim_country), "country", "left")
    guest_key = F.lit(settings.unknown_customer_key).cast("bigint")
    customer_key = F.when(F.col("customer_id").isNull(), guest_key).otherwise(F.col("known_key"))
    return (
        keyed.withColumn("customer_key", customer_key)
        .withColumn("date_key", date_key(F.col("invoice_ts")))
        .withColumn("year_month", C.year_month(F.col("invoice_ts")))
        .withColumn("is_cancellation", F.col("is_cancellation").cast("int"))
        .select(*LINE_COLUMNS)
    )


def fact_figures() -> dict[str, Column]:
    """What the gates ask of the fact, as the write of it can count it."""
    anything_null = F.lit(False)
    for key in FACT_KEYS:
        anything_null = anything_null | F.col(key).isNull()
    return {"rows": F.count(F.lit(1)), "revenue": F.sum("line_revenue"), "null_keys": F.count_if(anything_null)}


def sales_figures(settings: Settings) -> dict[str, Column]:
    """Gross, returns and net of the sales lines."""
    sales = F.col("line_type").isin(list(settings.net_line_types))
    kept = F.col("is_cancellation") == 0
    return {
        "gross_revenue": C.sum_when(sales & kept, F.col("line_revenue")),
        "returns": C.sum_when(sales & ~kept, F.col("line_revenue")),
        "net_revenue": C.sum_when(sales, F.col("line_revenue")),
    }


@dataclass(frozen=True)
class Star:
    """Four dimensions, the fact, and the fact at full width for the marts."""

    dim_date: DataFrame
    dim_customer: DataFrame
    dim_product: DataFrame
    dim_country: DataFrame
    fact_sales: DataFrame
    lines: DataFrame
    # the figures of the fact as it was written; none where it was not written by this run
    written: Mapping[str, object] | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {
            "dim_date": self.dim_date,
            "dim_customer": self.dim_customer,
            "dim_product": self.dim_product,
            "dim_country": self.dim_country,
            "fact_sales": self.fact_sales,
        }

    @cached_property
    def counts(self) -> DataFrame:
        """Rows per table, one row each."""
        frames = [
            frame.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
            for name, frame in self.tables().items()
        ]
        result = frames[0]
        for frame in frames[1:]:
            result = result.unionByName(frame)
        return result


class Dimensions:
    """The dimensions of numbered lines, each built on first use, and the star that takes all of them."""

    def __init__(self, numbered: DataFrame, settings: Settings, store: StageStore) -> None:
        self.numbered = numbered
        self.settings = settings
        self.store = store

    @cached_property
    def dim_date(self) -> DataFrame:
        return self.store.save(build_dim_date(self.numbered), "dim_date")

    @cached_property
    def customers(self) -> KeyedDimension:
        return build_dim_customer(self.numbered, self.settings, self.store)

    @cached_property
    def products(self) -> KeyedDimension:
        return build_dim_product(self.numbered, self.store)

    @cached_property
    def dim_country(self) -> DataFrame:
        markets = build_dim_country(self.numbered, self.settings.country_regions, self.store)
        return self.store.save(markets, "dim_country")

    def star(self) -> Star:
        customers, products, settings = self.customers, self.products, self.settings
        wide = build_lines(self.numbered, customers.keys, products.keys, self.dim_country, settings)
        lines, written = self.store.save_observed(wide, "fact_lines", fact_figures() | sales_figures(settings))
        fact = lines.select(*schemas.FACT_SALES.names)
        return Star(self.dim_date, customers.table, products.table, self.dim_country, fact, lines, written)


def build_star(transactions: DataFrame, settings: Settings, store: StageStore) -> Star:
    """All five tables; transactions that carry no sale key yet are numbered first."""
    numbered = transactions
    if SALE_KEY not in transactions.columns:
        numbered = number_sales(transactions, store).numbered(SALE_KEY)
    return Dimensions(numbered, settings, store).star()


def star_from_tables(tables: Mapping[str, DataFrame], settings: Settings) -> Star:
    """A star over tables that already exist; the wide lines come from joining them."""
    fact, customer = tables["fact_sales"], tables["dim_customer"]
    product, market = tables["dim_product"], tables["dim_country"]

    def widened(frame: DataFrame, dim: DataFrame, key: str, extra: list[str]) -> DataFrame:
        lookup = dim.select(F.col(key).alias("dim_key"), *extra, F.lit(1).alias("found"))
        # the unknown key has nothing to look up, and would bring all guests into one partition
        known = F.when(F.col(key) != settings.unknown_customer_key, F.col(key))
        joined = attach(frame, lookup, known, "dim_key", settings.broadcast_bytes, [SALE_KEY])
        return joined.where((F.col("found") == 1) | (F.col(key) == settings.unknown_customer_key)).drop("found")

    lines = widened(fact, product, "product_key", ["stock_code", "line_type"])
    lines = widened(lines, customer, "customer_key", ["customer_id"])
    lines = widened(lines, market, "country_key", ["country", "region"])
    lines = lines.withColumn("year_month", C.year_month(F.col("invoice_ts"))).select(*LINE_COLUMNS)
    return Star(tables["dim_date"], customer, product, market, fact, lines)
