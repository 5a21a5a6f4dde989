"""Raw invoice lines made from the shared test tables."""

from __future__ import annotations

from functools import cached_property
from threading import RLock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.config import Settings
from revlens.functions.columns import MONEY
from revlens.functions.joins import broadcast_within
from revlens.operators.cleaning import CleanResult, clean, normalise_columns
from revlens.operators.star import Dimensions, Star
from revlens.plans.marts import Marts
from revlens.plans.reports import same_day_reversals
from revlens.plans.run import Loaded, load, publish
from revlens.sources.raw import ORDINAL, read_raw_parts, spread_scan
from revlens.sources.releases import Release
from revlens.sources.stages import StageStore

COUNTRY_OVERRIDES = {"NATION_0": "Home"}
PARTS = ("part-1", "part-2")
SECOND_PART_STARTS = "1998-05-01"
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bound_settings(spark: SparkSession, folder: str) -> Settings:
    """Default settings with the markets of the test tables: one row per nation comes back."""
    nations = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    regions = {
        COUNTRY_OVERRIDES.get(row["n_name"], row["n_name"]): row["r_name"]
        for row in nations.select("n_name", "r_name").collect()
    }
    return Settings(
        country_overrides=COUNTRY_OVERRIDES,
        country_regions=regions,
        recent_year=("2000-08", "2001-07"),
        prior_year=("1999-08", "2000-07"),
    )


def bound_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One raw line per order line, plus repeated lines (branch 1) and same-day reversals (2)."""
    orders, part = table(spark, folder, "orders"), table(spark, folder, "part")
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    # orders, a quarter of the lines, meet customers and markets first: the lines move for two joins at most
    markets = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    buyers = broadcast_within(markets.select("c_custkey", "n_name"), BROADCAST_BYTES)
    placed = orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        (
            F.col("o_orderdate")
            + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("o_orderkey") % 86400)
        ).alias("InvoiceDate"),
        F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("Customer ID"),
        F.col("n_name").alias("Country"),
    )
    names = broadcast_within(part.select("p_partkey", "p_name"), BROADCAST_BYTES)
    cancelled = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    key = F.col("l_partkey")
    units = F.when(
        (F.col("l_discount") == 0.1) & (F.col("l_tax") == 0.08), F.lit(0).cast("bigint")
    ).otherwise(F.col("l_quantity").cast("bigint"))
    # what a line needs, worked out before it moves
    sold = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        cancelled.alias("cancelled"),
        F.when(cancelled, -units).otherwise(units).alias("Quantity"),
        F.when((F.col("l_discount") == 0) & (F.col("l_tax") == 0), F.lit(0.0))
        .otherwise(F.col("l_extendedprice"))
        .cast(MONEY)
        .alias("Price"),
    )
    joined = (
        spread_scan(sold, "l_orderkey")
        .join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(names, F.col("l_partkey") == F.col("p_partkey"))
    )
    base = joined.select(
        F.concat(F.when(F.col("cancelled"), "C").otherwise(""), F.col("l_orderkey").cast("string")).alias(
            "Invoice"
        ),
        F.when(key % 97 == 0, "post")
        .when(key % 101 == 0, "M")
        .when(key % 103 == 0, "TEST001")
        .otherwise(F.concat(F.lit(" p"), key.cast("string"), F.lit(" ")))
        .alias("StockCode"),
        F.when(F.col("l_linenumber") != 7, F.col("p_name")).alias("Description"),
        "Quantity",
        "InvoiceDate",
        "Price",
        "Customer ID",
        "Country",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
    )
    repeated = F.col("l_orderkey") % 31 == 0
    reversed_ = (F.col("l_orderkey") % 50 == 0) & (F.col("Quantity") > 0)
    branches = (
        F.when(repeated & reversed_, F.array(F.lit(0), F.lit(1), F.lit(2)))
        .when(repeated, F.array(F.lit(0), F.lit(1)))
        .when(reversed_, F.array(F.lit(0), F.lit(2)))
        .otherwise(F.array(F.lit(0)))
    )
    spread = base.withColumn("branch", F.explode(branches))
    reversal = F.col("branch") == 2
    return spread.select(
        F.when(reversal, F.concat(F.lit("C"), F.col("Invoice")))
        .otherwise(F.col("Invoice"))
        .alias("Invoice"),
        "StockCode",
        "Description",
        F.when(reversal, -F.col("Quantity")).otherwise(F.col("Quantity")).alias("Quantity"),
        "InvoiceDate",
        "Price",
        "Customer ID",
        "Country",
        # branch, line number, part number: lines equal in all three are equal altogether
        (
            F.col("branch").cast("bigint") * 10**17
            + F.col("l_linenumber").cast("bigint") * 10**15
            + F.col("l_partkey")
        ).alias(ORDINAL),
    )


class Workspace:
    """One run over one folder of test tables; every stage is built once, when first needed."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder
        self.store = StageStore(spark)
        self.lock = RLock()

    @cached_property
    def settings(self) -> Settings:
        return bound_settings(self.spark, self.folder)

    @cached_property
    def raw(self) -> DataFrame:
        """The bound lines landed as two raw parts, then read back the way any extract is."""
        day = F.col("InvoiceDate")
        part = F.when(day < F.lit(SECOND_PART_STARTS).cast("timestamp_ntz"), PARTS[0]).otherwise(
            PARTS[1]
        )
        lines = bound_lines(self.spark, self.folder).withColumn("landed", part)
        self.store.save(lines, "raw", partition_by=["landed"], folders=len(PARTS))
        paths = {name: self.store.path(f"raw/landed={name}") for name in PARTS}
        return read_raw_parts(self.spark, paths, ordinal_column=ORDINAL)

    @cached_property
    def normalised(self) -> DataFrame:
        return normalise_columns(self.raw, self.settings)

    @cached_property
    def cleaned(self) -> CleanResult:
        return clean(self.raw, self.settings, self.store)

    @cached_property
    def dimensions(self) -> Dimensions:
        return Dimensions(self.cleaned.numbered, self.settings, self.store)

    @cached_property
    def star(self) -> Star:
        return self.dimensions.star()

    @cached_property
    def marts(self) -> Marts:
        return Marts(self.star, self.settings, self.store)

    @cached_property
    def reversals(self) -> DataFrame:
        """The one row of same-day reversals, which two reports look at."""
        return self.store.save(same_day_reversals(self.star, self.settings), "reversals")

    @cached_property
    def loaded(self) -> Loaded:
        """What a reader gets of this run: published as a version, then loaded from it."""
        root = self.store.path("published")
        publish(Release.begin(self.spark, root), self.cleaned, self.star, self.marts, audited=False)
        return load(self.spark, self.settings, root, self.store.within("loaded"))


_WORKSPACES: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, folder: str) -> Workspace:
    """The workspace of this application for that folder, so queries share their stages."""
    key = (spark.sparkContext.applicationId, folder.rstrip("/"))
    if key not in _WORKSPACES:
        _WORKSPACES[key] = Workspace(spark, key[1])
    return _WORKSPACES[key]
