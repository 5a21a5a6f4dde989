"""Marts as views and parameterised reports as table functions, for people who write SQL.

    SELECT * FROM market_filter(region => 'Europe', top => 5)
    SELECT * FROM cohort_depth(depth => 12)
    SELECT * FROM segments_by(measure => 'customers')
    SELECT * FROM products_by(measure => 'units')

Arguments have names and defaults. Functions are views with a condition, so their filters reach the mart
like those of any query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from revlens.plans import reports
from revlens.plans.marts import Marts
from revlens.sources.sinks import register_marts

PREFIX = "report_"


@dataclass(frozen=True)
class TableFunction:
    """A report over one panel: its arguments as SQL declares them, and what it returns of the panel."""

    name: str
    arguments: str
    panel: str
    body: str
    placed: bool = False

    def sql(self, panel: DataFrame) -> str:
        fields = [*panel.schema.fields, *([T.StructField("place", T.LongType())] if self.placed else [])]
        columns = ", ".join(f"`{item.name}` {item.dataType.simpleString()}" for item in fields)
        body = self.body.format(panel=PREFIX + self.panel, columns=", ".join(f"p.`{item.name}`" for item in fields))
        return f"CREATE OR REPLACE TEMPORARY FUNCTION {self.name}({self.arguments}) RETURNS TABLE ({columns}) RETURN {body}"


# ranked by a measure that is a number either way; ties go by the panel's own order
_RANKED = """SELECT {{columns}} FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY CASE measure {cases} END DESC, {tie}) AS BIGINT) AS place
  FROM {{panel}}) p{{where}}"""


def _ranked(tie: str, *measures: str) -> str:
    cases = " ".join(f"WHEN '{name}' THEN CAST({name} AS DOUBLE)" for name in measures)
    known = ", ".join(f"'{name}'" for name in measures)
    where = f" WHERE measure IN ({known}) OR raise_error(concat('no such measure: ', measure)) IS NULL"
    return _RANKED.format(cases=cases, tie=tie).replace("{where}", where)


FUNCTIONS = (
    TableFunction(
        "market_filter",
        "region STRING DEFAULT 'all', top INT DEFAULT 0",
        "markets",
        # the panel has a row a market, so its order is a small window
        """SELECT {columns} FROM (
  SELECT *, row_number() OVER (ORDER BY revenue_rank, country) AS row_no FROM {panel} m
  WHERE market_filter.region = 'all' OR m.region = market_filter.region) p
WHERE market_filter.top = 0 OR p.row_no <= market_filter.top""",
    ),
    TableFunction(
        "cohort_depth",
        "depth INT DEFAULT 2147483647",
        "cohort",
        "SELECT {columns} FROM {panel} p WHERE p.month_offset <= cohort_depth.depth",
    ),
    TableFunction(
        "segments_by",
        "measure STRING DEFAULT 'net_revenue'",
        "segments",
        _ranked("segment", "net_revenue", "customers", "average_value"),
        placed=True,
    ),
    TableFunction(
        "products_by",
        "measure STRING DEFAULT 'net_revenue'",
        "products",
        _ranked("revenue_rank", "net_revenue", "units", "orders"),
        placed=True,
    ),
)


def panels(marts: Marts) -> dict[str, DataFrame]:
    """The reports that functions are cut from; each has a row a market, cell, segment or leading product."""
    return {
        "markets": reports.country_panel(marts.mart_country_performance),
        "cohort": reports.cohort_panel(marts.mart_cohort_retention),
        "segments": reports.rfm_segments(marts.mart_rfm),
        "products": reports.top_products(marts.mart_product_pareto, marts.settings.top_products),
    }


def register(spark: SparkSession, marts: Marts) -> dict[str, list[str]]:
    """Create all mart views and table functions of a build or a loaded version; returns their names."""
    found = panels(marts)
    for name, frame in found.items():
        frame.createOrReplaceTempView(PREFIX + name)
    for function in FUNCTIONS:
        spark.sql(function.sql(found[function.panel]))
    return {"views": register_marts(spark, marts.tables()), "functions": [function.name for function in FUNCTIONS]}
