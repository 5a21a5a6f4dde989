"""Integrity gates: one row per gate with the violations it found, and a wrapper that raises."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from revlens.config import SEGMENTS, Settings
from revlens.functions import columns as C
from revlens.operators.cleaning import CleanResult
from revlens.operators.star import FACT_KEYS, Star, fact_figures, sales_figures
from revlens.plans import quality
from revlens.plans.marts import TILES, Marts, is_kept, sales_lines

FLAT = 1e-9
KEYS = FACT_KEYS
# a small extract may leave a segment empty without anything being wrong
ADVISORY = ("segments_missing",)


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _flag(condition: Column) -> Column:
    """1 where the condition fails to hold or is unknown."""
    return F.when(condition, 0).otherwise(1).cast("bigint")


def _rows(frame: DataFrame, gates: list[str]) -> DataFrame:
    return frame.select(*[F.coalesce(F.col(name), _zero()).alias(name) for name in gates]).unpivot(
        [], gates, "gate", "violations"
    )


def _as_row(spark: SparkSession, figures: Mapping[str, object]) -> DataFrame:
    """Figures that a write has taken as a row; sums over no rows are null."""
    kinds = {int: "bigint", Decimal: "decimal(38,4)"}
    return spark.range(1).select(
        *[
            F.lit(value).cast(kinds.get(type(value), "decimal(38,4)")).alias(name)
            for name, value in figures.items()
        ]
    )


def clean_gates(result: CleanResult, written: bool = False) -> DataFrame:
    """Raw rows against kept, dropped and quarantined ones; `written` takes those as they were counted
    when the lines were written."""
    if written and result.written:
        raw_rows = result.raw.agg(F.count(F.lit(1))).scalar()
        seen = _as_row(result.raw.sparkSession, result.written)
        counted = seen.select(raw_rows.alias("raw_rows"), F.coalesce("accounted_rows", _zero()).alias("accounted_rows"))
    else:
        counted = quality.row_accounting(result)
    checked = counted.select(F.abs(F.col("accounted_rows") - F.col("raw_rows")).alias("rows_unaccounted"))
    return _rows(checked, ["rows_unaccounted"])


def star_gates(result: CleanResult, star: Star, settings: Settings, written: bool = False) -> DataFrame:
    """The fact against the cleaned lines and the dimensions.

    `written` takes rows, revenue and null keys as they were counted when both were written; without it
    the tables are read as they are.
    """
    zero = F.lit(0).cast(C.MONEY)
    if written and result.written and star.written:
        spark = star.fact_sales.sparkSession
        source = _as_row(spark, {name: result.written[f"kept_{name}"] for name in ("rows", "revenue")})
        fact = _as_row(spark, {name: star.written[name] for name in fact_figures()})
    else:
        source = result.kept.agg(F.count(F.lit(1)).alias("rows"), F.sum("line_revenue").alias("revenue"))
        fact = star.fact_sales.agg(*[column.alias(name) for name, column in fact_figures().items()])
    source_rows = source.select("rows").scalar()
    source_revenue = source.select(F.coalesce("revenue", zero)).scalar()
    totals = fact.select(
        "null_keys",
        F.abs(F.col("rows") - source_rows).alias("fact_rows_differ"),
        _flag(F.abs(F.coalesce("revenue", zero) - source_revenue) <= F.lit(settings.revenue_tolerance)).alias(
            "fact_revenue_differs"
        ),
    )
    frames = [
        _rows(torn_codes(result.kept), ["codes_with_two_line_types"]),
        _regions(star),
        _rows(totals, ["null_keys", "fact_rows_differ", "fact_revenue_differs"]),
        orphan_gates(star, settings),
    ]
    return reduce(DataFrame.unionAll, frames)


def torn_codes(lines: DataFrame) -> DataFrame:
    """How many stock codes have lines of several types.

    The least and greatest text of a code would be found by sorting all lines; pairs of code and type are
    hashed instead, so that a task holds the codes it meets, not its lines.
    """
    pairs = lines.where(F.col("line_type").isNotNull()).select("stock_code", "line_type").distinct()
    codes = pairs.groupBy("stock_code").agg(F.count(F.lit(1)).alias("types"))
    return codes.agg(F.count_if(F.col("types") > 1).alias("codes_with_two_line_types"))


def _regions(star: Star) -> DataFrame:
    markets = star.dim_country.agg(
        F.count_if(F.col("region").isNull()).alias("markets_without_region")
    )
    return _rows(markets, ["markets_without_region"])


def published_gates(star: Star, marts: Marts) -> DataFrame:
    """The gates that published tables can answer by themselves."""
    nulls = _rows(star.fact_sales.agg(fact_figures()["null_keys"].alias("null_keys")), ["null_keys"])
    return reduce(
        DataFrame.unionAll, [nulls, _regions(star), orphan_gates(star, marts.settings), mart_gates(star, marts)]
    )


def _dense(dim: DataFrame, key: str, unknown: int) -> Row:
    """How many keys a dimension has, whether they are 1 to that number, and whether it knows the unknown one."""
    own = F.when(F.col(key) != unknown, F.col(key))
    found = dim.agg(
        F.count(own).alias("n"),
        F.count_distinct(own).alias("different"),
        F.coalesce(F.min(own), F.lit(1)).alias("low"),
        F.coalesce(F.max(own), F.lit(0)).alias("high"),
        F.coalesce(F.bool_or(F.col(key) == unknown), F.lit(False)).alias("has_unknown"),
    )
    whole = (F.col("n") == F.col("different")) & (F.col("low") == 1) & (F.col("high") == F.col("n"))
    return found.select("n", "has_unknown", whole.alias("dense")).first()


def orphan_gates(star: Star, settings: Settings) -> DataFrame:
    """Fact lines whose key is in no dimension, per key.

    Surrogate keys run from 1 without gaps, so one scan of the fact settles all of them by their range,
    dates by the calendar. A dimension with gaps, which something has damaged, is joined instead.
    """
    unknown = settings.unknown_customer_key
    known_days = star.dim_date.select(F.col("date_key").alias("known_day")).distinct()
    # the calendar has a row a day
    fact = star.fact_sales.select(*KEYS).join(F.broadcast(known_days), F.col("date_key") == F.col("known_day"), "left")
    lost = {"date_key": F.col("date_key").isNotNull() & F.col("known_day").isNull()}
    joined = []
    for key, name in KEYS.items():
        if key in lost:
            continue
        keys = _dense(star.tables()[name], key, unknown)
        if keys["dense"]:
            known = F.col(key).between(1, keys["n"]) | (F.lit(keys["has_unknown"]) & (F.col(key) == unknown))
            lost[key] = F.col(key).isNotNull() & ~known
        else:
            joined.append(_orphans(star, key))
    names = [f"orphan_{key}" for key in lost]
    scanned = fact.agg(*[F.count_if(missing).alias(f"orphan_{key}") for key, missing in lost.items()])
    return reduce(DataFrame.unionAll, [_rows(scanned, names), *joined])


def _orphans(star: Star, key: str) -> DataFrame:
    # fact lines fold to one row per key value before they meet the dimension
    used = star.fact_sales.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    lost = used.join(star.tables()[KEYS[key]].select(key), key, "left_anti")
    gate = f"orphan_{key}"
    return _rows(lost.agg(F.sum("n").alias(gate)), [gate])


def rfm_gates(marts: Marts) -> DataFrame:
    rfm, settings = marts.mart_rfm, marts.settings
    scores = [F.col(name).between(1, TILES) for name in ("r_score", "f_score", "m_score")]
    known = F.col("segment").isin(list(SEGMENTS))
    # counted on the fact itself, past the summary that the scores come from
    eligible = (
        sales_lines(marts.star, settings)
        .where(is_kept() & (F.col("customer_key") != settings.unknown_customer_key))
        .agg(F.count_distinct("customer_key"))
        .scalar()
    )
    scored = rfm.agg(
        F.count_if(~reduce(lambda a, b: a & b, scores)).alias("scores_out_of_range"),
        F.count_if(F.col("segment").isNull()).alias("customers_without_segment"),
        F.count(F.lit(1)).alias("scored"),
        F.count_if(~known).alias("segments_unexpected"),
        (F.lit(len(SEGMENTS)) - F.count_distinct(F.when(known, F.col("segment")))).alias(
            "segments_missing"
        ),
    ).withColumn("scored_customers_differ", F.abs(F.col("scored") - eligible))
    repeated = (
        rfm.groupBy("customer_key")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count_if(F.col("n") > 1).alias("customers_scored_twice"))
    )
    return _rows(
        scored,
        [
            "scores_out_of_range",
            "customers_without_segment",
            "scored_customers_differ",
            "segments_unexpected",
            "segments_missing",
        ],
    ).unionAll(_rows(repeated, ["customers_scored_twice"]))


def cohort_gates(marts: Marts) -> DataFrame:
    checked = marts.mart_cohort_retention.agg(
        F.count_if((F.col("month_offset") == 0) & (F.col("retention_pct") != 100.0)).alias(
            "cohorts_not_starting_at_100"
        ),
        F.count_if(F.col("active_customers") > F.col("cohort_size")).alias("cells_above_cohort_size"),
    )
    return _rows(checked, ["cohorts_not_starting_at_100", "cells_above_cohort_size"])


def pareto_gates(marts: Marts) -> DataFrame:
    """Last point at 100, and no step down on a stock code with net revenue of 0 or more."""
    pareto = marts.mart_product_pareto
    share = F.col("cumulative_share_pct")
    ending = pareto.agg(F.max_by("cumulative_share_pct", "revenue_rank").alias("last")).select(
        _flag(F.abs(F.col("last") - 100.0) <= float(marts.settings.revenue_tolerance)).alias(
            "curve_not_ending_at_100"
        )
    )
    before = pareto.select(
        (F.col("revenue_rank") + 1).alias("revenue_rank"), share.alias("previous_share")
    )
    falls = pareto.join(before, "revenue_rank").agg(
        F.count_if((F.col("net_revenue") >= 0) & (share - F.col("previous_share") < -FLAT)).alias(
            "curve_falls_at_profit"
        )
    )
    return _rows(ending, ["curve_not_ending_at_100"]).unionAll(
        _rows(falls, ["curve_falls_at_profit"])
    )


def total_gates(star: Star, marts: Marts, written: bool = False) -> DataFrame:
    """Mart totals against the warehouse, and the warehouse against audited totals if given.

    `written` takes the totals of the warehouse as they were summed when the fact was written.
    """
    settings = marts.settings
    tolerance = F.lit(settings.revenue_tolerance)
    measures = ("gross_revenue", "returns", "net_revenue")
    trend = marts.mart_revenue_trend.agg(*[F.sum(name).alias(name) for name in measures])
    if written and star.written:
        figures = {name: star.written[name] for name in measures}
        totals = _as_row(star.fact_sales.sparkSession, figures)
    else:
        totals = star.lines.agg(*[column.alias(name) for name, column in sales_figures(settings).items()])
    totals = totals.select(*[F.coalesce(name, F.lit(0).cast(C.MONEY)).alias(name) for name in measures])
    zero = F.lit(0).cast(C.MONEY)
    checks = {
        f"trend_{name}_differs": _flag(
            F.abs(F.col(name) - trend.select(F.coalesce(name, zero)).scalar()) <= tolerance
        )
        for name in measures
    }
    country_gross = marts.mart_country_performance.agg(
        F.coalesce(F.sum("gross_revenue"), zero)
    ).scalar()
    checks["country_gross_differs"] = _flag(
        F.abs(F.col("gross_revenue") - country_gross) <= tolerance
    )
    for name, expected in (settings.expected_totals or {}).items():
        checks[f"audited_{name}_differs"] = _flag(
            F.abs(F.col(name) - F.lit(expected).cast("decimal(28,4)")) <= tolerance
        )
    return _rows(totals.select(*[check.alias(name) for name, check in checks.items()]), list(checks))


def mart_gates(star: Star, marts: Marts, written: bool = False) -> DataFrame:
    return reduce(
        DataFrame.unionAll,
        [rfm_gates(marts), cohort_gates(marts), pareto_gates(marts), total_gates(star, marts, written)],
    )


def gate_report(result: CleanResult, star: Star, marts: Marts, written: bool = False) -> DataFrame:
    """One row per gate. A run passes `written` and spares the scans whose figures its writes have taken."""
    return reduce(
        DataFrame.unionAll,
        [
            clean_gates(result, written),
            star_gates(result, star, marts.settings, written),
            mart_gates(star, marts, written),
        ],
    )


def assert_gates(report: DataFrame, advisory: tuple[str, ...] = ADVISORY) -> dict[str, int]:
    """Raise if any gate outside `advisory` found a violation; return the findings otherwise."""
    found = {row["gate"]: row["violations"] for row in report.collect()}
    broken = {gate: n for gate, n in sorted(found.items()) if n and gate not in advisory}
    if broken:
        raise RuntimeError(f"integrity gates failed: {broken}")
    return found
