"""Data-quality report over cleaned lines, and the audit of the raw union."""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.config import LINE_TYPES, Settings
from revlens.functions import columns as C
from revlens.functions.modal import modal_of
from revlens.operators.cleaning import COPIES, REASON, CleanResult, normalise_columns
from revlens.sources.raw import ORDINAL, PART

SHARE_DIGITS = 6
RAW_DUPLICATE_KEY = ("Invoice", "StockCode", "Quantity", "InvoiceDate", "Price")


def _count() -> Column:
    return F.count(F.lit(1))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(C.rounded(C.ratio(part, whole), SHARE_DIGITS), F.lit(0.0))


def _long_form(frame: DataFrame, name: str, value: str, columns: list[str]) -> DataFrame:
    """A one-row frame turned into one row per column."""
    return frame.unpivot([], columns, name, value)


# Report over the cleaned lines


def row_accounting(result: CleanResult) -> DataFrame:
    """Raw, kept, deduplicated and quarantined rows, and whether they balance."""
    raw_rows = result.raw.agg(_count()).scalar()
    counts = result.lines.agg(
        F.count_if(F.col(REASON).isNull()).alias("kept_rows"),
        F.coalesce(F.sum(F.col(COPIES) - 1), F.lit(0).cast("bigint")).alias("deduped_rows"),
        F.count_if(F.col(REASON).isNotNull()).alias("quarantined_rows"),
    )
    accounted = F.col("kept_rows") + F.col("deduped_rows") + F.col("quarantined_rows")
    return counts.select(
        raw_rows.alias("raw_rows"),
        "*",
        accounted.alias("accounted_rows"),
    ).withColumn("balances", (F.col("accounted_rows") == F.col("raw_rows")).cast("int"))


def rule_counts(result: CleanResult) -> DataFrame:
    """Lines touched per rule, quarantined lines included."""
    filled = result.modal.agg(
        F.coalesce(
            F.sum(
                F.when(
                    F.col("stock_code").isNotNull() & F.col("modal_description").isNotNull(),
                    F.col("missing"),
                )
            ),
            F.lit(0).cast("bigint"),
        )
    ).scalar()
    counts = result.lines.agg(
        F.count_if("is_cancellation").alias("cancellations_flagged"),
        F.count_if(F.col("line_type") != "product").alias("non_product_lines"),
        F.count_if(F.col("customer_id").isNull()).alias("guest_lines"),
    )
    wide = counts.select(filled.alias("descriptions_backfilled"), "*")
    return _long_form(wide, "rule", "lines", wide.columns)


def revenue_block(result: CleanResult) -> DataFrame:
    """Gross, returns and net of the sales lines, next to the totals they must tie back to."""
    sales = F.col("line_type").isin(list(result.settings.net_line_types)) & F.col(REASON).isNull()
    cancelled = F.col("is_cancellation")
    # taken from the union itself, two columns of it, so that it can contradict the cleaned lines
    raw_gross = (
        normalise_columns(result.raw, result.settings)
        .agg(F.coalesce(F.sum("line_revenue"), F.lit(0).cast(C.MONEY)))
        .scalar()
    )
    sums = result.lines.agg(
        C.sum_when(F.col(REASON).isNull(), F.col("line_revenue")).alias("all_line_types"),
        C.sum_when(sales & ~cancelled, F.col("line_revenue")).alias("gross"),
        C.sum_when(sales & cancelled, F.col("line_revenue")).alias("returns"),
    )
    return sums.select(
        C.money(raw_gross).alias("raw_gross"),
        C.money(F.col("all_line_types")).alias("all_line_types"),
        C.money(F.col("gross")).alias("gross"),
        C.money(F.col("returns")).alias("returns"),
        C.money(F.col("gross") + F.col("returns")).alias("net"),
        _share(-F.col("returns"), F.col("gross")).alias("return_rate"),
    )


def line_types(kept: DataFrame) -> DataFrame:
    """Rows and revenue of all four line types, an absent type showing as zero."""
    sums = [
        F.struct(
            F.lit(name).alias("line_type"),
            F.count_if(F.col("line_type") == name).alias("rows"),
            C.money(C.sum_when(F.col("line_type") == name, F.col("line_revenue"))).alias("revenue"),
        )
        for name in LINE_TYPES
    ]
    return kept.agg(F.array(*sums).alias("types")).select(F.inline("types"))


def guests(kept: DataFrame) -> DataFrame:
    guest = F.col("customer_id").isNull()
    sums = kept.agg(
        F.count_if(guest).alias("rows"),
        _count().alias("all_rows"),
        C.sum_when(guest, F.col("line_revenue")).alias("guest_revenue"),
        F.sum("line_revenue").alias("all_revenue"),
    )
    return sums.select(
        "rows",
        _share(F.col("rows"), F.col("all_rows")).alias("row_share"),
        C.money(F.col("guest_revenue")).alias("revenue"),
        _share(F.col("guest_revenue"), F.col("all_revenue")).alias("revenue_share"),
    )


def null_counts(kept: DataFrame) -> DataFrame:
    wide = kept.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in kept.columns])
    return _long_form(wide, "column_name", "nulls", kept.columns)


def date_range(kept: DataFrame) -> DataFrame:
    return kept.agg(F.min("invoice_ts").alias("start_ts"), F.max("invoice_ts").alias("end_ts"))


def quarantine_reasons(quarantined: DataFrame) -> DataFrame:
    return quarantined.groupBy(REASON).agg(_count().alias("rows"))


def quality_report(result: CleanResult) -> dict[str, Any]:
    """The report document; every part of it is an aggregate of a few rows."""

    def one(frame: DataFrame) -> dict[str, Any]:
        return frame.first().asDict()

    counts = one(row_accounting(result))
    bounds = one(date_range(result.kept))
    return {
        "counts": {
            name: counts[name]
            for name in ("raw_rows", "kept_rows", "deduped_rows", "quarantined_rows")
        },
        "rules_before_quarantine": {
            row["rule"]: row["lines"] for row in rule_counts(result).collect()
        },
        "reconciliation": {
            "raw_rows": counts["raw_rows"],
            "accounted_rows": counts["accounted_rows"],
            "balances": bool(counts["balances"]),
        },
        "revenue": {
            **one(revenue_block(result)),
            "net_line_types": list(result.settings.net_line_types),
        },
        "line_types": {
            row["line_type"]: {"rows": row["rows"], "revenue": row["revenue"]}
            for row in line_types(result.kept).collect()
        },
        "guests": one(guests(result.kept)),
        "null_counts": {
            row["column_name"]: row["nulls"] for row in null_counts(result.kept).collect()
        },
        "date_range": {
            "start": bounds["start_ts"].isoformat() if bounds["start_ts"] else None,
            "end": bounds["end_ts"].isoformat() if bounds["end_ts"] else None,
        },
        "quarantine_reasons": {
            row[REASON]: row["rows"] for row in quarantine_reasons(result.quarantined).collect()
        },
    }


# Audit of the raw union


def audit_view(raw: DataFrame, settings: Settings) -> DataFrame:
    """Raw columns as delivered, but for text ids and the market names cleaning would give."""
    return raw.select(
        F.col("Invoice").cast("string").alias("Invoice"),
        F.col("StockCode").cast("string").alias("StockCode"),
        F.col("Description").cast("string").alias("Description"),
        "Quantity",
        "InvoiceDate",
        "Price",
        "Customer ID",
        C.replaced(F.col("Country"), settings.country_overrides).alias("Country"),
        *[name for name in (PART,) if name in raw.columns],
    )


def _line_value() -> Column:
    return (F.col("Quantity") * F.col("Price")).cast(C.MONEY)


def _clean_code() -> Column:
    return F.upper(C.stripped(F.col("StockCode")))


def column_profile(audit: DataFrame) -> DataFrame:
    """Per column: type, nulls, exact distinct values, and range and mean where numeric.

    Every column is profiled by its own branch reading only that column, so the table is read once
    in all and no row is blown up to carry one distinct set per column.
    """
    return reduce(DataFrame.unionAll, [_profile(audit, item) for item in audit.schema.fields])


def _profile(audit: DataFrame, item: T.StructField) -> DataFrame:
    column = F.col(f"`{item.name}`")
    numeric = isinstance(item.dataType, T.NumericType)
    # one row per distinct value first, so a value filling a third of the rows folds before it moves
    values = audit.groupBy(column.alias("v")).agg(_count().alias("n"))
    value = F.col("v")
    # whole numbers add up in decimal, where a long total cannot overflow
    wide = value if isinstance(item.dataType, C.FRACTIONAL) else value.cast("decimal(28,4)")
    summed = F.sum(wide * F.col("n")) if numeric else F.lit(None)
    sums = values.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("total"),
        F.coalesce(F.sum(F.when(value.isNull(), F.col("n"))), F.lit(0).cast("bigint")).alias("nulls"),
        F.count("v").alias("distinct_values"),
        (F.min("v") if numeric else F.lit(None)).cast("double").alias("min_value"),
        (F.max("v") if numeric else F.lit(None)).cast("double").alias("max_value"),
        summed.alias("value_sum"),
    )
    filled = F.col("total") - F.col("nulls")
    return sums.select(
        F.lit(item.name).alias("column_name"),
        F.lit(item.dataType.simpleString()).alias("data_type"),
        filled.alias("non_null"),
        "nulls",
        F.coalesce(C.ratio(F.col("nulls"), F.col("total")), F.lit(0.0)).alias("null_share"),
        "distinct_values",
        "min_value",
        "max_value",
        C.ratio(F.col("value_sum"), filled).alias("mean_value"),
    )


def quality_flags(audit: DataFrame, settings: Settings) -> DataFrame:
    """Nine checks on the values as delivered."""
    code = _clean_code()
    cancelled = C.starts_with_prefix(F.col("Invoice"), settings.cancellation_prefix)
    listed = [item for codes in settings.code_groups.values() for item in codes]
    checks = {
        "null_customer": F.col("Customer ID").isNull(),
        "null_description": F.col("Description").isNull(),
        "cancellation_lines": cancelled,
        "exact_duplicates": F.lit(True),
        "price_not_positive": F.col("Price") <= 0,
        "quantity_zero": F.col("Quantity") == 0,
        "negative_quantity_not_cancelled": (F.col("Quantity") < 0) & ~cancelled,
        "non_product_code": code.isin(listed),
        "code_not_normalised": F.col("StockCode") != code,
    }
    # lines fold to their duplicate key first; the checks that need more columns count inside it
    folded = audit.groupBy(*RAW_DUPLICATE_KEY).agg(
        _count().alias("n"),
        F.count_if(checks["null_customer"]).alias("null_customer"),
        F.count_if(checks["null_description"]).alias("null_description"),
    )
    counted = {
        "null_customer": F.sum("null_customer"),
        "null_description": F.sum("null_description"),
        "exact_duplicates": F.sum(F.col("n") - 1),
    }
    zero = F.lit(0).cast("bigint")
    wide = folded.agg(
        F.coalesce(F.sum("n"), zero).alias("total"),
        *[
            F.coalesce(
                counted[name] if name in counted else F.sum(F.when(check, F.col("n"))), zero
            ).alias(name)
            for name, check in checks.items()
        ],
    )
    flags = wide.unpivot(["total"], list(checks), "issue", "rows")
    return flags.select(
        "issue",
        "rows",
        F.coalesce(C.ratio(F.col("rows"), F.col("total")), F.lit(0.0)).alias("share_of_rows"),
    )


def revenue_by_month(audit: DataFrame) -> DataFrame:
    return (
        audit.groupBy(C.year_month(F.col("InvoiceDate")).alias("month"))
        .agg(_count().alias("rows"), F.sum(_line_value()).cast("double").alias("gross_revenue"))
        .orderBy("month")
    )


def revenue_by_country(audit: DataFrame) -> DataFrame:
    return (
        audit.groupBy(F.col("Country").alias("country"))
        .agg(
            _count().alias("rows"),
            F.count_distinct("Customer ID").alias("customers"),
            F.sum(_line_value()).cast("double").alias("gross_revenue"),
        )
        .orderBy(F.col("gross_revenue").desc(), "country")
    )


def stock_code_evidence(audit: DataFrame, settings: Settings) -> DataFrame:
    """Codes that do not start with a digit: their class, size and usual description."""
    code = _clean_code()
    counted = (
        audit.where(~code.rlike(r"(?U)^\d"))
        .groupBy(code.alias("stock_code"), "Description")
        .agg(_count().alias("lines"), F.sum(_line_value()).alias("revenue"))
    )
    codes = counted.groupBy("stock_code").agg(
        F.sum("lines").alias("rows"),
        F.sum("revenue").alias("revenue"),
        modal_of("Description", "lines").alias("modal"),
    )
    return codes.select(
        "stock_code",
        C.line_type_of(F.col("stock_code"), settings.code_groups, "product").alias("class"),
        "rows",
        F.col("revenue").cast("double").alias("total_revenue"),
        F.coalesce("modal", F.lit("")).alias("modal_description"),
    ).orderBy(F.abs("total_revenue").desc(), "stock_code")


def readiness_figures(audit: DataFrame, delivered: Sequence[str] = ()) -> DataFrame:
    """Raw rows, raw gross revenue and rows per part; a part named in `delivered` counts 0 if it has
    none."""
    parts = audit.groupBy(PART).agg(_count().alias("n"), F.sum(_line_value()).alias("value"))
    whole = parts.agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    counted = parts.select(PART, "n")
    if delivered:
        named = audit.sparkSession.createDataFrame([(name,) for name in delivered], f"{PART} string")
        counted = named.join(counted, PART, "full")
    return (
        whole.select(F.lit("raw_rows").alias("figure"), F.col("n").cast("double").alias("value"))
        .unionAll(whole.select(F.lit("raw_gross_revenue"), C.money(F.col("value"))))
        .unionAll(
            counted.select(F.concat(F.lit("rows_in_"), F.col(PART)), F.coalesce("n", F.lit(0)).cast("double"))
        )
    )


def raw_union(raw: DataFrame) -> DataFrame:
    return raw.drop(ORDINAL)
