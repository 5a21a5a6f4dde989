"""Column expressions: text, strict casts, time and exact money arithmetic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters a Unicode-aware strip removes from both ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
MONEY = "decimal(18,4)"
ROUNDING = "decimal(28,8)"
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)


def stripped(column: Column) -> Column:
    """A text between two visible ASCII characters stays as it is, without a search for white space."""
    text = column.cast("string")
    clean = F.ascii(text).between(33, 126) & F.ascii(F.substring(text, -1, 1)).between(33, 126)
    return F.when(clean, text).otherwise(F.btrim(text, F.lit(WHITESPACE)))


def replaced(column: Column, mapping: Mapping[str, str]) -> Column:
    """Exact-match replacement from a short mapping; anything else passes through."""
    result = None
    for old, new in mapping.items():
        hit = column == F.lit(old)
        result = F.when(hit, new) if result is None else result.when(hit, new)
    return column if result is None else result.otherwise(column)


def line_type_of(code: Column, groups: Mapping[str, Sequence[str]], default: str) -> Column:
    """Label of the group that lists the whole code; prefixes do not count."""
    result = None
    for label, codes in groups.items():
        hit = code.isin([str(item).strip().upper() for item in codes])
        result = F.when(hit, label) if result is None else result.when(hit, label)
    return F.lit(default) if result is None else result.otherwise(default)


def starts_with_prefix(invoice: Column, prefix: str) -> Column:
    return F.coalesce(F.upper(invoice).startswith(prefix.upper()), F.lit(False))


def whole_number(column: Column, data_type: T.DataType) -> Column:
    """Nullable integer; a fractional value is an error, never a silent truncation."""
    if isinstance(data_type, INTEGRAL):
        return column.cast("bigint")
    exact = without_nan(column, data_type).cast("decimal(38,10)")
    return F.when(
        exact.isNotNull() & (exact != F.floor(exact)),
        F.raise_error(F.concat(F.lit("not a whole number: "), exact.cast("string"))),
    ).otherwise(exact.cast("bigint"))


def quantity(column: Column, data_type: T.DataType) -> Column:
    """Nullable integer; a fraction is cut towards zero."""
    if not isinstance(data_type, INTEGRAL):
        column = without_nan(column, data_type).cast("decimal(38,10)")
    return column.cast("bigint")


def required_quantity(column: Column, data_type: T.DataType) -> Column:
    missing = F.raise_error(F.lit("quantity is missing"))
    return F.when(column.isNull(), missing).otherwise(quantity(column, data_type))


def price(column: Column, data_type: T.DataType) -> Column:
    """Four decimals; a price with more is an error, never rounded in silence."""
    given = without_nan(column, data_type)
    money = given.cast(MONEY)
    short = isinstance(data_type, T.DecimalType) and data_type.scale <= 4
    if short or isinstance(data_type, INTEGRAL):
        return money
    return F.when(
        given.cast("decimal(38,10)") != money,
        F.raise_error(F.concat(F.lit("more than four decimals: "), given.cast("string"))),
    ).otherwise(money)


def without_nan(column: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, FRACTIONAL):
        return F.when(~F.isnan(column), column)
    return column


def floor_minute(column: Column) -> Column:
    """Drops seconds by interval arithmetic, so no session time zone takes part."""
    ts = column.cast("timestamp_ntz")
    zero = F.lit(0)
    return ts - F.make_dt_interval(zero, zero, zero, F.extract(F.lit("SECOND"), ts))


def year_month(ts: Column) -> Column:
    # a format pattern costs a line more than all of its joins
    month = F.lpad(F.month(ts).cast("string"), 2, "0")
    return F.concat(F.lpad(F.year(ts).cast("string"), 4, "0"), F.lit("-"), month)


def month_index(text: Column) -> Column:
    """Months since year 0 of a 'YYYY-MM' text."""
    return F.substring(text, 1, 4).cast("int") * 12 + F.substring(text, 6, 2).cast("int")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double quotient, NULL where the denominator is 0 or NULL."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(F.lit(100.0) * part.cast("double"), whole.cast("double"))


def rounded(column: Column, digits: int) -> Column:
    """Half-up rounding done in decimal, so a double just under a tie cannot go either way."""
    return F.round(column.cast(ROUNDING), digits).cast("double")


def money(column: Column) -> Column:
    return rounded(column, 2)


def sum_when(condition: Column, value: Column) -> Column:
    """Conditional sum that is 0, not NULL, where nothing matches."""
    return F.sum(F.when(condition, value).otherwise(F.lit(0).cast(MONEY)))


def with_double_money(frame: DataFrame) -> DataFrame:
    """Output form of a mart: exact decimals become doubles once all arithmetic is done."""
    return frame.select(
        *[
            F.col(item.name).cast("double").alias(item.name)
            if isinstance(item.dataType, T.DecimalType)
            else F.col(item.name)
            for item in frame.schema.fields
        ]
    )
