"""Most frequent value per key, ties broken by the smaller value."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def modal_of(value: str, lines: str) -> Column:
    """Aggregate over rows already counted per (key, value); null values never win."""
    best = F.min(
        F.when(F.col(value).isNotNull(), F.struct((-F.col(lines)).alias("n"), F.col(value).alias("v")))
    )
    return best["v"]
