"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
ROW = "_row"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def box(frame: DataFrame) -> Column:
    """All columns of a row in one struct, so working columns selected with it cannot clash with them."""
    return F.struct(*[quoted(name) for name in frame.columns]).alias(ROW)


def unboxed(columns: Sequence[str], results: Sequence[str]) -> list[Column]:
    """The boxed columns again; one that has the name of a result column gives way to it."""
    taken = {name.lower() for name in results}
    return [
        F.col(f"{ROW}.`{escaped(name)}`").alias(name)
        for name in columns
        if name.lower() not in taken
    ]


def escaped(name: str) -> str:
    return name.replace("`", "``")


def quoted(name: str) -> Column:
    return F.col(f"`{escaped(name)}`")


def array_literal(values: Sequence[object], element: str) -> Column:
    """One text constant that folds into an array, however many values there are."""
    if not values:
        return F.array().cast(f"array<{element}>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{element}>")


def unit_hash(*parts: Column | str) -> Column:
    """A double in [0, 1) from the top 52 bits of a hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 12) / F.lit(float(1 << 52))
