"""Readers for the raw invoice lines."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens import schemas
from revlens.functions import columns as C

ORDINAL = "source_ordinal"
PART = "source_part"


def _file_order(part_number: int, source_format: str) -> Column:
    """Sortable position of a row in its source: part, file, then row inside the file."""
    file_path = F.col("_metadata.file_path").alias("file")
    if source_format == "parquet":
        row = F.col("_metadata.row_index").alias("row")
        return F.struct(F.lit(part_number).alias("part"), file_path, row)
    # text formats expose no row index; ids only grow inside one split of a file
    return F.struct(
        F.lit(part_number).alias("part"),
        file_path,
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def _typed(frame: DataFrame) -> list[Column]:
    """The eight raw columns in their contract types; a malformed value is an error."""
    types = {item.name: item.dataType for item in frame.schema.fields}
    casts = {
        "Quantity": C.quantity,
        "Price": C.price,
        "Customer ID": C.whole_number,
    }
    return [
        casts[item.name](F.col(f"`{item.name}`"), types[item.name]).alias(item.name)
        if item.name in casts
        else F.col(f"`{item.name}`").cast(item.dataType).alias(item.name)
        for item in schemas.RAW.fields
    ]


def read_raw_parts(
    spark: SparkSession,
    parts: Mapping[str, str],
    source_format: str = "parquet",
    ordinal_column: str | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Stack the named parts in order, tagging each row with its part and its source position.

    Parquet files bring their own types, which may differ from the contract's; text columns of a
    CSV are read as text, for a typed CSV read would turn what it cannot parse into nulls.
    `ordinal_column` names a column that already carries the position; otherwise it comes from
    the file layout.
    """
    frames = []
    for number, (name, path) in enumerate(parts.items()):
        reader = spark.read.format(source_format)
        if source_format == "csv":
            text = [T.StructField(item.name, T.StringType()) for item in schemas.RAW.fields]
            reader = reader.schema(T.StructType(text)).option("header", "true")
        frame = reader.options(**dict(options or {})).load(path)
        ordinal = F.col(ordinal_column) if ordinal_column else _file_order(number, source_format)
        frames.append(
            frame.select(*_typed(frame), F.lit(name).alias(PART), ordinal.alias(ORDINAL))
        )
    return reduce(DataFrame.unionByName, frames)


def spread_scan(frame: DataFrame, *keys: str) -> DataFrame:
    """Hash a scan over the cores when its files split into fewer tasks than there are cores.

    A few unsplittable files would leave the cluster idle; an input of many splits stays as it is.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    if frame.rdd.getNumPartitions() >= cores:
        return frame
    return frame.repartition(cores, *keys)
