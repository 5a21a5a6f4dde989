"""Writers for stage tables, the star, the marts and the two JSON documents."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from revlens.functions.columns import with_double_money
from revlens.sources.stages import COMPRESSION


def write_table(frame: DataFrame, path: str) -> int:
    """Overwrite `path` and return the rows written, counted by the write itself."""
    written = Observation()
    frame.observe(written, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").options(
        **COMPRESSION
    ).parquet(path)
    return written.get["rows"]


def write_tables(tables: Mapping[str, DataFrame], folder: str) -> dict[str, int]:
    return {name: write_table(frame, f"{folder}/{name}") for name, frame in tables.items()}


def sorted_export(frame: DataFrame) -> DataFrame:
    """A mart as it is exported: money as doubles, sorted on all of its columns."""
    plain = with_double_money(frame)
    return plain.orderBy(*[F.col(f"`{column}`").asc_nulls_last() for column in plain.columns])


def export_marts(marts: Mapping[str, DataFrame], folder: str) -> dict[str, int]:
    """Write every mart as it is exported; returns the rows written per mart."""
    return {name: write_table(sorted_export(marts[name]), f"{folder}/{name}") for name in sorted(marts)}


def register_marts(spark: SparkSession, marts: Mapping[str, DataFrame], prefix: str = "mart_") -> list[str]:
    """Create one temporary view per mart; returns the names of all views with the prefix."""
    for name, frame in marts.items():
        with_double_money(frame).createOrReplaceTempView(name)
    return sorted(table.name for table in spark.catalog.listTables(pattern=f"{prefix}*"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One JSON line per input file."""
    manifest.write.mode("overwrite").json(path)


def json_text(document: Mapping[str, Any]) -> str:
    return json.dumps(document, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def write_text(spark: SparkSession, text: str, path: str) -> str:
    """Write one small document, through whatever file system the path belongs to."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    return path


def write_json(spark: SparkSession, document: Mapping[str, Any], path: str) -> str:
    return write_text(spark, json_text(document), path)
