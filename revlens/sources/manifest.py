"""Checksums of input files of any size, on any file system."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Spark reads a file as one row up to this many bytes; larger ones are read in blocks
ROW_BYTES = 1 << 30
BLOCK_BYTES = 8 << 20
HASHED = "path string, bytes bigint, sha256 string"


def listed_files(spark: SparkSession, path: str, glob: str = "*") -> list[tuple[str, int]]:
    """(path, bytes) of every matching file in a folder, empty ones included, on any file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, glob)) or []
    return [(status.getPath().toString(), status.getLen()) for status in found if status.isFile()]


def _streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each file, read from front to back by the task that has it."""
    schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string())])
    for batch in batches:
        for path, size in zip(batch.column("path").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
            system, name = fs.FileSystem.from_uri(path)
            digest, read = hashlib.sha256(), 0
            with system.open_input_stream(name) as stream:
                while block := stream.read(BLOCK_BYTES):
                    digest.update(block)
                    read += len(block)
            if read != size:
                raise OSError(f"{path}: {read} bytes of {size}")
            yield pa.RecordBatch.from_pylist([{"path": unquote(path), "bytes": size, "sha256": digest.hexdigest()}], schema=schema)


def _uri(path: str) -> str:
    """Hadoop writes file:/a b where other readers want file:///a%20b."""
    scheme, _, rest = path.partition(":")
    return f"{scheme}:{quote(rest if rest.startswith('//') else '//' + rest)}"


def source_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per file: name, SHA-256, bytes and when it was recorded.

    Files of up to `ROW_BYTES` are read by Spark, a file a row; larger ones in blocks, a file a task, since
    a SHA-256 has to see its bytes in order. Spark's own listing leaves out empty files; they come from the
    file system's and have the hash of nothing.
    """
    files = listed_files(spark, path, glob)
    empty = [(name, 0) for name, size in files if not size]
    large = [(_uri(name), size) for name, size in files if size > ROW_BYTES]
    rows = spark.createDataFrame(empty, "path string, bytes bigint").withColumn(
        "sha256", F.sha2(F.lit("").cast("binary"), 256)
    )
    if large:
        dealt = spark.createDataFrame(large, "path string, bytes bigint").repartition(len(large), "path")
        rows = rows.unionByName(dealt.mapInArrow(_streamed, HASHED))
    if len(empty) + len(large) < len(files):
        # the condition on the length reaches the reader, which then never opens larger files
        filled = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
        rows = rows.unionByName(
            filled.where((F.col("length") > 0) & (F.col("length") <= ROW_BYTES)).select(
                "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")
            )
        )
    return rows.select(
        F.element_at(F.split("path", "/"), -1).alias("file"),
        "sha256",
        "bytes",
        F.current_timestamp().alias("recorded_at"),
    )


def manifest_of(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """The manifest of several folders, with the folder of each file."""
    parts = [source_manifest(spark, folder).select(F.lit(folder).alias("folder"), "*") for folder in folders]
    return reduce(DataFrame.unionByName, parts)
