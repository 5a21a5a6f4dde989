"""Published versions: a folder of tables each, and a marker that names the one readers are to take.

A version is written table by table into a folder of its own and ends with a record of its tables. Only
then the marker moves, by one rename, so a reader sees the old version or the new one, never a mixture,
and a run that dies on the way leaves the old one as it was.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from revlens.sources import sinks

MARKER, RECORD, VERSIONS = "CURRENT", "_release.json", "versions"


class NotPublished(LookupError):
    """There is no complete version where one was looked for."""


class ContractError(ValueError):
    """A published table is not what its contract says."""


def _path(spark: SparkSession, path: str) -> tuple[object, object]:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small document; None where there is none."""
    system, found = _path(spark, path)
    if not system.exists(found):
        return None
    stream = system.open(found)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def _replace(spark: SparkSession, source: str, target: str) -> None:
    """Rename over what is there, in one step where the file system can."""
    gateway = spark.sparkContext._gateway
    jvm = spark._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        jvm.org.apache.hadoop.fs.Path(target).toUri(), spark._jsc.hadoopConfiguration()
    )
    files.rename(jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target), options)


@dataclass
class Release:
    """One version on its way; readers do not see it before `commit`."""

    spark: SparkSession
    root: str
    version: str
    counts: dict[str, int] = field(default_factory=dict)
    schemas: dict[str, dict] = field(default_factory=dict)

    @classmethod
    def begin(cls, spark: SparkSession, root: str) -> Release:
        moment = dt.datetime.now(dt.UTC).strftime("%Y%m%dT%H%M%S")
        return cls(spark, root.rstrip("/"), f"{moment}-{uuid.uuid4().hex[:12]}")

    @property
    def folder(self) -> str:
        return f"{self.root}/{VERSIONS}/{self.version}"

    def write(self, name: str, frame: DataFrame) -> None:
        self.counts[name] = sinks.write_table(frame, f"{self.folder}/{name}")
        self.schemas[name] = frame.schema.jsonValue()

    def write_text(self, name: str, text: str) -> None:
        sinks.write_text(self.spark, text, f"{self.folder}/{name}")

    def commit(self) -> str:
        """Complete the version and make it the current one; returns its folder."""
        record = {"version": self.version, "rows": self.counts, "schemas": self.schemas}
        self.write_text(RECORD, sinks.json_text(record))
        waiting = f"{self.root}/.{MARKER}-{self.version}"
        sinks.write_text(self.spark, self.version + "\n", waiting)
        _replace(self.spark, waiting, f"{self.root}/{MARKER}")
        return self.folder


@dataclass(frozen=True)
class Version:
    """A complete version, for reading."""

    spark: SparkSession
    folder: str
    counts: Mapping[str, int]
    schemas: Mapping[str, T.StructType]

    def table(self, name: str, contract: T.StructType | None = None) -> DataFrame:
        """A table, read with its contract's schema after its files have been held against it."""
        if name not in self.schemas:
            raise ContractError(f"{self.folder} has no table {name}")
        path = f"{self.folder}/{name}"
        expected = _shape(contract or self.schemas[name])
        found = _shape(self.spark.read.parquet(path).schema)
        if found != expected:
            odd = sorted(set(found) ^ set(expected)) or ["order of columns"]
            raise ContractError(f"{name}: {odd}")
        return self.spark.read.schema(contract or self.schemas[name]).parquet(path)

    def checked(self) -> None:
        """Raise unless every table still has the rows that were written."""
        for name, rows in self.counts.items():
            found = self.table(name).count()
            if found != rows:
                raise ContractError(f"{name}: {found} rows of {rows}")


def _shape(schema: T.StructType) -> list[tuple[str, str]]:
    return [(item.name, item.dataType.simpleString()) for item in schema.fields]


def open_version(spark: SparkSession, root: str, version: str | None = None) -> Version:
    """The current version under `root`, or a named one."""
    root = root.rstrip("/")
    version = version or (read_text(spark, f"{root}/{MARKER}") or "").strip()
    if not version:
        raise NotPublished(f"nothing is published under {root}")
    folder = f"{root}/{VERSIONS}/{version}"
    text = read_text(spark, f"{folder}/{RECORD}")
    if text is None:
        raise NotPublished(f"{folder} is not complete")
    record = json.loads(text)
    schemas = {name: T.StructType.fromJson(schema) for name, schema in record["schemas"].items()}
    return Version(spark, folder, record["rows"], schemas)


def versions(spark: SparkSession, root: str) -> list[str]:
    """Names of all versions, complete or not, oldest first."""
    system, folder = _path(spark, f"{root.rstrip('/')}/{VERSIONS}")
    if not system.exists(folder):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(folder) if status.isDirectory())


def expire(spark: SparkSession, root: str, keep: int) -> list[str]:
    """Delete versions older than the `keep` last ones up to the current one; returns their names.

    What is newer than the current version may still be on its way and stays.
    """
    if keep < 1:
        raise ValueError("at least the current version is kept")
    current = (read_text(spark, f"{root.rstrip('/')}/{MARKER}") or "").strip()
    older = [name for name in versions(spark, root) if name <= current]
    gone = older[: max(len(older) - keep, 0)]
    for name in gone:
        system, folder = _path(spark, f"{root.rstrip('/')}/{VERSIONS}/{name}")
        system.delete(folder, True)
    return gone
