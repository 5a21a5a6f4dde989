"""Stage tables: Parquet written once in the shared folder and read back by later steps.

A stage cuts lineage and survives the loss of any executor, and unlike a checkpointed RDD it is
columnar, so every reader gets column pruning and filter pushdown on it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

FOLDER_SETTING = "spark.checkpoint.dir"
COMPRESSION = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}
# a task that has a file open per folder need not sort its rows by folder first
WRITERS_SETTING = "spark.sql.maxConcurrentOutputFileWriters"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names; a private one only for a local master that names none."""
    folder = spark.conf.get(FOLDER_SETTING, None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError(f"set {FOLDER_SETTING} to a folder every executor of {master} can reach")
    return "file://" + tempfile.mkdtemp(prefix="revlens-stages-")


@contextmanager
def _open_files(spark: SparkSession, files: int) -> Iterator[None]:
    """Let each writing task hold so many files open, while the block lasts."""
    if not files:
        yield
        return
    before = spark.conf.get(WRITERS_SETTING, None)
    spark.conf.set(WRITERS_SETTING, str(files))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(WRITERS_SETTING)
        else:
            spark.conf.set(WRITERS_SETTING, before)


class StageStore:
    """One folder of stages. A name saved again gets a path of its own, so no stage that an earlier
    frame still reads is ever overwritten."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
        self._saves: Counter[str] = Counter()

    def within(self, name: str) -> StageStore:
        """A fresh folder inside this one."""
        return StageStore(self.spark, self.path(f"{name}-{uuid.uuid4().hex[:8]}"))

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def save(
        self, frame: DataFrame, name: str, partition_by: Sequence[str] = (), folders: int = 0
    ) -> DataFrame:
        """`folders` is the number of values of `partition_by`, if it is known and small."""
        self._saves[name] += 1
        path = self.path(name if self._saves[name] == 1 else f"{name}-{self._saves[name]}")
        writer = frame.write.mode("error").options(**COMPRESSION)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        with _open_files(self.spark, folders):
            writer.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def save_observed(
        self, frame: DataFrame, name: str, figures: Mapping[str, Column]
    ) -> tuple[DataFrame, dict[str, object]]:
        """A stage, and aggregates over its rows that the write itself has taken."""
        seen = Observation()
        columns = [column.alias(figure) for figure, column in figures.items()]
        return self.save(frame.observe(seen, *columns), name), seen.get

    def drop(self) -> None:
        """Delete the folder with all of its stages; frames that still read them fail from then on."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
