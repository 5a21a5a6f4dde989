"""The corpus pipeline: every stage works on all documents that the one before it has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import decontaminate, minhash, mixing, quality, sharding
from revlens.llm.common import table
from revlens.llm.shipping import ship_package
from revlens.sources.stages import StageStore

ORACLE_SQL = None
# percent of the shingles that near copies share at least; op2_minhash asks for 85
SIMILARITY = 80
_last: dict[str, StageStore] = {}


def _read_folders(docs: DataFrame) -> list[str]:
    """The paths that the plan of `docs` was told to read; not the files below them."""
    leaves = docs._jdf.queryExecution().analyzed().collectLeaves()
    relations = [leaves.apply(at) for at in range(leaves.size())]
    found = []
    for leaf in relations:
        if leaf.getClass().getSimpleName() == "LogicalRelation":
            roots = leaf.relation().location().rootPaths()
            found += [roots.apply(at).toString() for at in range(roots.size())]
    return found


def _own_store(spark: SparkSession, docs: DataFrame) -> StageStore:
    """A store for a stage. What the stage before has left goes, unless `docs` still reads it."""
    application = spark.sparkContext.applicationId
    before = _last.get(application)
    if before and not any(f"/{before.folder.rsplit('/', 1)[1]}" in path for path in _read_folders(docs)):
        before.drop()
    _last[application] = StageStore(spark)
    return _last[application]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    ship_package(spark)
    return quality.accepted(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _own_store(spark, docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ship_package(spark)
    return minhash.deduplicated(docs, _own_store(spark, docs), percent=SIMILARITY)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), _own_store(spark, docs))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs, _own_store(spark, docs))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in shards of near equal bytes, with their shard and slot."""
    return sharding.shard(docs, _own_store(spark, docs), sharding.text_bytes("text"), F.col("text"))


STAGES = [
    ("quality classifier", good_documents),
    ("minhash near-dedup", without_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed_sources),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        result = StageStore(spark)
        docs = result.save(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        # the result before this one has been read for the last time
        if before:
            before.drop()
        before = result
    return STAGES[-1][1](spark, docs, sf_dir)
