"""Token counts from flat token files without an index.

Texts become one stream of token ids per task, each document followed by an end identifier, cut into
blocks of equal size whatever documents they cut through. Only a list of the documents in order goes
beside it. Counting reads the blocks alone: each block is searched for the end identifier at once, and
a prefix scan over the blocks of a stream adds up what a block boundary has parted.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.llm.common import quoted
from revlens.sources.stages import StageStore

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed values: the word pattern and the end identifier that belong to the vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_ID = 50256
BLOCK_TOKENS = 1 << 16


@lru_cache(maxsize=1)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _write(path: str, block_tokens: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, coder = TaskContext.get().partitionId(), encoding(path)
        held, size, block, ordinal = [], 0, 0, 0
        for batch in batches:
            ids = []
            blocks = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found = coder.encode_ordinary(text.as_py() or "")
                held.append(np.array([*found, END_ID], dtype=np.uint32))
                size += len(found) + 1
                ids.append(doc_id)
                if size >= block_tokens:
                    tokens = np.concatenate(held)
                    whole = len(tokens) // block_tokens * block_tokens
                    for start in range(0, whole, block_tokens):
                        blocks.append(tokens[start : start + block_tokens].tobytes())
                    held, size = [tokens[whole:]], len(tokens) - whole
            yield _rows(stream, range(ordinal, ordinal + len(ids)), ids, None)
            ordinal += len(ids)
            yield _rows(stream, range(block, block + len(blocks)), None, blocks)
            block += len(blocks)
        if size:
            yield _rows(stream, range(block, block + 1), None, [np.concatenate(held).tobytes()])

    return write


def _rows(stream: int, at: range, ids: list | None, blocks: list | None) -> pa.RecordBatch:
    count = len(at)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([stream] * count, pa.int32()),
            pa.array(list(at), pa.int64()),
            pa.array(ids, pa.int64()) if ids is not None else pa.nulls(count, pa.int64()),
            pa.array(blocks, pa.binary()) if blocks is not None else pa.nulls(count, pa.binary()),
        ],
        names=["stream", "at", "doc_id", "block"],
    )


def write_streams(
    docs: DataFrame,
    store: StageStore,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str = TOKENIZER,
    block_tokens: int = BLOCK_TOKENS,
) -> tuple[DataFrame, DataFrame]:
    """The blocks (stream, block_no, block) and the documents in order (stream, ordinal, doc_id)."""
    plain = docs.select(quoted(doc_id).cast("bigint").alias("doc_id"), quoted(text).alias("text"))
    rows = plain.mapInArrow(
        _write(tokenizer, block_tokens), "stream int, at bigint, doc_id bigint, block binary"
    )
    written = store.save(rows, "streams")
    blocks = written.where("block is not null").select("stream", F.col("at").alias("block_no"), "block")
    order = written.where("block is null").select("stream", F.col("at").alias("ordinal"), "doc_id")
    return blocks, order


def read_flat_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of existing flat files of 4-byte ids; a stream is a file, named by its path."""
    size = block_tokens * 4
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("stream"), "content")
    last = F.floor((F.length("content") - F.lit(1)) / F.lit(size))
    cut = files.where(F.length("content") > 0).select(
        "stream", "content", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block_no")
    )
    return cut.select(
        "stream", "block_no", F.substring("content", (F.col("block_no") * size + 1).cast("int"), F.lit(size)).alias("block")
    )


def _search(end_id: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, sizes = [], []
            for block in batch.column("block"):
                tokens = np.frombuffer(block.as_buffer(), dtype=np.uint32)
                ends.append(np.flatnonzero(tokens == end_id).astype(np.int64))
                sizes.append(len(tokens))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("stream"),
                    batch.column("block_no"),
                    pa.array(ends, pa.list_(pa.int64())),
                    pa.array(sizes, pa.int64()),
                ],
                names=["stream", "block_no", "ends", "size"],
            )

    return search


def count_tokens(blocks: DataFrame, end_id: int = END_ID) -> DataFrame:
    """(stream, ordinal, n_tokens) of every document of the streams, its end identifier not counted.

    Tokens behind the last end identifier of a stream belong to no document.
    """
    stream_type = blocks.schema["stream"].dataType.simpleString()
    found = blocks.mapInArrow(
        _search(end_id), f"stream {stream_type}, block_no bigint, ends array<bigint>, size bigint"
    )
    # a few numbers a block: where the block starts, how many documents end before it, and where
    # the last of those ended
    order = Window.partitionBy("stream").orderBy("block_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    placed = placed.withColumn("last_end", F.col("start") + F.try_element_at("ends", F.lit(-1)))
    placed = placed.withColumns(
        {
            "ended": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)),
            "open_since": F.coalesce(F.max("last_end").over(before), F.lit(-1).cast("bigint")),
        }
    )
    one = placed.select("stream", "ended", "start", "open_since", "ends", F.posexplode("ends").alias("at", "end"))
    previous = F.when(F.col("at") == 0, F.col("open_since")).otherwise(
        F.col("start") + F.get("ends", F.col("at") - 1)
    )
    return one.select(
        "stream",
        (F.col("ended") + F.col("at")).alias("ordinal"),
        (F.col("start") + F.col("end") - previous - 1).alias("n_tokens"),
    )


def document_tokens(
    docs: DataFrame,
    store: StageStore,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str = TOKENIZER,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """(doc_id, n_tokens) of every row of `docs`, counted from its flat token streams.

    Null and empty texts have no tokens. The end identifier's own string inside a text is plain text.
    Repeated rows are counted each. An empty table gives an empty result.
    """
    blocks, order = write_streams(docs, store, doc_id, text, tokenizer, block_tokens)
    return order.join(count_tokens(blocks), ["stream", "ordinal"]).select("doc_id", "n_tokens")
