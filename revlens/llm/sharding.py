"""Shards of near equal bytes from sampled splitters.

Keys are drawn with chances in proportion to record size, the draws' quantiles split the key space into
many ranges, and the bytes of each range are measured exactly. Ranges that turn out overfull are
subdivided by a second key, so that one group of copies with a third of all rows is cut as well. Every
shard takes a run of consecutive ranges; then ranges move from the fullest to the emptiest shard while
that brings the two nearer. Only ranges reach the driver, `CELLS_PER_SHARD` or a few times that for
each shard, whatever the table holds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import array_literal, box, unboxed, unit_hash
from revlens.sources.stages import StageStore

SHARDS = 24
CELLS_PER_SHARD = 64
DRAWS_PER_CELL = 16
KEY_BITS = 52
# rows of a range, about, where shards alone would make them larger
RANGE_ROWS = 1 << 20
RESULTS = ("shard", "slot")


def _cells(shards: int) -> int:
    return 1 << (shards * CELLS_PER_SHARD - 1).bit_length()


def _range_of(bounds: Column, cells: int, key: Column) -> Column:
    """How many bounds are at or below the key, by halving steps."""
    steps = []
    step = cells // 2
    while step:
        steps.append(step)
        step //= 2
    return F.aggregate(
        array_literal(steps, "int"),
        F.lit(0),
        lambda at, by: at + F.when(F.get(bounds, at + by - F.lit(1)) <= key, by).otherwise(F.lit(0)),
    )


def splitters(keyed: DataFrame, total: int, cells: int) -> list[int]:
    """cells - 1 ascending keys at the quantiles of the size-weighted draws."""
    draws = F.floor(
        F.col("_weight") * F.lit(cells * DRAWS_PER_CELL / total) + unit_hash("_tie", F.lit("draw"))
    )
    shares = array_literal([index / cells for index in range(1, cells)], "double")
    drawn = keyed.select("_key", draws.alias("_draws")).where("_draws > 0")
    found = drawn.agg(F.percentile("_key", shares, F.col("_draws")).alias("at")).first()["at"]
    return [int(value) for value in found or [0] * (cells - 1)]


@dataclass(frozen=True)
class _Layout:
    """Shard and first slot of each range, in key order."""

    shard: list[int]
    first_slot: list[int]


def _balanced(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Consecutive ranges to each shard, then single ranges from the fullest to the emptiest."""
    if not len(sizes):
        return np.zeros(0, dtype=int)
    middle = np.cumsum(sizes) - sizes / 2
    owner = np.minimum((middle * shards / max(sizes.sum(), 1)).astype(int), shards - 1)
    loads = np.bincount(owner, weights=sizes, minlength=shards)
    for _ in range(4 * len(sizes)):
        full, empty = int(loads.argmax()), int(loads.argmin())
        gap = loads[full] - loads[empty]
        own = np.flatnonzero((owner == full) & (sizes > 0) & (sizes < gap))
        if not len(own):
            break
        moved = own[np.abs(sizes[own] - gap / 2).argmin()]
        owner[moved] = empty
        loads[full] -= sizes[moved]
        loads[empty] += sizes[moved]
    return owner


def _layout(ranges: list, count: int, shards: int) -> _Layout:
    sizes, rows = np.zeros(count), np.zeros(count, dtype=np.int64)
    for row in ranges:
        sizes[row["unit"]], rows[row["unit"]] = row["bytes"], row["rows"]
    owner = _balanced(sizes, shards)
    first = np.zeros(count, dtype=np.int64)
    for shard in range(shards):
        own = np.flatnonzero(owner == shard)
        first[own] = np.cumsum(rows[own]) - rows[own]
    return _Layout(owner.tolist(), first.tolist())


def shard(
    docs: DataFrame, store: StageStore, size: Column, key: Column, shards: int = SHARDS
) -> DataFrame:
    """`docs` with shard (from 0) and slot (gapless from 0 within its shard).

    `size` is what the shards share out evenly; a null or negative size counts as nothing. Records go by
    a hash of `key`, so equal keys stay together unless their range is overfull; a null key is a key
    like any other. Repeated rows each get a slot of their own. A record larger than a shard's share fills
    its shard by itself, however long its text. An input column named shard or slot gives way to the result. An empty table gives an empty result.
    """
    weight = F.greatest(F.coalesce(size.cast("bigint"), F.lit(0)), F.lit(0))
    # one select, so that no working column can clash with one of the input
    keyed = store.save(
        docs.select(
            box(docs),
            weight.alias("_bytes"),
            F.greatest(weight, F.lit(1)).alias("_weight"),
            F.shiftrightunsigned(F.xxhash64(key), 12).alias("_key"),
            F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 12).alias("_tie"),
        ),
        "keyed",
    )
    sums = keyed.agg(F.sum("_weight").alias("weight"), F.count(F.lit(1)).alias("rows")).first()
    total = sums["weight"] or 1
    # ranges grow with the rows, so that each stays small enough to be put in order by one task
    cells = max(_cells(shards), 1 << (sums["rows"] // RANGE_ROWS).bit_length())
    bounds = array_literal(splitters(keyed, total, cells), "bigint")
    placed = keyed.withColumn("_cell", _range_of(bounds, cells, F.col("_key")))

    measured = placed.groupBy("_cell").agg(F.sum("_weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    pieces = [1] * cells
    most = total / cells
    for row in measured.collect():  # a row per range
        if row["weight"] > 2 * most:
            pieces[row["_cell"]] = min(int(np.ceil(row["weight"] / most)), row["n"])
    offsets = np.concatenate([[0], np.cumsum(pieces)])
    piece = F.floor(
        F.col("_tie") / F.lit(float(1 << KEY_BITS)) * F.get(array_literal(pieces, "int"), F.col("_cell"))
    ).cast("int")
    units = placed.withColumn(
        "_unit", F.get(array_literal(offsets.tolist(), "int"), F.col("_cell")) + piece
    )
    ranges = units.groupBy(F.col("_unit").alias("unit")).agg(
        F.sum("_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")
    )
    layout = _layout(ranges.collect(), int(offsets[-1]), shards)  # a row per range
    within = Window.partitionBy("_unit").orderBy("_key", "_tie")
    return units.withColumn("_rank", F.row_number().over(within) - F.lit(1)).select(
        *unboxed(docs.columns, RESULTS),
        F.get(array_literal(layout.shard, "int"), F.col("_unit")).alias("shard"),
        (F.get(array_literal(layout.first_slot, "bigint"), F.col("_unit")) + F.col("_rank")).alias(
            "slot"
        ),
    )


def text_bytes(text: str) -> Column:
    """Bytes of the text in UTF-8 (none for null) and eight more for its record."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + F.lit(8)
