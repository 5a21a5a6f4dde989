"""Global row numbers, running totals and quantile groups without a single-partition window.

A range-partitioned sort is written once as a stage table together with each row's position, which
Spark builds from the partition number and the row number inside it. Adding up the per-partition
row counts then turns positions into global row numbers with plain arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.sources.stages import StageStore

POSITION = "_position"
PARTITION_SHIFT = 33
ROW_MASK = (1 << PARTITION_SHIFT) - 1


def partition_of(position: str = POSITION) -> Column:
    return F.shiftright(F.col(position), PARTITION_SHIFT).cast("int")


def _array_literal(values: Sequence[object], element: str) -> Column:
    # one text literal folds into one array constant, however many partitions there are
    return F.split(F.lit(",".join(str(value) for value in values)), ",").cast(f"array<{element}>")


@dataclass(frozen=True)
class SortedStage:
    """A stage table in global order, with what is needed to number its rows."""

    table: DataFrame
    rows: int
    row_offsets: tuple[int, ...]
    sum_offsets: tuple[object, ...]
    # aggregates over all rows, taken while they were written
    figures: Mapping[str, object] | None = None

    def row_number(self) -> Column:
        local = F.col(POSITION).bitwiseAND(F.lit(ROW_MASK)) + F.lit(1)
        return local + F.get(_array_literal(self.row_offsets, "bigint"), partition_of())

    def numbered(self, name: str, keep_position: bool = False) -> DataFrame:
        frame = self.table.select(self.row_number().alias(name), "*")
        return frame if keep_position else frame.drop(POSITION)

    def running_sum(self, column: str) -> Column:
        """Running total in row order: a window per range partition plus what came before it."""
        window = (
            Window.partitionBy(partition_of())
            .orderBy(POSITION)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        before = F.get(_array_literal(self.sum_offsets, "decimal(38,4)"), partition_of())
        return F.sum(column).over(window) + before


def sorted_stage(
    store: StageStore,
    frame: DataFrame,
    order: Sequence[Column],
    name: str,
    total: str | None = None,
    figures: Mapping[str, Column] | None = None,
    derive: Callable[[DataFrame], DataFrame] | None = None,
) -> SortedStage:
    """Sort by a total order and stage it; `total` names a decimal column to prefix-sum as well.

    `derive` adds columns row by row behind the sort and keeps the position."""
    ordered = frame.orderBy(*order).withColumn(POSITION, F.monotonically_increasing_id())
    if derive:
        ordered = derive(ordered)
    # observed above the sort, whose input is read once more for its bounds
    table, seen = store.save_observed(ordered, name, figures) if figures else (store.save(ordered, name), None)
    sums = F.sum(total) if total else F.lit(0)
    # one row per range partition comes back, whatever the table holds
    parts = (
        table.groupBy(partition_of().alias("part"))
        .agg(F.count(F.lit(1)).alias("rows"), sums.alias("total"))
        .collect()
    )
    by_part = {row["part"]: row for row in parts}
    row_offsets, sum_offsets = [0], [0]
    for part in range(max(by_part, default=-1) + 1):
        row = by_part.get(part)
        row_offsets.append(row_offsets[-1] + (row["rows"] if row else 0))
        sum_offsets.append(sum_offsets[-1] + ((row["total"] or 0) if row else 0))
    return SortedStage(table, row_offsets[-1], tuple(row_offsets), tuple(sum_offsets), seen)


def tile_starts(rows: int, tiles: int) -> list[int]:
    """Row number at which each NTILE group after the first begins; empty groups are left out."""
    size, larger = divmod(rows, tiles)
    starts, start = [], 1
    for tile in range(1, tiles):
        start += size + (1 if tile <= larger else 0)
        if start <= rows:
            starts.append(start)
    return starts


def tiles_by_measure(
    store: StageStore,
    frame: DataFrame,
    key: str,
    measures: Sequence[str],
    tiles: int,
    name: str,
) -> dict[str, Column]:
    """NTILE(tiles) of every measure, ordered by (measure, key), as expressions over `frame`.

    The measures are stacked so that one distributed sort ranks them all: measure i owns global
    rows i*n+1 .. (i+1)*n. Only the rows that open a group are fetched, tiles-1 per measure, and a
    row's group is 1 plus the openings it does not precede.
    """
    stacked = frame.select(
        F.col(key).alias("key"),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(index).alias("measure"),
                        F.col(measure).cast("decimal(38,4)").alias("value"),
                    )
                    for index, measure in enumerate(measures)
                ]
            )
        ).alias("m"),
    ).select("m.measure", "m.value", "key")
    ordered = sorted_stage(
        store, stacked, [F.col("measure").asc(), F.col("value").asc(), F.col("key").asc()], name
    )
    rows = ordered.rows // len(measures)
    wanted = [
        index * rows + start
        for index in range(len(measures))
        for start in tile_starts(rows, tiles)
    ]
    openings = (
        ordered.numbered("row").where(F.col("row").isin(wanted)).collect() if wanted else []
    )
    result: dict[str, Column] = {}
    for index, measure in enumerate(measures):
        tile = F.lit(1)
        for opening in openings:
            if opening["measure"] != index:
                continue
            value = F.lit(opening["value"]).cast("decimal(38,4)")
            current = F.col(measure).cast("decimal(38,4)")
            reached = (current > value) | (
                (current == value) & (F.col(key) >= F.lit(opening["key"]))
            )
            tile = tile + reached.cast("int")
        result[measure] = tile
    return result
