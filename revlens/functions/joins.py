"""Joins against lookup tables that may or may not fit in memory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIXED_WIDTH = 8
FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
HOT_KEYS = 1000
# a broadcast is collected and hashed on the driver, which holds some hundred bytes a row beside the values
BROADCAST_ROWS = 1_500_000
# bounds for lookups that go in arrays, which hold the values alone
PACKED_BYTES = 64 << 20
FILTER_BYTES = 32 << 20
BLOCK = 512
FILTER_BITS_A_HASH = 32


def _measured(frame: DataFrame) -> tuple[int, int]:
    """Rows of a frame, and the bytes of the values in them."""
    widths = [
        F.coalesce(F.octet_length(f"`{item.name}`"), F.lit(0))
        if isinstance(item.dataType, T.StringType)
        else F.lit(FIXED_WIDTH)
        for item in frame.schema.fields
    ]
    total = widths[0].cast("bigint")
    for width in widths[1:]:
        total = total + width
    found = frame.agg(F.count(F.lit(1)).alias("rows"), F.sum(total).alias("bytes")).first()
    return found["rows"], found["bytes"] or 0


def measured_bytes(frame: DataFrame) -> int:
    """Bytes of the values in a frame, summed over all of its rows."""
    return _measured(frame)[1]


def fits_broadcast(lookup: DataFrame, broadcast_bytes: int) -> bool:
    """Whether the driver can hold a lookup: few bytes may still be many rows, and those cost it far more."""
    rows, size = _measured(lookup)
    return rows <= BROADCAST_ROWS and size <= broadcast_bytes


def broadcast_within(lookup: DataFrame, broadcast_bytes: int) -> DataFrame:
    """`lookup` marked for broadcast where its measured size is within the bound, as it is elsewhere."""
    return F.broadcast(lookup) if fits_broadcast(lookup, broadcast_bytes) else lookup


def _block(key: Column) -> Column:
    return F.shiftright(key, BLOCK.bit_length() - 1)


def _place(key: Column) -> Column:
    return key.bitwiseAND(F.lit(BLOCK - 1)).cast("int")


def _in_arrays(entries: DataFrame, key: str, values: Sequence[str], empty: object = None) -> DataFrame:
    """One row per block of keys, with an array per value that has a place for every key of the block."""
    maps = [F.map_from_entries(F.collect_list(F.struct(_place(F.col(key)), F.col(name)))).alias(name) for name in values]
    places = F.sequence(F.lit(0), F.lit(BLOCK - 1))

    def spread_out(name: str) -> Column:
        kind = entries.schema[name].dataType
        return F.transform(
            places, lambda place: F.coalesce(F.try_element_at(F.col(name), place), F.lit(empty).cast(kind))
        ).alias(name)

    blocks = entries.groupBy(_block(F.col(key)).alias("_block")).agg(*maps)
    return blocks.select("_block", *[spread_out(name) for name in values])


def packed(lookup: DataFrame, key: str, values: Sequence[str], broadcast_bytes: int) -> DataFrame | None:
    """`lookup` in arrays over blocks of its keys, where that is small: whole numbers that lie close together.

    None where the keys are no numbers or too far apart, a value has no fixed width, or a key comes twice.
    """
    types = {item.name: item.dataType for item in lookup.schema.fields}
    if not isinstance(types[key], T.LongType) or any(not isinstance(types[name], FIXED) for name in values):
        return None
    bound = min(broadcast_bytes, PACKED_BYTES)
    entries = lookup.where(F.col(key).isNotNull())
    # keys far apart, such as hashes, are told by an estimate, before any of them moves
    about = entries.agg(F.approx_count_distinct(_block(F.col(key)))).first()[0]
    if about * BLOCK * FIXED_WIDTH * len(values) > 2 * bound:
        return None
    blocks = entries.groupBy(_block(F.col(key))).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(_place(F.col(key))).alias("places")
    )
    found = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.col("rows") - F.col("places")).alias("twice")).first()
    size = found["blocks"] * BLOCK * FIXED_WIDTH * len(values)
    if found["twice"] or size > bound:
        return None
    return _in_arrays(entries, key, values)


def filter_bits(hashes: int, broadcast_bytes: int) -> int:
    """Bits of a filter over so many hashes, a power of two; 0 where those within the bound are too few to help."""
    bound = 8 * min(broadcast_bytes, FILTER_BYTES)
    bits = max(64 * BLOCK, 1 << (FILTER_BITS_A_HASH * hashes).bit_length())
    while bits > bound:
        bits >>= 1
    return bits if bits >= max(64 * BLOCK, 4 * hashes) else 0


def hash_filter(hashes: DataFrame, name: str, bits: int) -> DataFrame:
    """A bit for each hash modulo `bits`, in words of 64, those in arrays."""
    slot = F.col(name).bitwiseAND(F.lit(bits - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int"))
    words = hashes.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    return _in_arrays(words, "word", ["bits"], empty=0)


def flag_hashes(frame: DataFrame, value: Column, blocks: DataFrame, bits: int, name: str) -> DataFrame:
    """`frame` with a flag: true wherever `value` is a hash of the filter, and seldom elsewhere."""
    slot = value.bitwiseAND(F.lit(bits - 1))
    word = F.shiftright(slot, 6)
    joined = frame.join(F.broadcast(blocks), _block(word) == F.col("_block"), "left")
    bit = F.call_function("shiftright", F.get("bits", _place(word)), slot.bitwiseAND(F.lit(63)).cast("int"))
    hit = F.coalesce(bit.bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return joined.withColumn(name, hit).drop("_block", "bits")


def attach(
    frame: DataFrame,
    lookup: DataFrame,
    key: Column,
    lookup_key: str,
    broadcast_bytes: int,
    spread: Sequence[str],
    weight: str | None = None,
    keyless_stay: bool = False,
) -> DataFrame:
    """Left join `lookup`, unique on `lookup_key` and cheap to read, where `key` matches.

    The lookup is broadcast only when its measured size is within the bound, row by row or else packed
    in arrays. Past it both sides shuffle, and no key may fill a partition:

    - `weight` names the lookup column that counts the rows per key. Keys with a thousandth of all
      rows or more, so a thousand of them at most, are looked up in a broadcast of their own.
      Without a weight, hot keys are left to adaptive skew splitting.
    - Rows with no key, or served by the hot lookup, shuffle by a hash of the `spread` columns.
      `keyless_stay` says that most rows have no key: those then stay where they are, and `frame` is read
      twice.
    """
    values = [name for name in lookup.columns if name not in (lookup_key, weight)]
    right = lookup.select(F.col(lookup_key).alias("_lookup_key"), *values)
    if fits_broadcast(right, broadcast_bytes):
        joined = frame.join(F.broadcast(right), key == F.col("_lookup_key"), "left")
        return joined.drop("_lookup_key")
    names = frame.columns
    blocks = packed(right, "_lookup_key", values, broadcast_bytes)
    if blocks is not None:
        arrays = blocks.select("_block", *[F.col(name).alias(f"_packed_{name}") for name in values])
        joined = frame.join(F.broadcast(arrays), _block(key) == F.col("_block"), "left")
        found = [F.get(f"_packed_{name}", _place(key)).alias(name) for name in values]
        return joined.select(*names, *found)
    if keyless_stay:
        types = {item.name: item.dataType for item in right.schema.fields}
        keyless = frame.where(key.isNull()).select(*names, *[F.lit(None).cast(types[v]).alias(v) for v in values])
        return keyless.unionByName(_merged(frame.where(key.isNotNull()), lookup, lookup_key, key, spread, weight))
    return _merged(frame, lookup, lookup_key, key, spread, weight)


def _merged(
    frame: DataFrame, lookup: DataFrame, lookup_key: str, key: Column, spread: Sequence[str], weight: str | None
) -> DataFrame:
    """The join of `attach` past the bound."""
    values = [name for name in lookup.columns if name not in (lookup_key, weight)]
    right = lookup.select(F.col(lookup_key).alias("_lookup_key"), *values)
    names = frame.columns
    left, cold_key = frame, key
    if weight:
        whole = lookup.agg(F.sum(weight)).scalar()
        hot = lookup.where(F.col(weight) * HOT_KEYS >= whole).select(
            F.col(lookup_key).alias("_hot_key"),
            *[F.col(name).alias(f"_hot_{name}") for name in values],
        )
        left = frame.join(F.broadcast(hot), key == F.col("_hot_key"), "left")
        cold_key = F.when(F.col("_hot_key").isNull(), key)
    key_type = right.schema["_lookup_key"].dataType
    # the key itself moves once; that a row is looked up here, or was among the hot ones, moves as a flag
    left = left.withColumn("_is_cold", cold_key.isNotNull()).withColumn(
        "_shuffle_key", F.coalesce(cold_key, F.xxhash64(*spread).cast(key_type))
    )
    if weight:
        left = left.withColumn("_is_hot", F.col("_hot_key").isNotNull()).drop("_hot_key")
    # a spread value may equal a real key, hence the second condition
    matches = (F.col("_shuffle_key") == F.col("_lookup_key")) & F.col("_is_cold")
    joined = left.hint("merge").join(right, matches, "left")
    if not weight:
        return joined.select(*names, *values)
    return joined.select(
        *names,
        *[
            F.when(F.col("_is_hot"), F.col(f"_hot_{name}")).otherwise(F.col(name)).alias(name)
            for name in values
        ],
    )
