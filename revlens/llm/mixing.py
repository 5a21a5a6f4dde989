"""Mixes sources to target weights by whole copies and Pareto order sampling.

A source's target is its share of all words by weight, limited to three times its own size. Each of its
documents is taken floor(target / size of the source) times for certain. What is left of the target is
drawn without replacement by Pareto sampling: documents are ranked by their random odds divided by
their inclusion odds, and the ranking is cut where the words reach the target. Inclusion odds follow
the square root of a document's words. The ranking of a source is never brought together: sums over
slices of the ranking find the slice with the cut, a second round of slices narrows it, and only that
sliver is put in order.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import WORD, box, quoted, unboxed
from revlens.sources.stages import StageStore

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
MAX_SOURCES = 100_000
SLICES = 4096
RANDOM_BITS = 52
RESULTS = ("size", "source_size", "target", "taken", "copies")


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(quoted(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS) -> dict[str | None, float]:
    """The words each source is to give: its share by weight, what passes its limit reshared."""
    names = sorted(sizes, key=lambda name: (name is None, name or ""))
    weight = {name: weights[at % len(weights)] for at, name in enumerate(names)}
    limit = {name: MAX_COPIES * sizes[name] for name in names}
    left, shares, result = sum(sizes.values()), sum(weight.values()), {}
    for name in sorted(names, key=lambda name: (Fraction(limit[name], weight[name]), names.index(name))):
        if limit[name] * shares <= weight[name] * left:
            result[name] = float(limit[name])
            left -= limit[name]
            shares -= weight[name]
        else:
            result[name] = None
    return {
        name: left * weight[name] / shares if found is None else found
        for name, found in result.items()
    }


def _cut_slices(rows: DataFrame, slice_name: str, before: Column) -> DataFrame:
    """Per source the slice of the ranking in which the words pass what is wanted."""
    sums = rows.groupBy("_source", "_wanted", before.alias("_before"), slice_name).agg(
        F.sum("_size").alias("_words")
    )
    order = Window.partitionBy("_source").orderBy(slice_name)
    upto = F.col("_before") + F.sum("_words").over(order)
    cut = sums.withColumn("_upto", upto).withColumn("_start", upto - F.col("_words"))
    return cut.where((F.col("_upto") > F.col("_wanted")) & (F.col("_start") <= F.col("_wanted"))).select(
        F.col("_source").alias("_cut_source"), slice_name, F.col("_start").alias("_cut_start")
    )


def _rank(wanted_rate: Column) -> Column:
    """Random odds over inclusion odds, mapped to [0, 1) without changing their order."""
    random = (F.col("_random") + F.lit(0.5)) / F.lit(float(1 << RANDOM_BITS))
    chance = wanted_rate * F.sqrt(F.col("_size"))
    odds = (random / (F.lit(1.0) - random)) * ((F.lit(1.0) - chance) / chance)
    return F.when(chance >= 1.0, F.lit(0.0)).when(chance > 0.0, odds / (odds + F.lit(1.0)))


def mix(
    docs: DataFrame,
    store: StageStore,
    source: str = "source",
    doc_id: str = "doc_id",
    text: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
) -> DataFrame:
    """`docs` with size, source_size, target, taken and copies; taken is size times copies.

    A null text has no words and is taken as often as any document, for no words. A null source is a
    source of its own, after all others. A null doc_id draws like the text "null". Rows that repeat a
    doc_id share their random number and are taken one after the other. An input column with the name
    of a result gives way to it. An empty table gives an empty result. More than `MAX_SOURCES` sources
    are refused, since each has its target on the driver.
    """
    drawn = F.substring(F.md5(F.coalesce(quoted(doc_id).cast("string"), F.lit("null"))), 1, 13)
    # one select, so that no working column can clash with one of the input
    staged = store.save(
        docs.select(
            box(docs),
            word_count(text).alias("_size"),
            quoted(source).cast("string").alias("_source"),
            F.conv(drawn, 16, 10).cast("bigint").alias("_random"),
            F.monotonically_increasing_id().alias("_at"),
        ),
        "measured",
    )
    # whole numbers, so that the sums do not depend on the order of the rows
    rooted = F.floor(F.col("_size") * F.sqrt(F.col("_size")))
    sums = (
        staged.groupBy("_source")
        .agg(F.sum("_size").alias("words"), F.sum(rooted.cast("decimal(38,0)")).alias("rooted"))
        .limit(MAX_SOURCES + 1)
        .collect()
    )
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    wanted = targets({row["_source"]: row["words"] for row in sums}, weights)
    plan = []
    for row in sums:
        words, target = row["words"], wanted[row["_source"]]
        copies = math.floor(target / words) if words else 0
        rest = target - copies * words
        rate = rest / float(row["rooted"]) if row["rooted"] else 0.0
        plan.append((row["_source"], words, target, copies, rest, rate))
    spark = docs.sparkSession
    sources = spark.createDataFrame(
        plan,
        "_plan_source string, source_size bigint, target double, _copies int, _wanted double, _rate double",
    )
    known = F.col("_source").eqNullSafe(F.col("_plan_source"))
    rank = _rank(F.col("_rate"))
    ranked = staged.join(F.broadcast(sources), known).withColumns(
        {"_rank": rank, "_coarse": F.floor(rank * SLICES), "_fine": F.floor(rank * SLICES * SLICES)}
    )
    slim = ranked.where("_rank is not null and _wanted > 0").select(
        "_source", "_size", "_random", "_at", "_wanted", "_rank", "_coarse", "_fine"
    )
    in_cut = F.col("_source").eqNullSafe(F.col("_cut_source"))
    coarse = store.save(_cut_slices(slim, "_coarse", F.lit(0).cast("bigint")), "coarse_cuts")
    narrowed = slim.join(
        F.broadcast(coarse.withColumnRenamed("_coarse", "_cut_coarse")),
        in_cut & (F.col("_coarse") == F.col("_cut_coarse")),
    )
    fine = store.save(_cut_slices(narrowed, "_fine", F.col("_cut_start")), "fine_cuts")
    sliver = slim.join(
        F.broadcast(fine.withColumnRenamed("_fine", "_cut_fine")),
        in_cut & (F.col("_fine") == F.col("_cut_fine")),
    )
    order = Window.partitionBy("_source", "_cut_fine").orderBy("_rank", "_random", "_at")
    before = F.col("_cut_start") + F.sum("_size").over(order) - F.col("_size")
    # the document that crosses the cut is taken where that comes nearer to the target
    taken = (F.lit(2) * F.col("_before") + F.col("_size")) <= F.lit(2.0) * F.col("_wanted")
    place = F.struct("_rank", "_random", "_at")
    last = (
        sliver.withColumn("_before", before)
        .groupBy(F.col("_source").alias("_cut_source"), "_cut_fine")
        .agg(F.max(F.when(taken, place)).alias("_last"))
    )
    last = store.save(last, "last_taken")
    extra = F.coalesce(
        (F.col("_fine") < F.col("_cut_fine"))
        | ((F.col("_fine") == F.col("_cut_fine")) & F.coalesce(place <= F.col("_last"), F.lit(False))),
        F.lit(False),
    )
    copies = F.col("_copies") + extra.cast("int")
    return ranked.join(F.broadcast(last), in_cut, "left").select(
        *unboxed(docs.columns, RESULTS),
        F.col("_size").alias("size"),
        "source_size",
        "target",
        (F.col("_size") * copies).alias("taken"),
        copies.alias("copies"),
    )


def mixed(
    docs: DataFrame, store: StageStore, source: str = "source", doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`docs` with each row as many times as the mix takes it; all columns stay, whatever their names."""
    held = docs.select(
        F.struct(*[quoted(name) for name in docs.columns]).alias("held"),
        quoted(source).alias("source"),
        quoted(doc_id).alias("doc_id"),
        quoted(text).alias("text"),
    )
    chosen = mix(held, store).where("copies > 0")
    repeated = chosen.select("held", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select("held.*")
