"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.sources.stages import StageStore


def _neighbours(edges: DataFrame) -> DataFrame:
    """(node, label, open): the least of a node and its neighbours, and whether it keeps its component from being a star.

    In a star whose centre is its least node, a node with a smaller neighbour has no other.
    """
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    ends = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    unsettled = (F.col("low") < F.col("node")) & (F.col("low") != F.col("high"))
    return ends.select("node", F.least("node", "low").alias("label"), unsettled.alias("open"))


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    return edges.join(least, F.col("v") == F.col("node")).select("u", F.col("label").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
    return edges.join(least, "u").select(F.explode(ends).alias("edge")).select("edge.*").where("u <> v")


def components(edges: DataFrame, store: StageStore, name: str) -> DataFrame:
    """(node, label) of every node with a link; the label is the least node of its component.

    `edges` should be a stage: the first round reads it more than once. Each round is written as a stage,
    so the lineage stays short and a lost executor costs no more than the round it worked on. Rounds grow
    with the logarithm of the longest path, and end as soon as all components are stars; links that are
    stars from the start take none. Star centres may be joined with a third of all rows: adaptive
    execution splits such a join. No links give no rows.
    """
    one, two = edges.columns[:2]
    current = edges.select(F.greatest(one, two).alias("u"), F.least(one, two).alias("v")).where("u <> v")
    while True:
        # the aggregate that a round starts from tells whether there is any need of it
        least = store.save(_neighbours(current), f"{name}_labels")
        if least.where("open").isEmpty():
            return least.select("node", "label")
        current = store.save(_small_star(_large_star(current, least)).distinct(), name)
