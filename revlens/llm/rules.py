"""Quality rules: counted base rules, then a likelihood ratio of hashed n-grams.

Words and pairs of neighbouring words are hashed into buckets. Two multinomials over the buckets are
estimated: the raw one from all documents, the target from trusted ones. A document's score is the mean
log ratio of its n-grams, kept in whole millionths so that sums do not depend on their order. Documents
below a fixed mean are rejected: every document meets the same threshold, without chance.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import ROW, WORD, array_literal, quoted, unboxed
from revlens.sources.stages import StageStore

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
SYMBOLS = r"[#*$%&|<>]"
BUCKETS = 1 << 16
SCALE = 1_000_000
# a document is kept where the mean log ratio of its n-grams is at least this, in millionths
MIN_MEAN = -150_000
# ids of trusted documents that a broadcast may have; beyond it the join shuffles ids and n-grams
BROADCAST_IDS = 1_000_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
RESULTS = (*BASE, "n_grams", "log_ratio", "kept")


def _spaced(text: Column) -> Column:
    """The text with every blank a plain space."""
    spaced = F.coalesce(text, F.lit(""))
    for blank in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    return spaced


def _doubled(hashes: str, step: int) -> Column:
    """Hashes of runs twice as long from hashes of runs of `step` words."""
    shifted = F.slice(hashes, step + 1, F.greatest(F.size(hashes), F.lit(1)))
    pairs = F.zip_with(hashes, shifted, lambda one, two: F.xxhash64(one, two))
    # the last `step` runs have no partner
    return F.slice(pairs, 1, F.greatest(F.size(hashes) - F.lit(step), F.lit(0)))


def _gram_buckets() -> Column:
    """Buckets of words and of pairs, small enough for two bytes each."""
    low = F.lit(BUCKETS - 1)
    return F.transform(
        F.concat("_hashes", "_pairs"),
        lambda gram: (gram.bitwiseAND(low) - F.lit(BUCKETS // 2)).cast("smallint"),
    )


def log_ratios(grams: DataFrame, trusted: DataFrame) -> list[int]:
    """The log ratio of each bucket in millionths, smoothed by one n-gram a bucket.

    `grams` has the `_grams` of all documents, `trusted` those of the trusted ones; what comes back is
    one row a bucket. Without trusted documents every ratio is 0.
    """
    both = grams.select(F.lit(0).alias("_trusted"), "_grams").union(trusted.select(F.lit(1), "_grams"))
    exploded = both.select("_trusted", F.explode_outer("_grams").alias("_gram"))
    counted = (
        exploded.groupBy("_gram")
        .agg(F.sum(F.lit(1) - F.col("_trusted")).alias("raw"), F.sum("_trusted").alias("target"))
        .where("_gram is not null")
        .collect()
    )
    raw, target = [1] * BUCKETS, [1] * BUCKETS
    for row in counted:
        raw[row["_gram"] + BUCKETS // 2] += row["raw"]
        target[row["_gram"] + BUCKETS // 2] += row["target"]
    if sum(target) == BUCKETS:
        return [0] * BUCKETS
    shift = math.log(sum(raw) / sum(target))
    return [
        round(SCALE * (math.log(wanted / found) + shift))
        for wanted, found in zip(target, raw, strict=True)
    ]


def with_base_counts(docs: DataFrame, text: str) -> DataFrame:
    """`docs` with `_words`, `_hashes`, `_pairs` and the counts of the base rules."""
    counted = docs.withColumn("_spaced", _spaced(quoted(text)))
    counted = counted.withColumn("_words", F.array_remove(F.split("_spaced", " "), ""))
    counted = counted.withColumn("_hashes", F.transform("_words", lambda word: F.xxhash64(word)))
    counted = counted.withColumn("_pairs", _doubled("_hashes", 1))
    lines = F.filter(F.split(F.coalesce(quoted(text), F.lit("")), "\n"), lambda line: line.rlike(WORD))
    counted = counted.withColumn("_lines", lines)
    counted = counted.withColumn("_quads", _doubled("_pairs", 2))
    counted = counted.withColumn("_windows", _doubled("_quads", 4))
    counted = counted.withColumn(
        "_repeats", F.size("_windows") > F.size(F.array_distinct("_windows"))
    )
    # only a text with a repeated window has its windows put in order
    order = F.sort_array(F.transform("_windows", lambda window, at: F.struct(window.alias("window"), at.alias("at"))))
    counted = counted.withColumn("_order", F.when(F.col("_repeats"), order))
    found = F.col("_order")
    twice = F.transform(
        found,
        lambda item, at: F.when(
            (F.get(found, at - F.lit(1))["window"] == item["window"])
            | (F.get(found, at + F.lit(1))["window"] == item["window"]),
            item["at"],
        ),
    )
    counted = counted.withColumn("_starts", F.sort_array(F.array_compact(twice)))
    none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("words"))
    covered = F.aggregate(
        "_starts",
        none,
        lambda seen, at: F.struct(
            (at + F.lit(WINDOW)).alias("end"),
            (seen["words"] + at + F.lit(WINDOW) - F.greatest(at, seen["end"])).alias("words"),
        ),
    )["words"]
    counted = counted.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.length(F.replace("_spaced", F.lit(" "), F.lit(""))).cast("bigint"),
            "n_symbols": F.coalesce(F.regexp_count(quoted(text), F.lit(SYMBOLS)), F.lit(0)).cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("bigint"),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT
    )
    return counted.withColumn("base_failed", failed)


def trusted_documents(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `counted` whose `_doc` is labelled good."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("_doc"))
    good = good.distinct()
    few = good.count() <= BROADCAST_IDS
    return counted.where("_doc is not null").join(F.broadcast(good) if few else good.hint("merge"), "_doc", "left_semi")


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    store: StageStore,
    text: str = "text",
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """`docs`, or its columns named in `carry`, with the base counts, base_failed, n_grams, log_ratio (mean, in nats) and kept.

    Texts are read once: the counts and the buckets of their n-grams are staged, ratios are estimated
    from all of them and from all trusted ones, and the scores are sums over the staged buckets. A null or empty text has no
    words: its counts are 0, base_failed holds and it is not kept. Repeated rows get equal answers. An
    input column with the name of a result gives way to it. An empty table gives an empty result.
    """
    names = docs.columns if carry is None else list(carry)
    inner = docs.select(
        F.struct(*[quoted(name) for name in names]).alias(ROW),
        quoted(text).alias("_text"),
        quoted("doc_id").cast("bigint").alias("_doc"),
    )
    counted = with_base_counts(inner, "_text").select(ROW, "_doc", *BASE, _gram_buckets().alias("_grams"))
    counted = store.save(counted, "counted")
    table = array_literal(log_ratios(counted, trusted_documents(counted, labels)), "int")
    total = F.aggregate(
        "_grams",
        F.lit(0).cast("bigint"),
        lambda sum_, gram: sum_ + F.get(table, gram + F.lit(BUCKETS // 2)),
    )
    scored = counted.withColumns({"_total": total, "n_grams": F.size("_grams").cast("bigint")})
    passed = ~F.col("base_failed") & (F.col("_total") >= F.col("n_grams") * F.lit(MIN_MEAN))
    mean = F.col("_total") / F.col("n_grams") / F.lit(float(SCALE))
    return scored.select(
        *unboxed(names, RESULTS),
        *BASE,
        "n_grams",
        F.when(F.col("n_grams") > 0, mean).otherwise(F.lit(0.0)).alias("log_ratio"),
        passed.alias("kept"),
    )
