"""Ranked lexical search: the best documents of every item, by an exact dual-tree search.

A document is the vector of its saturated term frequencies, an item the vector of the weights of its
terms, and a score is their inner product. Items form one hierarchy, the documents of a batch another;
every node holds the largest value of each coordinate below it, so the product of two nodes bounds every
score between them. A pair of nodes whose bound is under the weakest kth score of its items is left out
whole, with all that is below. Nothing that could be ranked is lost, so the result is exact.

Each task searches the batches of its own documents and keeps k a task and item; those meet in one
window. Kth scores of a sample of documents open the search: they are scores that documents do have,
hence lower bounds, and change the work only. Items come in blocks of bounded bytes, since a block goes
to all tasks.

All sums are of whole numbers below 2 ** 53, so products of matrices of doubles are exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.sources.stages import StageStore

# everything but ASCII letters and digits separates terms, only A-Z are lower-cased
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLDED = bytes(at if at >= 128 or chr(at).isalnum() else 32 for at in range(256)).lower()
# terms of a block of items, in bytes; a single longer item is a block of its own size
BLOCK_BYTES = 1 << 18
# documents whose kth scores open the search
SEED_DOCUMENTS = 20_000
# documents of one hierarchy, of one of its leaves, and items of a leaf
BATCH, LEAF, ITEM_LEAF = 2048, 32, 4
# beyond this many coordinates sums could pass 2 ** 53, and whole numbers are used instead
EXACT_TERMS = 300_000
NO_ID = (1 << 63) - 1

FOUND = "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"
HIT = "item int, doc_id bigint, score bigint"


def terms_of(text: Column) -> Column:
    """The terms of a text with repeats; none for null."""
    folded = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))


def split_terms(text: str | None) -> list[bytes]:
    """The same terms as UTF-8 bytes."""
    return text.encode("utf-8", "replace").translate(_FOLDED).split() if text else []


def count_terms(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of documents with at least one term: which numbered terms they hold."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))]
        )
        for batch in batches:
            ids, sizes, held, times = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = split_terms(text.as_py())
                if not words:
                    continue
                tally = Counter(filter(numbers.__contains__, words))
                ids.append(doc_id)
                sizes.append(len(words))
                held.append([numbers[word] for word in tally])
                times.append(list(tally.values()))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": ids, "n": sizes, "terms": held, "tfs": times}, schema=schema
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(counted, FOUND)


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _upwards(leaves: np.ndarray) -> list[np.ndarray]:
    """Levels of a binary hierarchy of maxima, the leaves first and the root last."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        if len(below) % 2:
            below = np.vstack([below, np.zeros((1, below.shape[1]), below.dtype)])
        levels.append(np.maximum(below[0::2], below[1::2]))
    return levels


@dataclass
class ItemTree:
    """A block of items: their terms as numbers, in leaves of items that share their heaviest terms."""

    order: list[int]
    members: list[list[int]]
    columns: list[np.ndarray]
    weights: list[np.ndarray]
    levels: list[np.ndarray]

    @classmethod
    def over(cls, items: list[list[int]], weights: np.ndarray) -> ItemTree:
        def heaviest(item: int) -> list[tuple[int, int]]:
            return sorted(((-int(weights[term]), term) for term in items[item]))[:4]

        order = sorted(range(len(items)), key=heaviest)
        kind = np.float64 if len(weights) < EXACT_TERMS else np.int64
        members = [order[at : at + ITEM_LEAF] for at in range(0, len(order), ITEM_LEAF)]
        columns, local = [], []
        peaks = np.zeros((len(members), len(weights)), kind)
        for leaf, inside in enumerate(members):
            terms = np.unique(np.concatenate([np.asarray(items[item], np.int64) for item in inside]))
            block = np.zeros((len(inside), len(terms)), kind)
            for row, item in enumerate(inside):
                at = np.searchsorted(terms, np.asarray(items[item], np.int64))
                block[row, at] = weights[np.asarray(items[item], np.int64)]
            columns.append(terms)
            local.append(block)
            peaks[leaf, terms] = weights[terms]
        return cls(order, members, columns, local, _upwards(peaks))


class Best:
    """The k best (score, least id) of every item met so far."""

    def __init__(self, least: list[int], k: int) -> None:
        self.k = k
        self.least = np.asarray(least, np.float64)
        self.scores: list[np.ndarray] = [np.empty(0) for _ in least]
        self.ids: list[np.ndarray] = [np.empty((0, 2), np.int64) for _ in least]

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.concatenate([self.scores[item], scores])
        ids = np.concatenate([self.ids[item], ids])
        kept = np.lexsort((ids[:, 1], ids[:, 0], -scores))[: self.k]
        self.scores[item], self.ids[item] = scores[kept], ids[kept]
        if len(kept) == self.k:
            self.least[item] = max(self.least[item], scores[kept[-1]])


def _surviving(tree: ItemTree, heights: list[np.ndarray], best: Best) -> list[tuple[float, int, int]]:
    """(bound, item leaf, document leaf) of the pairs of leaves that no bound above them rules out."""
    weakest = [np.array([best.least[inside].min() for inside in tree.members])]
    while len(weakest[-1]) > 1:
        below = weakest[-1]
        if len(below) % 2:
            below = np.append(below, np.inf)
        weakest.append(np.minimum(below[0::2], below[1::2]))
    left, right = len(tree.levels) - 1, len(heights) - 1
    open_pairs = np.ones((1, 1), bool)
    while True:
        bounds = tree.levels[left] @ heights[right].T
        open_pairs = open_pairs & (bounds > 0) & (bounds >= weakest[left][:, None])
        if left == 0 and right == 0:
            leaves = np.argwhere(open_pairs)
            return sorted(((float(bounds[i, d]), int(i), int(d)) for i, d in leaves), reverse=True)
        # both hierarchies are halved together; the one that has reached its leaves waits
        if left > 0:
            left -= 1
            open_pairs = np.repeat(open_pairs, 2, axis=0)[: len(tree.levels[left])]
        if right > 0:
            right -= 1
            open_pairs = np.repeat(open_pairs, 2, axis=1)[:, : len(heights[right])]


def search_batch(
    tree: ItemTree, weights: np.ndarray, best: Best, rows: np.ndarray, terms: np.ndarray, values: np.ndarray, ids: np.ndarray
) -> None:
    """Search one batch: `rows`, `terms` and `values` hold its vectors, `ids` its documents."""
    count, width = len(ids), len(weights)
    # documents with the same heaviest term lie side by side, so leaves differ in their maxima
    worth = weights[terms] * values
    by_row = np.lexsort((terms, -worth, rows))
    first = np.ones(len(by_row), bool)
    first[1:] = rows[by_row][1:] != rows[by_row][:-1]
    lead = np.zeros(count, np.int64)
    lead[rows[by_row][first]] = terms[by_row][first]
    place = np.empty(count, np.int64)
    place[np.lexsort((np.arange(count), lead))] = np.arange(count)
    spot = place[rows]
    placed = np.empty_like(ids)
    placed[place] = ids
    leaves = -(-count // LEAF)
    peaks = np.zeros(leaves * width, tree.levels[0].dtype)
    np.maximum.at(peaks, spot // LEAF * width + terms, values)
    heights = _upwards(peaks.reshape(leaves, width))
    by_spot = np.argsort(spot, kind="stable")
    spot, terms, values = spot[by_spot], terms[by_spot], values[by_spot]
    starts = np.searchsorted(spot, np.arange(leaves + 1) * LEAF)
    dense: dict[int, np.ndarray] = {}
    for bound, item_leaf, leaf in _surviving(tree, heights, best):
        inside = tree.members[item_leaf]
        if bound < best.least[inside].min():
            continue
        if leaf not in dense:
            here = slice(starts[leaf], starts[leaf + 1])
            table = np.zeros((min(LEAF, count - leaf * LEAF), width), peaks.dtype)
            table[spot[here] - leaf * LEAF, terms[here]] = values[here]
            dense[leaf] = table
        scores = tree.weights[item_leaf] @ dense[leaf][:, tree.columns[item_leaf]].T
        for row, item in enumerate(inside):
            good = (scores[row] > 0) & (scores[row] >= best.least[item])
            if good.any():
                where = np.flatnonzero(good)
                best.add(item, scores[row][where], placed[leaf * LEAF + where])


def _best_of(found: DataFrame, tree: ItemTree, weights: np.ndarray, totals: tuple[int, int], least: list[int], k: int) -> DataFrame:
    """(item, doc_id, score): the best of every task; the item is its place in the block."""
    documents, length = totals

    def searched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(least, k)
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                held, times = batch.column("terms"), batch.column("tfs")
                sizes = held.value_lengths().to_numpy(zero_copy_only=False)
                rows = np.repeat(np.arange(batch.num_rows), sizes)
                terms = held.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                tfs = times.flatten().to_numpy(zero_copy_only=False)
                norms = np.array([10 + 90 * n * documents // length for n in batch.column("n").to_pylist()], np.int64)
                values = (1_000_000_000 * tfs) // (1000 * tfs + 8 * norms[rows])
                names = batch.column("doc_id")
                missing = names.is_null().to_numpy(zero_copy_only=False)
                ids = np.stack([names.fill_null(NO_ID).to_numpy(zero_copy_only=False), missing.astype(np.int64)], 1)
                search_batch(tree, weights, best, rows, terms, values.astype(tree.levels[0].dtype), ids)
        hits = [
            (item, None if absent else int(doc_id), int(score))
            for item in range(len(least))
            for score, (doc_id, absent) in zip(best.scores[item], best.ids[item], strict=True)
        ]
        schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])
        columns = dict(zip(schema.names, zip(*hits, strict=True), strict=True)) if hits else {name: [] for name in schema.names}
        yield pa.RecordBatch.from_pydict({name: list(column) for name, column in columns.items()}, schema=schema)

    return found.mapInArrow(searched, HIT)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, items: DataFrame, store: StageStore, k: int) -> DataFrame | None:
    # a block is bounded by BLOCK_BYTES, so it may pass through the driver and go to every task
    block = items.collect()
    if not block:
        return None
    vocabulary = sorted({term for row in block for term in row["terms"]})
    numbers = {term.encode("utf-8", "replace"): number for number, term in enumerate(vocabulary)}
    found = store.save(count_terms(docs, numbers), "found")
    totals = found.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
    if not totals["documents"]:
        return None
    holding = found.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    held = Counter({row["term"]: row["count"] for row in holding})
    weights = np.array([term_weight(totals["documents"], held[number]) for number in range(len(vocabulary))], np.int64)
    place = {term: number for number, term in enumerate(vocabulary)}
    tree = ItemTree.over([[place[term] for term in row["terms"]] for row in block], weights)
    sums = (totals["documents"], totals["length"])
    matched = found.where(F.size("terms") > 0)
    least = [1] * len(block)
    share = totals["documents"] // SEED_DOCUMENTS
    if share > 1:
        seed = matched.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(share)) == 0)
        for row in _ranked(_best_of(seed, tree, weights, sums, least, k), k).where(F.col("rank") == k).collect():
            least[row["item"]] = row["score"]
    ranked = _ranked(_best_of(matched, tree, weights, sums, least, k), k)
    names = F.array(*[F.lit(row["item_id"]).cast("bigint") for row in block])
    return ranked.select(F.get(names, F.col("item")).alias("item_id"), "rank", "doc_id", "score")


def ranked_documents(docs: DataFrame, items: DataFrame, store: StageStore, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item with a score above 0.

    `docs` has doc_id and text, `items` item_id and text; other columns are not looked at. Equal scores
    rank by ascending doc_id, null ids last. Every row is a document or an item of its own, repeated
    rows too, and null ids are kept. Null and empty texts have no terms: such documents count nowhere,
    such items find nothing. Texts are read whole. Empty tables give an empty result.
    """
    wanted = items.select("item_id", F.array_distinct(terms_of(F.col("text"))).alias("terms"))
    wanted = store.save(
        wanted.where(F.size("terms") > 0).withColumn("bytes", F.octet_length(F.array_join("terms", " "))), "items"
    )
    blocks = -(-(wanted.agg(F.sum("bytes").alias("bytes")).first()["bytes"] or 0) // BLOCK_BYTES)
    parts = []
    for number in range(blocks):
        inside = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == number)
        part = _search_block(docs, inside, store.within(f"block_{number}"), k)
        if part is not None:
            parts.append(part)
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, parts)
