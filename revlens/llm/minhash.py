"""Near-duplicate documents by a MinHash LSH forest.

A document is the set of its distinct five-word shingles. Documents of equal sets fold into one node
first. Each node gets 512 minhashes; the forest has 16 trees, and a tree sorts the nodes by eight of
those minhashes of its own. The low bytes of all of them estimate similarities.

1. In each order, next-door neighbours whose common prefix is three minhashes or longer are compared
   on their full sets. These are the longest common prefixes there are, and they join most of every
   group of copies.
2. Nodes that have such a neighbour at all are compared with every node of their region, which is a
   run of an order with a common prefix of three minhashes. Where such a run holds more than
   `REGION_NODES` nodes, the depth adapts: each of its nodes takes the shallowest prefix that no more
   nodes share. Nodes already joined are passed over, a pair is taken in the first tree that brings it
   together, and the minhash estimate must be within four standard errors of the threshold. What remains
   is compared on full sets: first each node's likeliest partner in a region, then, when those have been
   joined, all others.
3. A deeper prefix parts pairs that share the shallow one. Nodes that went deeper anywhere meet once more
   by their rarest shingles: two sets at the threshold share one of the few that either cannot do without.
   Shingles all of whose nodes are joined by now are passed over.

A prefix of full depth, or a rare shingle, that is still shared by more than `REGION_NODES` nodes is dealt
into blocks as the last resort, and each pair of its blocks is compared by itself, so that tasks stay small
and no pair is left out.

Two sets at the threshold of 0.85 share no region of depth three in 16 trees once in four million
times, and sets at 0.8 once in a hundred thousand, however crowded the regions are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.joins import attach
from revlens.llm import bytescan
from revlens.llm.common import ROW, box, quoted, unboxed
from revlens.llm.graph import components
from revlens.sources.stages import StageStore

WIDTH = 5
PERCENT = 85
HASHES = 512
TREES = 16
TREE_DEPTH = 8
MIN_DEPTH = 3
REGION_NODES = 4096
# side of a row whose region, or block, is compared within itself; else 0 and 1 for two blocks
WHOLE = 2
SLICE_ROWS = 1 << 16
SPREAD = 4.0
# texts that go, and names of sets, are broadcast up to this; beyond it documents or all sets shuffle
BROADCAST_BYTES = 64 << 20
MARK_BYTES = 24
VALUE_BYTES = 4
KEY_BYTES = TREE_DEPTH * VALUE_BYTES
TREE_HASHES = TREES * TREE_DEPTH

_random = np.random.default_rng(20240607)
_FACTORS = _random.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; all words as one where there are fewer than
    five."""
    words = bytescan.words_of(data, offsets)
    hashes = bytescan.range_hashes(data, words.start, words.end, fold_case=True)
    windows = bytescan.window_hashes(hashes, WIDTH)
    sets = []
    for first, last in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        if last - first >= WIDTH:
            sets.append(np.unique(windows[first : last - WIDTH + 1]))
        elif last > first:
            sets.append(bytescan.window_hashes(hashes[first:last], last - first))
        else:
            sets.append(hashes[:0])
    return sets


def _set_key(found: np.ndarray) -> bytes:
    """Sixteen bytes from two independent sums over the set."""
    first = np.sum(bytescan.mixed(found + np.uint64(1)), dtype=np.uint64)
    second = np.sum(bytescan.mixed(found ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)
    return bytescan.mixed(np.array([first, second]) + np.uint64(len(found))).tobytes()


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, HASHES) minhashes of sets that are not empty."""
    starts = np.cumsum([0] + [len(found) for found in sets[:-1]])
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    result = np.empty((len(sets), HASHES), dtype=np.uint32)
    for index in range(HASHES):
        result[:, index] = np.minimum.reduceat(values * _FACTORS[index] + _SHIFTS[index], starts)
    return result


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets, _ in bytescan.slices(batch.column("text")):
            sets = shingle_sets(data, offsets)
            filled = [found for found in sets if len(found)]
            values = iter(_signatures(filled)) if filled else iter(())
            keys = [_set_key(found) if len(found) else None for found in sets]
            signed = [next(values) if len(found) else None for found in sets]
            in_trees = [None if row is None else row[:TREE_HASHES].tobytes() for row in signed]
            low = [None if row is None else row.astype(np.uint8).tobytes() for row in signed]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, last - first),
                    batch.column("content").slice(first, last - first),
                    pa.array([len(found) for found in sets], pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(in_trees, pa.binary()),
                    pa.array(low, pa.binary()),
                ],
                names=["doc_id", "content", "n_shingles", "node", "signature", "sketch"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets, _ in bytescan.slices(batch.column("text")):
            sets = [found for found in shingle_sets(data, offsets) if len(found)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_set_key(found) for found in sets], pa.binary()),
                    pa.array([found.tobytes() for found in sets], pa.binary()),
                ],
                names=["node", "shingles"],
            )


def _matrix(column: pa.Array, width: int, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), width)


def _next_door(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of neighbours in a sorted order, and the first and last row of the partition."""
    before: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if before is None else pa.concat_batches([before, batch])
        tree = rows.column("tree").to_numpy()
        keys = _matrix(rows.column("sort_key"), TREE_DEPTH, np.uint32)
        near = (tree[1:] == tree[:-1]) & (keys[1:, :MIN_DEPTH] == keys[:-1, :MIN_DEPTH]).all(axis=1)
        at = np.flatnonzero(near)
        node = rows.column("node")
        yield _links(rows, node.take(pa.array(at)), node.take(pa.array(at + 1)), False)
        if before is None:
            yield _links(rows.slice(0, 1), node.slice(0, 1), None, True)
        before = rows.slice(rows.num_rows - 1, 1)
    if before is not None:
        yield _links(before, before.column("node"), None, True)


def _links(rows: pa.RecordBatch, u: pa.Array, v: pa.Array | None, edge: bool) -> pa.RecordBatch:
    count = len(u)
    return pa.RecordBatch.from_arrays(
        [
            u,
            pa.nulls(count, pa.binary()) if v is None else v,
            rows.column("tree") if edge else pa.nulls(count, pa.int32()),
            rows.column("sort_key") if edge else pa.nulls(count, pa.binary()),
        ],
        names=["u", "v", "tree", "sort_key"],
    )


def _cut(percent: int) -> int:
    """Equal minhashes that two sets at the threshold have, less the allowed standard errors."""
    share = percent / 100
    return int(HASHES * share - SPREAD * np.sqrt(HASHES * share * (1 - share)))


def _within_regions(best_only: bool, percent: int):
    """Pairs of nodes of one region that are not joined yet and whose minhashes say they may be."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            region = rows.column("region").to_numpy()
            whole = int(np.searchsorted(region, region[-1]))
            # the last region may go on in the next batch
            held = rows.slice(whole)
            if whole:
                yield _region_pairs(rows.slice(0, whole), best_only, percent)
        if held is not None:
            yield _region_pairs(held, best_only, percent)

    return within


def _region_pairs(rows: pa.RecordBatch, best_only: bool, percent: int = PERCENT) -> pa.RecordBatch:
    region = rows.column("region").to_numpy()
    tree = rows.column("tree").to_numpy()
    side = rows.column("side").to_numpy()
    label = _matrix(rows.column("label"), 2, np.uint64)
    sketch = _matrix(rows.column("sketch"), HASHES, np.uint8)
    regions = np.stack(rows.column("regions").to_numpy(zero_copy_only=False))
    node = rows.column("node")
    none = np.zeros(0, dtype=np.int64)
    first, second, equal = [none], [none], [none]
    step, at = 1, np.arange(len(region))
    while True:
        at = at[at + step < len(region)]
        at = at[region[at] == region[at + step]]
        if not len(at):
            break
        for part in np.array_split(at, len(at) // 4096 + 1):
            other = part + step
            apart = (side[part] != side[other]) | (side[part] == WHOLE)
            part, other = part[apart], other[apart]
            apart = (label[part] != label[other]).any(axis=1)
            part, other = part[apart], other[apart]
            shared = (regions[part] == regions[other]) & (regions[part] != 0)
            leading = shared.argmax(axis=1) == tree[part]
            part, other = part[leading], other[leading]
            same = (sketch[part] == sketch[other]).sum(axis=1)
            alike = same >= _cut(percent)
            first.append(part[alike])
            second.append(other[alike])
            equal.append(same[alike])
        step += 1
    u, v, same = np.concatenate(first), np.concatenate(second), np.concatenate(equal)
    if best_only:
        order = np.argsort(-same, kind="stable")
        chosen = np.union1d(
            order[np.unique(u[order], return_index=True)[1]], order[np.unique(v[order], return_index=True)[1]]
        )
        u, v = u[chosen], v[chosen]
    return pa.RecordBatch.from_arrays([node.take(pa.array(u)), node.take(pa.array(v))], names=["u", "v"])


def _confirm(percent: int):
    """Those pairs whose full sets are as similar as it takes."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for one, two in zip(batch.column("set_u"), batch.column("set_v"), strict=True):
                a = np.frombuffer(one.as_buffer(), dtype=np.uint64)
                b = np.frombuffer(two.as_buffer(), dtype=np.uint64)
                if percent * max(len(a), len(b)) > 100 * min(len(a), len(b)):
                    linked.append(False)
                    continue
                shared = len(a) + len(b) - len(np.union1d(a, b))
                linked.append(100 * shared >= percent * (len(a) + len(b) - shared))
            chosen = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("u").filter(chosen), batch.column("v").filter(chosen)], names=["u", "v"]
            )

    return confirm


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    sets = _needed(sets, pairs)
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("set_u"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("set_v"))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "set_u", "set_v")
    return both.mapInArrow(_confirm(percent), "u binary, v binary")


def _sized(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose set sizes allow the similarity; few bytes move for those that do not."""
    both = pairs.join(sizes.toDF("u", "size_u"), "u").join(sizes.toDF("v", "size_v"), "v")
    fits = F.least("size_u", "size_v") * 100 >= F.greatest("size_u", "size_v") * percent
    return both.where(fits).select("u", "v")


def _needed(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets that `pairs`, a stage, names: those alone are shuffled, while the names can be broadcast."""
    named = pairs.select(F.explode(F.array(F.xxhash64("u"), F.xxhash64("v"))).alias("named")).distinct()
    return _only(sets, named, sets)


def _only(rows: DataFrame, named: DataFrame, otherwise: DataFrame) -> DataFrame:
    """Rows whose node has its hash in `named`, which stay where they are; `otherwise` past the broadcast bound.

    A node that shares its hash with a named one stays too; the joins that follow go by the node itself.
    """
    if named.count() * MARK_BYTES > BROADCAST_BYTES:
        return otherwise
    return rows.join(F.broadcast(named), F.xxhash64("node") == F.col("named"), "left_semi")


def _of_nodes(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of `nodes`, a stage with a row a node."""
    named = nodes.select(F.xxhash64("node").alias("named"))
    return _only(rows, named, rows.join(nodes.select("node"), "node", "left_semi"))


def _ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _neighbour_pairs(orders: DataFrame, store: StageStore) -> DataFrame:
    found = orders.orderBy("tree", "sort_key", "node").mapInArrow(
        _next_door, "u binary, v binary, tree int, sort_key binary"
    )
    found = store.save(found, "neighbours")
    # two rows a partition: neighbours that a partition boundary has parted
    edges = found.where(F.col("sort_key").isNotNull()).select(F.col("u").alias("node"), "tree", "sort_key")
    edges = edges.distinct().coalesce(1).sortWithinPartitions("tree", "sort_key", "node")
    across = edges.mapInArrow(_next_door, "u binary, v binary, tree int, sort_key binary")
    pairs = found.where(F.col("sort_key").isNull()).union(across.where(F.col("sort_key").isNull()))
    return store.save(_ordered_pairs(pairs), "neighbour_pairs")


def _prefix(depth: int):
    """What nodes share that agree in a tree on their first minhashes."""
    return F.xxhash64("tree", F.substring("sort_key", 1, depth * VALUE_BYTES))


def _regions(orders: DataFrame, store: StageStore) -> tuple[DataFrame, DataFrame]:
    """(node, tree, depth, region) where another node shares the shallowest region, region 0 where none is
    left at the depth the node has taken; and (crowd, blocks): the blocks of each region that is too
    crowded for one task at full depth too."""
    keyed = orders.select("node", "tree", _prefix(MIN_DEPTH).alias("region"))
    sizes = keyed.groupBy("region").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = keyed.join(sizes, "region").select("node", "tree", F.lit(MIN_DEPTH).alias("depth"), "region", "size")
    shared = store.save(shared, "regions")
    crowded = store.save(shared.where(F.col("size") > REGION_NODES).select("region").distinct(), "shallow")
    if not crowded.isEmpty():
        roomy = shared.where(F.col("size") <= REGION_NODES)
        shared = store.save(roomy.unionByName(_deeper(orders, crowded)), "regions")
    still = shared.where(F.col("size") > REGION_NODES).select("region", "size").distinct()
    return shared.drop("size"), _blocks(still, store)


def _deeper(orders: DataFrame, crowded: DataFrame) -> DataFrame:
    """Nodes of crowded regions, each at the shallowest depth that parts its region enough, or the last."""
    inside = orders.withColumn("shallow", _prefix(MIN_DEPTH)).join(
        crowded.withColumnRenamed("region", "shallow"), "shallow", "left_semi"
    )
    depths = range(MIN_DEPTH + 1, TREE_DEPTH + 1)
    ladder = F.array(*[F.struct(F.lit(depth).alias("depth"), _prefix(depth).alias("region")) for depth in depths])
    steps = inside.select("node", "tree", F.inline(ladder))
    sizes = steps.groupBy("depth", "region").agg(F.count(F.lit(1)).alias("size"))
    fits = (F.col("size") <= REGION_NODES) | (F.col("depth") == TREE_DEPTH)
    taken = steps.join(sizes, ["depth", "region"]).where(fits).groupBy("node", "tree")
    step = taken.agg(F.min(F.struct("depth", "region", "size")).alias("step")).select("node", "tree", "step.*")
    return step.withColumn("region", F.when(F.col("size") > 1, F.col("region")).otherwise(F.lit(0)))


def _blocks(sizes: DataFrame, store: StageStore) -> DataFrame:
    """(crowd, blocks) of (region, size)."""
    blocks = F.ceil(F.col("size") * 2 / REGION_NODES).cast("int")
    return store.save(sizes.select(F.col("region").alias("crowd"), blocks.alias("blocks")), "crowded")


def _list_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(one.as_buffer(), dtype=np.int64) for one in batch.column("shingles")]
        of = np.repeat(np.arange(len(sets)), [len(found) for found in sets])
        for first in range(0, len(of), SLICE_ROWS):
            last = min(first + SLICE_ROWS, len(of))
            shingles = np.concatenate(sets[of[first] : of[last - 1] + 1])
            skipped = int(np.searchsorted(of, of[first]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node").take(pa.array(of[first:last])),
                    pa.array(shingles[first - skipped : last - skipped]),
                ],
                names=["node", "shingle"],
            )


def _rare_shingles(nodes: DataFrame, sets: DataFrame, store: StageStore, percent: int) -> DataFrame:
    """(node, shingle): of each set the rarest shingles, one of which a set alike enough must share.

    A set of n that shares `percent` of its union with another shares as much of itself at least. So of its
    shingles, in one order for all sets, it shares one of the first n + 1 less that share.
    """
    held = nodes.join(sets, "node").mapInArrow(_list_shingles, "node binary, shingle bigint")
    held = store.save(held, "shingles")
    counts = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1")
    counts = store.save(counts.withColumn("rows", F.col("nodes")), "shingle_counts")
    counted = attach(held, counts, F.col("shingle"), "shingle", BROADCAST_BYTES, ["node", "shingle"], weight="rows")
    ranked = counted.groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("nodes", F.lit(1)).alias("nodes"), "shingle"))).alias("ranked")
    )
    n = F.size("ranked")
    needed = n + 1 - F.ceil(n * F.lit(percent) / F.lit(100)).cast("int")
    rare = ranked.select("node", F.inline(F.slice("ranked", F.lit(1), needed))).where("nodes > 1")
    return store.save(rare.select("node", "shingle"), "rare_shingles")


def _rare_candidates(
    rare: DataFrame, sketches: DataFrame, labels: DataFrame, store: StageStore, best_only: bool, percent: int
) -> DataFrame:
    """Pairs that share a rare shingle and are not joined yet."""
    labelled = rare.join(labels, "node")
    sizes = labelled.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("size"), F.min("label").alias("least"), F.max("label").alias("most")
    )
    open_still = store.save(sizes.where("least != most").select(F.col("shingle").alias("region"), "size"), "open_shingles")
    rows = labelled.withColumnRenamed("shingle", "region").join(open_still.select("region"), "region")
    spread = rows.join(sketches, "node").select(
        "node",
        "label",
        "sketch",
        F.array_repeat(F.lit(0).cast("bigint"), TREES).alias("regions"),
        F.lit(0).alias("tree"),
        "region",
    )
    crowded = _blocks(open_still.where(F.col("size") > REGION_NODES), store)
    return _pairs_of(spread, crowded, best_only, percent)


def _region_rows(regions: DataFrame, sketches: DataFrame) -> DataFrame:
    """(node, sketch, regions): what a node is compared by, and its region in each tree (0 for none)."""
    listed = F.map_from_entries(F.collect_list(F.struct("tree", "region")))
    in_trees = regions.groupBy("node").agg(listed.alias("by_tree"))
    trees = F.sequence(F.lit(0), F.lit(TREES - 1))
    in_order = F.transform(trees, lambda tree: F.coalesce(F.try_element_at("by_tree", tree), F.lit(0)))
    return in_trees.join(sketches, "node").select("node", "sketch", in_order.alias("regions"))


def _region_candidates(
    placed: DataFrame, crowded: DataFrame, labels: DataFrame, best_only: bool, percent: int = PERCENT
) -> DataFrame:
    spread = (
        placed.join(labels, "node")
        .select("*", F.posexplode("regions").alias("tree", "region"))
        .where(F.col("region") != 0)
    )
    return _pairs_of(spread, crowded, best_only, percent)


def _pairs_of(spread: DataFrame, crowded: DataFrame, best_only: bool, percent: int) -> DataFrame:
    """All pairs of each region that pass the estimate; regions in `crowded` by pairs of blocks."""
    spread = spread.withColumn("side", F.lit(WHOLE))
    if not crowded.isEmpty():
        # a node of a crowded region goes to each pair of blocks that has its own
        sized = spread.join(crowded, F.col("region") == F.col("crowd"), "left")
        own = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")
        others = F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).otherwise(
            F.sequence(F.lit(0), F.col("blocks") - F.lit(1))
        )
        dealt = sized.withColumn("own", own).withColumn("other", F.explode(others))
        pair = F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other"))
        spread = dealt.withColumns(
            {
                "region": F.when(F.col("blocks").isNull(), F.col("region")).otherwise(pair),
                "side": F.when(F.col("blocks").isNull() | (F.col("own") == F.col("other")), F.lit(WHOLE)).otherwise(
                    (F.col("own") > F.col("other")).cast("int")
                ),
            }
        ).drop("crowd", "blocks", "own", "other")
    spread = spread.repartition("region").sortWithinPartitions("region")
    return _ordered_pairs(spread.mapInArrow(_within_regions(best_only, percent), "u binary, v binary"))


def _relabelled(labels: DataFrame, links: DataFrame, store: StageStore, name: str) -> DataFrame:
    """(node, label) when the labels of linked nodes have become one."""
    between = (
        links.join(labels.toDF("u", "lu"), "u").join(labels.toDF("v", "lv"), "v").select("lu", "lv")
    )
    between = store.save(between.where("lu <> lv").distinct(), f"{name}_links")
    merged = components(between, store, f"{name}_links").toDF("label", "merged")
    moved = labels.join(merged, "label", "left").select("node", F.coalesce("merged", "label").alias("label"))
    return store.save(moved, f"{name}_labels")


def _verdicts(
    docs: DataFrame, store: StageStore, doc_id: str, text: str, percent: int
) -> DataFrame:
    """One row per row of `docs`: doc_id, content (a hash of the text), n_shingles, node, label, component_id.

    `node` stands for the set of shingles, null without one; `label` for the component of the node.
    """
    plain = docs.select(quoted(doc_id).cast("bigint").alias("doc_id"), quoted(text).alias("text"))
    signed = store.save(
        plain.withColumn("content", F.xxhash64("text")).mapInArrow(
            _sign,
            "doc_id bigint, content bigint, n_shingles bigint, node binary, signature binary, sketch binary",
        ),
        "signed",
    )
    linked = signed.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    nodes = store.save(linked.groupBy("node").agg(F.min("doc_id").alias("least_doc"), F.max("n_shingles").alias("size")), "nodes")
    signatures = linked.select("node", "signature").dropDuplicates(["node"])
    orders = store.save(
        signatures.select(
            "node",
            F.posexplode(
                F.array(
                    *[
                        F.substring("signature", tree * KEY_BYTES + 1, KEY_BYTES)
                        for tree in range(TREES)
                    ]
                )
            ).alias("tree", "sort_key"),
        ),
        "orders",
    )
    pairs = _neighbour_pairs(orders, store)

    near = store.save(
        pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(nodes, "node"),
        "near_nodes",
    )
    texts = plain.join(near.select(F.col("least_doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = store.save(
        texts.select("text")
        .mapInArrow(_full_sets, "node binary, shingles binary")
        .dropDuplicates(["node"]),
        "sets",
    )
    alone = store.save(near.select("node", F.col("node").alias("label")), "own_labels")
    sized = store.save(_sized(pairs, near.select("node", "size"), percent), "sized_pairs")
    labels = _relabelled(alone, store.save(_confirmed(sized, sets, percent), "first"), store, "first")
    sketches = _of_nodes(linked.select("node", "sketch"), near)
    near_orders = _of_nodes(orders, near)
    regions, crowded = _regions(near_orders, store)
    placed = store.save(_region_rows(regions, sketches.dropDuplicates(["node"])), "placed")
    for name, best_only in (("best", True), ("rest", False)):
        found = store.save(_region_candidates(placed, crowded, labels, best_only, percent), f"{name}_pairs")
        labels = _relabelled(labels, store.save(_confirmed(found, sets, percent), name), store, name)
    parted = regions.where(F.col("depth") > MIN_DEPTH).select("node").distinct()
    if not parted.isEmpty():
        rare = _rare_shingles(parted, sets, store, percent)
        for name, best_only in (("rare_best", True), ("rare_rest", False)):
            found = _rare_candidates(rare, placed.select("node", "sketch"), labels, store, best_only, percent)
            links = store.save(_confirmed(store.save(found, f"{name}_pairs"), sets, percent), name)
            labels = _relabelled(labels, links, store, name)
    groups = store.save(labels.join(nodes, "node"), "groups")
    least = groups.groupBy("label").agg(F.min("least_doc").alias("component_id"))
    grouped = groups.join(least, "label").select("node", "label", "component_id")
    chosen = nodes.join(grouped, "node", "left").select(
        "node",
        F.coalesce("label", "node").alias("label"),
        F.coalesce("component_id", "least_doc").alias("component_id"),
    )
    own_node = F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")
    result = signed.select("doc_id", "content", "n_shingles", own_node).join(chosen, "node", "left")
    return result.withColumn("component_id", F.coalesce("component_id", "doc_id"))


def near_duplicates(
    docs: DataFrame, store: StageStore, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    component_id is the least doc_id reachable over links of a similarity of `percent` or more, the
    document's own included; kept says whether that is the document itself. A text without words, or none at all,
    has no shingle and stays by itself. A row without doc_id takes part in no group: its component_id
    is null and it is kept. Rows that share a doc_id and a text all get the same answer; several texts
    under one doc_id are nodes of their own. An empty table gives an empty result. Other columns of
    the input are not looked at.
    """
    verdicts = _verdicts(docs, store, doc_id, text, percent)
    return verdicts.select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def deduplicated(
    docs: DataFrame, store: StageStore, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT
) -> DataFrame:
    """`docs` with one row of each group of near-duplicates: one of those with the least doc_id.

    Rows are judged by doc_id and text: unlike texts under one doc_id are documents of their own, and
    each stays that is the one of its group. Of rows that repeat a doc_id and a text one stays, that of
    the least hash over its columns. Rows without doc_id stay as they are.
    """
    verdicts = _verdicts(docs, store, doc_id, text, percent).where("doc_id is not null")
    texts = store.save(
        verdicts.groupBy("doc_id", "content").agg(
            F.count(F.lit(1)).alias("rows"),
            # a text without words has no node and is alone with the rows of its own
            F.first("label").alias("label"),
            F.first("component_id").alias("component_id"),
        ),
        "texts",
    )
    # several texts of the least doc_id may be in one group, where one of them stays
    firsts = texts.where("label is not null and doc_id = component_id")
    crowded = firsts.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("first")).where("n > 1")
    judged = texts.join(crowded.select(F.col("label").alias("shared"), "first"), F.col("label") == F.col("shared"), "left")
    stays = (F.col("doc_id") == F.col("component_id")) & (F.col("first").isNull() | (F.col("content") == F.col("first")))
    # only the texts that go, or that are there more than once, meet the documents again
    marked = store.save(
        judged.select(
            F.col("doc_id").alias("_marked_id"),
            F.col("content").alias("_marked_content"),
            stays.alias("_stays"),
            (F.col("rows") > 1).alias("_repeated"),
        ).where("not _stays or _repeated"),
        "marked",
    )
    keyed = docs.select(
        box(docs), quoted(doc_id).cast("bigint").alias("_own_id"), F.xxhash64(quoted(text)).alias("_own_content")
    )
    same = (F.col("_own_id") == F.col("_marked_id")) & (F.col("_own_content") == F.col("_marked_content"))
    few = marked.count() * MARK_BYTES <= BROADCAST_BYTES
    clean = keyed.join(F.broadcast(marked) if few else marked.hint("merge"), same, "left_anti").select(ROW)
    again = marked.where("_stays and _repeated")
    if again.isEmpty():
        return clean.select(*unboxed(docs.columns, ()))
    # repeated rows fold in each task before the shuffle
    once = keyed.join(F.broadcast(again) if few else again.hint("merge"), same, "left_semi").groupBy("_own_id", "_own_content").agg(
        F.min_by(ROW, F.xxhash64(ROW)).alias(ROW)
    )
    return clean.unionByName(once.select(ROW)).select(*unboxed(docs.columns, ()))
