"""Line deduplication by a segment-partition edit join.

Distinct lines are compared, whatever their number of copies. A line is cut into one segment more than
edits are allowed. Lines within that many edits share a segment at nearly the same place, so each line's
segments are indexed by length, place and hash, and every line probes the index with the few substrings
that can match. What meets is verified by bit-parallel edit distance in a band around the diagonal.

Two edits are much in a short line: where the shorter of two lines has less than `SHORT` characters, one
edit links them, and below `SHORTEST` characters none. Lines below `SHORT` that differ in nothing but their
digits are lines of a list, not copies, and are linked only if `digits` asks for it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.bytescan import mixed, range_hashes, slices
from revlens.llm.common import quoted
from revlens.llm.graph import components
from revlens.sources.stages import StageStore

EDITS = 2
SHORT = 24
SHORTEST = 12
# entries of the index with more lines than this are first compared with one of their lines only
CROWD = 64
LETTERS = "etaonirs"
BLANKS = " \t\r\x0b\x0c"
# ids of lines that a broadcast may have; beyond it all lines are shuffled to their pairs
BROADCAST_NODES = 1_000_000


def within(one: str, two: str, limit: int = EDITS) -> bool:
    """Whether two strings are within `limit` edits, by a banded bit-parallel automaton.

    Bit d of row e says that the strings can be matched up to here with e edits, the second d - limit
    characters ahead of the first.
    """
    if abs(len(one) - len(two)) > limit:
        return False
    first, last = 0, min(len(one), len(two))
    while first < last:  # the common prefix, by halving
        middle = (first + last + 1) // 2
        if one[first:middle] == two[first:middle]:
            first = middle
        else:
            last = middle - 1
    one, two = one[first:], two[first:]
    first, last = 0, min(len(one), len(two))
    while first < last:  # the common suffix
        middle = (first + last + 1) // 2
        if one[len(one) - middle :] == two[len(two) - middle :]:
            first = middle
        else:
            last = middle - 1
    one, two = one[: len(one) - first], two[: len(two) - first]
    width = 2 * limit + 1
    whole = (1 << width) - 1
    rows = []
    for edits in range(limit + 1):
        # inserting characters of the second string moves ahead
        rows.append(sum(1 << at for at in range(limit, limit + edits + 1)))
    for place, letter in enumerate(one):
        same = 0
        for at in range(width):
            other = place + at - limit
            if 0 <= other < len(two) and two[other] == letter:
                same |= 1 << at
        fresh = []
        for edits in range(limit + 1):
            row = rows[edits] & same
            if edits:
                row |= rows[edits - 1]  # replaced
                row |= rows[edits - 1] >> 1  # dropped from the first
                row |= (fresh[edits - 1] << 1) & whole  # inserted from the second
            fresh.append(row)
        rows = fresh
        if not any(rows):
            return False
    end = len(two) - len(one) + limit
    return any(row >> end & 1 for row in rows)


def allowed(one: str, two: str) -> int:
    """Edits within which two different lines are linked."""
    shorter = min(len(one), len(two))
    return EDITS if shorter >= SHORT else int(shorter >= SHORTEST)


def _only_digits_differ(one: str, two: str) -> bool:
    return _DIGITS.sub("0", one) == _DIGITS.sub("0", two)


def _segment(length: np.ndarray, number: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of a segment of lines of these lengths; the last segments take the rest."""
    count = edits + 1
    base, longer = np.divmod(length, count)
    return base * number + np.maximum(longer - (count - number), 0), base + (longer > edits - number)


def _probe_places(edits: int) -> list[tuple[int, int, int]]:
    """(number, shorter, move): where a segment of a line up to two characters shorter may lie.

    Edits before a segment move it, and so do those after it, seen from the line's end.
    """
    return [
        (number, shorter, move)
        for shorter in range(edits + 1)
        for number in range(edits + 1)
        for move in range(-number, number + 1)
        if abs(shorter - move) <= edits - number
    ]


def _index_places(edits: int) -> list[tuple[int, int, int]]:
    return [(number, 0, 0) for number in range(edits + 1)]


# (edits, least and greatest length of indexed lines): a line of `SHORT` may be an edit from a shorter one
RANGES = ((1, SHORTEST, SHORT), (EDITS, SHORT, 1 << 31))
_DIGITS = re.compile(r"\d+")
_MARKS = np.zeros(256, dtype=np.uint64)
_MARKS[[ord(letter) for letter in LETTERS]] = [1 << 4 * place for place in range(len(LETTERS))]


def _entries(lines: DataFrame, places: Callable[[int], list[tuple[int, int, int]]]) -> DataFrame:
    """(key, node, letters): a hash of each substring of a line that `places` names for its range.

    Prefix sums give the hash of any substring at once. `letters` holds how often each of `LETTERS` is
    in the line, four bits each, with what overflows carried on.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            for first, last, data, offsets, _ in slices(batch.column("line")):
                # bytes that begin a character, then characters where each line begins
                opens = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
                base = np.searchsorted(opens, offsets)
                size = np.diff(base)
                counted = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_MARKS[data], dtype=np.uint64)])
                letters = (counted[offsets[1:]] - counted[offsets[:-1]]) & np.uint64(0xFFFFFFFF)
                start, end, salt, owner = [], [], [], []
                for edits, least, most in RANGES:
                    for number, shorter, move in places(edits):
                        length = size - shorter
                        at, width = _segment(length, number, edits)
                        at = at + move
                        inside = (length >= least) & (length <= most)
                        fits = np.flatnonzero((at >= 0) & (at + width <= size) & inside)
                        begin = base[fits] + at[fits]
                        start.append(opens[begin])
                        end.append(opens[begin + width[fits]])
                        salt.append((length[fits] * (EDITS + 1) + number) * (EDITS + 1) + edits)
                        owner.append(fits)
                owner = np.concatenate(owner)
                salted = mixed(np.concatenate(salt).astype(np.uint64))
                keys = range_hashes(data, np.concatenate(start), np.concatenate(end), fold_case=False)
                found = [mixed(keys ^ salted).view(np.int64), nodes[first:last][owner]]
                found.append(letters.view(np.int64)[owner])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["key", "node", "letters"])

    return lines.select("node", "line").mapInArrow(cut, "key bigint, node bigint, letters bigint")


def _close(one: str, two: str) -> Column:
    """An edit moves the counts of letters by two at most, so more than four apart is too far.

    The difference of two packed numbers has the differences of the counts as its digits, whatever was
    carried, since those of lines within the limit are less than eight.
    """
    middle = sum(8 << 4 * place for place in range(len(LETTERS))) + (1 << 4 * len(LETTERS))
    apart = F.col(one) - F.col(two) + F.lit(middle)
    total = F.lit(0).cast("bigint")
    for place in range(len(LETTERS)):
        total = total + F.abs(F.shiftright(apart, 4 * place).bitwiseAND(F.lit(15)) - F.lit(8))
    return total <= F.lit(2 * EDITS)


def linked(one: str, two: str, digits: bool = False) -> bool:
    """Whether two different lines are near copies of each other."""
    if not within(one, two, allowed(one, two)):
        return False
    return digits or min(len(one), len(two)) >= SHORT or not _only_digits_differ(one, two)


def _verify(digits: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column("line_u").to_pylist(), batch.column("line_v").to_pylist()
            chosen = pa.array([linked(a, b, digits) for a, b in zip(one, two, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("u").filter(chosen), batch.column("v").filter(chosen)], names=["u", "v"]
            )

    return verify


def _pairs(met: DataFrame, store: StageStore, name: str) -> DataFrame:
    return store.save(
        met.select(F.least("probe", "node").alias("u"), F.greatest("probe", "node").alias("v")).distinct(), name
    )


def _verified(pairs: DataFrame, lines: DataFrame, store: StageStore, name: str, digits: bool) -> DataFrame:
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    few = 2 * pairs.count() <= BROADCAST_NODES
    if not few:  # many pairs may still be of few lines
        wanted = store.save(wanted, f"{name}_nodes")
        few = wanted.count() <= BROADCAST_NODES
    if few:
        lines = lines.join(F.broadcast(wanted), "node", "left_semi")
    left = lines.select(F.col("node").alias("u"), F.col("line").alias("line_u"))
    right = lines.select(F.col("node").alias("v"), F.col("line").alias("line_v"))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "line_u", "line_v")
    return store.save(both.mapInArrow(_verify(digits), "u bigint, v bigint"), name)


def _crowded(entries: DataFrame, hot: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    """The entries of crowded keys, each with the label of its line; a line without links is its own."""
    labels = labels.toDF("linked", "found")
    found = entries.join(hot.select("key"), "key").join(labels, F.col(node) == F.col("linked"), "left")
    return found.select(*entries.columns, F.coalesce("found", node).alias(label))


def _joined(labels: DataFrame, links: DataFrame, store: StageStore) -> DataFrame:
    """The labels after further links. Only labels are linked anew, not all lines that have them."""
    between = links
    for end in ("u", "v"):
        of = labels.toDF("linked", "found")
        between = between.join(of, F.col(end) == F.col("linked"), "left")
        between = between.withColumn(end, F.coalesce("found", end)).drop("linked", "found")
    merged = components(store.save(between, "label_links"), store, "merged").toDF("root", "merged")
    moved = labels.join(merged, F.col("label") == F.col("root"), "left")
    fresh = merged.join(labels, F.col("root") == F.col("linked"), "left_anti")  # lines without links before
    return moved.select("linked", F.coalesce("merged", "label").alias("label")).union(fresh)


def trimmed(line: Column) -> Column:
    """The line without blanks around it; one that has none at its ends is not searched for them."""
    edge = F.lit(False)
    for blank in BLANKS:
        edge = edge | line.startswith(blank) | line.endswith(blank)
    return F.when(edge, F.btrim(line, F.lit(BLANKS))).otherwise(line)


def numbered_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, line_no, line, digest): the lines with a word, trimmed of blanks around them."""
    lines = F.split(F.coalesce(quoted(text), F.lit("")), "\n")
    cut = docs.select(quoted(doc_id).alias("doc_id"), F.posexplode_outer(lines).alias("line_no", "line"))
    worded = cut.withColumn("line", trimmed(F.col("line"))).where("line <> ''")
    return worded.withColumn("digest", F.unhex(F.md5("line")))


def line_classes(
    docs: DataFrame, store: StageStore, doc_id: str = "doc_id", text: str = "text", digits: bool = False
) -> DataFrame:
    """(doc_id, line_no, class): each line with a word and the class of its near copies.

    Classes are components of links within two edits, or one where a line is short. `digits` also links
    short lines that differ in their digits only. Null and empty texts have no lines; repeated rows repeat
    their lines; a null doc_id is an id like any other. Lines are compared whole, however long.
    """
    lines = numbered_lines(docs, doc_id, text)
    placed = store.save(lines.select("doc_id", "line_no", "digest"), "placed")
    # lines are nothing but keys of this aggregate, so it hashes them and sorts none
    distinct = lines.where(F.length("line") >= SHORTEST).select("line").distinct()
    distinct = distinct.withColumn("digest", F.unhex(F.md5("line")))
    # the stage fixes the numbers
    distinct = store.save(distinct.withColumn("node", F.monotonically_increasing_id()), "lines")
    # read for its sizes and again for the joins
    index = store.save(_entries(distinct, _index_places), "index")
    probes = _entries(distinct, _probe_places).toDF("key", "probe", "probe_letters")
    sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader"))
    hot = store.save(sizes.where(F.col("n") > CROWD).select("key", "leader"), "hot_keys")
    kept = F.col("leader").isNull() | (F.col("node") == F.col("leader"))
    asked_first = index.join(hot, "key", "left").where(kept).select("key", "node", "letters")
    near = F.col("probe") != F.col("node")
    met = probes.join(asked_first, "key").where(near & _close("letters", "probe_letters"))
    links = _verified(_pairs(met.select("probe", "node"), store, "pairs"), distinct, store, "links", digits)
    labels = components(links, store, "line_links").toDF("linked", "label")
    if not hot.isEmpty():
        # what the leaders of crowded entries have not joined is compared in full
        theirs = store.save(_crowded(index, hot, labels, "node", "label"), "crowded")
        asked = store.save(_crowded(probes, hot, labels, "probe", "probe_label"), "crowded_probes")
        # lines that only probe an entry count as well: no other entry need bring them to its lines
        meeting = theirs.select("key", "label").union(asked.select("key", "probe_label"))
        divided = meeting.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b")
        asked = asked.join(divided.select("key"), "key")
        different = (F.col("label") != F.col("probe_label")) & _close("letters", "probe_letters")
        apart = asked.join(theirs, "key").where(different)
        more = _verified(_pairs(apart.select("probe", "node"), store, "more_pairs"), distinct, store, "more_links", digits)
        labels = store.save(_joined(labels, more, store), "labels")
    # a class that has several lines goes by the digest of one of them, which is among them
    members = distinct.select("node", "digest").join(labels, F.col("node") == F.col("linked"))
    members = store.save(members.select("node", "label", "digest"), "members")
    heads = members.where("node = label").select("label", F.col("digest").alias("class_digest"))
    named = members.join(heads, "label").select(F.col("digest").alias("linked_digest"), "class_digest")
    joined = placed.join(named, F.col("digest") == F.col("linked_digest"), "left")
    return joined.select("doc_id", "line_no", F.coalesce("class_digest", "digest").alias("class"))


def line_verdicts(docs: DataFrame, store: StageStore, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line with a word: doc_id, line_no, class_doc_id, class_line_no, kept.

    A class goes by its first line, the one of the least doc_id (null first) and line number; only that
    line is kept. Repeated rows repeat their lines and verdicts. An empty table, or one without words,
    gives an empty result.
    """
    classes = store.save(line_classes(docs, store, doc_id, text), "classes")
    here = F.struct("doc_id", "line_no")
    first = classes.groupBy("class").agg(F.min(here).alias("first"))
    return classes.join(first, "class").select(
        "doc_id",
        "line_no",
        F.col("first.doc_id").alias("class_doc_id"),
        F.col("first.line_no").alias("class_line_no"),
        here.eqNullSafe(F.col("first")).alias("kept"),
    )
