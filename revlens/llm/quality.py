"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is good or bad. Features describe a line and its two neighbours; two weights a
pair of labels tie neighbouring lines together. Forward and backward passes give each line its chance
of being good, and the mean of these, weighted by line length, is the score of the document.
The model is fitted on the driver to a bounded sample of labelled documents, whose lines all carry the
label of their document; features are made on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm import bytescan
from revlens.llm.common import quoted
from revlens.sources.stages import StageStore

# labelled documents in the sample, about as many at most, and the most lines one of them may have
SAMPLE_DOCUMENTS = 4000
SAMPLE_LINES = 100
ROUNDS = 200
RATE = 0.05
PENALTY = 1e-3
EMPTY_SCORE = 0.0
UNKNOWN_SCORE = 0.5
OWN = 24


def _shares(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Share of the bytes of each range for which a flag is set."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (sums[end] - sums[start]) / np.maximum(end - start, 1)


def _flagged(text: bytes) -> np.ndarray:
    flags = np.zeros(256, dtype=bool)
    flags[list(text)] = True
    return flags


_CLASSES = [
    _flagged(bytes(range(65, 91))),
    _flagged(bytes(range(48, 58))),
    _flagged(b"!?"),
    _flagged(b"#*$%&|<>~^_=+{}[]\\@/"),
    _flagged(b".,;:"),
    _flagged(b" \t"),
]


@dataclass
class Lines:
    """The lines with a word of a slice of texts, in order; `text` tells whose a line is."""

    text: np.ndarray
    size: np.ndarray
    features: np.ndarray


def _repeated(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether an equal value comes earlier in the same group."""
    order = np.lexsort((np.arange(len(value)), value, group))
    again = np.zeros(len(value), dtype=bool)
    same = (group[order[1:]] == group[order[:-1]]) & (value[order[1:]] == value[order[:-1]])
    again[order[1:]] = same
    return again


def lines_of(data: np.ndarray, offsets: np.ndarray) -> Lines:
    start = np.union1d(offsets[:-1], np.flatnonzero(data == 10) + 1)
    start = start[start < len(data)]
    end = np.append(start[1:], len(data))
    words = bytescan.words_of(data, offsets)
    line = np.searchsorted(start, words.start, side="right") - 1
    hashes = bytescan.range_hashes(data, words.start, words.end, fold_case=True)
    used, line = np.unique(line, return_inverse=True)
    start, end = start[used], end[used]
    end = end - (data[end - 1] == 10)
    text = np.searchsorted(offsets, start, side="right") - 1
    count = np.bincount(line, minlength=len(used)).astype(float)

    def per_word(flags: np.ndarray) -> np.ndarray:
        return np.bincount(line, weights=flags, minlength=len(used)) / np.maximum(count, 1)

    beside = np.zeros(len(line))
    beside[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    length = (words.end - words.start).astype(float)
    shares = [_shares(flags[data], start, end) for flags in _CLASSES]
    shares += [
        per_word(beside),
        per_word(_repeated(line, hashes)),
        _repeated(text, bytescan.range_hashes(data, start, end, fold_case=False)).astype(float),
        per_word(length > 20),
    ]
    columns = [np.ones(len(used)), np.log1p(count), np.log1p(end - start), per_word(length) / 8]
    columns += shares + [np.sqrt(share) for share in shares]
    own = np.stack(columns, axis=1) if len(used) else np.zeros((0, OWN))
    return Lines(text, (end - start).astype(float), with_neighbours(own, text))


def with_neighbours(own: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A line's own features, then those of the lines before and after it; zeros at either end."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = text[1:] == text[:-1]
    before[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    return np.concatenate([own, before, after], axis=1)


@dataclass
class Model:
    weights: np.ndarray
    # score of label i followed by label j
    moves: np.ndarray
    middle: np.ndarray
    scale: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """How much each line by itself speaks for good over bad."""
        return ((features - self.middle) / self.scale) @ self.weights


def _grid(text: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values as (chain, step), longest chain first; which cells are filled; where each value is."""
    _, rank, counts = np.unique(text, return_inverse=True, return_counts=True)
    step = np.arange(len(rank)) - (np.cumsum(counts) - counts)[rank]
    longest_first = np.argsort(-counts, kind="stable")
    chain, sizes = np.argsort(longest_first)[rank], counts[longest_first]
    grid = np.zeros((len(sizes), sizes.max(initial=0)))
    filled = np.zeros(grid.shape, dtype=bool)
    grid[chain, step], filled[chain, step] = values, True
    return grid, filled, chain, step


def _passes(grid: np.ndarray, filled: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds of good over bad; only chains that reach a step take it."""
    forward, backward = grid.copy(), np.zeros_like(grid)
    alive = filled.sum(axis=0)
    for at in range(1, grid.shape[1]):
        last = forward[: alive[at], at - 1]
        step = np.logaddexp(last + moves[1, 1], moves[0, 1]) - np.logaddexp(last + moves[1, 0], moves[0, 0])
        forward[: alive[at], at] += step
    for at in range(grid.shape[1] - 2, -1, -1):
        rows = slice(alive[at + 1])
        ahead = backward[rows, at + 1] + grid[rows, at + 1]
        step = np.logaddexp(ahead + moves[1, 1], moves[1, 0]) - np.logaddexp(ahead + moves[0, 1], moves[0, 0])
        backward[rows, at] = step
    return forward, backward


def _chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def marginals(model: Model, text: np.ndarray, features: np.ndarray) -> np.ndarray:
    """The chance of each line to be good."""
    grid, filled, chain, step = _grid(text, model.emissions(features))
    forward, backward = _passes(grid, filled, model.moves)
    return _chance((forward + backward)[chain, step])


def document_scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean chance of each text's lines, weighted by their bytes; a text without words scores 0."""
    lines = lines_of(data, offsets)
    count = len(offsets) - 1
    chances = np.zeros(len(lines.text))
    sizes = np.bincount(lines.text, minlength=count)
    # texts of like numbers of lines go together, so that the grids stay dense
    kind = np.ceil(np.log2(np.maximum(sizes, 1)))
    for value in np.unique(kind):
        own = kind[lines.text] == value
        chances[own] = marginals(model, lines.text[own], lines.features[own])
    weight = np.bincount(lines.text, weights=lines.size, minlength=count)
    total = np.bincount(lines.text, weights=lines.size * chances, minlength=count)
    return np.where(weight > 0, total / np.maximum(weight, 1e-9), EMPTY_SCORE)


def fit(text: np.ndarray, features: np.ndarray, label: np.ndarray) -> Model:
    """Maximum likelihood with an L2 penalty, by Adam; `label` is 1 for the lines of good documents.

    `features` is scaled in place; single precision is enough for sums over lines, and half the memory.
    """
    middle, scale = features.mean(axis=0, dtype=float), features.std(axis=0, dtype=float)
    middle[0], scale[scale < 1e-9] = 0.0, 1.0
    model = Model(np.zeros(features.shape[1]), np.zeros((2, 2)), middle, scale)
    scaled = features
    scaled -= middle.astype(scaled.dtype)
    scaled /= scale.astype(scaled.dtype)
    _, filled, chain, step = _grid(text, label)
    pair = filled[:, 1:]
    truth = np.zeros((2, 2))
    by_chain = np.zeros(filled.shape[0], dtype=int)
    by_chain[chain] = label.astype(int)
    for value in (0, 1):
        truth[value, value] = pair[by_chain == value].sum()
    state = np.zeros((2, features.shape[1] + 4))
    for turn in range(1, ROUNDS + 1):
        grid, _, _, _ = _grid(text, (scaled @ model.weights.astype(scaled.dtype)).astype(float))
        forward, backward = _passes(grid, filled, model.moves)
        slope = (label - _chance((forward + backward)[chain, step])).astype(scaled.dtype) @ scaled
        ahead = (backward + grid)[:, 1:]
        joint = np.stack(
            [
                np.full(ahead.shape, model.moves[0, 0]),
                model.moves[0, 1] + ahead,
                model.moves[1, 0] + forward[:, :-1],
                model.moves[1, 1] + forward[:, :-1] + ahead,
            ]
        )
        joint = np.exp(joint - np.logaddexp.reduce(joint, axis=0))
        expected = (joint * pair).sum(axis=(1, 2)).reshape(2, 2)
        values = np.concatenate([model.weights, model.moves.ravel()])
        gradient = np.concatenate([slope, (truth - expected).ravel()]) / len(label) - PENALTY * values
        state[0] += 0.1 * (gradient - state[0])
        state[1] += 0.001 * (gradient**2 - state[1])
        size = np.sqrt(state[1] / (1 - 0.999**turn)) + 1e-8
        values = values + RATE * (state[0] / (1 - 0.9**turn)) / size
        model.weights, model.moves = values[:-4], values[-4:].reshape(2, 2)
    return model


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column("quality").to_numpy()
        ids = batch.column("doc_id").to_numpy()
        for first, last, data, offsets, _ in bytescan.slices(batch.column("text")):
            lines = lines_of(data, offsets)
            found = []
            for at in range(last - first):
                own = lines.features[lines.text == at][:, :OWN].astype(np.float32)
                if 0 < len(own) <= SAMPLE_LINES:
                    found.append((ids[first + at], labels[first + at], own.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([item[0] for item in found], pa.int64()),
                    pa.array([item[1] for item in found], pa.int32()),
                    pa.array([item[2] for item in found], pa.binary()),
                ],
                names=["doc_id", "quality", "features"],
            )


def learns_from(doc_id: str) -> Column:
    """Two documents in three; the third is held out."""
    return F.crc32(quoted(doc_id).cast("string")) % 3 != 1


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model | None:
    """A model from labelled documents; None where there are no labels of both kinds.

    Null labels and null ids are passed over, a document labelled twice counts as its lower label.
    """
    known = labels.where(F.col("quality").isNotNull() & quoted(doc_id).isNotNull() & learns_from(doc_id))
    known = known.groupBy(quoted(doc_id).cast("bigint").alias("_id")).agg(
        F.min("quality").cast("int").alias("_quality")
    )
    rate = min(1.0, SAMPLE_DOCUMENTS / max(known.count(), 1))

    def picked(key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1_000_000)) < int(rate * 1_000_000)

    texts = docs.select(quoted(doc_id).cast("bigint").alias("doc_id"), quoted(text).alias("text"))
    sample = (
        texts.where(picked("doc_id"))
        .join(F.broadcast(known.where(picked("_id"))), F.col("doc_id") == F.col("_id"))
        .select("doc_id", "text", F.col("_quality").alias("quality"))
        .mapInArrow(_sample_features, "doc_id bigint, quality int, features binary")
    )
    # the sample is bounded, so one task fits the model; the driver gets its parameters only
    fitted = sample.repartition(1).mapInArrow(_fitted, "name string, values array<double>").collect()
    found = {row["name"]: np.array(row["values"]) for row in fitted}
    return Model(found["weights"], found["moves"].reshape(2, 2), found["middle"], found["scale"]) if found else None


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parameters of the model of all rows; none where they are not of both kinds."""
    sample = [row for batch in batches for row in batch.to_pylist()]
    sample.sort(key=lambda row: (row["doc_id"], row["quality"], bytes(row["features"])))
    labels_found = {row["quality"] for row in sample}
    if not {0, 1} <= labels_found:
        return
    parts = [np.frombuffer(row["features"], dtype=np.float32).reshape(-1, OWN) for row in sample]
    text_of = np.repeat(np.arange(len(parts)), [len(part) for part in parts])
    own = np.concatenate(parts)
    label = np.array([float(row["quality"]) for row in sample])[text_of]
    model = fit(text_of, with_neighbours(own, text_of), label)
    values = [model.weights, model.moves.ravel(), model.middle, model.scale]
    yield pa.RecordBatch.from_pydict(
        {"name": ["weights", "moves", "middle", "scale"], "values": [part.tolist() for part in values]}
    )


def scorer(model: Model | None) -> Column:
    """A function of a text column; without a model every text scores 0.5."""

    def score(texts: pa.Array) -> pa.Array:
        if model is None:
            return pa.array(np.full(len(texts), UNKNOWN_SCORE))
        parts = [
            document_scores(model, data, offsets)
            for _, _, data, offsets, _ in bytescan.slices(texts)
        ]
        return pa.array(np.concatenate([np.zeros(0), *parts]))

    return F.arrow_udf(score, "double")


def score_documents(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `docs`.

    A null or empty text, or one of blanks only, scores 0: there is no good line in it. Without a model
    every text scores 0.5. Repeated rows score alike, ties are predicted 1, texts are read whole. An empty
    table gives an empty result.
    """
    score = scorer(train(docs, labels, doc_id, text))
    scored = docs.select(quoted(doc_id).alias("doc_id"), score(quoted(text)).alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(~learns_from("doc_id"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, known: DataFrame, labels: DataFrame, store: StageStore, text: str = "text") -> DataFrame:
    """The rows of `docs` that a model learned from `known` and its labels calls good.

    Null and empty texts are not; repeated rows all stay or all go. Without labels of both kinds there is
    no model and every row stays.
    """
    score = scorer(train(known, labels, text=text))
    return docs.where(score(quoted(text)) >= 0.5)
