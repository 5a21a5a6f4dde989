"""Language of every word, and of the whole text, in texts that may mix languages.

Words are runs of letters. Ranges of code points give a word its script, and only languages that were
seen in that script are candidates. A candidate's score is the log likelihood of the word's byte
trigrams. Viterbi with a fixed price for changing the language labels all words of a text; runs of one
label are its spans, and the label with most letters names the text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm import bytescan
from revlens.llm.common import quoted

UNDETERMINED = "und"
BUCKETS = 1 << 15
SWITCH = 8.0
# trigrams of a word overlap, so their sum is taken in part
TRIGRAM_WEIGHT = 0.5
SMOOTHING = 0.5
SCRIPT_SHARE = 0.01
OUT_OF_SCRIPT = -40.0
# documents that are learned from, about as many at most
SAMPLE_DOCUMENTS = 20_000
RESULT = "lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>"
# fixed values: first code point of each range of scripts
SCRIPT_STARTS = [0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0xE00, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x2C00, 0x2C60, 0x2C80, 0x3040, 0x3400, 0xAC00, 0xD7B0]
SCRIPTS = ["Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Indic", "Thai", "Hangul", "other", "Latin", "Greek", "Latin", "other", "Latin", "other", "Kana", "Han", "Hangul", "other"]
SCRIPT_NAMES = sorted(set(SCRIPTS))
_SCRIPT_OF_RANGE = np.array([SCRIPT_NAMES.index(name) for name in SCRIPTS])

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _signs(first: int, last: int) -> np.ndarray:
    """Whether a code point is neither a letter nor a mark on one."""
    return np.array([unicodedata.category(chr(point))[0] not in "LM" for point in range(first, last)])


# U+0080 to U+00BF, whose lead byte is C2, and U+2000 to U+2FFF, whose lead byte is E2
_SIGNS_C2, _SIGNS_E2 = _signs(0x80, 0xC0), _signs(0x2000, 0x3000)


@dataclass
class Letters:
    """Words of letters in a slice of texts."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    script: np.ndarray
    buckets: np.ndarray


def letters_of(data: np.ndarray, offsets: np.ndarray) -> Letters:
    folded = _FOLD[data]
    # capital letters of Latin-1, whose second byte moves by 32
    capital = np.zeros(len(data), dtype=bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    folded = np.where(capital, folded + 32, folded).astype(np.uint8)
    # signs of Latin-1 and of the blocks from general punctuation on; there are letters among them
    sign = np.zeros(len(data), dtype=bool)
    two = np.flatnonzero(data[:-1] == 0xC2)
    two = two[_SIGNS_C2[data[two + 1] & 63]]
    three = np.flatnonzero(data[:-2] == 0xE2)
    three = three[_SIGNS_E2[(data[three + 1] & 63).astype(np.int64) << 6 | (data[three + 2] & 63)]]
    for own in (two, two + 1, three, three + 1, three + 2):
        sign[own] = True
    folded[sign] = 32
    inside = folded != 32
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = np.unique(offsets)
    edges = edges[(edges > 0) & (edges < len(data))]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    before, after = np.full(len(data), 32, np.uint32), np.full(len(data), 32, np.uint32)
    before[1:], after[:-1] = folded[:-1], folded[1:]
    before[start], after[end - 1] = 32, 32
    trigram = (before << 16) | (folded.astype(np.uint32) << 8) | after
    buckets = ((trigram * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)
    text = np.searchsorted(offsets, start, side="right") - 1
    return Letters(start, end, text, _scripts(data, start), buckets)


def _scripts(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The script of the first letter of each word."""
    wide = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
    one, two, three = wide[start], wide[start + 1] & 63, wide[start + 2] & 63
    point = np.select(
        [one < 0x80, one < 0xE0, one < 0xF0],
        [one, (one & 31) << 6 | two, (one & 15) << 12 | two << 6 | three],
        0x10000,
    )
    return _SCRIPT_OF_RANGE[np.searchsorted(SCRIPT_STARTS, point, side="right") - 1]


@dataclass
class Model:
    languages: list[str]
    # (bucket, language) log likelihoods
    table: np.ndarray
    # (script, language) what being out of script costs
    scripts: np.ndarray

    def word_scores(self, found: Letters) -> np.ndarray:
        """(word, language)"""
        scores = np.empty((len(found.start), len(self.languages)))
        for column in range(len(self.languages)):
            sums = np.concatenate([[0.0], np.cumsum(self.table[found.buckets, column], dtype=float)])
            scores[:, column] = sums[found.end] - sums[found.start]
        return scores * TRIGRAM_WEIGHT + self.scripts[found.script]


def _reaches(gain: np.ndarray, first: np.ndarray, text: np.ndarray, limit: float) -> np.ndarray:
    """Per text whether any run of its words gains more than the limit."""
    total = np.cumsum(gain, axis=0)
    # texts are parted by a fall that no run can make up for
    fall = (np.abs(gain).sum(axis=0) + 1.0) * 2
    level = total - text[:, None] * fall
    lowest = level.copy()
    lowest[first] = np.minimum(level[first], level[first] - gain[first])
    lowest = np.minimum.accumulate(lowest, axis=0)
    before = np.empty_like(lowest)
    before[1:] = lowest[:-1]
    before[0] = level[0] - gain[0]
    before[first] = level[first] - gain[first]
    best = (level - before).max(axis=1)
    return np.maximum.reduceat(best, first) > limit


def viterbi(scores: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The best language of each word; `text` is ascending."""
    labels = np.zeros(len(text), dtype=np.int64)
    if not len(text):
        return labels
    _, first, rank, sizes = np.unique(text, return_index=True, return_inverse=True, return_counts=True)
    best = np.add.reduceat(scores, first, axis=0).argmax(axis=1)
    labels = best[rank]
    # One language throughout is best unless another gains more in some run than half a change costs:
    # k runs that fill a text change k - 1 times, and k halves are no more than k - 1 for two runs on.
    gain = scores - scores[np.arange(len(text)), labels][:, None]
    mixed = np.flatnonzero(_reaches(gain, first, rank, SWITCH / 2))
    if not len(mixed):
        return labels
    mixed = mixed[np.argsort(-sizes[mixed], kind="stable")]
    longest, width = sizes[mixed[0]], scores.shape[1]
    came = np.zeros((longest, len(mixed), width), dtype=np.int8 if width < 128 else np.int16)
    state = scores[first[mixed]].copy()
    at_end = state.copy()
    for step in range(1, longest):
        active = int(np.searchsorted(-sizes[mixed], -step, side="left"))
        now = state[:active]
        top = now.argmax(axis=1)
        moved = now[np.arange(active), top][:, None] - SWITCH
        stays = now >= moved
        came[step, :active] = np.where(stays, np.arange(width), top[:, None])
        state[:active] = np.where(stays, now, moved) + scores[first[mixed[:active]] + step]
        at_end[:active] = state[:active]
    label = at_end.argmax(axis=1)
    for step in range(longest - 1, -1, -1):
        active = int(np.searchsorted(-sizes[mixed], -step, side="left"))
        labels[first[mixed[:active]] + step] = label[:active]
        label[:active] = came[step, np.arange(active), label[:active]] if step else label[:active]
    return labels


def _identify(model: Model, texts: pa.Array) -> pa.Array:
    rows: list[dict] = []
    for one, last, data, offsets, _ in bytescan.slices(texts):
        count = last - one
        found = letters_of(data, offsets)
        labels = viterbi(model.word_scores(found), found.text)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        size = points[found.end] - points[found.start]
        width = len(model.languages)
        share = np.bincount(found.text * width + labels, weights=size, minlength=count * width)
        share = share.reshape(count, width)
        total, named = share.sum(axis=1), share.argmax(axis=1)
        change = np.flatnonzero((np.diff(found.text) != 0) | (np.diff(labels) != 0)) + 1
        change = np.concatenate([[0], change]).astype(int) if len(labels) else np.zeros(0, int)
        close = np.append(change[1:], len(labels)) - 1 if len(change) else change
        owner = found.text[change]
        starts = points[found.start[change]] - points[offsets[owner]]
        ends = points[found.end[close]] - points[offsets[owner]]
        bounds = np.searchsorted(owner, np.arange(count + 1))
        for at in range(count):
            if not total[at]:
                rows.append({"lang_pred": UNDETERMINED, "score": 0.0, "spans": []})
                continue
            spans = [
                {"start": int(starts[k]), "end": int(ends[k]), "lang": model.languages[labels[change[k]]]}
                for k in range(bounds[at], bounds[at + 1])
            ]
            best = named[at]
            rows.append(
                {"lang_pred": model.languages[best], "score": share[at, best] / total[at], "spans": spans}
            )
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    return pa.array(
        rows, pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("spans", spans_type)])
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams, and words of each script, by language; scripts count as negative buckets."""
    for batch in batches:
        names = np.array(batch.column("lang").to_pylist(), dtype=object)
        for one, last, data, offsets, _ in bytescan.slices(batch.column("text")):
            found = letters_of(data, offsets)
            known, code = np.unique(names[one:last].astype(str), return_inverse=True)
            spread = np.zeros(len(data) + 1, dtype=np.int64)
            np.add.at(spread, found.start, 1)
            np.add.at(spread, found.end, -1)
            inside = np.flatnonzero(np.cumsum(spread[:-1]))
            text = np.searchsorted(offsets, inside, side="right") - 1
            for value, name in enumerate(known):
                count = np.bincount(found.buckets[inside[code[text] == value]], minlength=BUCKETS)
                script = np.bincount(found.script[code[found.text] == value], minlength=len(SCRIPT_NAMES))
                used, seen = np.flatnonzero(count), np.flatnonzero(script)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * (len(used) + len(seen)), pa.string()),
                        pa.array(np.concatenate([used, -1 - seen]), pa.int64()),
                        pa.array(np.concatenate([count[used], script[seen]]), pa.int64()),
                    ],
                    names=["lang", "bucket", "n"],
                )


def learns_from(doc_id: str) -> Column:
    """Four documents in five; the fifth is held out."""
    return F.crc32(quoted(doc_id).cast("string")) % 5 != 0


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """A model from the documents that have a language and are not held out; None without any.

    A row for each language and used bucket comes to the driver, whatever the documents are.
    """
    known = docs.where(quoted(lang).isNotNull() & quoted(text).isNotNull() & learns_from(doc_id))
    rate = min(1.0, SAMPLE_DOCUMENTS / max(known.count(), 1))
    picked = F.pmod(F.xxhash64(quoted(doc_id), F.lit("sample")), F.lit(1_000_000)) < int(rate * 1_000_000)
    counted = (
        known.where(picked)
        .select(quoted(text).alias("text"), quoted(lang).cast("string").alias("lang"))
        .mapInArrow(_count, "lang string, bucket bigint, n bigint")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    languages = sorted({row["lang"] for row in counted})
    if not languages:
        return None
    place = {name: at for at, name in enumerate(languages)}
    table = np.full((BUCKETS, len(languages)), SMOOTHING)
    scripts = np.zeros((len(SCRIPT_NAMES), len(languages)))
    for row in counted:
        if row["bucket"] < 0:
            scripts[-1 - row["bucket"], place[row["lang"]]] = row["n"]
        else:
            table[row["bucket"], place[row["lang"]]] += row["n"]
    table = np.log(table / table.sum(axis=0)).astype(np.float32)
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    seen = share >= SCRIPT_SHARE
    # a script that no language was seen in leaves all of them in the running
    price = np.where(seen | ~seen.any(axis=1, keepdims=True), 0.0, OUT_OF_SCRIPT)
    return Model(languages, table, price)


def identifier(model: Model | None) -> Column:
    """A function of a text column that gives `RESULT`; without a model every text is undetermined."""

    def identify(texts: pa.Array) -> pa.Array:
        return _identify(model or Model([UNDETERMINED], np.zeros((BUCKETS, 1)), np.zeros((len(SCRIPT_NAMES), 1))), texts)

    return F.arrow_udf(identify, RESULT)


def identify_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans of every row of `docs`.

    `score` is the share of the text's letters that Viterbi gave to lang_pred. Spans are in code points.
    A null text and one without a letter are `und`, score 0, without spans. Repeated rows are answered
    alike, a null lang is not learned from. An empty table gives an empty result.
    """
    found = identifier(train(docs, doc_id, text, lang))
    named = docs.select(
        quoted(doc_id).alias("doc_id"),
        F.coalesce(quoted(text).rlike(r"\p{L}"), F.lit(False)).alias("_letters"),
        found(quoted(text)).alias("_found"),
    )
    return named.select(
        "doc_id",
        F.coalesce(~learns_from("doc_id"), F.lit(False)).alias("held_out"),
        F.when(F.col("_letters"), F.col("_found.lang_pred")).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(F.col("_letters"), F.col("_found.score")).otherwise(0.0).alias("score"),
        F.when(F.col("_letters"), F.col("_found.spans")).otherwise(F.array()).alias("spans"),
    )
