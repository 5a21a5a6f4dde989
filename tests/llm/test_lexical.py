"""Ranked lexical search against scores of all pairs."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from revlens.llm import lexical
from revlens.sources.stages import StageStore

DOCS = "doc_id bigint, text string, n int, terms string, item_id int, score double"
ITEMS = "item_id bigint, text string, rank int, bytes int"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda found: found[0].lower(), text or ""))


def brute(docs, items, k):
    held = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    held = [(doc_id, tally, sum(tally.values())) for doc_id, tally in held if tally]
    count, length = len(held), sum(n for _, _, n in held)
    holding = Counter(term for _, tally, _ in held for term in tally)
    found = []
    for item_id, text in items:
        scores = []
        for doc_id, tally, n in held:
            m = 10 + (90 * n * count) // length
            score = 0
            for term in set(terms(text)):
                if term in tally:
                    weight = math.floor(1000 * math.log((2 * count + 2) / (2 * holding[term] + 1)))
                    score += weight * ((1_000_000_000 * tally[term]) // (1000 * tally[term] + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        scores.sort(key=lambda row: (row[0], row[1], row[2] or 0))
        found += [(item_id, rank, row[2], -row[0]) for rank, row in enumerate(scores[:k], 1)]
    return found


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{at}" for at in range(60)] + ["Ärger", "ärger", "日本語", "x_y", "42", "don't"]
    chance = [1 / (at + 1) for at in range(len(words))]
    docs = [(at, " ".join(rng.choices(words, chance, k=rng.choice([1, 5, 30, 200])))) for at in range(700)]
    docs += [(1000, None), (1001, ""), (1002, "?! --"), (None, "w50 w51"), (None, "w50 w51")]
    docs += [(2000 + at, "w58 w59 w58") for at in range(90)] + [docs[3], docs[3]]
    docs.append((5000, "w1 " * 60_000 + "rare"))
    items = [(at, " ".join(rng.choices(words, k=rng.choice([1, 4, 25])))) for at in range(30)]
    items += [(50, None), (51, "?"), (None, "w50"), (7, "W58, w59!"), (8, "absent"), (9, "rare rare"), (9, "rare rare")]
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(*row, 1, "t", 2, 0.5) for row in docs], DOCS).repartition(5),
        spark.createDataFrame([(*row, 3, 4) for row in items], ITEMS),
    )


def result(frame):
    return sorted((tuple(row) for row in frame.collect()), key=repr)


@pytest.mark.parametrize("k", [1, 10])
def test_ranks_equal_those_of_all_pairs(spark, corpus, k):
    docs, items = corpus
    found = lexical.ranked_documents(*frames(spark, docs, items), StageStore(spark), k)
    assert result(found) == sorted(brute(docs, items, k), key=repr)


def test_small_leaves_seeds_and_blocks_of_items_change_nothing(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(lexical, "BATCH", 64)
    monkeypatch.setattr(lexical, "LEAF", 3)
    monkeypatch.setattr(lexical, "ITEM_LEAF", 2)
    monkeypatch.setattr(lexical, "SEED_DOCUMENTS", 100)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 400)
    found = lexical.ranked_documents(*frames(spark, docs, items), StageStore(spark), 10)
    assert result(found) == sorted(brute(docs, items, 10), key=repr)


def test_many_terms_are_added_in_whole_numbers(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(lexical, "EXACT_TERMS", 0)
    found = lexical.ranked_documents(*frames(spark, docs, items), StageStore(spark), 10)
    assert result(found) == sorted(brute(docs, items, 10), key=repr)


def test_empty_tables(spark, corpus):
    docs, items = frames(spark, *corpus)
    assert lexical.ranked_documents(docs.limit(0), items, StageStore(spark)).collect() == []
    assert lexical.ranked_documents(docs, items.limit(0), StageStore(spark)).collect() == []


def test_bounds_leave_pairs_of_leaves_out():
    import numpy as np

    weights = np.array([9, 8, 7, 6], np.int64)
    tree = lexical.ItemTree.over([[0], [1], [2], [3], [0, 1], [2, 3]], weights)
    best = lexical.Best([1] * 6, 1)
    rows, terms_, values = np.arange(200), np.arange(200) % 4, np.full(200, 5.0)
    ids = np.stack([np.arange(200), np.zeros(200, np.int64)], 1)
    lexical.search_batch(tree, weights, best, rows, terms_, values, ids)
    assert [int(scores[0]) for scores in best.scores] == [45, 40, 35, 30, 45, 35]
    # the same documents again, with higher ids and lower values: nothing is left to look at
    heights = lexical._upwards(np.full((4, 4), 1.0))
    assert lexical._surviving(tree, heights, best) == []
