"""Components against union by hand, and how many rounds and stages they and the line classes write."""

from __future__ import annotations

import os

import numpy as np
import pytest

from revlens.llm import graph, linededup


def least_reachable(links):
    label = {node: node for link in links for node in link}
    changed = True
    while changed:
        changed = False
        for one, two in links:
            least = min(label[one], label[two])
            changed |= label[one] != least or label[two] != least
            label[one] = label[two] = least
    return label


def stages(store):
    return sorted(os.listdir(store.path("").removeprefix("file://")))


def found_labels(spark, store, links):
    edges = store.save(spark.createDataFrame(links, "one long, two long"), "edges")
    rows = graph.components(edges, store, "linked").collect()
    assert len(rows) == len({row["node"] for row in rows})
    return {row["node"]: row["label"] for row in rows}


@pytest.mark.parametrize("seed", range(4))
def test_components_equal_brute_force(spark, store, seed):
    random = np.random.default_rng(seed)
    path = random.permutation(np.arange(100, 160)).tolist()
    links = list(zip(path, path[1:], strict=False))  # long, its ids in no order
    links += [(1000, centre) for centre in range(1001, 1030)] + [(at, 2030) for at in range(2000, 2030)]
    links += [(a, b) for a in range(300, 312) for b in range(300, 312)]  # both ways and to themselves
    links += [(int(a), int(b)) for a, b in random.integers(400, 460, (45, 2))] * 2
    links = [(a, b) for a, b in links if seed or a < 1000]
    expected = least_reachable([(a, b) for a, b in links if a != b])
    assert found_labels(spark, store.within("graph"), links) == expected


def test_stars_take_no_round_and_others_no_more_than_needed(spark, store):
    stars = store.within("stars")
    assert found_labels(spark, stars, [(1, 2), (3, 1), (7, 5), (5, 7)]) == {1: 1, 2: 1, 3: 1, 5: 5, 7: 5}
    assert stages(stars) == ["edges", "linked_labels"]
    path = store.within("path")
    assert found_labels(spark, path, [(1, 2), (2, 3)]) == {1: 1, 2: 1, 3: 1}
    assert stages(path) == ["edges", "linked", "linked_labels", "linked_labels-2"]
    none = store.within("none")
    assert found_labels(spark, none, []) == {} and stages(none) == ["edges", "linked_labels"]


def test_further_links_join_labels_and_lines_without_one(spark, store):
    inside = store.within("joined")
    first, more = [(1, 2), (1, 3), (5, 6), (20, 21)], [(3, 6), (6, 9), (11, 12), (10, 12)]
    labels = inside.save(spark.createDataFrame(sorted(least_reachable(first).items()), "linked long, label long"), "known")
    links = inside.save(spark.createDataFrame(more, "u long, v long"), "more")
    rows = linededup._joined(labels, links, inside).collect()
    assert sorted(map(tuple, rows)) == sorted(least_reachable(first + more).items())


@pytest.mark.parametrize("broadcast", [0, 7, 1_000_000])
def test_line_pairs_need_no_rounds_and_no_labels_of_other_lines(spark, store, monkeypatch, broadcast):
    monkeypatch.setattr(linededup, "BROADCAST_NODES", broadcast)
    monkeypatch.setattr(linededup, "CROWD", 4)
    inside = store.within("lines")
    start = "Order number for the shipped parcel is "
    crowd = [start + letter * 8 for letter in "abcdefghij"]  # share their start and are far from each other
    near = [start + "aaaaaaaz", start + "gggggggz", "a line that is by itself and not near anything else"]
    lines = "\n".join([*crowd, *near])
    found = linededup.line_classes(spark.createDataFrame([(0, lines)], "doc_id long, text string"), inside).collect()
    of = {row["line_no"]: bytes(row["class"]) for row in found}
    assert len(found) == 13 and len(set(of.values())) == 11 and of[0] == of[10] and of[6] == of[11]
    written = stages(inside)
    assert "hot_keys" in written and "line_links" not in written and "merged" not in written
    if broadcast == 1_000_000:
        assert "links_nodes" not in written
    # labels are those of linked lines, not of all
    assert spark.read.parquet(inside.path("labels")).count() == 4
