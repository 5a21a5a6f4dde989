"""The corpus operators against brute force, on small tables with every kind of odd row."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from revlens.llm import (
    chat,
    decontaminate,
    language,
    linededup,
    minhash,
    mixing,
    quality,
    queries,
    rules,
    sharding,
    tokens,
)

SCHEMA = "doc_id bigint, text string, lang string, source string, shard string, _row int, kept boolean, copies int"
WORD = re.compile("[^\x20\x09-\x0d]+")
LONG = " ".join(f"w{at % 977}x{at % 31}" for at in range(30_000))
BASE = " ".join(f"word{at}" for at in range(120))


def documents(spark, texts):
    """Rows with clashing column names, then a null id, a null text and rows that repeat."""
    rows = [(at, text, "en", f"s{at % 3}", "x", 7, True, 9) for at, text in enumerate(texts)]
    rows += [(None, BASE, None, None, None, None, None, None), (900, None, None, None, None, None, None, None)]
    rows += [rows[0], rows[0]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    near = BASE.replace("word60 ", "other ")
    far = " ".join(f"word{at}" if at % 4 else f"else{at}" for at in range(120))
    repeated = "one two three four five six seven eight nine ten " * 9
    return [BASE, near, BASE.upper(), far, "", "   \n\t", "tiny text", "Tiny  TEXT", LONG, repeated, "?!", None]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return documents(spark, texts).cache()


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda found: found[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[at : at + 5]) for at in range(max(1, len(words) - 4)))


def components(keys, linked):
    parent = {key: key for key in keys}

    def find(key):
        while parent[key] != key:
            key = parent[key]
        return key

    for one, two in linked:
        parent[find(one)] = find(two)
    groups = defaultdict(list)
    for key in keys:
        groups[find(key)].append(key)
    return {key: min(group) for group in groups.values() for key in group}


def test_near_duplicates_equal_brute_force(docs, store):
    rows = [row for row in docs.collect() if row["doc_id"] is not None]
    sets = {row["doc_id"]: shingles(row["text"]) for row in rows}
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    expected = components(sets, links)
    found = minhash.near_duplicates(docs, store).collect()
    assert len(found) == docs.count()
    for row in found:
        if row["doc_id"] is None:
            assert row["component_id"] is None and row["kept"]
        else:
            assert row["n_shingles"] == len(sets[row["doc_id"]])
            assert row["component_id"] == expected[row["doc_id"]]
            assert row["kept"] == (row["component_id"] == row["doc_id"])
    left = minhash.deduplicated(docs, store)
    assert left.columns == docs.columns
    stays = Counter(row["doc_id"] for row in left.collect())
    assert stays == Counter(set(expected.values()) | {None})


@pytest.mark.parametrize("bound", [minhash.BROADCAST_BYTES, 0])
def test_documents_are_judged_by_id_and_text(spark, store, monkeypatch, bound):
    monkeypatch.setattr(minhash, "BROADCAST_BYTES", bound)
    far = " ".join(f"far{at}" for at in range(120))
    lone = " ".join(f"lone{at}" for at in range(120))
    near = BASE.replace("word60 ", "other ")
    rows = [(1, BASE), (1, far), (1, near), (2, near), (2, lone), (3, far), (1, BASE), (1, ""), (1, None), (1, ""), (4, "")]
    frame = spark.createDataFrame([(*row, {"a": 1}) for row in rows], "doc_id long, text string, extra map<string,int>")
    for layout in (frame.orderBy(F.desc("text")).repartition(5),):
        left = Counter((row["doc_id"], row["text"]) for row in minhash.deduplicated(layout.drop("extra"), store).collect())
        # BASE and near are one group, of whose texts under the least id one stays
        kept = [text for text in (BASE, near) if left.pop((1, text), 0)]
        assert len(kept) == 1
        assert left == Counter({(1, far): 1, (2, lone): 1, (1, ""): 1, (1, None): 1, (4, ""): 1})


def test_working_columns_may_have_any_name(spark, store):
    names = "_size _size_ _source _source_ _random _random_ _key _key_ _at _row _gone _d _c _own_id _own_content "
    names += "_held_id _held_content _marked_id _stays _bytes _weight _tie _unit _cell content node a.b"
    extra = [F.lit(at).alias(name) for at, name in enumerate(names.split())]
    frame = documents(spark, [BASE, BASE, "one two three"]).drop("_row").select("*", *extra)
    benchmark = spark.createDataFrame([(1, "something else entirely that is in no document")], "item_id long, text string")
    for found in (
        minhash.deduplicated(frame, store),
        decontaminate.decontaminated(frame, benchmark, store),
        mixing.mixed(frame, store),
        sharding.shard(frame, store, sharding.text_bytes("text"), F.col("text")).drop("slot"),
    ):
        rows = found.collect()
        assert set(found.columns) == set(frame.columns) and rows
        assert all(row["_gone"] == names.split().index("_gone") for row in rows)


def test_pairs_of_a_crowded_region_are_all_compared():
    random = np.random.default_rng(7)
    sketch = random.integers(0, 256, minhash.HASHES, dtype=np.uint8).tobytes()
    regions = [5] + [0] * (minhash.TREES - 1)
    sides = {"diagonal": [minhash.WHOLE] * 6, "across": [0, 1, 0, 1, 1, 0]}
    for name, side in sides.items():
        rows = pa.RecordBatch.from_pydict(
            {
                "node": [b"%d" % at for at in range(6)],
                "sketch": [sketch] * 6,
                "regions": pa.array([regions] * 6, pa.list_(pa.int64())),
                "label": [b"%016d" % at for at in range(6)],
                "tree": pa.array([0] * 6, pa.int32()),
                "region": pa.array([9] * 6, pa.int64()),
                "side": pa.array(side, pa.int32()),
            }
        )
        found = minhash._region_pairs(rows, False).to_pydict()
        wanted = {(a, b) for a in range(6) for b in range(a) if name == "diagonal" or side[a] != side[b]}
        assert {(max(int(u), int(v)), min(int(u), int(v))) for u, v in zip(found["u"], found["v"], strict=True)} == wanted


def test_blocks_of_a_crowded_region_leave_no_pair_out(spark, store, monkeypatch):
    monkeypatch.setattr(minhash, "REGION_NODES", 8)
    nodes = [f"{at:016d}".encode() for at in range(60)]
    # all share the least prefix of a tree; in another, half of them do
    orders = [(node, 0, b"\0" * minhash.KEY_BYTES) for node in nodes]
    orders += [(node, 1, b"\1" * minhash.KEY_BYTES) for node in nodes[::2]]
    orders = spark.createDataFrame(orders, "node binary, tree int, sort_key binary")
    same = bytes(minhash.HASHES)
    sketches = spark.createDataFrame([(node, same) for node in nodes], "node binary, sketch binary")
    labels = spark.createDataFrame([(node, node) for node in nodes], "node binary, label binary")
    regions, crowded = minhash._regions(orders, store)
    placed = minhash._region_rows(regions, sketches)
    found = minhash._region_candidates(placed, crowded, labels, False).collect()
    assert len(found) == 60 * 59 // 2


def alike_texts(count, seed):
    """Texts with a long part in common that makes regions crowded, and near copies of some of them."""
    random = np.random.default_rng(seed)
    common = [f"c{at}" for at in range(150)]
    found = []
    for at in range(count):
        own = [f"o{at}x{word}" for word in range(int(random.integers(0, 60)))]
        found.append(common + own)
        for _ in range(int(random.integers(0, 3))):
            changed = list(found[-1])
            for place in random.integers(0, len(changed), int(random.integers(1, 6))):
                changed[place] = f"n{random.integers(1 << 30)}"
            found.append(changed)
    return [" ".join(words) for words in found]


@pytest.mark.parametrize("percent", [80, 85])
def test_crowded_regions_lose_no_link(spark, store, monkeypatch, percent):
    monkeypatch.setattr(minhash, "REGION_NODES", 4)
    texts = alike_texts(60, percent)
    sets = {at: shingles(text) for at, text in enumerate(texts)}
    links = [
        (a, b)
        for a in sets
        for b in range(a)
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    expected = components(sets, links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = minhash.near_duplicates(docs, store, percent=percent).collect()
    assert {row["doc_id"]: row["component_id"] for row in found} == expected


def test_depth_adapts_to_the_crowd_of_a_region(spark, store, monkeypatch):
    monkeypatch.setattr(minhash, "REGION_NODES", 3)
    value = lambda *numbers: b"".join(number.to_bytes(4, "little") for number in numbers)
    keys = {f"a{at}": value(1, 1, 1, at // 3, 0, 0, 0, 0) for at in range(8)}
    keys |= {f"b{at}": value(2, 2, 2, at, 0, 0, 0, 0) for at in range(3)}
    keys |= {"c": value(1, 1, 1, 9, 0, 0, 0, 0), "d": value(3, 3, 3, 0, 0, 0, 0, 0)}
    orders = [(node.encode(), 0, key) for node, key in keys.items()]
    regions, crowded = minhash._regions(spark.createDataFrame(orders, "node binary, tree int, sort_key binary"), store)
    rows = {bytes(row["node"]).decode(): (row["depth"], row["region"]) for row in regions.collect()}
    assert crowded.isEmpty() and set(rows) == set(keys) - {"d"}
    assert {rows[f"b{at}"][0] for at in range(3)} == {3} and {rows[f"a{at}"][0] for at in range(8)} == {4}
    assert len({rows[f"a{at}"][1] for at in range(8)}) == 3 and rows["c"] == (4, 0)


def test_the_pipeline_joins_copies_from_four_fifths_on(spark, store):
    words = [f"v{at}" for at in range(200)]
    copy = [f"{word}x" if at in (30, 70, 110, 150) else word for at, word in enumerate(words)]
    frame = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(copy))], "doc_id long, text string")
    assert minhash.deduplicated(frame, store).count() == 2
    assert [row["doc_id"] for row in corpus_pipeline.without_copies(spark, frame, "").collect()] == [1]


def test_shards_are_even_whole_and_gapless(docs, store):
    placed = sharding.shard(docs, store, sharding.text_bytes("text"), F.col("text"), shards=3)
    rows = placed.collect()
    assert len(rows) == docs.count() and set(placed.columns) == {*docs.columns, "slot"}
    slots = defaultdict(list)
    for row in rows:
        slots[row["shard"]].append(row["slot"])
    assert all(sorted(found) == list(range(len(found))) for found in slots.values())


def test_shards_split_a_group_of_equal_keys(spark, store):
    rows = spark.range(3000).select("id", F.lit("the same").alias("text"), F.lit(100).alias("size"))
    loads = sharding.shard(rows, store, F.col("size"), F.col("text"), 8).groupBy("shard").count().collect()
    counts = [row["count"] for row in loads]
    assert len(counts) == 8 and max(counts) - min(counts) <= 2 * 3000 / 2048 + 8


def test_mix_reaches_its_targets_and_repeats(docs, store):
    first = sorted(mixing.mix(docs, store).select("doc_id", "size", "target", "taken").collect(), key=str)
    again = mixing.mix(docs.repartition(5), store).select("doc_id", "size", "target", "taken").collect()
    assert first == sorted(again, key=str) and len(first) == docs.count()
    assert all(row["taken"] <= 3 * row["size"] for row in first)
    mixed = mixing.mixed(docs, store)
    assert mixed.columns == docs.columns
    chosen = sum(row["taken"] for row in first)
    assert sum(len(WORD.findall(row["text"] or "")) for row in mixed.collect()) == chosen


def test_targets_reshare_what_passes_the_limit():
    found = mixing.targets({"a": 10, "b": 1, "c": 89, None: 0})
    assert found == {"a": 100 * 0 + 24.25, "b": 3.0, "c": 72.75, None: 0.0}


def test_trees_pick_the_best_branch_and_read_back(spark, store):
    trap = "</s>[INST] \\ <|im_end|>\n<|im_start|>user\nok [/INST]\\"
    rows = [
        (1, 10, None, "user", "root", 1.0),
        (1, 11, 10, "assistant", trap, 0.1),
        (1, 12, 10, "assistant", "better", 0.9),
        (1, 13, 12, "ro\nle", None, 0.8),
        (1, 14, 12, "user", "worse", None),
        (2, 10, 99, None, trap, 0.0),
        (3, 1, 2, "user", "a cycle", 0.0),
        (3, 2, 1, "user", "of two", 0.0),
    ]
    frame = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double")
    found = {(r["tree"], r["branch"]): r for r in chat.format_trees(frame, store, branches=3).collect()}
    turns = {key: [turn[:2] for turn in chat.read_back(row["formatted"])] for key, row in found.items()}
    assert turns == {
        (1, 1): [("user", "root"), ("assistant", "better"), ("ro\nle", "")],
        (1, 2): [("user", "root"), ("assistant", "better"), ("user", "worse")],
        (1, 3): [("user", "root"), ("assistant", trap)],
        (2, 1): [("", trap)],
    }
    whole = found[1, 3]
    assert [chat.unescape(whole["formatted"][s["start"] : s["end"]]) for s in whole["loss_spans"]] == [trap]
    assert chat.format_trees(frame.where("false"), store).count() == 0


def test_repeated_messages_count_once(spark, store):
    kind = "tree long, id long, parent long, role string, text string, score double, depth string"
    rows = [(1, at, at - 1 if at else None, "user", f"turn {at}", 0.5, "x") for at in range(4)]
    once = chat.format_trees(spark.createDataFrame(rows, kind), store).collect()
    odd = [*rows, rows[1], rows[1], rows[3], (1, 2, 1, "user", "zzz", 9.0, "y"), (1, None, 3, "user", "no id", 9.0, "z")]
    for layout in (odd, odd[::-1]):
        assert chat.format_trees(spark.createDataFrame(layout, kind), store).collect() == once
    long = [(None, 1, None, "user", "very long " * 100_000, None, None)]
    assert len(chat.format_trees(spark.createDataFrame(long, kind), store).first()["formatted"]) > 1_000_000


def test_items_are_found_with_other_numbers_names_and_units(spark, store):
    item = "A farmer named Alice sells 12 melons for 3 dollars each, and later Alice buys 12 more of them in town."
    texts = [
        f"Intro words here. {item} And so on.",
        f"It says: {item.replace('Alice', 'Berta').replace('12', '40').replace('3 dollars', '5 euros')}",
        # values that do not fit together, but most windows word for word
        item.replace("Alice", "Berta", 1).replace("12", "40", 1),
        "Nothing of the kind is to be read in this text, which goes on for a while without any numbers.",
        item.lower(),
    ]
    docs = documents(spark, texts)
    benchmark = spark.createDataFrame([(5, item), (6, "too short"), (None, item), (7, None)], "item_id long, text string")
    found = decontaminate.contaminated(docs, benchmark, store).collect()
    hits = {row["doc_id"]: row["n_changed_slots"] for row in found}
    assert {row["item_id"] for row in found} == {5}
    assert hits[0] == 0 and hits[1] > 0 and 2 in hits and 3 not in hits
    kept = decontaminate.decontaminated(docs, benchmark, store)
    assert kept.columns == docs.columns and not {0, 1} & {row["doc_id"] for row in kept.collect()}
    assert decontaminate.contaminated(docs.where("false"), benchmark, store).count() == 0
    assert decontaminate.contaminated(docs, benchmark.where("false"), store).count() == 0


def test_near_verbatim_items_and_short_items(spark, store):
    item = "A farmer named Alice sells 12 melons for 3 dollars each, and later Alice buys 12 more of them in town."
    texts = [item.replace("Alice", "Berta", 1), item.replace("12", "40", 1), item.replace("each", "apiece")]
    texts += ["Yes it is.", "He said yes", "Well. Yes. No.", "first\nyes\nlast", "yes", "x " * 300_000 + item]
    found = decontaminate.contaminated(
        documents(spark, texts), spark.createDataFrame([(5, item), (6, "yes")], "item_id long, text string"), store
    )
    hits = Counter((row["doc_id"], row["item_id"]) for row in found.collect())
    assert hits == Counter(dict.fromkeys([(0, 5), (1, 5), (2, 5), (5, 6), (6, 6), (7, 6), (8, 5)], 1))


def test_blocks_of_the_benchmark_find_what_one_does(spark, store, monkeypatch):
    folder = "/root/testdata/sf0.001"
    docs, benchmark = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "benchmark"))
    whole = sorted(decontaminate.contaminated(docs, benchmark, store).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100_000)
    assert whole and sorted(decontaminate.contaminated(docs, benchmark, store).collect()) == whole


TOKENS = re.compile(r"[^\W\d_]+|[0-9]+(?:[.,:/][0-9]+)*|[%$]")


def test_items_in_the_test_documents_equal_brute_force(spark, store):
    """Every run of eight words of every item in every document, by comparing strings."""
    docs, benchmark = (
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").collect() for name in ("documents", "benchmark")
    )
    texts = {row["doc_id"]: " ".join(TOKENS.findall((row["text"] or "").lower())) for row in docs}
    expected = set()
    for item in benchmark:
        words = TOKENS.findall(item["text"].lower())
        runs = [f" {' '.join(words[at : at + 8])} " for at in range(len(words) - 7)]
        for doc_id, text in texts.items():
            if 2 * sum(run in f" {text} " for run in runs) >= len(runs):
                expected.add((doc_id, item["item_id"]))
    frames = (spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet") for name in ("documents", "benchmark"))
    found = decontaminate.contaminated(*frames, store).collect()
    assert expected and expected <= {(row["doc_id"], row["item_id"]) for row in found}
    # what is found besides has other numbers, names or units
    assert all(row["n_changed_slots"] for row in found if (row["doc_id"], row["item_id"]) not in expected)


def test_a_value_that_does_not_fit_only_spoils_its_own_windows(spark, store):
    plain = "the slow river runs past old mills and wide green fields until it meets the sea near a small port"
    item = f"Mona has 2 apples and 2 pears in the one big basket. {plain}"
    texts = [item.replace("2", "3", 1).replace("2", "5"), item.replace("2", "3"), item.replace("Mona", "Vera"), plain]
    docs = documents(spark, texts)
    benchmark = spark.createDataFrame([(5, item)], "item_id long, text string")
    rows = {row["doc_id"]: row for row in decontaminate.contaminated(docs, benchmark, store).collect()}
    # 24 windows; seven of the first text hold one of the twos
    assert {0, 1, 2} <= rows.keys() and rows[0]["n_matched"] < rows[1]["n_matched"] == rows[1]["n_windows"]
    assert rows[1]["n_changed_slots"] == 1


def test_every_item_is_found_verbatim_and_openings_may_be_names(spark, store):
    tom = "Tom has 5 apples. Tom gives 2 to Mary. How many apples does Tom have?"
    items = [(1, tom), (2, "12 + 7 = 19, 3 + 5 = 8"), (3, "Alice Bob Carol 12 km"), (4, "小明有几个苹果？"), (5, "Yes, 12")]
    texts = [
        f"So. {tom.replace('Tom', 'Ben')} Answer it.",
        "Sums: 12 + 7 = 19, 3 + 5 = 8. Done",
        "Sums: 12 + 7 = 18, 4 + 5 = 9. Done",
        "They are Alice, Bob, Carol: 12 km.",
        "请看题目小明有几个苹果？谢谢",
        "小红有几本书",
        "Is it? yes 12",
    ]
    frame = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(frame, benchmark, store).collect()
    assert {(row["doc_id"], row["item_id"]) for row in found} == {(0, 1), (1, 2), (3, 3), (4, 4), (6, 5)}
    assert {row["n_changed_slots"] for row in found if row["item_id"] != 1} == {0}


def test_rules_count_as_brute_force_does(spark, docs, store):
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, 0), (9, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for row in rules.quality_rules(docs, labels, store).collect():
        text = row["text"] or ""
        words = WORD.findall(text)
        windows = [tuple(words[at : at + 8]) for at in range(len(words) - 7)]
        counts, inside = Counter(windows), set()
        for at, window in enumerate(windows):
            if counts[window] > 1:
                inside.update(range(at, at + 8))
        lines = [line for line in text.split("\n") if WORD.search(line)]
        assert row["n_words"] == len(words) and row["word_chars"] == sum(map(len, words))
        assert row["n_symbols"] == len(re.findall(rules.SYMBOLS, text))
        assert row["n_dup_lines"] == len(lines) - len(set(lines))
        assert row["n_repeat_words"] == len(inside)
        assert row["base_failed"] == (len(words) < 20 or 100 * len(inside) > 30 * len(words))
        assert not (row["base_failed"] and row["kept"])
    assert rules.quality_rules(docs.where("false"), labels, store).count() == 0


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_all_trusted_documents_count(spark, store, monkeypatch, limit):
    monkeypatch.setattr(rules, "BROADCAST_IDS", limit)
    count = 20_400
    frame = spark.range(count).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"))
    frame = frame.union(spark.createDataFrame([(None, "w0")], "doc_id long, text string"))
    labels = frame.select("doc_id", F.lit(1).alias("quality"))
    labels = labels.union(labels)
    counted = rules.with_base_counts(frame.select(F.col("doc_id").alias("_doc"), "text"), "text")
    counted = counted.select("_doc", rules._gram_buckets().alias("_grams"))
    trusted = rules.trusted_documents(counted, labels)
    assert trusted.count() == count
    # all but one row are trusted, so raw and target nearly agree in every bucket
    assert max(map(abs, rules.log_ratios(counted, trusted))) < rules.SCALE


def test_line_field_marginals_equal_enumeration():
    random = np.random.default_rng(1)
    model = quality.Model(random.normal(size=2), random.normal(size=(2, 2)), np.zeros(2), np.ones(2))
    features = random.normal(size=(5, 2))
    own = model.emissions(features)
    weights, good = 0.0, np.zeros(5)
    for code in range(32):
        states = [code >> at & 1 for at in range(5)]
        score = sum(own[at] for at in range(5) if states[at])
        score += sum(model.moves[states[at], states[at + 1]] for at in range(4))
        weights += np.exp(score)
        good += np.exp(score) * np.array(states)
    assert np.allclose(quality.marginals(model, np.zeros(5, int), features), good / weights)


def test_quality_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score_documents(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= row["score"] <= 1 for row in rows)
    assert {row["score"] for row in rows if row["doc_id"] in (4, 5, 900)} == {0.0}
    assert quality.score_documents(docs.where("false"), labels).count() == 0
    assert {row["score"] for row in quality.score_documents(docs, labels.where("false")).collect()} == {0.5}


def test_viterbi_equals_search():
    random = np.random.default_rng(2)
    for _ in range(40):
        count = int(random.integers(1, 7))
        scores = random.normal(scale=6, size=(count, 3))
        best = max(
            np.ndindex(*[3] * count),
            key=lambda path: sum(scores[at, path[at]] for at in range(count))
            - language.SWITCH * sum(path[at] != path[at + 1] for at in range(count - 1)),
        )
        assert tuple(language.viterbi(scores, np.zeros(count, int))) == best


def test_language_spans_and_odd_rows(spark, docs):
    english, german = "the house and the garden of the town ", "der Garten und das Haus in der Stadt "
    rows = [(at, english * 5 if at % 2 else german * 5, "en" if at % 2 else "de") for at in range(60)]
    rows += [(100, english * 6 + german * 2, None), (101, "12 34 !", None), (102, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {row["doc_id"]: row for row in language.identify_languages(frame).collect()}
    assert all(found[at]["lang_pred"] == ("en" if at % 2 else "de") for at in range(60))
    assert [span["lang"] for span in found[100]["spans"]] == ["en", "de"] and found[100]["lang_pred"] == "en"
    assert (found[101]["lang_pred"], found[102]["lang_pred"]) == ("und", "und")
    assert language.identify_languages(frame.where("false")).count() == 0
    assert {r["lang_pred"] for r in language.identify_languages(frame.withColumn("lang", F.lit(None))).collect()} == {"und"}


def test_letters_among_signs_are_letters(spark):
    words = {"zgh": "ⵜⴰⵎⴰⵣⵉⵖⵜ ⵜⴰⵎⵓⵔⵜ ", "cop": "ⲧⲙⲛⲧⲣⲙⲛⲕⲏⲙⲉ ⲛⲟⲩⲧⲉ ", "en": "the house – “garden” of the town… "}
    rows = [(at, name, words[name] * 5) for at, name in enumerate([*words] * 20)]
    rows += [(100, None, "— “…” ⁂ → ∑ ⠿ § ¿"), (101, None, "ª º µ")]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    found = {row["doc_id"]: row for row in language.identify_languages(frame).collect()}
    assert all(found[at]["lang_pred"] == name and found[at]["score"] == 1.0 for at, name, _ in rows[:60])
    assert found[100]["lang_pred"] == "und" and found[101]["lang_pred"] != "und"
    for sign in "–“…⁂→∑⠿§¿\u2028\u3000"[:-1]:
        data = np.frombuffer(f"a{sign}b".encode(), np.uint8)
        assert len(language.letters_of(data, np.array([0, len(data)])).start) == 2
    for letter in "ªºµⁿℂⰀⱠⲀⴀⴰⶀ\u2de0ⸯ":
        data = np.frombuffer(f"a{letter}b".encode(), np.uint8)
        assert len(language.letters_of(data, np.array([0, len(data)])).start) == 1


def edits(one, two):
    last = list(range(len(two) + 1))
    for at, letter in enumerate(one, 1):
        row = [at]
        for to, other in enumerate(two, 1):
            row.append(min(last[to] + 1, row[-1] + 1, last[to - 1] + (letter != other)))
        last = row
    return last[-1]


def test_line_classes_equal_brute_force(spark, store):
    random = np.random.default_rng(4)
    lines = ["the quick brown fox jumps over it", "another line that has nothing to do with it", "short"]
    for _ in range(150):
        line = list(lines[int(random.integers(0, 2))])
        for _ in range(int(random.integers(0, 4))):
            at = int(random.integers(0, len(line)))
            line[at : at + int(random.integers(0, 2))] = "zé語"[int(random.integers(0, 3))][: int(random.integers(0, 2))]
        lines.append("".join(line))
    docs = documents(spark, ["\n".join(lines[at : at + 4]) for at in range(0, len(lines), 4)])
    rows = docs.select("doc_id", "text").collect()
    places = defaultdict(list)
    for row in rows:
        for at, line in enumerate((row["text"] or "").split("\n")):
            if line.strip():
                places[line.strip()].append((-1 if row["doc_id"] is None else row["doc_id"], at))
    links = [
        (a, b)
        for a in places
        for b in places
        if a < b and min(len(a), len(b)) >= linededup.SHORT and edits(a, b) <= linededup.EDITS
    ]
    label = components(places, links)
    first = {}
    for line, found in places.items():
        first[label[line]] = min([*found, first.get(label[line], (10**9, 0))])
    expected = {place: first[label[line]] for line, found in places.items() for place in found}
    for row in linededup.line_verdicts(docs, store).collect():
        plain = [-1 if value is None else value for value in row[:4]]
        assert expected[plain[0], plain[1]] == (plain[2], plain[3])
        assert row["kept"] == (plain[:2] == plain[2:])


def classes_of_lines(spark, store, lines, digits=False):
    """The classes that `line_classes` makes of lines, and those that comparing all of them makes."""
    frame = spark.createDataFrame([(0, "\n".join(lines))], "doc_id long, text string")
    found = linededup.line_classes(frame, store, digits=digits)
    named = defaultdict(set)
    for row in found.collect():
        named[bytes(row["class"])].add(lines[row["line_no"]])

    def close(one, two):
        shorter = min(len(one), len(two))
        if shorter < 24 and not digits and re.sub(r"\d+", "0", one) == re.sub(r"\d+", "0", two):
            return False
        return edits(one, two) <= (2 if shorter >= 24 else 1 if shorter >= 12 else 0)

    label = components(lines, [(a, b) for a in lines for b in lines if a < b and close(a, b)])
    expected = defaultdict(set)
    for line in lines:
        expected[label[line]].add(line)
    return sorted(map(sorted, named.values())), sorted(map(sorted, expected.values()))


def test_a_line_that_only_probes_a_crowded_entry_is_compared(spark, store):
    start = "Order number for the shipped parcel is "
    lines = [f"{start}{number}" for number in range(100, 200)]
    # two characters more than one of the lines, so in no index entry of theirs, and far from most of them
    lines += [f"{start}{end}" for end in ("1045", "1-4-5", "1+2+7", "1=8=3")]
    found, expected = classes_of_lines(spark, store, lines)
    assert found == expected


@pytest.mark.parametrize(("digits", "crowd"), [(False, 64), (True, 2)])
def test_short_lines_are_joined_by_two_segments(spark, store, monkeypatch, digits, crowd):
    monkeypatch.setattr(linededup, "CROWD", crowd)
    random = np.random.default_rng(6)
    lines = {"Click here to subscribe", "Click here to subscribe!", "Share on Facebook", "Share on Facebook.", "a", "b"}
    lines |= {"one two one two one two 12", "one two one two one two x", "one two one two one two 1xy"}
    words = ["cat", "bat", "bag", "big", "dig", "dog"]
    numbers = ["Total: 5", "Total: 7", "Order no. 12345", "Order no. 12346", "Order no. 1234", "Order no. 123x5"]
    lines |= {*words, *numbers}
    for size in (11, 12, 13, 23, 24, 25):
        line = list(random.choice(list("aé語"), size))
        for _ in range(8):
            line[int(random.integers(0, len(line)))] = "bé9"[int(random.integers(0, 3))]
            lines.add("".join(line))
            lines.add("".join(line[1:]))
    found, expected = classes_of_lines(spark, store, sorted(lines), digits)
    assert found == expected and ["Share on Facebook", "Share on Facebook."] in found
    assert all([word] in found for word in [*words, *numbers[:2]])
    assert (["Order no. 12346"] in found) != digits


def test_lines_are_trimmed_alike_and_their_index_is_cut_once(spark, store, monkeypatch):
    texts = ["", " ", "a", " a", "a ", "\t a b \r", "\x0ba\x0c", "\xa0a\xa0", "é ", "\x1fa", " \u3000", "a\tb", None]
    frame = spark.createDataFrame([(text,) for text in texts], "line string")
    whole = F.btrim("line", F.lit(" \t\r\x0b\x0c"))
    assert frame.where(~linededup.trimmed(F.col("line")).eqNullSafe(whole)).collect() == []
    cuts = []
    entries = linededup._entries
    monkeypatch.setattr(linededup, "_entries", lambda lines, places: cuts.append(places) or entries(lines, places))
    inside = store.within("index_once")
    lines = [(0, "one line of words that is long enough\n one line of words that is long enouhg \nshort")]
    found = linededup.line_classes(spark.createDataFrame(lines, "doc_id long, text string"), inside)
    assert len({bytes(row["class"]) for row in found.collect()}) == 2
    assert len(cuts) == 2 and spark.read.parquet(inside.path("index")).count() == 6


def test_bit_parallel_distance_is_exact():
    random = np.random.default_rng(5)
    for _ in range(3000):
        one, two = ("".join(random.choice(["a", "b"], int(random.integers(0, 8)))) for _ in range(2))
        assert linededup.within(one, two) == (edits(one, two) <= linededup.EDITS)


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_token_counts_for_any_block_size(docs, store, block):
    coder = tokens.encoding(tokens.TOKENIZER)
    chosen = docs.where("doc_id <> 8 OR doc_id IS NULL")
    found = tokens.document_tokens(chosen, store, block_tokens=block).collect()
    expected = [(row["doc_id"], len(coder.encode_ordinary(row["text"] or ""))) for row in chosen.collect()]
    assert Counter(map(tuple, found)) == Counter(expected)


def test_flat_files_are_counted_per_file(spark, tmp_path):
    ids = np.array([5, 6, 50256, 50256, 7, 8, 9, 50256, 3], dtype=np.uint32)
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    counted = tokens.count_tokens(tokens.read_flat_files(spark, f"file://{tmp_path}", 2)).collect()
    assert sorted((row["ordinal"], row["n_tokens"]) for row in counted) == [(0, 2), (1, 0), (2, 3)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for table in ("documents", "conversations", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    cursor = duck.execute(queries.ORACLE_SQL[name])
    names = [item[0] for item in cursor.description]
    frame = queries.QUERIES[name](spark, folder)
    assert sorted(frame.columns) == sorted(names)
    assert sorted(map(tuple, frame.select(*names).collect()), key=str) == sorted(cursor.fetchall(), key=str)


def test_pipeline_stages_keep_the_columns(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.good_documents(spark, docs, folder)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    shards = corpus_pipeline.sharded(spark, kept, folder)
    assert set(shards.columns) == {*docs.columns, "shard", "slot"} and shards.count() == kept.count()
