"""Conversation repair against a search over all edits, in one chunk and in many."""

from __future__ import annotations

import hashlib
import heapq
import random
import re

import pytest

from revlens.llm import repair
from revlens.sources.stages import StageStore

SCHEMA = "conv_id bigint, turn bigint, role string, text string, fault string, edits int, _position string, copies int"
WANTED = re.compile(r"(s?(ua)+)?")


def faults(messages):
    """(role, text, fault) in order, from the definitions."""
    md5 = lambda text: hashlib.md5(text.encode()).hexdigest()
    read = [(turn, " " if role is None else role, " " if text is None else text) for turn, role, text in messages]
    read.sort(key=lambda row: (row[0] is not None, row[0] or 0, row[1], md5(row[2])))
    seen, found = set(), []
    for _, role, text in read:
        words = text.strip(" \t\n\x0b\f\r")
        fault = "blank" if not words else "duplicate" if (role, text) in seen else None
        if fault is None and words[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        found.append((role, text, fault))
    return found


def best(judged):
    """(cost, edits, turns) by uniform-cost search over whole prefixes of edits; no vectors, no states."""
    queue, done = [(0, "", 0, "", ())], {}
    while queue:
        cost, edits, at, initials, turns = heapq.heappop(queue)
        if at == len(judged) and WANTED.fullmatch(initials):
            return cost, edits, turns
        # what follows depends on the last initial and on whether there was any
        key = (at, initials[-1:])
        if done.setdefault(key, (cost, edits)) != (cost, edits):
            continue

        def push(price, edit, step, role=None, text=""):
            now = initials + (role[:1] if role is not None else "")
            if role is None or (role[:1] and any(WANTED.fullmatch(now + rest) for rest in ("", "a", "ua"))):
                said = turns + ((role, text),) if role is not None else turns
                heapq.heappush(queue, (cost + price, edits + edit, at + step, now, said))

        for role in ("user", "assistant"):
            push(3, "I", 0, role)
        if at < len(judged):
            role, text, fault = judged[at]
            push(4, "D", 1)
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                push(extra, "K", 1, role, text)
                for other in ("user", "assistant"):
                    push(extra + 3, "R", 1, other, text)
    raise AssertionError


def expected(messages):
    judged = faults(messages)
    cost, edits, turns = best(judged)
    numbers = [turn for turn, _, _ in messages if turn is not None]
    pairs = zip(judged, judged[1:], strict=False)
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
        **{name: sum(fault == name for _, _, fault in judged) for name in ("blank", "duplicate", "truncated")},
        "illegal": sum(one[0][:1] + two[0][:1] not in ("su", "ua", "au") for one, two in pairs),
        "cost": cost,
        "audit": edits,
        "repaired_sha256": hashlib.sha256("\n".join(f"{role}:{text}" for role, text in turns).encode()).hexdigest(),
    }


def conversations():
    rng = random.Random(11)
    said = ["Yes.", "And then", "What?", "", " \n", "No!  ", "Well; …", "Größe 1.", None]
    roles = ["user", "assistant"] * 4 + ["system", "tool", "", None]
    found = {None: [(0, "user", "Hello."), (0, "user", "Hello."), (None, "assistant", "Hi.")]}
    for conv in range(40):
        size = rng.randrange(1, 14)
        found[conv] = [(rng.choice([at, at, at, None]), rng.choice(roles), rng.choice(said)) for at in range(size)]
        found[conv] += [rng.choice(found[conv])] * rng.choice([0, 0, 1, 3])
    # long ones: in order, deletions only, deletions with one message between, changing rules
    found[100] = [(at, ("user", "assistant")[at % 2], f"Turn {at}.") for at in range(60)]
    found[101] = [(at, "user", "") for at in range(50)]
    found[102] = [(at, "user" if at == 31 else "assistant", "Same." if at != 31 else "Well.") for at in range(60)]
    found[103] = [(0, "system", "Be kind."), *[(at, "system", "") for at in range(1, 40)], (40, "assistant", "Bye.")]
    found[104] = [(1, "user", "long " * 50_000 + "."), (2, "assistant", "x" * 300_000)]
    return found


@pytest.fixture(scope="module")
def rows():
    return [(conv, *said, "x", 7, "y", 9) for conv, messages in conversations().items() for said in messages]


@pytest.mark.parametrize("bits", [20, 2, 0])
def test_edits_are_the_least_of_the_cheapest_in_any_chunks(spark, rows, bits):
    store = StageStore(spark)
    found = repair.audits(repair.repaired(spark.createDataFrame(rows, SCHEMA), store, bits)).collect()
    got = {row["conv_id"]: {name: row[name] for name in row.asDict() if name != "conv_id"} for row in found}
    assert got == {conv: expected(messages) for conv, messages in conversations().items()}


def test_chunks_that_only_delete_take_no_pass_each(spark):
    """A vector runs through chunks of forced deletions without another run of them."""
    rows = [(1, at, "assistant", "", None, None, None, None) for at in range(64)]
    rows.append((1, 64, "assistant", "Bye.", None, None, None, None))
    slim = repair._slim(repair.ordered_messages(spark.createDataFrame(rows, SCHEMA), StageStore(spark)), 1)
    runs = []
    original = repair._arrivals
    repair._arrivals = lambda frame, starts: runs.append(dict(starts)) or original(frame, starts)
    try:
        repair.stitched(slim)
    finally:
        repair._arrivals = original
    assert len(runs) <= 3


def test_an_empty_table_gives_an_empty_result(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.audits(repair.repaired(empty, StageStore(spark))).collect() == []


def test_the_messages_keep_their_texts_and_faults(spark):
    rows = [(1, 0, "assistant", "Hm.", *[None] * 4), (1, 1, "user", "Well", *[None] * 4)]
    found = repair.repaired(spark.createDataFrame(rows, SCHEMA), StageStore(spark)).orderBy("_position").collect()
    assert [(row["text"], row["fault"]) for row in found] == [("Hm.", None), ("Well", "truncated")]
    turns = [turn for row in found for turn in repair.edited(row["role"], row["edits"], row["state"])]
    assert [role for role, _ in turns] in (["user", "assistant"], ["user", "assistant", "user", "assistant"])
