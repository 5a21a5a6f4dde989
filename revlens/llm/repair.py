"""Conversation structure repair: the cheapest edits that give a conversation the turns it should have.

A conversation should be an optional system turn and then pairs of user and assistant turns. Four states
follow it: nothing yet, after the system turn, after a user turn, after a pair. Every message is kept,
given another role or deleted, and empty messages may be inserted anywhere.

The costs from each message to the end are a Viterbi pass over four states, taken in chunks at once: a
chunk starts from a speculative cost vector, that of the end of a conversation. Where the vector that
the next chunk arrives at is another one, the chunk is run again from there, beside its first run, until
the two vectors differ by a constant only, from where on they stay alike. Passes are repeated until all
chunks agree. The stitched costs then lead a forward pass that takes the least edit among the cheapest.

Only vectors of chunk ends reach the driver, one chunk in 2 ** CHUNK_BITS messages of a range partition.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.joins import attach
from revlens.functions.ranking import POSITION, sorted_stage
from revlens.sources.stages import StageStore

# fixed values: what the edits cost, and the white space of texts
RELABEL, REMOVE, INSERT, CUT_SHORT = 3, 4, 3, 3
SPACE = " \t\n\x0b\f\r"
START, SYSTEM, USER, PAIR = range(4)
NEVER = 1 << 40
# messages of a chunk, as a power of two
CHUNK_BITS = 20
# bytes of repeated messages that are broadcast; beyond it they meet by a shuffle
BROADCAST_BYTES = 32 << 20

Vector = tuple[int, int, int, int]
# what a message is to the repair: its role's initial times three, and its state
INITIALS, FINE, TRUNCATED, LOST = "sua", 0, 1, 2


def _after(state: int) -> int:
    """The state that the next user or assistant turn leads to, whichever of them is due."""
    return PAIR if state == USER else USER


def _closed(costs: list[int]) -> Vector:
    """Costs once messages may be inserted first."""
    user = min(costs[USER], INSERT + costs[PAIR])
    rest = [min(costs[state], INSERT + user) for state in (START, SYSTEM)]
    return rest[0], rest[1], user, min(costs[PAIR], INSERT + user)


END = _closed([0, NEVER, NEVER, 0])


def _kept_state(state: int, initial: int) -> int | None:
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 1:
        return None if state == USER else USER
    return PAIR if initial == 2 and state == USER else None


def _choices(later: Vector, kind: int, state: int) -> list[tuple[int, str, int]]:
    """(cost, edit, next state) of what can be done with a message in a state."""
    initial, fault = divmod(kind, 3)
    found = [(REMOVE + later[state], "D", state)]
    if fault != LOST:
        extra = CUT_SHORT if fault == TRUNCATED else 0
        kept = _kept_state(state, initial)
        if kept is not None:
            found.append((extra + later[kept], "K", kept))
        found.append((extra + RELABEL + later[_after(state)], "R", _after(state)))
    return found


class Costs:
    """Cost vectors up to a constant, by number, and what messages make of them."""

    def __init__(self) -> None:
        self.shapes: list[Vector] = []
        self._numbers: dict[Vector, int] = {}
        self._steps: dict[tuple[int, int], int] = {}
        self._edits: dict[tuple[int, int, int], tuple[str, int]] = {}

    def number(self, vector: Iterable[int]) -> int:
        values = tuple(vector)
        shape = tuple(value - min(values) for value in values)
        if shape not in self._numbers:
            self._numbers[shape] = len(self.shapes)
            self.shapes.append(shape)
        return self._numbers[shape]

    def _before(self, shape: int, kind: int) -> Vector:
        later = self.shapes[shape]
        return _closed([min(_choices(later, kind, state))[0] for state in range(4)])

    def step(self, shape: int, kind: int) -> int:
        """The shape before a message from the shape after it."""
        key = (shape, kind)
        if key not in self._steps:
            self._steps[key] = self.number(self._before(shape, kind))
        return self._steps[key]

    def edit(self, shape: int, kind: int, state: int) -> tuple[str, int]:
        """The least of the cheapest edits up to a message and the state they lead to."""
        key = (shape, kind, state)
        if key not in self._edits:
            later, before = self.shapes[shape], self._before(shape, kind)
            done, at = "", state
            while True:
                best = [(edit, to) for cost, edit, to in _choices(later, kind, at) if cost == before[at]]
                if INSERT + before[_after(at)] == before[at]:
                    best.append(("I", _after(at)))
                edit, to = min(best)
                done, at = done + edit, to
                if edit != "I":
                    break
            self._edits[key] = (done, at)
        return self._edits[key]


def closing(state: int) -> str:
    """The inserts that end a conversation in a state."""
    return {START: "", SYSTEM: "II", USER: "I", PAIR: ""}[state]


def edited(role: str, edits: str, state: int) -> Iterator[tuple[str, bool]]:
    """(role, whether it is the message itself) of the turns that edits leave, from a state on."""
    for edit in edits:
        if edit == "D":
            continue
        state = (SYSTEM if role[:1] == "s" else _after(state)) if edit == "K" else _after(state)
        yield (role if edit == "K" else "user" if state == USER else "assistant"), edit != "I"


def _is_blank(text: Column) -> Column:
    return F.length(F.trim(text, F.lit(SPACE))) == 0


def ordered_messages(conversations: DataFrame, store: StageStore) -> DataFrame:
    """Messages in order, equal ones of a turn as one row with `copies`, with their fault and kind."""
    said = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    # copies fold in each task before the shuffle
    folded = said.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    folded = folded.withColumn("digest", F.md5("text")).withColumn(
        "said_key", F.md5(F.concat_ws("\n", F.col("conv_id").cast("string"), F.length("role"), "role", "digest"))
    )
    repeated = (
        folded.groupBy("said_key")
        .agg(
            F.count(F.lit(1)).alias("rows_of"),
            F.min("turn").alias("first_turn"),
            F.bool_or(F.col("turn").isNull()).alias("first_null"),
        )
        .where("rows_of > 1")
    )
    repeated = store.save(repeated, "repeated")
    joined = attach(
        folded, repeated, F.col("said_key"), "said_key", BROADCAST_BYTES, ["said_key", "turn"], weight="rows_of"
    )
    later = F.coalesce(F.col("first_null") | (F.col("turn") > F.col("first_turn")), F.lit(False))
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    fault = (
        F.when(_is_blank(F.col("text")), "blank")
        .when(F.col("turn").isNotNull() & later, "duplicate")
        .when(~last.isin(".", "!", "?"), "truncated")
    )
    state = F.when(F.col("fault") == "truncated", TRUNCATED).when(F.col("fault").isNull(), FINE).otherwise(LOST)
    place = F.instr(F.lit(INITIALS), F.left("role", F.lit(1)))
    initial = F.when((F.length("role") == 0) | (place == 0), len(INITIALS)).otherwise(place - 1)
    judged = joined.withColumn("fault", fault).select(
        "conv_id", "turn", "role", "text", "copies", "digest", "fault", (initial * 3 + state).cast("int").alias("kind")
    )
    order = [F.col(name).asc_nulls_first() for name in ("conv_id", "turn", "role", "digest")]
    return sorted_stage(store, judged, order, "ordered").table.drop("digest")


def _chunk(bits: int) -> Column:
    return F.shiftright(F.col(POSITION), bits)


def _slim(ordered: DataFrame, bits: int) -> DataFrame:
    return ordered.select(_chunk(bits).alias("chunk"), POSITION, "conv_id", "kind", "copies")


def _in_order(slim: DataFrame) -> DataFrame:
    return slim.repartition("chunk").sortWithinPartitions("chunk", POSITION)


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int | None, list[int], array, list[int]]]:
    """(chunk, conv_id, positions, kinds, copies) of each stretch of a conversation within a chunk."""
    now, positions, kinds, copies = None, [], array("b"), []
    for batch in batches:
        for chunk, at, conv, kind, times in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if now != (chunk, conv):
                if now:
                    yield *now, positions, kinds, copies
                now, positions, kinds, copies = (chunk, conv), [], array("b"), []
            positions.append(at)
            kinds.append(kind)
            copies.append(times)
    if now:
        yield *now, positions, kinds, copies


def _spanning(slim: DataFrame) -> DataFrame:
    """Conversations that more than one chunk holds; no more than there are chunks."""
    ends = slim.groupBy("conv_id").agg(F.min("chunk").alias("first_chunk"), F.max("chunk").alias("last_chunk"))
    return ends.where("first_chunk < last_chunk")


END_RUN = "conv_id bigint, chunk bigint, vector array<bigint>, arrives array<bigint>, forced boolean, first_kind int, last_kind int"


def _arrivals(slim: DataFrame, starts: dict[tuple[int | None, int], Vector]) -> DataFrame:
    """What each chunk of a spanning conversation makes of a vector: the speculative one, or that of `starts`.

    A chunk that is run again goes beside its speculative run until both are alike.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = Costs()
        rows = []
        for chunk, conv, _, kinds, _ in _runs(batches):
            vector = starts.get((conv, chunk), END)
            shape, guess = costs.number(vector), costs.number(END)
            again = (conv, chunk) in starts
            for kind in reversed(kinds):
                if again and shape == guess:
                    break
                shape, guess = costs.step(shape, kind), costs.step(guess, kind) if again else guess
            else:
                again = False
            # a run that met the speculative one arrives where that did
            rows.append(
                {
                    "conv_id": conv,
                    "chunk": chunk,
                    "vector": list(vector),
                    "arrives": None if again else list(costs.shapes[shape]),
                    "forced": all(kind % 3 == LOST for kind in kinds),
                    "first_kind": kinds[0],
                    "last_kind": kinds[-1],
                }
            )
        numbers = pa.list_(pa.int64())
        kind_of = [("conv_id", pa.int64()), ("chunk", pa.int64()), ("vector", numbers), ("arrives", numbers)]
        kind_of += [("forced", pa.bool_()), ("first_kind", pa.int32()), ("last_kind", pa.int32())]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kind_of))

    return _in_order(slim).mapInArrow(run, END_RUN)


def stitched(slim: DataFrame) -> tuple[dict[int, tuple[int, str]], dict[int, Vector]]:
    """({chunk: (state, last initial before it)}, {chunk: cost vector after it}) at the chunk borders
    that cut a conversation. The borders inside one conversation are the only ones that need any."""
    ends = _spanning(slim).select(F.col("conv_id").alias("spans"), "first_chunk", "last_chunk")
    if ends.isEmpty():
        return {}, {}
    # at most one conversation for each chunk border, so ids and borders fit a broadcast
    cut = slim.join(F.broadcast(ends.select("spans")), F.col("conv_id").eqNullSafe(F.col("spans"))).drop("spans")
    chains: dict[int | None, dict[int, object]] = defaultdict(dict)
    arrives: dict[tuple[int | None, int], dict[Vector, Vector]] = defaultdict(dict)
    for row in _arrivals(cut, {}).collect():
        chains[row["conv_id"]][row["chunk"]] = row
        arrives[row["conv_id"], row["chunk"]][END] = tuple(row["arrives"])
    after: dict[int, Vector] = {}
    while True:
        wanted: dict[tuple[int | None, int], Vector] = {}
        for conv, chunks in chains.items():
            vector = END
            for chunk in sorted(chunks, reverse=True):
                if chunk != max(chunks):
                    after[chunk] = vector
                known = arrives[conv, chunk]
                if chunks[chunk]["forced"]:
                    known.setdefault(vector, vector)
                if vector not in known:
                    # on with the speculative run, which the pass may confirm
                    wanted[conv, chunk] = vector
                    vector = known[END]
                else:
                    vector = known[vector]
        if not wanted:
            break
        for row in _arrivals(cut, wanted).collect():
            key = (row["conv_id"], row["chunk"])
            if key in wanted:
                reached = arrives[key][END] if row["arrives"] is None else tuple(row["arrives"])
                arrives[key][wanted[key]] = reached
    leads = {(row["conv_id"], row["chunk"]): list(row["leads"]) for row in _leads(cut, after, chains).collect()}
    before: dict[int, tuple[int, str]] = {}
    for conv, chunks in chains.items():
        state, last = START, ""
        for chunk in sorted(chunks):
            if last:
                before[chunk] = (state, last)
            state = leads[conv, chunk][state]
            last = INITIAL_OF[chunks[chunk]["last_kind"] // 3]
    return before, after


INITIAL_OF = (*INITIALS, "x")


def _leads(slim: DataFrame, after: dict[int, Vector], chains: dict) -> DataFrame:
    """The state after each chunk of a spanning conversation for each state before it."""
    lasts = {(conv, max(chunks)) for conv, chunks in chains.items()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = Costs()
        rows = []
        for chunk, conv, _, kinds, copies in _runs(batches):
            end = END if (conv, chunk) in lasts else after[chunk]
            shapes = _shapes(costs, kinds, end)
            states = list(range(4))
            for kind, shape in zip(kinds, shapes, strict=True):
                states = [costs.edit(shape, kind, state)[1] for state in states]
            rows.append({"conv_id": conv, "chunk": chunk, "leads": states})
        kind_of = [("conv_id", pa.int64()), ("chunk", pa.int64()), ("leads", pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kind_of))

    return _in_order(slim).mapInArrow(run, "conv_id bigint, chunk bigint, leads array<int>")


def _shapes(costs: Costs, kinds: array, end: Vector) -> array:
    """The shape of the costs after each message."""
    shapes = array("i", bytes(4 * len(kinds)))
    shape = costs.number(end)
    for at in range(len(kinds) - 1, -1, -1):
        shapes[at] = shape
        shape = costs.step(shape, kinds[at])
    return shapes


EDITS = f"{POSITION} bigint, edits string, state int, cost bigint, illegal bigint"
LEGAL = {"su", "ua", "au"}


def _traced(slim: DataFrame, before: dict[int, tuple[int, str]], after: dict[int, Vector]) -> DataFrame:
    """(position, edits, state before them, cost, illegal pairs) of every message.

    The edits of a message start with what is inserted before it; the last message's end with what is
    inserted at the end. Its further copies are deleted, and illegal counts pairs that end in one of them.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = Costs()
        kind_of = pa.schema(
            [(POSITION, pa.int64()), ("edits", pa.string()), ("state", pa.int32()), ("cost", pa.int64()), ("illegal", pa.int64())]
        )
        for run_now in _chain_ends(_runs(batches)):
            (chunk, _, positions, kinds, copies), is_head, is_tail = run_now
            state, last = before.get(chunk, (START, "")) if is_head else (START, "")
            end = after.get(chunk) if is_tail else None
            shapes = _shapes(costs, kinds, end or END)
            names: list[str] = []
            states: list[int] = []
            prices: list[int] = []
            wrong: list[int] = []
            for kind, shape, times in zip(kinds, shapes, copies, strict=True):
                states.append(state)
                edits, state = costs.edit(shape, kind, state)
                edits += "D" * (times - 1)
                names.append(edits)
                prices.append(_price(edits, kind))
                initial = INITIAL_OF[kind // 3]
                wrong.append((times - 1) + bool(last and last + initial not in LEGAL))
                last = initial
            if end is None:
                names[-1] += closing(state)
                prices[-1] += INSERT * len(closing(state))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(positions, pa.int64()),
                    pa.array(names, pa.string()),
                    pa.array(states, pa.int32()),
                    pa.array(prices, pa.int64()),
                    pa.array(wrong, pa.int64()),
                ],
                schema=kind_of,
            )

    return _in_order(slim).mapInArrow(run, EDITS)


def _chain_ends(runs: Iterable[tuple]) -> Iterator[tuple[tuple, bool, bool]]:
    """Each run with whether it is the first and whether it is the last of its chunk."""
    held, first = None, True
    for run in runs:
        if held:
            other = held[0] != run[0]
            yield held, first, other
            first = other
        held = run
    if held:
        yield held, first, True


def _price(edits: str, kind: int) -> int:
    prices = {"D": REMOVE, "I": INSERT, "R": RELABEL, "K": 0}
    stays = "K" in edits or "R" in edits
    return sum(map(prices.__getitem__, edits)) + (CUT_SHORT if stays and kind % 3 == TRUNCATED else 0)


def repaired(conversations: DataFrame, store: StageStore, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Every message in order with its fault and its edits: (conv_id, turn, role, text, copies, fault,
    _position, edits, state, cost, illegal).

    `conversations` has conv_id, turn, role and text; other columns are not looked at. Messages follow
    their turn, null turns first, then role and a digest of the text where turns are equal. Equal
    messages of a turn are one row with `copies`; all but the first are deleted as duplicates. Null
    roles and texts read as one space, null conv_ids are one conversation. Roles count by their first
    letter: s, u, a, or none of the turns wanted. Texts are read whole. An empty table gives an empty result.
    """
    ordered = ordered_messages(conversations, store)
    slim = store.save(_slim(ordered, chunk_bits), "slim")
    edits = store.save(_traced(slim, *stitched(slim)), "edits")
    return ordered.drop("kind").join(edits, POSITION)


SUMMARY = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, repaired_sha256 string"
)


class _Conversation:
    """What adds up over the messages of one conversation."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.audit, self.hash, self.empty = conv, [], hashlib.sha256(), True
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.cost = self.turns = 0
        self.first = self.last = None

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: str | None, edits: str, state: int) -> None:
        if turn is not None:
            self.turns += turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn
        if fault:
            self.faults[fault] += 1
        # further copies of a blank message are blank, those of any other are duplicates
        self.faults["blank" if fault == "blank" else "duplicate"] += copies - 1
        self.audit.append(edits)
        for name, itself in edited(role, edits, state):
            if not self.empty:
                self.hash.update(b"\n")
            self.empty = False
            self.hash.update(f"{name}:".encode("utf-8", "replace"))
            if itself:
                self.hash.update(text.encode("utf-8", "replace"))

    def row(self) -> dict[str, object]:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return {
            "conv_id": self.conv,
            "gaps": gaps,
            **self.faults,
            "illegal": self.illegal,
            "cost": self.cost,
            "audit": "".join(self.audit),
            "repaired_sha256": self.hash.hexdigest(),
        }


def audits(messages: DataFrame) -> DataFrame:
    """One row per conversation of `repaired`: faults, cost, edits, and a digest of its repaired text.

    A digest reads a conversation in order, so its messages pass one task, as a sorted stream of which
    no more than a batch is held.
    """

    def gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(name, pa.string() if name in ("audit", "repaired_sha256") else pa.int64()) for name in _summary_names()]
        )
        now: _Conversation | None = None
        for batch in batches:
            done = []
            for conv, turn, role, text, copies, fault, edits, state, cost, illegal in zip(
                *(column.to_pylist() for column in batch.columns[:-1]), strict=True
            ):
                if now is None or now.conv != conv:
                    if now:
                        done.append(now.row())
                    now = _Conversation(conv)
                now.add(turn, role, text, copies, fault, edits, state)
                now.cost += cost
                now.illegal += illegal
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if now:
            yield pa.RecordBatch.from_pylist([now.row()], schema=schema)

    columns = ["conv_id", "turn", "role", "text", "copies", "fault", "edits", "state", "cost", "illegal", POSITION]
    streamed = messages.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", POSITION)
    return streamed.mapInArrow(gathered, SUMMARY)


def _summary_names() -> list[str]:
    return [part.split()[0] for part in SUMMARY.split(", ")]
