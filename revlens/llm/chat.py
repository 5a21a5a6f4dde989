"""Reply trees: picks the best branch of every tree of messages and formats it as one conversation.

Parents are followed by self-joins that double their reach each round, so a tree of depth d takes
log2(d) rounds. They give every message its root, its depth and the sum of scores on its path; branches
are ranked by mean score, and the reach tables lead from the chosen leaf back over all of its ancestors.

The template marks turns as `<|im_start|>role`, a line end, the text and `<|im_end|>` with a line end.
Control strings inside roles and texts are broken by a backslash after their first character, and
backslashes are doubled, so that the text of a turn can be read back exactly and never holds a mark.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.sources.stages import StageStore

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
# fixed values: strings that chat templates use as marks
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_TURN = re.compile(r"<\|im_start\|>((?:\\.|[^\\\n])*)\n((?:\\.|[^\\])*?)<\|im_end\|>\n", re.DOTALL)
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escape(text: Column) -> Column:
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROLS:
        escaped = F.replace(escaped, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return escaped


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def read_back(formatted: str) -> list[tuple[str, str, int]]:
    """(role, text, where the escaped text starts) of every turn of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2)) for m in _TURN.finditer(formatted)]


def _finished(reach: list[DataFrame]) -> DataFrame:
    """The messages that have reached their root in any round; each is in one of them."""
    return reduce(DataFrame.unionByName, [found.where("up is null") for found in reach])


def best_branches(messages: DataFrame, store: StageStore, branches: int = 1) -> DataFrame:
    """(tree, branch, depth, id) of the messages on the best root-to-leaf paths of each tree.

    `messages` has tree, id, parent and score; (tree, id) names a message and a message without a parent
    in its tree is a root. Branches rank by mean score, then by the least leaf; several roots of one
    tree compete. A null score counts as 0. Rows of a cycle have no root and are left out.
    """
    nodes = store.save(
        messages.select("tree", "id", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")),
        "nodes",
    )
    ids = nodes.select(F.col("tree").alias("t"), F.col("id").alias("i"))
    known = nodes.join(
        ids, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("i")), "left"
    ).select("tree", "id", F.col("i").alias("up"), "score")
    # what is summed so far covers `hops` messages, from the message itself up to just below `up`
    reach = [store.save(known.withColumn("hops", F.lit(1).cast("bigint")), "reach_0")]
    total = nodes.count()
    while (1 << len(reach)) <= 2 * max(total, 1):
        # what has reached its root stays as it is and leaves the rounds, so one deep tree costs its own rows
        active = reach[-1].where("up is not null")
        if active.isEmpty():
            break
        above = active.unionByName(_finished(reach)).select(
            F.col("tree").alias("t"),
            F.col("id").alias("i"),
            F.col("up").alias("further"),
            F.col("score").alias("s"),
            F.col("hops").alias("h"),
        )
        step = active.join(
            above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("i")), "left"
        ).select(
            "tree",
            "id",
            F.col("further").alias("up"),
            (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"),
            (F.col("hops") + F.coalesce("h", F.lit(0))).alias("hops"),
        )
        reach.append(store.save(step, f"reach_{len(reach)}"))
    rooted = _finished(reach)
    parents = reach[0].where("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("p")).distinct()
    leaves = rooted.join(
        parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("p")), "left_anti"
    )
    ranking = Window.partitionBy("tree").orderBy((F.col("score") / F.col("hops")).desc(), "id")
    chosen = leaves.withColumn("branch", F.row_number().over(ranking)).where(F.col("branch") <= branches)
    path = chosen.select("tree", "branch", "id", F.col("hops").alias("depth"))
    for level, jumps in reversed(list(enumerate(reach[:-1]))):
        jump = jumps.where("up is not null").select(F.col("tree").alias("t"), F.col("id").alias("i"), "up")
        further = path.join(
            jump, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i"))
        ).select("tree", "branch", F.col("up").alias("id"), (F.col("depth") - F.lit(1 << level)).alias("depth"))
        path = store.save(path.union(further), f"path_{level}")
    return path


def format_turns(turns: DataFrame, *keys: str) -> DataFrame:
    """One row per conversation: its keys, formatted, and loss_spans, the code points of assistant text.

    `turns` has the keys, depth, role and text; null roles and texts read as empty.
    """
    said = turns.select(
        *keys,
        F.struct(
            "depth",
            F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\\n")).alias("role"),
            escape(F.coalesce("text", F.lit(""))).alias("text"),
            (F.coalesce("role", F.lit("")) == ASSISTANT).alias("learned"),
        ).alias("turn"),
    )
    gathered = said.groupBy(*keys).agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    piece = F.transform(
        "turns",
        lambda turn: F.struct(
            F.concat(F.lit(OPEN), turn["role"], F.lit("\n")).alias("head"),
            turn["text"].alias("text"),
            F.length(turn["text"]).alias("size"),
            turn["learned"].alias("learned"),
        ),
    )
    tail = f"{CLOSE}\n"
    gathered = gathered.withColumn("pieces", piece)
    written = F.array_join(
        F.transform("pieces", lambda part: F.concat(part["head"], part["text"], F.lit(tail))), ""
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    spans = F.aggregate(
        "pieces",
        start,
        lambda seen, part: F.struct(
            (seen["at"] + F.length(part["head"]) + part["size"] + F.lit(len(tail))).alias("at"),
            F.when(
                part["learned"],
                F.array_append(
                    seen["spans"],
                    F.struct(
                        (seen["at"] + F.length(part["head"])).alias("start"),
                        (seen["at"] + F.length(part["head"]) + part["size"]).alias("end"),
                    ),
                ),
            )
            .otherwise(seen["spans"])
            .alias("spans"),
        ),
    )["spans"]
    return gathered.select(*keys, written.alias("formatted"), spans.alias("loss_spans"))


def _once(messages: DataFrame) -> DataFrame:
    """Each (tree, id) once; texts are only shuffled for it where one is there again."""
    named = messages.where("id is not null").select("tree", "id", "role", "text", "parent", "score")
    if named.groupBy("tree", "id").count().where("count > 1").isEmpty():
        return named
    least = named.groupBy("tree", "id").agg(F.min(F.struct("role", "text", "parent", "score")).alias("said"))
    return least.select("tree", "id", "said.*")


def format_trees(messages: DataFrame, store: StageStore, branches: int = 1) -> DataFrame:
    """(tree, branch, formatted, loss_spans): the best branches of every tree as conversations.

    `messages` has tree, id, parent, role, text and score; other columns are not looked at. Rows that
    repeat a (tree, id) are one message, the least of them by role, text, parent and score, nulls first.
    A null tree is a tree like any other, a message without id takes no part. Branches that tie rank by
    the least leaf. Texts are formatted whole, null and empty ones as empty turns. An empty table gives
    an empty result.
    """
    messages = _once(messages)
    path = best_branches(messages, store, branches)
    named = messages.select(F.col("tree").alias("t"), F.col("id").alias("i"), "role", "text")
    turns = path.join(named, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i")))
    return format_turns(turns.select("tree", "branch", "depth", "role", "text"), "tree", "branch")


def as_trees(conversations: DataFrame) -> DataFrame:
    """Linear conversations as trees: every turn answers the one before it.

    Turns that share a number, repeated rows included, follow each other by role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.withColumn("_at", F.row_number().over(order).cast("bigint"))
    return numbered.select(
        F.col("conv_id").alias("tree"),
        F.col("_at").alias("id"),
        F.when(F.col("_at") > 1, F.col("_at") - F.lit(1)).alias("parent"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )
