"""Conversations from reply trees, in a template that can be read back.

Messages point to the message that they answer.  Self-joins that double the
distance of each step give every message's depth and summed score in a few
rounds; the leaves, one for each root-to-leaf path, are ranked by mean score;
the same steps, from the longest to the shortest, then list the messages of each
chosen path exactly once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

BEGIN = "<s>"
OPEN = {"system": "<<SYS>>", "user": "[INST]", "assistant": "[ASST]"}
CLOSE = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
OTHER, NAMED, ENDED = "<<ROLE>>", "<</ROLE>>", "<</TURN>>"
_CONTROL = re.compile("|".join(map(re.escape, ["\\", BEGIN, OTHER, NAMED, ENDED, *OPEN.values(), *CLOSE.values()])))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Breaks each control string by a backslash after its first character, and doubles backslashes."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, spans of the assistant's texts in its code points)."""
    parts, spans, at = [BEGIN], [], len(BEGIN)
    for role, text in turns:
        head = OPEN.get(role) or f"{OTHER}{escape(role)}{NAMED}"
        body = escape(text)
        start = at + len(head) + 1
        piece = f"{head} {body} {CLOSE.get(role, ENDED)}"
        if role == "assistant":
            spans.append((start, start + len(body)))
        parts.append(piece)
        at += len(piece)
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns that ``format_turns`` took."""
    if not formatted.startswith(BEGIN):
        raise ValueError("no begin mark")
    at, turns = len(BEGIN), []
    while at < len(formatted):
        role = next((r for r, mark in OPEN.items() if formatted.startswith(mark, at)), None)
        if role is not None:
            at += len(OPEN[role]) + 1
            close = CLOSE[role]
        else:
            if not formatted.startswith(OTHER, at):
                raise ValueError(f"no turn begins at {at}")
            end = formatted.index(NAMED, at)
            role, at, close = unescape(formatted[at + len(OTHER) : end]), end + len(NAMED) + 1, ENDED
        end = formatted.index(close, at)
        turns.append((role, unescape(formatted[at : end - 1])))
        at = end + len(close)
    return turns


def _steps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (tree, id, up) of steps of 1, 2, 4, ... messages, and (tree, id, up, size, total).

    ``up`` is the message a step above.  The second table counts and sums the
    messages from each one to its root; ``up`` stays set only where a circle of
    parents never ends.  Only messages that aren't at their root take part in
    the next round.
    """
    present = nodes.select(F.col("tree").alias("t"), F.col("id").alias("i"))
    first = nodes.join(present, nodes.tree.eqNullSafe(F.col("t")) & (nodes.parent == F.col("i")), "left")
    state = written(first.select("tree", "id", F.col("i").alias("up"), F.lit(1).cast("long").alias("size"), F.col("score").alias("total")), "steps")
    steps, limit = [], nodes.count().bit_length() + 1
    while len(steps) <= limit and state.where("up is not null").limit(1).count():
        low = state.where("up is not null")
        steps.append(low.select("tree", "id", "up"))
        high = state.select(F.col("tree").alias("t"), F.col("id").alias("i"), F.col("up").alias("further"), F.col("size").alias("more"), F.col("total").alias("extra"))
        joined = low.join(high, low.tree.eqNullSafe(F.col("t")) & (low.up == F.col("i")))
        moved = joined.select("tree", "id", F.col("further").alias("up"), (F.col("size") + F.col("more")).alias("size"), (F.col("total") + F.col("extra")).alias("total"))
        state = written(state.where("up is null").union(moved), "steps")
    return steps, state


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, rank, depth, id) for the messages of each tree's best paths.

    ``messages`` has tree, id, parent, score.  Paths rank by mean score, then by
    length, then by the smaller leaf.  A parent that is missing makes a root; a
    message on or below a circle of parents has no path; a null score counts 0.
    """
    nodes = messages.select("tree", "id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    steps, state = _steps(nodes)
    inner = nodes.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("i")).distinct()
    done = state.where("up is null")
    leaves = done.join(inner, done.tree.eqNullSafe(F.col("t")) & (done.id == F.col("i")), "left_anti")
    worth = F.struct((F.col("total") / F.col("size")).alias("mean"), F.col("size"), (-F.col("id")).alias("first"))
    if branches == 1:
        best = leaves.groupBy("tree").agg(F.max(worth).alias("w")).select("tree", (-F.col("w.first")).alias("leaf"), F.lit(1).alias("rank"), F.col("w.size").alias("size"))
    else:
        place = F.row_number().over(Window.partitionBy("tree").orderBy(worth.desc()))
        best = leaves.select("tree", F.col("id").alias("leaf"), place.alias("rank"), "size").where(F.col("rank") <= branches)
    path = best.select("tree", "leaf", "rank", F.col("size").alias("depth"), F.col("leaf").alias("id"))
    for k in range(len(steps) - 1, -1, -1):
        jump = steps[k].select(F.col("tree").alias("t"), F.col("id").alias("i"), "up")
        above = path.join(jump, path.tree.eqNullSafe(F.col("t")) & (path.id == F.col("i")))
        path = written(path.union(above.select("tree", "leaf", "rank", F.col("depth") - (1 << k), F.col("up"))), "path")
    return path


def linear_messages(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages of conversations that have one reply each: every turn answers the one before.

    Rows that repeat a turn follow each other by role and text; null turns come
    first; null roles and texts are empty.
    """
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("tree"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    id_ = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    rows = rows.select("tree", id_.alias("id"), "role", "text")
    return rows.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _formatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, starts, ends = [], [], []
        for turns in batch.column("turns"):
            text, spans = format_turns([(t["role"], t["text"]) for t in turns.as_py()])
            texts.append(text)
            starts.append([s for s, _ in spans])
            ends.append([e for _, e in spans])
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("tree", "leaf", "rank")), pa.array(texts, pa.string()), pa.array(starts, longs), pa.array(ends, longs)],
            names=["tree", "leaf", "rank", "formatted", "loss_starts", "loss_ends"],
        )


def format_trees(messages: DataFrame, branches: int = 1, unique: bool = False) -> DataFrame:
    """(tree, leaf, rank, formatted, loss_starts, loss_ends), one row for each chosen path.

    ``messages`` has tree, id, parent, role, text, score.  Of messages that repeat
    an id within a tree the smallest by parent, role, text and score stands for
    all; ``unique`` says that there are none.  Null roles and texts are empty, and
    messages without an id are in no path.  The loss mask is the assistant's
    texts, as spans of code points.
    """
    said = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    messages = messages.where("id is not null").select("tree", "id", "parent", *said, "score")
    if not unique:
        one = messages.groupBy("tree", "id").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m"))
        messages = one.select("tree", "id", "m.*")
    messages = written(messages, "messages")
    path = chosen_paths(messages, branches)
    text = messages.select(F.col("tree").alias("t"), F.col("id").alias("i"), "role", "text")
    rows = path.join(text, path.tree.eqNullSafe(F.col("t")) & (path.id == F.col("i")))
    turns = F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns")
    grouped = rows.groupBy("tree", "leaf", "rank").agg(turns)
    return grouped.mapInArrow(_formatter, "tree long, leaf long, rank int, formatted string, loss_starts array<long>, loss_ends array<long>")
