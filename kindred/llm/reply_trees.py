"""Chat formatting of reply trees: self-joins that double their reach each round enumerate the root-to-leaf
paths, branches are ranked by score, and each chosen path is formatted as one conversation.

A tree of depth d takes about log2(d) rounds, each an equi-join on node ids. A message whose parent is
missing or null is a root; a cycle raises an error. The template marks turns; control strings inside a text
or a role get a backslash, which reading takes out again. A conversation is written in parts of whole turns, a single
one unless it is long, so that no task holds more of it than a part. Null texts and roles count as empty; rows of equal
order are put in order by role and text, repeated rows are repeated turns; a null tree id is a tree of its
own; empty tables give empty results. Only the columns named are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Written, lean

# The template.
START, STOP, LOSS_ROLE = "<|im_start|>", "<|im_end|>\n", "assistant"


def escape_text(c):
    """'<' and '|' with any backslashes between take one more, so that no control string is left."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def escape_role(c):
    """As texts, and a line break becomes '<n|'."""
    return F.replace(F.regexp_replace(c, r"<(\\*)(n?)\|", r"<$1\\$2|"), F.lit("\n"), F.lit("<n|"))


def unescape_text(s: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", s)


def unescape_role(s: str) -> str:
    return re.sub(r"<\\(\\*)(n?)\|", r"<\1\2|", s.replace("<n|", "\n"))


def chain(messages: DataFrame, tree: str, order: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Messages without parents as trees, each row replying to the one before it in ``order``: (tree, node, parent, score) and
    (tree, node, role, text). An answer scores 1. Rows are dealt out by ranges of (tree, order), so that a conversation
    of most rows is many tasks' work; only the first row of each of its ranges looks for its parent elsewhere."""
    clean = messages.select(
        F.coalesce(F.col(tree).cast("string"), F.lit("")).alias("tree"),
        F.col(order).alias("at"),
        F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"),
    )
    dealt = clean.repartitionByRange("tree", "at").sortWithinPartitions("tree", "at", "role", "text")
    rows = Written(dealt.select("tree", F.monotonically_increasing_id().alias("node"), "role", "text")).df
    nodes = rows.select("tree", "node", (F.col("role") == LOSS_ROLE).cast("double").alias("score"))
    ranges = nodes.groupBy("tree", F.shiftright("node", 33).alias("range")).agg(F.min("node").alias("node"), F.max("node").alias("last"))
    firsts = ranges.select("tree", "node", F.lit(True).alias("first"), F.lag("last").over(Window.partitionBy("tree").orderBy("range")).alias("before"))
    parent = F.when(F.col("first"), F.col("before")).otherwise(F.col("node") - 1)
    linked = nodes.join(firsts, ["tree", "node"], "left").select("tree", "node", parent.alias("parent"), "score")
    return Written(linked).df, rows


def branches(messages: DataFrame, top: int | None = None) -> DataFrame:
    """Root-to-leaf paths of messages (tree, node, parent, score): (tree, leaf, node, place), place from 0 at the root.
    With ``top``, only so many paths of each tree: those of the highest sum of scores, ties to the smaller leaf."""
    made: list[Written] = []

    def keep(df: DataFrame) -> DataFrame:
        made.append(Written(df))
        return made[-1].df

    nodes = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    state = keep(nodes.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("depth"), "score"))
    most, jumps = math.ceil(math.log2(max(2, state.count()))) + 1, []
    first, finished, open_ = state, [state.filter("up is null")], state.filter("up is not null")
    while not open_.isEmpty():
        if len(jumps) > most:
            raise ValueError("the replies form a cycle")
        jumps.append(open_.select("tree", "node", "up"))
        state = reduce(DataFrame.unionByName, [*finished, open_])
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("score").alias("score2"))
        further = open_.join(above, ["tree", "up"])  # messages that have come to their root take no further part
        reached = keep(further.select("tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("score") + F.col("score2")).alias("score")))
        finished.append(reached.filter("up is null"))
        open_ = reached.filter("up is not null")
    state = reduce(DataFrame.unionByName, finished)
    parents = first.filter("up is not null").select("tree", F.col("up").alias("node"))
    leaves = state.join(parents, ["tree", "node"], "left_anti").select("tree", "node", "depth", "score")
    if top is not None:
        best = Window.partitionBy("tree").orderBy(F.desc("score"), "node")
        leaves = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    members = [keep(leaves.select("tree", F.col("node").alias("leaf"), "node", (F.col("depth") - 1).alias("place")))]
    for k, jump in enumerate(jumps):  # after k rounds every ancestor less than 2^k above is there, once
        below = reduce(DataFrame.unionByName, members)
        members.append(keep(below.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("place") - (1 << k)).alias("place"))))
    return reduce(DataFrame.unionByName, members)


def segments(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """The formatted conversations, a row for each turn: (tree, leaf, place, segment, loss, content_start, content_chars).
    A conversation is its segments in order, joined; ``loss`` marks those whose content is under the loss mask."""
    role, text = escape_role(F.col("role")), escape_text(F.col("text"))
    own = messages.select("tree", "node", role.alias("r"), text.alias("t"), (F.col("role") == LOSS_ROLE).alias("loss"))
    return paths.join(own, ["tree", "node"]).select(
        "tree", "leaf", "place",
        F.concat(F.lit(START), "r", F.lit("\n"), "t", F.lit(STOP)).alias("segment"),
        "loss",
        (F.length("r") + len(START) + 1).cast("long").alias("content_start"),
        F.length("t").cast("long").alias("content_chars"),
    )


#: Code points after which a conversation's next turn begins a new part.
PART = 1 << 20
JOINED = "tree string, leaf long, part int, start long, text string, mask array<struct<start:long,end:long>>"


def joined(parts: DataFrame, part_chars: int = PART) -> DataFrame:
    """The conversations of ``parts`` (from :func:`segments`): (tree, leaf, part, start, text, mask), a row for each
    conversation, or for each ``part_chars`` of a long one. A part has whole turns and begins at ``start`` of its
    conversation; mask has [start, end) there of the texts under the loss mask. Rows come in order."""
    mask_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), mask_type]
    names = [c.split()[0] for c in JOINED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, start, at, texts, mask = None, 0, 0, 0, [], []
        for b in batches:
            out = []
            for row in b.to_pylist():
                fresh = (row["tree"], row["leaf"]) != key
                if texts and (fresh or at - start >= part_chars):
                    out.append((*key, part, start, "".join(texts), mask))
                    part, start, texts, mask = part + 1, at, [], []
                if fresh:
                    key, part, start, at = (row["tree"], row["leaf"]), 0, 0, 0
                if row["loss"]:
                    first = at + row["content_start"]
                    mask.append({"start": first, "end": first + row["content_chars"]})
                texts.append(row["segment"])
                at += len(row["segment"])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        if texts:
            last = (*key, part, start, "".join(texts), mask)
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(last, types)], names)

    slim = parts.select("tree", "leaf", "place", "segment", "loss", "content_start", "content_chars")
    return slim.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "place").mapInArrow(lean(run), JOINED)


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(STOP), re.DOTALL)


def parse(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn starts at {at}")
        turns.append((unescape_role(m[1]), unescape_text(m[2])))
        at = m.end()
    return turns


DIGEST = "tree string, leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(conversations: DataFrame, in_order: bool = False) -> DataFrame:
    """Each conversation (of :func:`joined`) read back: its turns by the template, and the texts under the loss mask by its
    places. A task holds one part and the states of two digests, however long a conversation is. ``in_order`` says
    that rows come as :func:`joined` yields them; others, as from files, are put in order first."""
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in DIGEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, turns, loss_chars, loss, chars = None, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
        for b in batches:
            out = []
            for row in b.to_pylist():
                if (row["tree"], row["leaf"]) != key:
                    if key is not None:
                        out.append((*key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    key, n, turns, loss_chars, loss, chars = (row["tree"], row["leaf"]), 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                chars += len(row["text"])
                for role, text in parse(row["text"]):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                for span in row["mask"]:
                    own = unescape_text(row["text"][span["start"] - row["start"] : span["end"] - row["start"]])
                    loss_chars += len(own)
                    loss.update(own.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        if key is not None:
            last = (*key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(last, types)], names)

    rows = conversations if in_order else conversations.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "part")
    return rows.select("tree", "leaf", "start", "text", "mask").mapInArrow(lean(run), DIGEST)
