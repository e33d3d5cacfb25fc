"""Operator 3, chat formatting: reply trees, root-to-leaf paths by self-joins, one conversation per chosen path."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rowharvest.llm.common import stored

# The template, and strings that steer models and must not come out of a text.
TURN, END = "<|turn|>", "<|end|>"
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\\"

_CONTROL = re.compile("|".join(re.escape(c) for c in (ESCAPE, *CONTROL)))
_ROLE = re.compile("|".join(re.escape(c) for c in (ESCAPE, "\n", *CONTROL)))


def _broken(match: re.Match) -> str:
    found = match.group()
    return ESCAPE + found if found in (ESCAPE, "\n") else found[0] + ESCAPE + found[1:]


def escape(text: str, pattern: re.Pattern = _CONTROL) -> str:
    """Double each escape sign and put one behind the first character of each control string.

    The result holds no control string, and ``unescape`` gives the text back. Control strings hold
    no escape sign, and no two of them overlap in a way that leaves one whole.
    """
    return pattern.sub(_broken, text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turns(turns: list[tuple[str, str]], learn_from: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """(formatted conversation, spans of the loss mask): each turn is its mark, role, line feed, text, end mark."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = TURN + escape(role, _ROLE) + "\n"
        body = escape(text)
        if role == learn_from:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        head = re.match(r"(?:[^\\\n]|\\.)*", part, flags=re.S).group()
        turns.append((unescape(head), unescape(part[len(head) + 1:-len(END)])))
    return turns


def read_mask(formatted: str, spans: list[tuple[int, int]]) -> str:
    """All text under the loss mask, unescaped."""
    return "".join(unescape(formatted[a:b]) for a, b in spans)


def reply_paths(messages: DataFrame, *, key: str = "conv_id", id_col: str = "id", parent_col: str = "parent", score: Column | None = None,
                best: int | None = 1) -> DataFrame:
    """(key, leaf, branch, score, place, id): the messages of the ``best`` root-to-leaf paths of each tree (None: of all).

    Pointers are doubled: after k rounds every message knows its ancestor 2**k replies up and the score of
    the path between, so a thread of n replies takes log2(n) self-joins. Then leaves walk up by the same tables, the
    longest jumps first: each jump cuts every open segment of a path in two, until a segment is one message.
    A row per message and path goes through the joins, never a whole path. branch is 1 for the path with the
    highest score (the sum over its messages; the least leaf id if equal). A message whose parent is missing is a
    root; messages in a circle, or in reply to one, belong to no path. Null keys or ids are left out; repeated ids count once.
    """
    nodes = messages.select(F.col(key).alias("key"), F.col(id_col).alias("id"), F.col(parent_col).alias("parent"),
                            (F.lit(0.0) if score is None else score.cast("double")).alias("own")).where("key is not null and id is not null")
    nodes = nodes.groupBy("key", "id").agg(F.min("parent").alias("parent"), F.max(F.coalesce("own", F.lit(0.0))).alias("own"))
    known = nodes.select("key", F.col("id").alias("parent"))
    up = nodes.join(known, ["key", "parent"], "left_semi").select("key", "id", F.col("parent").alias("up"))
    leaves = stored(nodes.join(up.select("key", F.col("up").alias("id")).distinct(), ["key", "id"], "left_anti"), "leaves")
    tables, n = [stored(up, "ancestors")], nodes.count()
    while 2 ** (len(tables) - 1) < n:  # tables[k]: the ancestor 2**k replies up
        far = tables[-1].select("key", F.col("id").alias("up"), F.col("up").alias("top"))
        longer = stored(tables[-1].join(far, ["key", "up"]).select("key", "id", F.col("top").alias("up")), "ancestors")
        if longer.isEmpty():
            break
        tables.append(longer)
    else:  # more replies up than there are messages: in a circle, or below one
        leaves = leaves.join(tables.pop().select("key", "id"), ["key", "id"], "left_anti")
    walk = leaves.select("key", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("height"))
    for k in range(len(tables) - 1, -1, -1):
        jump = walk.join(tables[k], ["key", "id"]).select("key", "leaf", F.col("up").alias("id"), (F.col("height") + 2 ** k).alias("height"))
        walk = stored(walk.unionAll(jump), "paths")  # else every round would compute all rounds before it twice
    scored = walk.join(nodes.select("key", "id", "own"), ["key", "id"]).groupBy("key", "leaf").agg(
        F.sum("own").alias("score"), F.max("height").alias("top"))
    if best == 1:  # needs no sorting of a tree's leaves
        first = scored.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("cost"), "leaf")).alias("x")).select("key", F.col("x.leaf").alias("leaf"))
        ranked = scored.join(first, ["key", "leaf"], "left_semi").withColumn("branch", F.lit(1).cast("long"))
    else:
        rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "leaf")).cast("long")
        ranked = scored.withColumn("branch", rank).where(F.lit(True) if best is None else F.col("branch") <= best)
    return walk.join(ranked, ["key", "leaf"]).select(F.col("key").alias(key), "leaf", "branch", "score", (F.col("top") - F.col("height")).alias("place"), "id")


def turn_messages(table: DataFrame, *, key: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(key, id, parent, role, text) of plain conversations: every turn replies to the one before.

    Rows are numbered in one order over the whole table (key, turn, then role and text for equal turns), cut into
    ranges, so that a conversation of any length is spread over tasks. A parent that is another conversation's
    last row is not found there, which makes the message a root. Rows without a key are left out; a null role or text is empty.
    """
    spark = table.sparkSession
    rows = table.select(F.col(key).alias("key"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("key is not null").withColumn("tie", F.xxhash64("role", "text"))
    order = ["key", "turn", "role", "tie", "text"]
    placed = rows.repartitionByRange(*order[:-1]).sortWithinPartitions(*order)
    placed = stored(placed.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()).withColumn(
        "place", F.col("place").bitwiseAND(F.lit((1 << 33) - 1))), "turns")
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row per partition
    before, at = [], 0
    for part, n in sizes:
        before.append((part, at))
        at += n
    shifts = spark.createDataFrame(before, "part int, before long")
    number = F.col("place") + F.col("before")
    return placed.join(F.broadcast(shifts), "part").select(F.col("key").alias(key), number.alias("id"), (number - 1).alias("parent"), "role", "text")


def format_conversations(messages: DataFrame, *, key: str = "conv_id", score: Column | None = None, best: int | None = 1,
                         learn_from: str = "assistant") -> DataFrame:
    """(key, leaf, branch, formatted, mask): one formatted conversation for each chosen path of (key, id, parent, role, text).

    mask has the (start, end) code points of the turns to learn from. Texts and roles come out escaped, so the
    template's own marks are the only control strings; ``read_turns`` and ``read_mask`` read them back. A whole
    conversation is one row, as the output asks. An empty table gives an empty result; other columns are ignored.
    """
    messages = stored(messages.select(key, "id", "parent", "role", "text", (F.lit(0.0) if score is None else score.cast("double")).alias("own")), "messages")
    paths = reply_paths(messages, key=key, score=F.col("own"), best=best)
    texts = messages.groupBy(key, "id").agg(F.min(F.struct("role", "text")).alias("turn"))
    whole = paths.join(texts, [key, "id"]).groupBy(key, "leaf", "branch").agg(F.sort_array(F.collect_list(F.struct("place", "turn"))).alias("turns"))
    kind = dict(messages.dtypes)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turns([(t["turn"]["role"] or "", t["turn"]["text"] or "") for t in turns.as_py()], learn_from) for turns in batch.column("turns")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("leaf"), batch.column("branch"), pa.array([m[0] for m in made], pa.string()),
                 pa.array([[{"start": a, "end": b} for a, b in m[1]] for m in made], span)], names=[key, "leaf", "branch", "formatted", "mask"])

    return whole.mapInArrow(run, f"{key} {kind[key]}, leaf {kind['id']}, branch long, formatted string, mask array<struct<start:long,end:long>>")
