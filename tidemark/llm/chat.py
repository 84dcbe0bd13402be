"""Reply trees to conversations: root-to-leaf paths, ranked, formatted (operator 6).

Messages point to the message they answer.  Paths are enumerated by self-joins
that double their reach each time: after k joins every leaf knows its 2**k nearest
ancestors, so a thread of n turns takes about log2(n) joins and every (leaf,
ancestor) pair is made once.  Branches are ranked by the sum of their messages'
scores and the best ones are formatted, one conversation per path.

The template marks each turn with control strings.  Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|``, so nothing in a text can look like
a control string, and reading back restores every text exactly.

Null texts and roles are empty, null scores 0.  Messages whose parent is missing
start a path.  Messages of a null conv_id form one conversation.  Rows that repeat
a (conv_id, msg_id) are refused, as a reply tree would be ambiguous; in turn order
(:func:`by_turn`) repeated rows are turns of their own, ordered by turn, role and
text with nulls first.  An empty table gives no conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import save

START, END = "<|im_start|>", "<|im_end|>"
#: Doublings; a reply chain longer than 2**40 must be a cycle.
MAX_DOUBLINGS = 40
_TURN = re.compile(re.escape(START) + r"(.*)\n([\s\S]*?)" + re.escape(END) + r"\n")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|n])", lambda m: "\n" if m[1] == "n" else m[1], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted conversation and its loss mask: spans of the assistant's texts."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns again."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def by_turn(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a reply chain, each turn answering the one before."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = rows.select("conv_id", F.row_number().over(order).cast("long").alias("msg_id"), "role", "text")
    return rows.select("conv_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def paths(messages: DataFrame) -> DataFrame:
    """(c, leaf, m, dist): every message of every root-to-leaf path; c is a never-null key of conv_id."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("\0"))
    nodes = messages.select(key.alias("c"), F.col("msg_id").alias("m"), F.col("parent_id").alias("up"))
    known = nodes.select("c", F.col("m").alias("up"))
    jump = save(nodes.where("up is not null").join(known, ["c", "up"], "left_semi"), "jump")
    leaves = nodes.join(jump.select("c", F.col("up").alias("m")).distinct(), ["c", "m"], "left_anti")
    found = [save(leaves.select("c", F.col("m").alias("leaf"), "m", F.lit(0).cast("long").alias("dist")), "paths")]
    for k in range(MAX_DOUBLINGS):
        if jump.isEmpty():
            return _all(found)
        far = _all(found).join(jump, ["c", "m"]).select("c", "leaf", F.col("up").alias("m"), (F.col("dist") + (1 << k)).alias("dist"))
        found.append(save(far, "paths"))
        again = jump.select("c", F.col("m").alias("up"), F.col("up").alias("top"))
        jump = save(jump.join(again, ["c", "up"]).select("c", "m", F.col("top").alias("up")), "jump")
    raise ValueError("the replies form a cycle")


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        done = [render([(x["role"] or "", x["text"] or "") for x in turns]) for turns in batch.column("turns").to_pylist()]
        masks = [[{"start": a, "end": b} for a, b in mask] for _, mask in done]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "leaf_id", "branch", "score")), pa.array([f for f, _ in done], pa.string()), pa.array(masks, span)], names=["conv_id", "leaf_id", "branch", "score", "formatted", "loss_mask"])


def conversations(messages: DataFrame, best: int = 1) -> DataFrame:
    """The ``best`` branches of each tree: conv_id, leaf_id, branch (1 is best), score, formatted, loss_mask.

    ``messages`` has conv_id, msg_id, parent_id, role, text and score.  The mask holds
    spans of code points in ``formatted``; equal scores rank the smaller leaf first.
    """
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("\0"))
    found = paths(messages)
    texts = messages.select(key.alias("c"), F.col("msg_id").alias("m"), "conv_id", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score"))
    scored = found.join(texts.select("c", "m", "score"), ["c", "m"]).groupBy("c", "leaf").agg(F.sum("score").alias("total"))
    rank = F.row_number().over(Window.partitionBy("c").orderBy(F.col("total").desc(), "leaf"))
    chosen = scored.withColumn("branch", rank).where(F.col("branch") <= best)
    rows = found.join(chosen, ["c", "leaf"]).join(texts.drop("score"), ["c", "m"])
    turns = F.sort_array(F.collect_list(F.struct(-F.col("dist"), "role", "text")))
    rows = rows.groupBy("c", "leaf", "branch", "total").agg(F.first("conv_id").alias("conv_id"), turns.alias("turns"))
    rows = rows.select("conv_id", F.col("leaf").alias("leaf_id"), "branch", F.col("total").alias("score"), "turns")
    kind = messages.schema
    return rows.mapInArrow(_format, f"conv_id {kind['conv_id'].dataType.simpleString()}, leaf_id {kind['msg_id'].dataType.simpleString()}, branch int, score double, formatted string, loss_mask array<struct<start:long,end:long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests read from the formatted conversations and their masks."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, mask in zip(batch.column("formatted").to_pylist(), batch.column("loss_mask").to_pylist()):
                turns = parse(text)
                loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                every = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss_mask").mapInArrow(digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
