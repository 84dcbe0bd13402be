"""Merkle manifest of a table with proofs by checkpoint and recompute (operator 11).

Leaves are digests of rows.  Per group they stand in order; each run of two
successive nodes (one at an odd end) is digested into a node of the next level until
one is left, the group's subroot.  Subroots, ordered by group, form a tree alike.

1. Leaves are written once, then sorted by range, so that a large group is spread over
   many tasks; counts per task and group turn positions into ranks.
2. Only levels 0, ``STEP``, 2 ``STEP``, ... are written.  Nodes are grouped into
   aligned subtrees of 2 ** STEP, whatever the sizes of the groups, and a subtree's
   top is folded from its array: no task holds more than a subtree.
3. Proofs go down from the top.  The missing levels of an aligned subtree are made
   again from its written nodes, every node's siblings are emitted and the rest is
   dropped; the path above comes by a join of subtrees, 2 ** STEP times fewer than nodes.

Only DataFrame functions run.  Null and empty texts differ (``-`` and ``0:``).  Rows
of one group and key stand by their leaves; fully repeated rows are leaves of their own, and
as they are equal any order of them gives the same tree.  Null keys come first.  An
empty table has no root and gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import save

#: Levels between two written ones.
STEP = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(*fields: Column) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, a colon and itself, null as a dash."""
    parts = []
    for f in fields:
        text = f.cast("string")
        parts += [F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))]
    return F.sha2(F.concat(*parts), 256)


def ranked(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``r``, the rank from 0 within ``group`` by ``order``, and ``size``, the group's rows.

    A sort by range: a group may span many tasks and a task many groups.
    """
    by = [F.col(c).asc_nulls_first() for c in (group, *order, "tie")]
    placed = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = placed.drop("tie").withColumn("at", F.monotonically_increasing_id())
    placed = save(placed.withColumn("task", F.shiftright("at", 33)), label)
    # as many rows as there are tasks and groups
    shares = placed.groupBy(group, "task").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    each = Window.partitionBy(group)
    before = F.coalesce(F.sum("n").over(each.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = shares.select(F.col(group).alias("g2"), F.col("task").alias("task2"), (before - F.col("first")).alias("shift"), F.sum("n").over(each).alias("size"))
    same = F.col(group).eqNullSafe(F.col("g2")) & (F.col("task") == F.col("task2"))
    return placed.join(shares, same).withColumn("r", F.col("at") + F.col("shift")).drop("at", "task", "g2", "task2", "shift")


def height(size: Column) -> Column:
    """Levels above the leaves of a group: the bits of size - 1."""
    return F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0).cast("int")


def _levels() -> Column:
    """All levels of a subtree from its nodes on, ``up`` of them above these."""
    return F.expr(f"""aggregate(slice(sequence(1, {STEP}), 1, up), cast(array(members.h) as array<array<string>>), (levels, k) -> concat(levels, array(
    transform(sequence(0, cast((size(element_at(levels, -1)) - 1) div 2 as int)),
              i -> sha2(concat(element_at(levels, -1)[2 * i], coalesce(get(element_at(levels, -1), 2 * i + 1), '')), 256)))))""")


def _blocks(nodes: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Written nodes of a level as aligned subtrees: g, size, block, members (r, h and ``extra``, by r)."""
    block = nodes.groupBy("g", "size", F.shiftright("r", STEP).alias("block"))
    return save(block.agg(F.sort_array(F.collect_list(F.struct("r", "h", *extra))).alias("members")), "nodes")


def _made_again(blocks: DataFrame, level: int) -> DataFrame:
    """``blocks`` of a level with ``up``, the levels that they have above it, and ``levels``, all their nodes."""
    up = F.greatest(F.lit(0), F.least(F.lit(STEP), height(F.col("size")) - level))
    return blocks.withColumn("up", up).withColumn("levels", _levels())


def written(nodes: DataFrame, extra: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """The written levels 0, STEP, 2 STEP, ... of ``nodes`` (g, size, r, h, ``extra``) in blocks, and each group's root (g, h)."""
    blocks = [_blocks(nodes, extra)]
    tallest = blocks[0].agg(F.coalesce(F.max(height(F.col("size"))), F.lit(0))).first()[0]
    for level in range(STEP, tallest + STEP, STEP):
        tops = _made_again(blocks[-1], level - STEP).select("g", "size", F.col("block").alias("r"), F.element_at("levels", -1)[0].alias("h"))
        if level >= tallest:
            return blocks, save(tops.select("g", "h"), "roots")
        blocks.append(_blocks(tops))
    return blocks, blocks[0].select("g", F.col("members")[0]["h"].alias("h"))


def paths(blocks: list[DataFrame], above: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Every leaf with its way up: h, ``extra``, path (array of left, sibling) and the other columns of ``above``.

    ``sibling`` is null where a node is digested alone; ``left`` says that the sibling
    comes first.  ``above`` has g and the path that goes on from each group's root.
    """
    others = [c for c in above.columns if c not in ("g", "path")]
    above = above.withColumn("r", F.lit(0).cast("long"))
    at = f"cast(m.r & {(1 << STEP) - 1} as int)"
    own = f"transform(slice(sequence(0, {STEP - 1}), 1, up), l -> struct((shiftright({at}, l) & 1) = 1 AS left, get(levels[l], shiftright({at}, l) ^ 1) AS sibling))"
    for k in range(len(blocks) - 1, -1, -1):
        upper = above.withColumnsRenamed({"g": "g2", "r": "block2", "path": "rest"})
        trees = _made_again(blocks[k], k * STEP).join(upper, F.col("g").eqNullSafe(F.col("g2")) & (F.col("block") == F.col("block2")))
        nodes = trees.select("g", *others, F.explode(F.expr(f"transform(members, m -> struct(m, concat({own}, rest) AS path))")).alias("x"))
        if k == 0:
            return nodes.select("x.m.h", *(F.col(f"x.m.{c}") for c in extra), "x.path", *others)
        above = save(nodes.select("g", "x.m.r", "x.path", *others), "paths")
    return above


def folded(leaf_: str, path: str) -> Column:
    """The root that a leaf and a path lead to."""
    return F.expr(
        f"aggregate({path}, {leaf_}, (h, s) -> CASE WHEN s.sibling IS NULL THEN sha2(h, 256) WHEN s.left THEN sha2(concat(s.sibling, h), 256) ELSE sha2(concat(h, s.sibling), 256) END)"
    )


def proof_digest(path: str) -> Column:
    return F.sha2(F.array_join(F.expr(f"transform({path}, s -> s.sibling)"), ""), 256)


def manifest(leaves: DataFrame, group: str, key: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``leaves`` (group, key, leaf, ``extra``): group, key, leaf, extra, subroot, root and path, up to the root."""
    rows = leaves.select(F.col(group).alias("g"), F.col(key).alias("key"), F.col("leaf").alias("h"), *extra)
    blocks, subroots = written(ranked(save(rows, "leaves"), "g", ["key", "h"], "sorted"), ("key", *extra))
    # subroots are nodes of one tree more, whose only group is named by a number
    named = subroots.select(F.lit(0).alias("all"), F.col("g").alias("name"), F.encode("g", "utf-8").alias("utf8"), "h")
    nodes = ranked(named, "all", ["utf8"], "subroots").withColumnRenamed("all", "g")
    upper, root = written(nodes, ("name",))
    start = root.select("g", F.col("h").alias("root"), F.expr("cast(array() as array<struct<left: boolean, sibling: string>>)").alias("path"))
    above = paths(upper, start, ("name",)).select(F.col("name").alias("g"), "path", F.col("h").alias("subroot"), "root")
    found = paths(blocks, save(above, "subroot-paths").withColumn("name", F.col("g")), ("key", *extra))
    return found.select(F.col("name").alias(group), F.col("key").alias(key), F.col("h").alias("leaf"), *extra, "subroot", "root", "path")


def audited(docs: DataFrame) -> DataFrame:
    """Proofs of all documents, and their check against a copy in which some n_chars are one too high.

    A document is tampered with where 7 divides the CRC-32 of its decimal doc_id.
    doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    """
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n_chars = F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    own = [F.col(c) for c in FIELDS]
    changed = [n_chars if c == "n_chars" else F.col(c) for c in FIELDS]
    leaves = docs.select("doc_id", "lang", leaf(*own).alias("leaf"), F.when(tampered & F.col("n_chars").isNotNull(), leaf(*changed)).alias("seen"))
    found = manifest(leaves, "lang", "doc_id", ("seen",)).withColumn("start", F.coalesce("seen", "leaf"))
    found = found.withColumn("folded_root", folded("start", "path"))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest("path").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
