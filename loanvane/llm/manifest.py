"""Merkle manifest of a dataset: one hash that stands for all rows, and for each row the proof that it belongs to it.

Every group of rows has a tree of its own, over its rows in key order; the group roots are the leaves of one more tree. The
trees grow by sibling-shift self-joins: on each level the nodes are joined with themselves on computed sibling places
(the place XOR one in binary trees, the other slots of the run otherwise), so each node learns what its run holds before
and after it. The node in slot zero then emits the parent. Each level is written once and halves the one below, so all
levels together move about twice the leaves. Proofs go the other way: a node's path is its own siblings and the path of its
parent, joined level by level, so the upper levels are never copied more often than once a child.

Rows of a group get their places from ranges of the key, not from a window over the group: the rows are dealt by ranges
and written in order, one small table counts rows per range, and a row's place is its number in the range after the
ranges before it. A group that holds most rows is spread like any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanvane.llm.shared import exchange_buckets, stage

ARITY = 2
# Levels whose paths are joined in one plan before the paths are written.
LEVELS_PER_PLAN = 8
NODE = ("tree", "n", "place")


# ---------------------------------------------------------------- hashes


def framed(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value's text: no two rows frame alike."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    """Hash of a row: hex SHA-256 of its framed values one after the other."""
    return F.sha2(F.concat(*[framed(v) for v in values]).cast("binary"), 256)


def digest_of(before: Column, node: Column, after: Column) -> Column:
    """Hex hash of a run of digests given as bytes: SHA-256 over their hex texts from left to right."""
    return F.sha2(F.lower(F.concat(F.hex(before), F.hex(node), F.hex(after))).cast("binary"), 256)


def fold(digest: Column, path: Column) -> Column:
    """Root that a hex digest leads to with the siblings of a path (structs ``before``, ``after``)."""
    step = lambda at, run: F.sha2(F.concat(F.lower(F.hex(run["before"])), at, F.lower(F.hex(run["after"]))).cast("binary"), 256)
    return F.aggregate(path, digest, step)


def path_digest(path: Column) -> Column:
    """Hex hash of all siblings of a path, from the leaf to the root, each run from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda run: F.lower(F.concat(F.hex(run["before"]), F.hex(run["after"])))), "").cast("binary"), 256)


# ---------------------------------------------------------------- places


def in_order(rows: DataFrame, order: Sequence[str], tag: str) -> DataFrame:
    """``rows`` (``tree``, any columns) with ``place`` from 0 in their tree by ``order`` (nulls first) and ``n``, the tree's size.

    ``rows`` must be staged: rows equal in all columns are told apart by where they are read, so that even
    copies of one row can go to several ranges.
    """
    told = rows.withColumn("read_at", F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in ("tree", *order, "read_at")]
    dealt = told.repartitionByRange(exchange_buckets(rows.sparkSession), *by).sortWithinPartitions(*by).drop("read_at")
    dealt = stage(dealt.withColumn("at", F.monotonically_increasing_id()), tag)
    part = F.shiftright("at", 33)
    counts = dealt.groupBy("tree", part.alias("part")).agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    ahead = F.coalesce(F.sum("rows").over(W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("rows").over(W.partitionBy("tree"))
    ranges = stage(counts.select("tree", "part", "first", ahead.alias("ahead"), total.alias("n")), f"{tag}-ranges")
    placed = dealt.withColumn("part", part).join(ranges, ["tree", "part"])
    return placed.withColumn("place", F.col("ahead") + F.col("at") - F.col("first")).drop("at", "part", "first", "ahead")


# ---------------------------------------------------------------- levels


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes (``tree``, ``n``, ``place``, ``digest``) with the digests of their run ``before`` and ``after`` them."""
    slot = F.col("place") % arity
    if arity == 2:
        asked = {None: F.col("place").bitwiseXOR(F.lit(1))}
    else:  # a node asks for every slot of its run but its own
        asked = {t: F.when(slot != t, F.col("place") - slot + t) for t in range(arity)}
    out, before, after = nodes, [], []
    for t, place in asked.items():
        name = f"sibling{t or 0}"
        other = nodes.select(F.col("tree").alias("its_tree"), F.col("place").alias("its_place"), F.col("digest").alias(name))
        out = out.join(other, (F.col("tree") == F.col("its_tree")) & (place == F.col("its_place")), "left").drop("its_tree", "its_place")
        ahead = slot == 1 if t is None else slot > t
        before.append(F.coalesce(F.when(ahead, F.col(name)), F.lit(b"")))
        after.append(F.coalesce(F.when(~ahead, F.col(name)), F.lit(b"")))
    return out.withColumns({"before": F.concat(*before), "after": F.concat(*after)}).drop(*[f"sibling{t or 0}" for t in asked])


def parents_of(level: DataFrame, arity: int) -> DataFrame:
    """The nodes above a level, emitted by the rows in slot zero; trees that had one node left are done."""
    first = level.filter((F.col("n") > 1) & (F.col("place") % arity == 0))
    up = [F.col("tree"), F.ceil(F.col("n") / arity).cast("long").alias("n"), F.floor(F.col("place") / arity).cast("long").alias("place")]
    return first.select(*up, F.unhex(digest_of(F.col("before"), F.col("digest"), F.col("after"))).alias("digest"))


def grow(leaves: DataFrame, arity: int, tag: str) -> list[DataFrame]:
    """Levels of all trees from the leaves up, each staged with siblings; a level of one node a tree ends them."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, nodes = [], leaves
    while True:
        levels.append(stage(with_siblings(nodes, arity), f"{tag}-level"))
        if most <= 1:
            return levels
        most = -(-most // arity)
        nodes = parents_of(levels[-1], arity)


def roots_of(levels: Sequence[DataFrame]) -> DataFrame:
    """``(tree, digest)`` of the last node of every tree."""
    out = None
    for level in levels:
        part = level.filter("n = 1").select("tree", "digest")
        out = part if out is None else out.union(part)
    return out


def paths_of(levels: Sequence[DataFrame], arity: int, tag: str) -> DataFrame:
    """The rows of the lowest level with ``path``: runs from their own up to below the root of their tree."""
    empty = F.array().cast("array<struct<before:binary,after:binary>>")
    above = None
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        own = F.when(F.col("n") > 1, F.array(F.struct("before", "after"))).otherwise(empty)
        if depth:
            level = level.select(*NODE, "before", "after")
        if above is None:
            level = level.withColumn("path", own)
        else:
            mine = above.select(F.col("tree").alias("up_tree"), F.col("place").alias("up_place"), F.col("path").alias("up_path"))
            same = (F.col("tree") == F.col("up_tree")) & (F.floor(F.col("place") / arity) == F.col("up_place"))
            level = level.join(mine, same, "left").withColumn("path", F.concat(own, F.coalesce("up_path", empty))).drop("up_tree", "up_place", "up_path")
        level = level.drop("before", "after")
        if depth:
            level = level.select("tree", "place", "path")
            if (len(levels) - depth) % LEVELS_PER_PLAN == 0:
                level = stage(level, f"{tag}-paths")
        above = level
    return above


# ---------------------------------------------------------------- the manifest


@dataclass(frozen=True)
class Manifest:
    """``levels`` of the group trees from the leaves up, ``top_levels`` of the tree over the group roots, and ``root`` (hex)."""

    levels: list[DataFrame]
    top_levels: list[DataFrame]
    root: str | None
    arity: int

    def nodes(self) -> DataFrame:
        """``(tree, level, place, n, digest)`` of every node, hex digests; the tree over the groups is named ``root``."""
        out = None
        for part, named in ((self.levels, None), (self.top_levels, "root")):
            for depth, level in enumerate(part):
                tree = F.lit(named) if named else F.col("tree")
                rows = level.select(tree.alias("tree"), F.lit(depth).alias("level"), "place", "n", F.lower(F.hex("digest")).alias("digest"))
                out = rows if out is None else out.unionByName(rows)
        return out

    def proofs(self) -> DataFrame:
        """Every leaf with its carried columns, ``leaf`` and ``subroot`` (hex), and ``path``, the runs of siblings up to the root."""
        low = paths_of(self.levels, self.arity, "manifest")
        high = paths_of(self.top_levels, self.arity, "manifest-top")
        high = high.select(F.col("group_tree").alias("tree"), F.lower(F.hex("digest")).alias("subroot"), F.col("path").alias("top_path"))
        low = low.withColumn("leaf", F.lower(F.hex("digest"))).drop("digest")
        return low.join(stage(high, "manifest-subroots"), "tree").withColumn("path", F.concat("path", "top_path")).drop("top_path")


def build_manifest(
    docs: DataFrame, key: str, group: str, columns: Sequence[str], arity: int = ARITY, carry: Mapping[str, Column] | None = None
) -> Manifest:
    """Manifest of the rows of ``docs``: leaves hash ``columns``, a tree for each value of ``group``, leaves by ``key``.

    ``carry`` names expressions over the input that stay with each leaf. A run of ``arity`` consecutive nodes has one parent,
    the last run of a level may be shorter; a tree of one leaf is that leaf. Groups are ordered null first, then by bytes; leaves
    with null keys come first. Rows of equal key are ordered by their digest, so equal rows get the same digests and
    proofs in any order. Null and empty values hash apart. An empty table has no nodes and no root. Other columns are ignored.
    """
    extra = {name: c.alias(f"carried_{name}") for name, c in (carry or {}).items()}
    digest = F.unhex(leaf_digest([F.col(c) for c in columns]))
    rows = docs.select(framed(F.col(group)).alias("tree"), F.col(group).alias("group_value"), F.col(key).alias("leaf_key"), digest.alias("digest"), *extra.values())
    leaves = in_order(stage(rows, "manifest-leaves"), ["leaf_key", "digest"], "manifest-order")
    levels = grow(leaves, arity, "manifest")
    values = levels[0].filter("place = 0").select("tree", "group_value")
    subroots = roots_of(levels).join(values, "tree").select(F.lit("top").alias("tree"), F.col("tree").alias("group_tree"), "group_value", "digest")
    top = grow(in_order(stage(subroots, "manifest-groups"), ["group_value"], "manifest-top-order"), arity, "manifest-top")
    last = roots_of(top).select(F.lower(F.hex("digest"))).first()
    return Manifest(levels, top, last[0] if last else None, arity)


def verify(proofs: DataFrame, root: str | None, digest: Column) -> DataFrame:
    """Proof rows with ``folded_root``, what ``digest`` (hex) leads to, and whether it is ``root``."""
    folded = proofs.withColumn("folded_root", fold(digest, F.col("path")))
    return folded.withColumn("verified", F.col("folded_root") == F.lit(root))


# ---------------------------------------------------------------- the query's rows

# Hashed columns in their order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_FOLD = 7


def tampered_round_trip(docs: DataFrame) -> DataFrame:
    """Manifest of ``docs`` by language, each row's proof digest, and the root its leaf folds to after tampering.

    Where 7 divides the CRC-32 of the id, one is added to ``n_chars`` before the leaf is hashed again; a null count stays, as do
    rows of a null id.
    """
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % TAMPER_FOLD == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    changed = leaf_digest([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in COLUMNS])
    made = build_manifest(docs, "doc_id", "lang", COLUMNS, carry={"tampered": F.unhex(F.when(chosen, changed))})
    shown = F.coalesce(F.lower(F.hex("carried_tampered")), F.col("leaf"))
    folded = verify(made.proofs(), made.root, shown)
    return folded.select(
        F.col("leaf_key").alias("doc_id"), "leaf", "subroot", F.lit(made.root).alias("root"), path_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified"
    )
