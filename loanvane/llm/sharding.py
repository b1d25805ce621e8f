"""Shards of bounded size by extendible hashing.

A directory indexed by the leading bits of the key hash points to buckets. Bytes are counted per directory entry, and
only buckets over the byte limit split on one bit more, so depth follows the data. Ten bits are looked at per round;
a later round reads only the rows of entries that are still too large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanvane.llm.shared import HASH_BITS, key_hash, stage

LEVEL_BITS = 10
SHARD_BYTES = 1 << 20


def _prefix(hash_: Column, depth: int) -> Column:
    return F.shiftright(hash_, HASH_BITS - depth)


def shard_directory(sized: DataFrame, limit: int) -> list[DataFrame]:
    """Directory levels of rows ``(h, bytes)``; level k has one row per used prefix of 10 (k + 1) bits.

    Columns: ``cell``, and ``depth``, ``prefix``, ``shard_bytes``, ``shard_rows``, ``single`` of the bucket that the
    entry points to; these are null for an entry that the next level splits further. A bucket whose rows all have
    one hash cannot be split and stays as it is (``single``).
    """
    levels, rows = [], sized
    for level in range(HASH_BITS // LEVEL_BITS):
        low, high = level * LEVEL_BITS, (level + 1) * LEVEL_BITS
        cells = rows.groupBy(_prefix(F.col("h"), high).alias("cell")).agg(
            F.sum("bytes").alias("b"), F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")
        )
        # at most 1024 cells of a bucket that is being split share a window group
        of_bucket = Window.partitionBy("depth", "prefix")
        nodes = (
            cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
            .withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
            .select(
                "cell", "depth", "prefix",
                F.sum("b").over(of_bucket).alias("shard_bytes"),
                F.sum("n").over(of_bucket).alias("shard_rows"),
                (F.min("lo").over(of_bucket) == F.max("hi").over(of_bucket)).alias("single"),
            )
        )
        fits = (F.col("shard_bytes") <= limit) | F.col("single")
        first = F.min(F.when(fits, F.struct("depth", "prefix", "shard_bytes", "shard_rows", "single")))
        entries = stage(nodes.groupBy("cell").agg(first.alias("at")).select("cell", "at.*"), "shard-directory")
        levels.append(entries)
        open_cells = entries.filter(F.col("depth").isNull()).select("cell")
        if open_cells.isEmpty():
            break
        rows = rows.join(open_cells, _prefix(F.col("h"), high) == F.col("cell"), "left_semi")
    return levels


def extendible_shards(docs: DataFrame, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``shard`` (depth-prefix-page), ``shard_depth``, ``row_bytes`` and ``shard_bytes`` (long).

    A row's bytes are those of its text (null: 0). Rows of equal key go together; if such a group alone is over the
    limit, it goes on in overflow pages within one bucket, and ``shard_bytes`` is then the whole bucket's. A single
    row over the limit has a page to itself. Columns of these names in ``docs`` are replaced. Empty input: no rows.
    """
    own = [c for c in docs.columns if c not in ("shard", "shard_depth", "row_bytes", "shard_bytes")]
    sized = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    levels = shard_directory(docs.select(key_hash(F.col(key)).alias("h"), sized.alias("bytes")), limit)
    kept = F.struct(*[F.col(c) for c in own]).alias("row")
    rows = docs.select(kept, key_hash(F.col(key)).alias("h"), sized.alias("row_bytes"))
    found = F.lit(None)
    for level, entries in enumerate(levels):
        bits = (level + 1) * LEVEL_BITS
        side = entries.select(F.col("cell").alias(f"cell{level}"), F.struct("depth", "prefix", "shard_bytes", "single").alias(f"at{level}"))
        side = F.broadcast(side) if level == 0 else side  # the first level has 1024 entries at most
        rows = rows.join(side, _prefix(F.col("h"), bits) == F.col(f"cell{level}"), "left")
        found = F.when(F.col(f"at{level}.depth").isNotNull(), F.col(f"at{level}")).otherwise(found)
    rows = rows.select("row", "h", "row_bytes", found.alias("at"))
    over = (F.col("at.shard_bytes") > limit) & F.col("at.single")
    has_overflow = any(not e.filter((F.col("shard_bytes") > limit) & F.col("single")).isEmpty() for e in levels)
    rows = rows.withColumn("page", F.lit(0).cast("long"))
    if has_overflow:
        equal = Window.partitionBy("h")
        before = F.sum("row_bytes").over(equal.orderBy("row_bytes").rowsBetween(Window.unboundedPreceding, -1))
        step = F.greatest(F.lit(1), F.lit(limit) - F.max("row_bytes").over(equal))
        pages = rows.filter(over).withColumn("page", F.floor(F.coalesce(before, F.lit(0)) / step))
        rows = rows.filter(~over).unionByName(pages)
    name = F.concat_ws("-", F.col("at.depth"), F.col("at.prefix"), F.col("page"))
    return rows.select(
        *[F.col("row")[c].alias(c) for c in own],
        name.alias("shard"), F.col("at.depth").alias("shard_depth"), "row_bytes", F.col("at.shard_bytes").alias("shard_bytes"),
    )
