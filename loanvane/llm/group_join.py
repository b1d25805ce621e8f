"""N-gram Jaccard self-join by a token-group matrix: which documents are joined by chains of similar pairs.

A document is the set of hashes of its five-word runs. Four steps, each exact:

1. Texts with equal sets form a class; only a class representative goes on.
2. A set can have a partner only if enough of its tokens occur in another set. One packed exchange of all tokens finds
   the few sets that pass.
3. Similar sets are brought together by their smallest hash, in blocks of limited size; links inside blocks give first
   components. This only saves work later.
4. What is left to find are links between components. Similar sets are partitioned into groups of limited size
   and each group stores the union of its tokens (its column of the token-group matrix). A set meets a group
   only over a token of both their rarest-token prefixes; the group is opened only if the overlap of the set
   with the group's union reaches what a member would need, and a first link to a component ends the search in it.

Links within one component are never listed, so a group of n near copies costs about n steps and not n squared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanvane.llm.components import connected_components
from loanvane.llm.shared import WordHashes, exchange_buckets, give_back, group_offsets, mix, release_memory, size_checked, small_batches, stage, text_bytes

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
BUCKET_TOKENS = 1_000_000
FLUSH_TOKENS = 400_000
TEXTS_PER_BATCH = 1000
BLOCK_SETS, BLOCK_TOKENS = 256, 1_000_000
GROUP_TOKENS = 65_536
MERGE_ROUNDS = 3
BROADCAST_ROWS = 2_000_000
# Leading bytes of a class digest that name the class in the exchange of step 2. Classes of equal tags only let more sets pass,
# unless they share tokens with nothing but each other: two given partners do so in one of 2**64 cases, as token hashes do.
TAG_BYTES = 8
# Numbers of sets without an id of their own go down from here, far below any id.
NO_ID = -(1 << 62)


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word runs of a text; of all its words if fewer; empty without words."""
    words = text_bytes(text).lower().split()
    return np.unique(WordHashes(words).runs(width)) if words else np.zeros(0, np.uint64)


def needed(n: int | np.ndarray) -> int | np.ndarray:
    """Least overlap of a set of ``n`` tokens with any partner."""
    return -(-NUMERATOR * n // DENOMINATOR)


def linked(overlap, n: int, m) -> bool | np.ndarray:
    return DENOMINATOR * overlap >= NUMERATOR * (n + m - overlap)


def _class_key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _class_tag(tokens: np.ndarray) -> bytes:
    return _class_key(tokens)[:TAG_BYTES]


# ---------------------------------------------------------------- step 1: classes


def set_classes(docs: DataFrame, key: str, width: int) -> DataFrame:
    """``(doc_id, n, cls)`` of every row; ``cls`` is the 128-bit digest of its set."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py(), width) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class_key(s) for s in sets], pa.binary())], ["doc_id", "n", "cls"]
            )
        release_memory()

    return docs.select(F.col(key).cast("long").alias("doc_id"), "text").mapInArrow(measure, "doc_id long, n long, cls binary")


# ---------------------------------------------------------------- packed exchange of tokens


def byte_runs(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same runs with lengths that fit a byte; a longer run goes on under its value again."""
    if not len(lengths) or lengths.max() <= 255:
        return values, lengths.astype(np.uint8)
    parts = -(-lengths // 255)
    out = np.full(parts.sum(), 255, np.uint8)
    out[np.cumsum(parts) - 1] = lengths - 255 * (parts - 1)
    return np.repeat(values, parts), out


class _Packer:
    """Gathers sets and yields, per bucket, the owners, their token counts and the tokens as packed arrays."""

    names = ("bucket", "owners", "counts", "tokens")
    schema = "bucket int, owners binary, counts binary, tokens binary"

    def __init__(self, buckets: int, wide: bool):
        self.buckets, self.kind = buckets, np.uint64 if wide else np.uint32
        self.clear()

    def clear(self) -> None:
        self.owners, self.sets, self.held = [], [], 0

    def add(self, owner: bytes, tokens: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.owners.append(owner)
        self.sets.append(tokens)
        self.held += len(tokens)
        if self.held >= FLUSH_TOKENS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            self.clear()
            return
        tokens = np.concatenate(self.sets)
        owner = np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets])
        bucket = ((tokens >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        tokens, owner, bucket = tokens[order].astype(self.kind), owner[order], bucket[order]
        at = group_offsets(bucket)
        names = np.array(self.owners, dtype=f"V{len(self.owners[0])}")
        rows = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            runs = group_offsets(owner[a:b])
            whose, counts = byte_runs(owner[a:b][runs[:-1]], np.diff(runs))
            rows.append((int(bucket[a]), names[whose].tobytes(), counts.tobytes(), tokens[a:b].tobytes()))
        self.clear()
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], list(self.names)
        )


def _unpack(table: pa.Table, width: int, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners (distinct), and per occurrence its owner's number and token."""
    join = lambda name: b"".join(table.column(name).to_pylist())
    form = np.uint64 if width == 8 else f"V{width}"
    owners, counts, tokens = np.frombuffer(join("owners"), form), np.frombuffer(join("counts"), np.uint8), np.frombuffer(join("tokens"), kind)
    distinct, number = np.unique(owners, return_inverse=True)
    return distinct, np.repeat(number, counts), tokens


# ---------------------------------------------------------------- step 2: sets that can have a partner


def shared_counts(docs: DataFrame, key: str, width: int, buckets: int) -> DataFrame:
    """``(tag, shared)``: how many tokens of a class occur in another class, by 32 bits and the bucket (so rather too many).

    A document leaves few tokens in each of many buckets, so what names its class there weighs more than the tokens: a tag
    of eight bytes and a count of one.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(buckets, wide=False)
        for batch in batches:
            for text in batch.column(0):
                tokens = shingle_set(text.as_py(), width)
                if len(tokens):
                    yield from packer.add(_class_tag(tokens), tokens)
        yield from packer.flush()
        release_memory()

    def count(table: pa.Table) -> pa.Table:
        classes, owner, token = _unpack(table, TAG_BYTES, np.uint32)
        pairs = np.unique(token.astype(np.uint64) << np.uint64(32) | owner.astype(np.uint64))
        at = group_offsets(pairs >> np.uint64(32))
        sizes = np.diff(at)
        shared = np.repeat(sizes > 1, sizes)
        n = np.bincount((pairs[shared] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=len(classes))
        # partial counts go on packed, a row for each bucket that adds them up
        some = np.flatnonzero(n)
        if not len(some):
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.binary(), pa.binary())], ["bucket", "owners", "counts"])
        names, n = classes[some], n[some].astype(np.uint32)
        to = (names % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        names, n, to = names[order], n[order], to[order]
        at = group_offsets(to)
        cut = list(zip(at[:-1], at[1:], strict=True))
        return pa.table(
            [pa.array(to[at[:-1]].astype(np.int32)), pa.array([names[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([n[a:b].tobytes() for a, b in cut], pa.binary())],
            ["bucket", "owners", "counts"],
        )

    def add(table: pa.Table) -> pa.Table:
        owners = np.frombuffer(b"".join(table.column("owners").to_pylist()), np.uint64)
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32)
        classes, number = np.unique(owners, return_inverse=True)
        total = np.bincount(number, counts, len(classes)).astype(np.int64)
        return pa.table({"tag": pa.array([c.tobytes() for c in classes], pa.binary()), "shared": pa.array(total)})

    packed = docs.select("text").mapInArrow(pack, _Packer.schema)
    partial = packed.groupBy("bucket").applyInArrow(count, "bucket int, owners binary, counts binary")
    return partial.groupBy("bucket").applyInArrow(add, "tag binary, shared long")


def sets_with_partner(docs: DataFrame, key: str, width: int, classes: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """``(rep, n, tokens)`` of the sets that can have a link to another set, and the number ``rep`` of each by ``rep_cls``."""
    counts = stage(shared_counts(docs, key, width, buckets), "join-shared")
    reps = classes.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("at"), F.max("n").alias("n"))
    able = counts.join(reps.withColumn("tag", F.substring("cls", 1, TAG_BYTES)), "tag").filter(100 * F.col("shared") >= NUMERATOR * F.col("n"))
    able = stage(able.select("at", F.col("cls").alias("rep_cls")), "join-able")
    # a set goes by the smallest id that carries it; where an id carries several, the others get negative numbers
    first = able.groupBy("at").agg(F.min("rep_cls").alias("first_cls"))
    number = F.when(F.col("rep_cls") == F.col("first_cls"), F.col("at")).otherwise(F.lit(NO_ID) - F.monotonically_increasing_id())
    named, able = able, stage(able.join(first, "at").select("at", "rep_cls", number.alias("rep")), "join-named")
    give_back(named)
    give_back(counts)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), "text")
    rows = rows.join(size_checked(able, BROADCAST_ROWS), F.col("doc_id") == F.col("at")).select("rep", "rep_cls", "text")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rep, cls, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                tokens = shingle_set(text.as_py(), width)
                if _class_key(tokens) == cls.as_py():  # not another text under the same id
                    out.append((rep.as_py(), len(tokens), tokens.tobytes()))
            yield pa.RecordBatch.from_pylist([dict(zip(("rep", "n", "tokens"), r, strict=True)) for r in out], pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())]))

    sets = stage(rows.mapInArrow(gather, "rep long, n long, tokens binary").dropDuplicates(["rep"]), "join-sets")
    return sets, able


# ---------------------------------------------------------------- step 3: links inside blocks of similar sets


def block_edges(table: pa.Table) -> pa.Table:
    """Edges from each set of a block to the first set of its component within the block."""
    reps = table.column("rep").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
    order = np.argsort(reps)
    reps, sets = reps[order], [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, column = np.unique(tokens, return_inverse=True)
    overlap = np.zeros((len(sets), len(sets)), np.float32)
    by_column = np.argsort(column, kind="stable")
    column, owner = column[by_column], owner[by_column]
    width = 4096
    for low in range(0, int(column[-1]) + 1, width):  # presence matrix, some columns at a time
        a, b = np.searchsorted(column, (low, low + width))
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        overlap += part @ part.T
    links = linked(np.rint(overlap).astype(np.int64), sizes[:, None], sizes[None, :])
    root = np.arange(len(sets))
    while True:  # smallest linked root until nothing moves
        least = np.where(links, root[None, :], len(sets)).min(1)
        least = np.minimum(root, least)
        least = least[least]
        if (least == root).all():
            break
        root = least
    moved = root != np.arange(len(sets))
    return pa.table({"a": pa.array(reps[moved]), "b": pa.array(reps[root[moved]])})


def merge_round(sets: DataFrame, turn: int) -> DataFrame:
    """Edges found in blocks of sets with the same smallest hash; hash and blocks differ from turn to turn."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.uint64(0xA0761D6478BD642F * (turn + 1) & 0xFFFFFFFFFFFFFFFF)
        for batch in batches:
            keys = [int(mix(np.frombuffer(x.as_py(), np.uint64) ^ salt).min().view(np.int64)) for x in batch.column("tokens")]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), pa.array(keys, pa.int64())], ["rep", "n", "key"])

    keyed = stage(sets.mapInArrow(smallest, "rep long, n long, key long"), "join-keys")
    blocks = keyed.groupBy("key").agg(F.count("*").alias("sets"), F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_TOKENS)).alias("k"))
    placed = keyed.join(blocks.filter("sets > 1"), "key").select("rep", "key", F.pmod(F.xxhash64("rep", F.lit(turn)), F.col("k")).alias("block"))
    full = sets.join(placed.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r")).select("key", "block", "rep", "tokens")
    edges = stage(full.groupBy("key", "block").applyInArrow(block_edges, "a long, b long"), "join-edges")
    give_back(keyed)
    return edges


# ---------------------------------------------------------------- step 4: links between components


def crossing_tokens(sets: DataFrame, buckets: int) -> DataFrame:
    """``(rep, token, df)`` for the tokens that occur in two components or more; ``sets`` has ``component``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(buckets, wide=True)
        for batch in batches:
            owners = np.column_stack([batch.column(i).to_numpy() for i in range(2)])
            for owner, body in zip(owners, batch.column(2), strict=True):
                yield from packer.add(owner.tobytes(), np.frombuffer(body.as_py(), np.uint64))
        yield from packer.flush()
        release_memory()

    def count(table: pa.Table) -> pa.Table:
        owners, owner, token = _unpack(table, 16, np.uint64)
        reps, comps = np.frombuffer(owners.tobytes(), np.int64).reshape(-1, 2).T
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        at = group_offsets(token)[:-1]
        sizes = np.diff(np.append(at, len(token)))
        comp = comps[owner]
        crossing = np.minimum.reduceat(comp, at) != np.maximum.reduceat(comp, at)
        keep = np.repeat(crossing, sizes)
        return pa.table(
            {"rep": pa.array(reps[owner[keep]]), "token": pa.array(token[keep].view(np.int64)), "df": pa.array(np.repeat(sizes, sizes)[keep].astype(np.int64))}
        )

    packed = sets.select("rep", "component", "tokens").mapInArrow(pack, _Packer.schema)
    return packed.groupBy("bucket").applyInArrow(count, "rep long, token long, df long")


def open_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows of a set and a group (packed members and their union): an edge to a linked member of each later component."""
    for batch in batches:
        a, b = [], []
        for rep, tokens, sets, comp, union, reps, sizes, m_sets, m_comps, members in zip(*(batch.column(i).to_pylist() for i in range(10)), strict=True):
            mine = np.frombuffer(tokens, np.uint64)
            n, m = len(mine), np.array(sizes)
            bound = len(np.intersect1d(mine, np.frombuffer(union, np.uint64), assume_unique=True))
            # an overlap with the union that no member could do with leaves the group closed
            fits = linked(np.minimum(bound, np.minimum(n, m)), n, m)
            joined = set()
            for i in np.flatnonzero(fits).tolist():
                if (m_sets[i], m_comps[i]) <= (sets, comp) or m_comps[i] in joined:
                    continue
                overlap = len(np.intersect1d(mine, np.frombuffer(members[i], np.uint64), assume_unique=True))
                if linked(overlap, n, int(m[i])):
                    a.append(rep)
                    b.append(reps[i])
                    joined.add(m_comps[i])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def pack_groups(table: pa.Table) -> pa.Table:
    """One row per group: union of the tokens, members, their sizes, components and tokens."""
    bodies = table.column("tokens").to_pylist()
    union = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in bodies]))
    lists = {name: pa.array([table.column(name).to_pylist()], pa.list_(pa.int64())) for name in ("rep", "n", "c_sets", "component")}
    return pa.table(
        {
            "g": pa.array([table.column("g")[0].as_py()], pa.string()), "union": pa.array([union.tobytes()], pa.binary()),
            "reps": lists["rep"], "sizes": lists["n"], "m_sets": lists["c_sets"], "m_comps": lists["component"],
            "members": pa.array([bodies], pa.list_(pa.binary())),
        }
    )


def foreign_edges(sets: DataFrame, buckets: int) -> DataFrame:
    """At least one link, where there is one, between every set and every other component.

    Large components have groups of their own. Sets of small ones are grouped by their most frequent token, so that a
    crowd of single near copies makes a few groups and not one each. Of two components the smaller one asks.
    """
    spark = sets.sparkSession
    tokens = stage(crossing_tokens(sets, buckets), "join-crossing")
    able = tokens.groupBy("rep").agg(F.count("*").alias("e"), F.max(F.struct("df", "token"))["token"].alias("top"))
    able = able.join(sets.select("rep", "n", "component"), "rep")
    able = able.withColumn("least", F.ceil(NUMERATOR * F.col("n") / DENOMINATOR)).filter("e >= least")
    comps = able.groupBy("component").agg(F.count("*").alias("c_sets"), F.sum("n").alias("c_tokens"))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1.2))
    kind = F.when(F.col("c_tokens") >= GROUP_TOKENS, F.concat_ws("/", F.lit("c"), "component", band)).otherwise(F.concat_ws("/", F.lit("t"), "top", band))
    kinds = able = stage(able.join(comps, "component").withColumn("kind", kind).drop("c_tokens", "top"), "join-able")
    parts = able.groupBy("kind").agg(F.ceil(F.sum("n") / GROUP_TOKENS).alias("k"))
    able = able.join(parts, "kind").withColumn("g", F.concat_ws("/", "kind", F.pmod(F.xxhash64("rep"), F.col("k"))))
    able = stage(able.select("rep", "n", "component", "c_sets", "e", "least", "g"), "join-groups")
    give_back(kinds)
    nth = F.row_number().over(W.partitionBy("rep").orderBy("df", "token"))
    prefix = tokens.join(able, "rep").withColumn("nth", nth).filter(F.col("nth") <= F.col("e") - F.col("least") + 1)
    rank = F.struct("c_sets", "component").alias("rank")
    prefix = stage(prefix.select("token", "rep", "n", rank, "g"), "join-prefixes")
    give_back(tokens)
    columns = prefix.groupBy("token", "g").agg(F.max("rank").alias("last"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    fits = (DENOMINATOR * F.col("hi") >= NUMERATOR * F.col("n")) & (DENOMINATOR * F.col("n") >= NUMERATOR * F.col("lo"))
    asks = prefix.select("token", "rep", "n", "rank").join(columns, "token").filter((F.col("rank") < F.col("last")) & fits)
    asks = stage(asks.select("rep", "g").distinct(), "join-asks")
    give_back(prefix)
    full = sets.select("rep", "tokens").join(able.select("rep", "n", "component", "c_sets", "g"), "rep")
    columns = "g string, union binary, reps array<long>, sizes array<long>, m_sets array<long>, m_comps array<long>, members array<binary>"
    groups = stage(full.groupBy("g").applyInArrow(pack_groups, columns), "join-columns")
    pairs = asks.join(full.drop("g"), "rep").join(groups, "g")
    pairs = pairs.select("rep", "tokens", "c_sets", "component", "union", "reps", "sizes", "m_sets", "m_comps", "members")
    with small_batches(spark, 16):
        links = stage(pairs.mapInArrow(open_groups, "a long, b long"), "join-links")
    give_back(asks, able, groups)
    return links


# ---------------------------------------------------------------- the join


def similar_components(docs: DataFrame, key: str = "doc_id", width: int = SHINGLE) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs`` (integer key, ``text``).

    Null and empty texts have no shingles and stay alone, as do rows of an empty table. Rows of equal id and different
    text count as one document with both sets' links. The component is the smallest id reachable by links.
    """
    spark = docs.sparkSession
    with small_batches(spark, TEXTS_PER_BATCH):  # everything with Python in it is staged inside
        return _components(docs, key, width)


def _components(docs: DataFrame, key: str, width: int) -> DataFrame:
    spark = docs.sparkSession
    classes = stage(set_classes(docs, key, width), "join-classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(exchange_buckets(spark), -(-total // BUCKET_TOKENS))
    sets, named = sets_with_partner(docs, key, width, classes, buckets)
    edges = None
    for turn in range(MERGE_ROUNDS):
        found = merge_round(sets, turn)
        edges = found if edges is None else edges.union(found)
    first = connected_components(edges).withColumnRenamed("id", "rep")
    known = stage(sets.join(first, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "join-known")
    give_back(sets)
    links = foreign_edges(known, buckets)
    give_back(known)
    final = connected_components(first.select(F.col("rep").alias("a"), F.col("component").alias("b")).union(links))
    # copies hang on the smallest id of their class; sets with a number of their own go by it
    own = classes.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    own = own.join(named.select(F.col("rep_cls").alias("cls"), "rep"), "cls", "left").withColumn("rep", F.coalesce("rep", "least"))
    several = classes.filter("n > 0").groupBy("doc_id").agg(F.countDistinct("cls").alias("k")).filter("k > 1 and doc_id is not null")
    filled = classes.filter("n > 0")
    if several.isEmpty():
        reps = own.join(final, F.col("rep") == F.col("id"), "left").select("cls", F.coalesce("component", "rep").alias("component"))
        rows = filled.join(reps, "cls")
    else:  # ids that carry several texts join the components of all of them, which are then named by their smallest id
        of_id = filled.join(several, "doc_id").join(own, "cls").filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        joined = connected_components(final.select(F.col("id").alias("a"), F.col("component").alias("b")).union(of_id.distinct()))
        placed = filled.join(own, "cls").join(joined, F.col("rep") == F.col("id"), "left").withColumn("component", F.coalesce("component", "rep"))
        placed = placed.select("doc_id", "n", "component")
        least = placed.groupBy("component").agg(F.min("doc_id").alias("least"))
        rows = placed.join(least, "component").select("doc_id", "n", F.col("least").alias("component"))
    rows = rows.select("doc_id", "n", "component").unionByName(classes.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component")))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key is the smallest of its component; rows without a key stay."""
    same = F.col("doc_id").eqNullSafe(F.col("component_id"))
    kept = similar_components(docs, key).filter(same).select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs[key].eqNullSafe(kept["kept_id"]), "left_semi")
