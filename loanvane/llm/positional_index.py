"""Benchmark decontamination over a distributed positional inverted index.

Documents are indexed in shards of limited size: per term, the sorted positions of its occurrences in the shard, where
documents follow one another with a gap. A test phrase goes only to the shards that hold its rarest term; there the
position lists of its terms, moved by their offsets, are intersected from the rarest term on. What is left are exact
occurrences. Terms that no test text has are not stored; a bitmap of fixed size tells them, and a false hit of the
bitmap costs space only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanvane.llm.shared import WordHashes, group_offsets, release_memory, small_batches, stage, text_bytes

WINDOW = 10
SHARD_WORDS = 2_000_000
BITMAP_BITS = 24
TEXTS_PER_BATCH = 1000
# Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased.
_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def bench_words(text: str | None) -> list[bytes]:
    return text_bytes(text).translate(_LETTERS).split()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ---------------------------------------------------------------- test side


def test_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """Rows ``(item_id, window, terms)``: every run of ``width`` words, or the whole of a shorter item; ids by content."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, windows, terms = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = bench_words(text)
                if not words:
                    continue
                hashes = WordHashes(words)
                one, whole = _signed(hashes.words()), _signed(hashes.runs(width))
                n = min(width, len(words))
                for i, w in enumerate(whole):
                    ids.append(item)
                    windows.append(int(w))
                    terms.append(one[i : i + n].tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(windows, pa.int64()), pa.array(terms, pa.list_(pa.int64()))], ["item_id", "window", "terms"]
            )

    rows = items.select(F.col("item_id").cast("string"), "text")
    return rows.mapInArrow(cut, "item_id string, window long, terms array<long>")


def term_bitmap(windows: DataFrame) -> np.ndarray:
    """Bitmap of 2^24 bits with the low bits of every test term; 2 MB whatever the number of test texts."""
    low = F.explode("terms").alias("t")
    bits = windows.select(low).select(F.col("t").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1)).alias("b"))
    chunks = bits.groupBy(F.shiftright("b", 5).alias("chunk")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 31 as int))")).alias("bits"))
    found = chunks.toArrow()  # 2^19 chunks at most
    bitmap = np.zeros(1 << (BITMAP_BITS - 5), np.uint32)
    bitmap[found.column("chunk").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return bitmap


# ---------------------------------------------------------------- index


def build_index(docs: DataFrame, key: str, bitmap: np.ndarray, gap: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Rows ``(shard, term, n, places, doc_ids)`` of ``docs``.

    A term's row has its ``n`` places in the shard as 32-bit integers. The shard's row with a null term lists the
    ``n`` documents: their start places and word counts, and ``doc_ids``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # 2 MB, fixed

    def rows_of(shard: int, ids: list, starts: list, counts: list, terms: list, places: list) -> pa.RecordBatch:
        term = np.concatenate(terms) if terms else np.zeros(0, np.uint64)
        place = np.concatenate(places) if places else np.zeros(0, np.uint32)
        order = np.argsort(term, kind="stable")
        term, place = term[order], place[order]
        at = group_offsets(term)
        n = len(at) - 1
        bodies = [place[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        table = np.array([starts, counts], np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n + 1, shard, np.int64)),
                pa.array([*_signed(term[at[:-1]]).tolist(), None], pa.int64()),
                pa.array([*np.diff(at).tolist(), len(ids)], pa.int64()),
                pa.array([*bodies, table.tobytes()], pa.binary()),
                pa.array([*([None] * n), ids], pa.list_(pa.int64())),
            ],
            ["shard", "term", "n", "places", "doc_ids"],
        )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        part, seq = TaskContext.get().partitionId(), 0
        ids, starts, counts, terms, places, base = [], [], [], [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                words = bench_words(batch.column(1)[i].as_py())
                ids.append(batch.column(0)[i].as_py())
                starts.append(base)
                counts.append(len(words))
                if words:
                    one = WordHashes(words).words()
                    low = one & np.uint64((1 << BITMAP_BITS) - 1)
                    hit = np.flatnonzero((known[(low >> np.uint64(5)).astype(np.int64)] >> (low & np.uint64(31)).astype(np.uint32)) & np.uint32(1))
                    terms.append(one[hit])
                    places.append((hit + base).astype(np.uint32))
                base += len(words) + gap
                if base >= shard_words:
                    yield rows_of(part << 32 | seq, ids, starts, counts, terms, places)
                    seq += 1
                    ids, starts, counts, terms, places, base = [], [], [], [], [], 0
        if ids:
            yield rows_of(part << 32 | seq, ids, starts, counts, terms, places)
        release_memory()

    schema = "shard long, term long, n long, places binary, doc_ids array<long>"
    return docs.select(F.col(key).cast("long").alias(key), "text").mapInArrow(build, schema)


# ---------------------------------------------------------------- search


def rarest_first(windows: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct windows with all terms in the index: ``(window, terms, offsets)``, ordered from the rarest term on."""
    seen = index.filter(F.col("term").isNotNull()).groupBy("term").agg(F.sum("n").alias("df"))
    distinct = windows.groupBy("window").agg(F.first("terms").alias("terms"))
    flat = distinct.select("window", F.size("terms").alias("width"), F.posexplode("terms").alias("offset", "term"))
    found = flat.join(seen, "term").groupBy("window", "width").agg(F.sort_array(F.collect_list(F.struct("df", "offset", "term"))).alias("t"))
    return found.filter(F.size("t") == F.col("width")).select("window", F.col("t.term").alias("terms"), F.col("t.offset").alias("offsets"))


def phrase_starts(lists: dict[int, np.ndarray], terms: list[int], offsets: list[int]) -> np.ndarray:
    """Start places of a phrase: intersection of the offset-adjusted lists, rarest term first."""
    starts = lists[terms[0]].astype(np.int64) - offsets[0]
    for term, offset in zip(terms[1:], offsets[1:], strict=True):
        other = lists.get(term)
        if other is None or not len(starts):
            return np.zeros(0, np.int64)
        at = np.searchsorted(other, starts + offset)
        at[at == len(other)] = 0
        starts = starts[other[at] == starts + offset]
    return starts


def near_starts(lists: dict[int, np.ndarray], terms: list[int], offsets: list[int], slack: int) -> np.ndarray:
    """Places of the rarest term with every other term of the phrase within its distance there plus ``slack`` words."""
    anchor = lists[terms[0]].astype(np.int64)
    for term, offset in zip(terms[1:], offsets[1:], strict=True):
        other = lists.get(term)
        if other is None:
            return np.zeros(0, np.int64)
        reach = abs(offset - offsets[0]) + slack
        low, high = np.searchsorted(other, anchor - reach), np.searchsorted(other, anchor + reach, "right")
        anchor = anchor[high > low]
    return anchor


def search_index(index: DataFrame, windows: DataFrame, slack: int | None = None) -> DataFrame:
    """Per document of the index: ``(row_key, doc_id, n_words, n_hit, found)``, ``found`` being the windows that occur in it.

    With ``slack`` the match is by proximity and ``n_hit`` counts the anchor words alone.
    """
    ranked = stage(rarest_first(windows, index), "index-windows")
    anchors = ranked.select("window", "terms", "offsets", F.col("terms")[0].alias("term"))
    asked = index.filter(F.col("term").isNotNull()).select("shard", "term").join(anchors, "term")
    asked = asked.select(F.col("shard").alias("asked"), "window", "terms", "offsets")

    def evaluate(key, left: pa.Table, right: pa.Table) -> pa.Table:
        lists, starts, counts, ids = {}, None, None, []
        for term, places, doc_ids in zip(*(right.column(c) for c in ("term", "places", "doc_ids")), strict=True):
            raw = places.as_py()
            if term.as_py() is None:
                (starts, counts), ids = np.frombuffer(raw, np.int64).reshape(2, -1), doc_ids.as_py()
            else:
                lists[term.as_py()] = np.frombuffer(raw, np.uint32)
        covered, pairs = [], []
        for window, terms, offsets in zip(*(left.column(c) for c in ("window", "terms", "offsets")), strict=True):
            terms, offsets = terms.as_py(), offsets.as_py()
            at = phrase_starts(lists, terms, offsets) if slack is None else near_starts(lists, terms, offsets, slack)
            if len(at):
                doc = np.unique(np.searchsorted(starts, at, "right") - 1)
                pairs.append(np.column_stack((doc, np.full(len(doc), window.as_py(), np.int64))))
                covered.append((at[:, None] + np.arange(len(terms) if slack is None else 1)).ravel())
        n_hit = np.zeros(len(ids), np.int64)
        found = [[] for _ in ids]
        if covered:
            words = np.unique(np.concatenate(covered))
            n_hit = np.bincount(np.searchsorted(starts, words, "right") - 1, minlength=len(ids))
            for doc, window in np.concatenate(pairs).tolist():
                found[doc].append(window)
        shard = key[0].as_py()
        return pa.table(
            {
                "shard": pa.array(np.full(len(ids), shard, np.int64)), "nth": pa.array(np.arange(len(ids), dtype=np.int64)),
                "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(np.array(counts if counts is not None else [], np.int64)),
                "n_hit": pa.array(n_hit.astype(np.int64)), "found": pa.array(found, pa.list_(pa.int64())),
            }
        )

    schema = "shard long, nth long, doc_id long, n_words long, n_hit long, found array<long>"
    return asked.groupBy("asked").cogroup(index.groupBy("shard")).applyInArrow(evaluate, schema)


def find_benchmark(docs: DataFrame, items: DataFrame, key: str = "doc_id", width: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: key, n_words, n_hit, n_items, items_sha256, contaminated.

    ``docs`` has ``text``, ``items`` has ``item_id`` and ``text``; null and empty texts have no words. Repeated rows are
    each judged. Without items nothing is hit. Keys must be integers.
    """
    windows = stage(test_windows(items, width), "test-windows")
    with small_batches(docs.sparkSession, TEXTS_PER_BATCH):
        index = stage(build_index(docs, key, term_bitmap(windows), width), "positional-index")
    rows = stage(search_index(index, windows), "index-hits")
    owners = windows.select("window", "item_id").distinct()
    per_doc = (
        rows.select("shard", "nth", F.explode("found").alias("window"))
        .join(owners, "window")
        .groupBy("shard", "nth")
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    names = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return rows.join(per_doc, ["shard", "nth"], "left").select(
        F.col("doc_id").alias(key), "n_words", "n_hit", F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key has no exact test phrase; rows without a key count as one document."""
    dirty = find_benchmark(docs, items, key).filter("contaminated").select(F.col(key).alias("dirty_id")).distinct()
    return docs.join(dirty, docs[key].eqNullSafe(dirty["dirty_id"]), "left_anti")
