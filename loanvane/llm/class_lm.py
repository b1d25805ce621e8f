"""Scores of a Brown class-based bigram model, learned from the whole corpus.

A seed comes from units: the most frequent words are units of their own, the others share one with the words of
like ending. Exchange clustering assigns units to classes so that the class bigrams of the corpus are likely. Then, for some
rounds, every other word seen ``LEAST_COUNT`` times or more goes to the class that raises that likelihood most, given the
classes that stand before and after it, and the frequent words are exchanged anew between the classes found; a round counts only
if the likelihood rose. Rarer and unknown words keep the class of their ending. The
model gives a word the probability of its class after the class before, times the word's share in its class.

Texts are cut into words once and kept as written chunks: the distinct words of a chunk, and per token the place of its word
among them. A chunk asks the word table, bucket by bucket, for the classes and counts of its distinct words. Counts and neighbours of all words
pass through packed exchanges. No word table is held in one place: only counts between units, and between classes, come to the driver. Written tables are
deleted once nothing reads them; the chunks and the last word table stay, as the result reads them.

Null and empty texts are an end alone; a text longer than a chunk is a chunk by itself; repeated rows are learned and scored each; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanvane.llm.shared import WordHashes, crc_fold, drop_shuffles, exchange_buckets, give_back, group_offsets, small_batches, stage, text_bytes

log = logging.getLogger(__name__)

FREQUENT_WORDS = 1000
ENDING_BITS = 8
CLASSES = 48
SWEEPS = 8
ROUNDS = 2
LEAST_COUNT = 3
SMOOTH = 0.1
FLUSH_WORDS = 2_000_000
BUCKET_BYTES = 1 << 27  # bytes of text per bucket of words, beyond as many buckets as shuffles have partitions
ENDING = 3
NO_ID = -(1 << 63)  # stands for a null key in packed arrays
_LOW = np.uint64(64 - ENDING_BITS)


def word_keys(text: str | None) -> np.ndarray:
    """64-bit keys of the words, A-Z lower-cased: the top bits tell the ending, the rest the word."""
    words = text_bytes(text).lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = WordHashes(words)
    ending = hashes.suffixes(ENDING) >> _LOW
    return ending << _LOW | (hashes.words() >> np.uint64(ENDING_BITS))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)


def _squeeze(values: np.ndarray) -> bytes:
    """Small numbers, byte by byte of their places of value, compressed: they pass through tables and shuffles in this form."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.Codec("zstd").compress(raw, asbytes=True) if raw else b"")


def _open(packed: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    raw = pa.Codec("zstd").decompress(packed[8:], size, asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


# ---------------------------------------------------------------- chunks


def pack_texts(texts: DataFrame) -> DataFrame:
    """Written table of chunks ``(chunk, held, ids, lengths, places, keys)`` of rows ``(doc, text, held)``.

    ``keys`` has the distinct words of the chunk, the usual ones first, ``places`` for each token the place of its word in there. Held-out rows have chunks of their own.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        parts = {held: ([], []) for held in (False, True)}
        sizes = {False: 0, True: 0}

        def flush(held: bool) -> pa.RecordBatch:
            ids, words = parts[held]
            keys, place, n = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            columns = (np.array(ids, np.int64).tobytes(), np.array([len(w) for w in words], np.int64).tobytes(), _squeeze(rank[place]), keys[order].tobytes())
            parts[held], sizes[held] = ([], []), 0
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | seq]), pa.array([held]), *(pa.array([c], pa.binary()) for c in columns)], ["chunk", "held", "ids", "lengths", "places", "keys"]
            )

        for batch in batches:
            for doc, text, held in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = word_keys(text.as_py())
                parts[held][0].append(NO_ID if doc is None else doc)
                parts[held][1].append(words)
                sizes[held] += len(words) + 1
                if sizes[held] >= FLUSH_WORDS:
                    yield flush(held)
                    seq += 1
        for held in (False, True):
            if sizes[held]:
                yield flush(held)
                seq += 1

    packed = texts.select("doc", "text", "held").mapInArrow(pack, "chunk long, held boolean, ids binary, lengths binary, places binary, keys binary")
    return stage(packed, "lm-chunks")


def _bordered(values: np.ndarray, lengths: np.ndarray, edge) -> np.ndarray:
    """Values of the tokens of all texts, with ``edge`` before, between and after the texts."""
    out = np.full(len(values) + len(lengths) + 1, edge, np.result_type(values, np.min_scalar_type(edge)))
    out[_token_places(lengths)] = values
    return out


def _token_places(lengths: np.ndarray) -> np.ndarray:
    return np.arange(lengths.sum()) + np.repeat(np.arange(len(lengths)), lengths) + 1


def count_words(chunks: DataFrame, buckets: int) -> DataFrame:
    """Written table ``(bucket, keys, counts, n, v)``: per bucket all words of ``chunks`` (sorted) and their counts."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, places in zip(batch.column(0), batch.column(1), strict=True):
                keys = np.frombuffer(keys.as_py(), np.uint64)
                if not len(keys):
                    continue
                counts, at = np.bincount(_open(places.as_py(), np.uint32), minlength=len(keys)).astype(np.uint32), _bucket(keys, buckets)
                order = np.argsort(at, kind="stable")
                keys, counts, at = keys[order], counts[order], at[order]
                runs = group_offsets(at)
                cut = list(zip(runs[:-1], runs[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at[runs[:-1]].astype(np.int32)), pa.array([keys[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([_squeeze(counts[a:b]) for a, b in cut], pa.binary())],
                    ["bucket", "keys", "counts"],
                )

    def total(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64)
        counts = np.concatenate([_open(x, np.uint32) for x in table.column("counts").to_pylist()])
        distinct, at = np.unique(keys, return_inverse=True)
        sums = np.bincount(at, counts, len(distinct)).astype(np.int64)
        return pa.table(
            {
                "bucket": table.column("bucket")[:1], "keys": pa.array([distinct.tobytes()], pa.binary()), "counts": pa.array([sums.tobytes()], pa.binary()),
                "n": pa.array([int(sums.sum())], pa.int64()), "v": pa.array([len(distinct)], pa.int64()),
            }
        )

    packed = chunks.select("keys", "places").mapInArrow(gather, "bucket int, keys binary, counts binary")
    return stage(packed.groupBy("bucket").applyInArrow(total, "bucket int, keys binary, counts binary, n long, v long"), "lm-words")


def frequent_words(vocabulary: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (sorted) and counts of the ``limit`` most frequent words."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(0), batch.column(1), strict=True):
                key, n = np.frombuffer(keys.as_py(), np.uint64), np.frombuffer(counts.as_py(), np.int64)
                best = np.lexsort((key, -n))[:limit]
                yield pa.RecordBatch.from_arrays([pa.array(key[best].view(np.int64)), pa.array(n[best])], ["key", "n"])

    rows = vocabulary.select("keys", "counts").mapInArrow(top, "key long, n long").orderBy(F.desc("n"), "key").limit(limit).collect()
    keys = np.array([r["key"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r["n"] for r in rows], np.int64)[order]


def units_of(keys: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Unit of each word: the place of a frequent word, or behind them the word's ending."""
    units = (keys >> _LOW).astype(np.int64) + len(frequent)
    if len(frequent):
        at = np.searchsorted(frequent, keys)
        at[at == len(frequent)] = 0
        units = np.where(frequent[at] == keys, at, units)
    return units


# ---------------------------------------------------------------- neighbours

_NEIGHBOURS = "b int, words binary, each binary, side binary, n binary"


def neighbours(keys: np.ndarray, units: np.ndarray, places: np.ndarray, lengths: np.ndarray, size: int, frequent: int, buckets: int) -> pa.RecordBatch:
    """Neighbours of a chunk's words whose units are not ``frequent``, a row per bucket, and in a row without bucket the bigrams of all units.

    ``each`` tells how many neighbours a word has; ``side`` is the unit before it, or ``size`` and the unit after it; ``n`` are their counts. The last of ``size`` units is the border.
    """
    order = np.argsort(_bucket(keys, buckets), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    keys, units, places = keys[order], units[order], rank[places]
    path, at = _bordered(units[places], lengths, size - 1), _token_places(lengths)
    bigrams, counts = np.unique(path[:-1] * size + path[1:], return_counts=True)
    rows = [(None, _squeeze(bigrams), None, None, _squeeze(counts.astype(np.int64)))]
    rare = units[places] >= frequent
    at, word = at[rare], places[rare] * (2 * size)
    pairs, counts = np.unique(np.concatenate((word + path[at - 1], word + size + path[at + 1])), return_counts=True)
    word, side, counts = pairs // (2 * size), (pairs % (2 * size)).astype(_small(2 * size)), counts.astype(np.uint32)
    runs = group_offsets(word)
    words, each = keys[word[runs[:-1]]], np.diff(runs).astype(np.uint32)
    bucket = _bucket(words, buckets)
    ends = group_offsets(bucket)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        c, d = runs[a], runs[b]
        rows.append((int(bucket[a]), words[a:b].tobytes(), _squeeze(each[a:b]), _squeeze(side[c:d]), _squeeze(counts[c:d])))
    types = (pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["b", "words", "each", "side", "n"])


def seed_neighbours(chunks: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
    """Written ``neighbours`` of all chunks by the units of the seed."""
    size = len(frequent) + (1 << ENDING_BITS) + 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lengths, places, keys in zip(*(batch.column(i) for i in range(3)), strict=True):
                keys = np.frombuffer(keys.as_py(), np.uint64)
                yield neighbours(
                    keys, units_of(keys, frequent), _open(places.as_py(), np.uint32), np.frombuffer(lengths.as_py(), np.int64), size, len(frequent), buckets
                )

    return stage(chunks.select("lengths", "places", "keys").mapInArrow(find, _NEIGHBOURS), "lm-neighbours")


def unit_bigrams(found: DataFrame, size: int) -> np.ndarray:
    """Counts of neighbouring units from written ``neighbours``; the last unit stands before and after each text."""

    def open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, counts in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(_open(pairs.as_py(), np.int64)), pa.array(_open(counts.as_py(), np.int64))], ["pair", "n"])

    rows = found.filter(F.col("b").isNull()).select("words", "n").mapInArrow(open_rows, "pair long, n long")
    sums = rows.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # size**2 rows at most
    bigrams = np.zeros(size * size, np.float64)
    bigrams[sums.column("pair").to_numpy()] = sums.column("n").to_numpy()
    return bigrams.reshape(size, size)


# ---------------------------------------------------------------- exchange clustering


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(joint: np.ndarray) -> float:
    """Log-likelihood of class bigrams, but for a constant of the words' own counts."""
    return float(_plogp(joint).sum() - _plogp(joint.sum(1)).sum() - _plogp(joint.sum(0)).sum())


def folded(bigrams: np.ndarray, of: np.ndarray, classes: int) -> np.ndarray:
    """Counts between classes from counts between units of classes ``of``."""
    member = np.zeros((len(of), classes))
    member[np.arange(len(of)), of] = 1
    return member.T @ bigrams @ member


def exchange_classes(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS, start: np.ndarray | None = None, movable: int | None = None) -> np.ndarray:
    """Class of each unit; the last unit (text border) keeps the last class for itself.

    Units start by frequency rank, or from ``start``, and are moved one at a time to the class that raises the class bigram likelihood
    most, until a sweep moves none. With ``movable`` only that many first units move.
    """
    size = len(bigrams)
    totals = bigrams.sum(0) + bigrams.sum(1)
    order = np.lexsort((np.arange(size - 1), -totals[: size - 1]))
    free = classes - 1
    if start is None:
        of = np.empty(size, np.int64)
        of[order] = np.arange(size - 1) % free
        of[size - 1] = free
    else:
        of = start.astype(np.int64)
    member = np.zeros((size, classes))
    member[np.arange(size), of] = 1
    joint = folded(bigrams, of, classes)
    right, left = bigrams @ member, bigrams.T @ member  # unit to following class, unit to preceding class
    used = order[totals[order] > 0]
    if movable is not None:
        used = used[used < movable]
    for _ in range(sweeps):
        moved = 0
        for u in used:
            home, own = of[u], bigrams[u, u]
            r, l = right[u].copy(), left[u].copy()
            r[home] -= own
            l[home] -= own
            # take u out of its class
            joint[home] -= r
            joint[:, home] -= l
            joint[home, home] -= own
            row, col = joint.sum(1), joint.sum(0)
            rs, ls = r.sum() + own, l.sum() + own
            # change of the likelihood for each class it could go to; cells (c, d) and (d, c) change by r[d] and l[d]
            gain = (_plogp(joint + r[None, :]) - _plogp(joint)).sum(1) + (_plogp(joint.T + l[None, :]) - _plogp(joint.T)).sum(1)
            d = np.diag(joint)
            rd, ld = r, l
            gain += _plogp(d + rd + ld + own) - _plogp(d + rd) - _plogp(d + ld) + _plogp(d)
            gain += _plogp(row) - _plogp(row + rs) + _plogp(col) - _plogp(col + ls)
            best = int(np.argmax(gain[:free]))
            if gain[best] <= gain[home] + 1e-9:
                best = home
            joint[best] += r
            joint[:, best] += l
            joint[best, best] += own
            if best != home:
                moved += 1
                of[u] = best
                into, out = bigrams[:, u], bigrams[u]
                right[:, home] -= into
                right[:, best] += into
                left[:, home] -= out
                left[:, best] += out
        if not moved:
            break
    return of


# ---------------------------------------------------------------- classes of all words


def _small(n: int) -> type:
    """Least integer type for ``n`` values."""
    return np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.uint32


def _classes_of(keys: np.ndarray, held: bytes | None, state: dict) -> np.ndarray:
    """Classes of words: those of the frequent ones, else ``held`` of the table, else those of the endings."""
    units = units_of(keys, state["frequent"])
    classes = state["endings"][(keys >> _LOW).astype(np.int64)] if held is None else np.frombuffer(held, _small(state["classes"])).astype(np.int64)
    known = units < len(state["frequent"])
    return np.where(known, state["of"][np.where(known, units, 0)], classes) if len(state["frequent"]) else classes


def class_gains(table: np.ndarray, home: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """Gain of the class bigram likelihood for each word (row) in each class, all others staying where they are.

    ``table`` has the counts of classes before the word, then of those after it; ``home`` is the class that ``joint`` counts it in. Exact but for words beside themselves.
    """
    size, rows = len(joint), np.arange(len(table))
    word, side = np.nonzero(table)
    n = table[word, side]
    base = np.vstack((joint, joint.T))[side]
    cells = _plogp(base + n[:, None]) - _plogp(base)
    at, own = np.arange(len(word)), home[word]
    cells[at, own] = _plogp(base[at, own]) - _plogp(base[at, own] - n)
    gains = np.zeros((len(table), size))
    some, starts = np.unique(word, return_index=True)
    if len(some):
        gains[some] = np.add.reduceat(cells, starts)
    before, after = table[:, :size], table[:, size:]
    for sums, change in ((joint.sum(1), after.sum(1)), (joint.sum(0), before.sum(1))):
        loss = _plogp(sums + change[:, None]) - _plogp(sums)
        loss[rows, home] = _plogp(sums[home]) - _plogp(sums[home] - change)
        gains -= loss
    d, sign = np.diag(joint)[None, :], np.ones(gains.shape)
    sign[rows, home] = -1  # the word is in there already
    both = _plogp(d + sign * (before + after)) - _plogp(d + sign * before) - _plogp(d + sign * after) + _plogp(d)
    gains += sign * both
    # cells between home and the other class lose the word on one side as they get it on the other
    for cell, out, into in ((joint.T[home], before, after[rows, home]), (joint[home], after, before[rows, home])):
        cross = _plogp(cell - out + into[:, None]) - _plogp(cell - out) - _plogp(cell + into[:, None]) + _plogp(cell)
        cross[rows, home] = 0
        gains += cross
    return gains


def place_words(found: DataFrame, vocabulary: DataFrame, fold: np.ndarray, joint: np.ndarray, state: dict) -> DataFrame:
    """Written table ``(bucket, keys, counts, classes)``: ``vocabulary`` with each word's class by its own neighbours.

    ``found`` are written ``neighbours`` by units of classes ``fold``. Words start from the column ``classes`` of ``vocabulary``, or from their endings' classes where it is null.
    """
    size, units = len(joint), len(fold)
    kind, frequent = _small(2 * units), state["frequent"]
    sides = np.concatenate((fold, size + fold))

    def place(known: pa.Table, seen: pa.Table) -> pa.Table:
        names = ["bucket", "keys", "counts", "classes"]
        if not known.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.binary(), pa.binary(), pa.binary())], names)
        keys, counts = np.frombuffer(known.column("keys")[0].as_py(), np.uint64), np.frombuffer(known.column("counts")[0].as_py(), np.int64)
        classes = _classes_of(keys, known.column("classes")[0].as_py(), state)
        movable = np.flatnonzero((units_of(keys, frequent) >= len(frequent)) & (counts >= LEAST_COUNT))
        slot = np.full(len(keys), -1)
        slot[movable] = np.arange(len(movable))
        cells, sums = [], []
        for words, each, side, n in zip(*(seen.column(c) for c in ("words", "each", "side", "n")), strict=True):
            own = np.repeat(slot[np.searchsorted(keys, np.frombuffer(words.as_py(), np.uint64))], _open(each.as_py(), np.uint32))
            there = own >= 0
            cells.append(own[there] * (2 * size) + sides[_open(side.as_py(), kind)[there]])
            sums.append(_open(n.as_py(), np.uint32)[there])
        if len(movable) and cells:
            cells, sums = np.concatenate(cells), np.concatenate(sums)
            order = np.argsort(cells, kind="stable")
            cells, sums = cells[order], sums[order]
            step = 1 << 10
            for a in range(0, len(movable), step):
                b = min(a + step, len(movable))
                c, d = np.searchsorted(cells, (a * 2 * size, b * 2 * size))
                table = np.bincount(cells[c:d] - a * 2 * size, sums[c:d], (b - a) * 2 * size).reshape(b - a, 2 * size)
                home = classes[movable[a:b]]
                gains = class_gains(table, home, joint)[:, :-1]
                best, every = np.argmax(gains, 1), np.arange(b - a)
                classes[movable[a:b]] = np.where(gains[every, best] > gains[every, home] + 1e-9, best, home)
        return pa.table(
            [known.column("bucket"), known.column("keys"), known.column("counts"), pa.array([classes.astype(_small(size)).tobytes()], pa.binary())], names
        )

    left = vocabulary.select("bucket", "keys", "counts", "classes").groupBy("bucket")
    placed = left.cogroup(found.filter(F.col("b").isNotNull()).groupBy("b")).applyInArrow(place, "bucket int, keys binary, counts binary, classes binary")
    return stage(placed, "lm-classes")


def look_up(chunks: DataFrame, table: DataFrame, state: dict, buckets: int, settle, schema: str, with_counts: bool) -> DataFrame:
    """``settle(head, classes, counts)`` of every chunk, with the classes (and counts) of its distinct words by ``table``."""
    kind = _small(state["classes"])
    names, types = ["chunk", "bucket", "classes", "counts"], (pa.int64(), pa.int32(), pa.binary(), pa.binary())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, keys in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys = np.frombuffer(keys.as_py(), np.uint64)
                at = _bucket(keys, buckets)
                order = np.argsort(at, kind="stable")
                keys, at = keys[order], at[order]
                runs = group_offsets(at)
                cut = list(zip(runs[:-1], runs[1:], strict=True))
                if cut:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([chunk] * len(cut)), pa.array(at[runs[:-1]].astype(np.int32)), pa.array([keys[a:b].tobytes() for a, b in cut], pa.binary())], ["chunk", "bucket", "words"]
                    )

    def answer(key, asked: pa.Table, known: pa.Table) -> pa.Table:
        words = counts = np.zeros(0, np.uint64)
        if known.num_rows:
            words, counts = np.frombuffer(known.column("keys")[0].as_py(), np.uint64), np.frombuffer(known.column("counts")[0].as_py(), np.int64)
            of_words = _classes_of(words, known.column("classes")[0].as_py(), state)
        out = []
        for chunk, own in zip(asked.column("chunk").to_pylist(), asked.column("words"), strict=True):
            word = np.frombuffer(own.as_py(), np.uint64)
            cls, n = _classes_of(word, None, state), np.zeros(len(word), np.int64)
            if len(words):
                at = np.searchsorted(words, word)
                at[at == len(words)] = 0
                hit = words[at] == word
                cls, n = np.where(hit, of_words[at], cls), np.where(hit, counts[at], 0)
            out.append((chunk, int(key[0].as_py()), _squeeze(cls.astype(kind)), _squeeze(n) if with_counts else None))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    def finish(head: pa.Table, answers: pa.Table) -> pa.Table:
        rows = sorted(zip(*(answers.column(c).to_pylist() for c in names[1:]), strict=True)) if answers.num_rows else []
        own = {c: np.frombuffer(head.column(c)[0].as_py(), t) for c, t in (("ids", np.int64), ("lengths", np.int64), ("keys", np.uint64))}
        own["places"] = _open(head.column("places")[0].as_py(), np.uint32)
        order = np.argsort(_bucket(own["keys"], buckets), kind="stable")
        classes, counts = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        if len(order):
            classes[order] = np.concatenate([_open(r[1], kind) for r in rows])
            if with_counts:
                counts[order] = np.concatenate([_open(r[2], np.int64) for r in rows])
        return settle(own, classes, counts)

    asked = chunks.select("chunk", "keys").mapInArrow(ask, "chunk long, bucket int, words binary")
    known = table.select(F.col("bucket").alias("k"), "keys", "counts", "classes")
    answers = asked.groupBy("bucket").cogroup(known.groupBy("k")).applyInArrow(_only_asked(answer, names, types), "chunk long, bucket int, classes binary, counts binary")
    heads = chunks.select("chunk", "ids", "lengths", "places", "keys").groupBy("chunk")
    return heads.cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)


def class_neighbours(chunks: DataFrame, table: DataFrame, state: dict, buckets: int) -> DataFrame:
    """Written ``neighbours`` of all chunks; units are the frequent words, then the classes of ``table`` for all others."""
    frequent = state["frequent"]
    size = len(frequent) + state["classes"]

    def settle(head: dict, classes: np.ndarray, _) -> pa.Table:
        units = units_of(head["keys"], frequent)
        units = np.where(units < len(frequent), units, len(frequent) + classes)
        found = neighbours(head["keys"], units, head["places"], head["lengths"], size, len(frequent), buckets)
        return pa.Table.from_batches([found])

    return stage(look_up(chunks, table, state, buckets, settle, _NEIGHBOURS, False), "lm-neighbours")


def class_sums(table: DataFrame, state: dict) -> tuple[np.ndarray, np.ndarray]:
    """Number of words and of tokens per class."""
    classes = state["classes"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, n = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
            for keys, counts, held in zip(*(batch.column(i) for i in range(3)), strict=True):
                of = _classes_of(np.frombuffer(keys.as_py(), np.uint64), held.as_py(), state)
                v += np.bincount(of, minlength=classes)
                n += np.bincount(of, np.frombuffer(counts.as_py(), np.int64), classes).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes)), pa.array(v), pa.array(n)], ["class", "v", "n"])

    found = table.select("keys", "counts", "classes").mapInArrow(sums, "class long, v long, n long").groupBy("class").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    v, n = np.zeros(classes), np.zeros(classes)
    for r in found.collect():
        v[r["class"]], n[r["class"]] = r["v"], r["n"]
    return v, n


# ---------------------------------------------------------------- scores


def class_model(train: DataFrame | None, buckets: int, frequent_limit: int, classes: int, rounds: int = ROUNDS, chunks: DataFrame | None = None) -> dict:
    """Everything scoring needs but the words' counts and classes, which stay in the table ``vocabulary``; learned from the texts of ``train``, or from packed ``chunks``."""
    if chunks is None:
        chunks = pack_texts(train.select(F.lit(0).cast("long").alias("doc"), "text", F.lit(False).alias("held")))
    spark = chunks.sparkSession
    with small_batches(spark, 4):  # rows are chunks
        vocabulary = count_words(chunks, buckets)
        frequent, _ = frequent_words(vocabulary, frequent_limit)
        drop_shuffles(spark)
        found = seed_neighbours(chunks, frequent, buckets)
    bigrams = unit_bigrams(found, len(frequent) + (1 << ENDING_BITS) + 1)
    fold = exchange_classes(bigrams, classes)
    ends = float(bigrams[-1].sum())
    state = {"frequent": frequent, "of": fold[: len(frequent)], "endings": fold[len(frequent) : -1], "classes": classes}
    joint = folded(bigrams, fold, classes)
    table, files = vocabulary.withColumn("classes", F.lit(None).cast("binary")), vocabulary
    for i in range(rounds):
        placed = place_words(found, table, fold, joint, state)
        give_back(found)
        found = None
        with small_batches(spark, 32):
            after = class_neighbours(chunks, placed, state, buckets)
        bigrams = unit_bigrams(after, len(frequent) + classes)
        start = np.concatenate((state["of"], np.arange(classes)))
        rose = likelihood(folded(bigrams, start, classes)) - likelihood(joint)
        log.info("round %d of placing words: log-likelihood changes by %.1f", i + 1, rose)
        if rose <= 0:
            give_back(placed, after)
            break
        give_back(files)
        table = files = placed
        found = after
        fold = exchange_classes(bigrams, classes, start=start, movable=len(frequent))
        state = state | {"of": fold[: len(frequent)]}
        joint = folded(bigrams, fold, classes)
    if found is not None:
        give_back(found)
    class_v, class_n = class_sums(table, state)
    n_all, v_all = float(class_n.sum() + ends), float(class_v.sum() + (ends > 0))
    class_v[-1], class_n[-1] = 1, ends
    return state | {
        "vocabulary": table, "step": np.log10((joint + SMOOTH) / (joint.sum(1, keepdims=True) + SMOOTH * classes)), "class_base": np.log10(class_n + SMOOTH * (class_v + 1)),
        "n": int(n_all), "base": float(np.log10(n_all + SMOOTH * (v_all + 1))), "end_log": float(np.log10(ends + SMOOTH)), "ends": ends, "joint": joint,
    }


def word_buckets(docs: DataFrame) -> int:
    """Buckets of the word table: as many as shuffles have partitions, and more where there are over ``BUCKET_BYTES`` of text for each."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    return max(exchange_buckets(docs.sparkSession), -(-total // BUCKET_BYTES))


def score_documents(
    docs: DataFrame, key: str = "doc_id", fold: int = 10, frequent_limit: int = FREQUENT_WORDS, classes: int = CLASSES
) -> DataFrame:
    """Per row of ``docs``: key, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    ``docs`` has an integer key and ``text``. Rows whose key's CRC-32 is divisible by ``fold`` are held out of learning. A text's end
    is a token; null and empty texts have that token alone. Rows of equal key are scored each.
    """
    buckets = word_buckets(docs)
    held_out = crc_fold(F.col("doc"), fold) == 0
    chunks = pack_texts(docs.select(F.col(key).cast("long").alias("doc"), "text").withColumn("held", held_out))
    model = class_model(None, buckets, frequent_limit, classes, chunks=chunks.filter(~F.col("held")))
    table = model.pop("vocabulary")
    state = {name: model[name] for name in ("frequent", "of", "endings", "classes")}
    local = {name: model[name] for name in ("step", "class_base", "end_log", "ends", "base")}

    def settle(head: dict, of_words: np.ndarray, counts: np.ndarray) -> pa.Table:
        ids, lengths, places = head["ids"], head["lengths"], head["places"]
        path = _bordered(of_words[places], lengths, classes - 1)
        logs = _bordered(np.log10(counts + SMOOTH)[places], lengths, local["end_log"])[1:]
        known = _bordered((counts > 0).astype(np.int64)[places], lengths, int(local["ends"] > 0))[1:]
        smooth = local["step"][path[:-1], path[1:]] - local["class_base"][path[1:]]
        n, starts = lengths + 1, np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        known, logs, smooth = (np.add.reduceat(x, starts) for x in (known, logs, smooth))
        return pa.table({"doc": ids, "n_tokens": n, "n_known": known, "base_score": logs - n * local["base"], "score": logs + smooth})

    result = look_up(chunks, table, state, buckets, settle, "doc long, n_tokens long, n_known long, base_score double, score double", True)
    result = result.withColumn("doc", F.nullif(F.col("doc"), F.lit(NO_ID)))
    return result.select(
        F.col("doc").alias(key), (crc_fold(F.col("doc"), fold) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model["n"]).cast("long").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def _only_asked(answer, names: list[str], types: tuple):
    """Buckets that no document asks for give no rows."""

    def either(key, asked: pa.Table, known: pa.Table) -> pa.Table:
        return answer(key, asked, known) if asked.num_rows else pa.table([pa.array([], t) for t in types], names)

    return either
