"""Periodic runs of words in a text: maximal stretches that repeat with a smallest period, and texts with the repeats cut.

The runs of a sequence are found from longest common extensions:

1. A suffix tree of the sequence and one of its reversal are built by Ukkonen's algorithm.
2. Between two leaves that follow each other in the Euler tour of a tree, the shallowest node is their lowest common
   ancestor. A table of minima over these depths answers the ancestor of any two leaves, so their common prefix, in
   constant time; the tree of the reversal answers common suffixes.
3. Every run holds a Lyndon root: the longest Lyndon word that begins at some position, by the order of the words or by
   its reverse. It ends before the next smaller (or next greater) suffix. These two candidates of each position are
   extended in both directions; those that get long enough are the runs.

Trees are grown only over stretches that can hold a run. In a run of at least ``max(6, 4 q)`` words of period ``q``
every window of five words has an equal one exactly ``q`` words further on or back, and ``q`` is at most a quarter of the
stretch of such windows around it. Windows without an equal one that near cannot belong to a run, and cutting them
away leaves every run whole; hashes can only let too many windows pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanvane.llm.shared import WORD, WordHashes, group_offsets, release_memory, text_bytes

LEAST_WORDS = 6
LEAST_EXPONENT = 4
# Words of the windows that choose stretches: the shortest run, of period one, has two of them.
WINDOW = LEAST_WORDS - 1
TEXTS_PER_BATCH = 256


# ---------------------------------------------------------------- suffix tree


def suffix_tree(tokens: list[int]) -> tuple[dict[int, int], list[int], list[int], int]:
    """Ukkonen's tree of ``tokens``, whose last entry occurs nowhere else and whose entries are 0 to their largest.

    Edges as ``child of (node * width + first token)``, and for each node where the label of the edge to it begins and
    ends. Node 0 is the root. Leaves come into being in the order of the suffixes they stand for.
    """
    n, width = len(tokens), max(tokens) + 1
    child_of: dict[int, int] = {}
    begin, end, link = [0], [0], [0]
    node = edge = depth = pending = 0  # depth: words matched on the edge below node that starts with tokens[edge]
    for i, token in enumerate(tokens):
        pending += 1
        unlinked = 0
        while pending:
            if not depth:
                edge = i
            key = node * width + tokens[edge]
            child = child_of.get(key)
            if child is None:
                child_of[key] = len(begin)
                begin.append(i)
                end.append(n)
                link.append(0)
                if unlinked:
                    link[unlinked] = node
                    unlinked = 0
            else:
                at = begin[child]
                span = end[child] - at
                if depth >= span:
                    node, edge, depth = child, edge + span, depth - span
                    continue
                if tokens[at + depth] == token:
                    if unlinked:
                        link[unlinked] = node
                    depth += 1
                    break
                split = len(begin)
                begin += (at, i)
                end += (at + depth, n)
                link += (0, 0)
                begin[child] = at + depth
                child_of[key] = split
                child_of[split * width + token] = split + 1
                child_of[split * width + tokens[at + depth]] = child
                if unlinked:
                    link[unlinked] = split
                unlinked = split
            pending -= 1
            if node:
                node = link[node]
            elif depth:
                depth -= 1
                edge = i - pending + 1
    return child_of, begin, end, width


class CommonExtension:
    """Longest common prefix of any two suffixes of a sequence, and the order of the suffixes."""

    def __init__(self, tokens: np.ndarray):
        """``tokens`` are numbers from 1; 0 closes the sequence."""
        n = len(tokens)
        child_of, begin, end, width = suffix_tree([*tokens.tolist(), 0])
        keys, below = np.fromiter(child_of, np.int64, len(child_of)), np.fromiter(child_of.values(), np.int64, len(child_of))
        del child_of
        order = np.argsort(keys)
        keys, below = keys[order] // width, below[order]
        first = np.searchsorted(keys, np.arange(len(begin) + 1)).tolist()
        span = (np.array(end) - np.array(begin)).tolist()
        leaves = np.flatnonzero(np.diff(first) == 0)  # in the order of their suffixes
        suffix_of = np.full(len(begin), -1)
        suffix_of[leaves] = np.arange(len(leaves))
        self.rank, low = self._tour(below.tolist(), first, span, suffix_of.tolist(), n + 1)
        self.length = n
        self._minima(low)

    @staticmethod
    def _tour(below: list[int], first: list[int], span: list[int], suffix_of: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Place of each suffix in the tour, and the depth of the shallowest node between each leaf and the one before."""
        places, low = [0] * n, [0] * n
        at = shallow = 0
        # a node waits with the depth of its parent, negative (less one) unless it is the parent's first child
        stack = [(0, 0)]
        while stack:
            node, depth = stack.pop()
            if depth < 0:
                depth = -1 - depth
                shallow = depth
            suffix = suffix_of[node]
            if suffix >= 0:
                places[suffix], low[at] = at, shallow
                at += 1
            else:
                depth += span[node]
                a, b = first[node], first[node + 1]
                later = -1 - depth
                stack += [(c, later) for c in below[b - 1 : a : -1]]
                stack.append((below[a], depth))
        return np.array(places), np.array(low, np.int32)

    def _minima(self, low: np.ndarray) -> None:
        self.table = [low]
        step = 1
        while 2 * step <= len(low):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefix lengths of suffixes ``i`` and ``j``, which differ pair by pair."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp(hi - lo)[1] - 1
        out = np.zeros(len(lo), np.int64)
        for k in np.unique(level).tolist():
            mine = level == k
            row = self.table[k]
            out[mine] = np.minimum(row[lo[mine]], row[hi[mine] - (1 << k)])
        return out


# ---------------------------------------------------------------- runs


def _next_beyond(rank: list[int], smaller: bool) -> np.ndarray:
    """First later position of smaller (or greater) rank; the length where there is none."""
    n = len(rank)
    out, stack = [n] * n, []
    for i in range(n - 1, -1, -1):
        r = rank[i]
        while stack and (rank[stack[-1]] > r if smaller else rank[stack[-1]] < r):
            stack.pop()
        if stack:
            out[i] = stack[-1]
        stack.append(i)
    return np.array(out)


def runs_of(tokens: np.ndarray, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Rows ``(start, length, period)`` of the runs of a sequence of numbers from 1, by start and length."""
    n = len(tokens)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    ahead, back = CommonExtension(tokens), CommonExtension(tokens[::-1])
    rank = ahead.rank[:n].tolist()
    i = np.concatenate((np.arange(n), np.arange(n)))
    j = np.concatenate((_next_beyond(rank, True), _next_beyond(rank, False)))
    i, j = i[j < n], j[j < n]  # of its four and more roots a run has one that something follows
    right = ahead.common(i, j)
    left = np.where(i > 0, back.common(n - i, n - j), 0)
    start, period = i - left, j - i
    length = j + right - start
    kept = length >= np.maximum(least_words, least_exponent * period)
    found = np.unique(np.column_stack((start, length, period))[kept].reshape(-1, 3), axis=0)
    # near the end of the sequence a candidate can be several roots long; the stretch then comes with its root as well
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    return found[first]


def stretches(words: list[bytes]) -> list[tuple[int, int]]:
    """Word ranges outside which no run of ``LEAST_WORDS`` words and exponent ``LEAST_EXPONENT`` reaches."""
    if len(words) < LEAST_WORDS:
        return []
    hashes = WordHashes(words).runs(WINDOW)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not same.any():
        return []
    gap = np.where(same, order[1:] - order[:-1], len(words))
    near = np.full(len(hashes), len(words))
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    kept = np.flatnonzero(near < len(words))
    while len(kept):
        cut = group_offsets(kept - np.arange(len(kept)))
        size = np.diff(cut)
        fits = LEAST_EXPONENT * near[kept] <= np.repeat(size, size) + WINDOW - 1
        if fits.all():
            return [(int(kept[a]), int(kept[b - 1]) + WINDOW) for a, b in zip(cut[:-1], cut[1:], strict=True) if b - a > 1]
        kept = kept[fits]
    return []


def text_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of a list of words, by start, then period."""
    found = []
    for a, b in stretches(words):
        number: dict[bytes, int] = {}
        tokens = np.array([number.setdefault(w, len(number) + 1) for w in words[a:b]])
        found += [(a + s, n, q) for s, n, q in runs_of(tokens).tolist()]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words without those that a run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_words, runs, collapsed)`` of every row; ``runs`` are structs ``(start, length, period)``, words from 0.

    Words are separated by blanks, tabs and line ends; runs have at least six words and four periods, and are maximal for
    their smallest period. ``collapsed`` are the words outside the repeats of every run, joined by one space. Null, empty
    and blank texts have no words, no runs and an empty ``collapsed``; texts are taken whole at any length; repeated
    rows and repeated keys give a row each, null keys stay; other columns are ignored. An empty table gives no rows.
    One pass over the rows, no exchange.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    struct = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, TEXTS_PER_BATCH):
                batch = whole.slice(low, TEXTS_PER_BATCH)
                sizes, runs, kept = [], [], []
                for value in batch.column(1):
                    words = text_bytes(value.as_py()).split()
                    found = text_runs(words)
                    sizes.append(len(words))
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                    kept.append(b" ".join(collapse(words, found)).decode())
                arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, struct), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, [key, "n_words", "runs", "collapsed"])
        release_memory()

    return docs.select(key, text).mapInArrow(find, schema)


# ---------------------------------------------------------------- the query's texts and digests


def with_planted_periods(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text)``; of keys whose CRC-32 ends in 0 the tail of the text becomes periodic, null keys stay as they are."""
    h = F.crc32(F.col(key).cast("string"))
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), 0)
    n, g = F.size("w").cast("long"), F.floor(F.col("h") / 10)
    a = F.col("g") % n
    p = F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + F.col("g") % 8))
    place = lambda i: F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i)
    moved = F.array_join(F.transform("w", lambda w, i: F.get("w", place(i).cast("int"))), " ")
    chosen = F.col("h") % 10 == 0
    named = docs.select(F.col(key), F.col(text).alias("t"), h.alias("h"), words.alias("all"))
    named = named.select(key, "t", "h", F.when(chosen, F.col("all")).alias("w"), g.alias("g"))
    sized = named.withColumn("a", F.when(n > 0, a)).withColumn("p", p)
    return sized.select(key, F.when(chosen & (n > 0), moved).otherwise(F.col("t")).alias(text))


def _better(a: Column, b: Column) -> Column:
    """Whether run ``b`` comes before ``a``: greater exact exponent, then smaller start, then smaller period."""
    left, right = b["length"] * a["period"], a["length"] * b["period"]
    return (left > right) | ((left == right) & ((b["start"] < a["start"]) | ((b["start"] == a["start"]) & (b["period"] < a["period"]))))


def run_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of runs, the one of greatest exponent, and digests of all runs and of the collapsed text."""
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda a, b: F.when(_better(a, b), b).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    top = lambda c: F.col("best")[c]
    return found.withColumn("best", best).select(
        key, F.size("runs").cast("long").alias("n_runs"), top("start").alias("start"), top("length").alias("length"), top("period").alias("period"),
        F.floor(F.lit(1000) * top("length") / top("period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
