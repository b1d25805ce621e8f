"""Toxicity scores by a factorization machine over hashed terms.

Terms are words and word beginnings, hashed to a fixed number of buckets. A chi-square test over the training rows
keeps the buckets that tell the classes apart, by themselves or as one of two words that stand near each other and tell nothing alone;
on their presence a factorization machine learns one weight and one short
vector each, so that pairs of terms count beyond their sum. Scoring is one pass with the few kept weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanvane.llm.shared import WordHashes, crc_fold, key_hash, mix, release_memory, stage, text_bytes

BUCKET_BITS = 20
PREFIXES = (4, 5, 6)
KEPT_TERMS = 2048
MIN_CHI2 = 28.0  # one in ten million by chance at one degree of freedom, as about a million buckets are tried
PAIR_WINDOW = 8  # words within which two words make a pair of the test
PAIR_BITS = 22
PAIR_TERMS = 256
MIN_PAIR_CHI2 = 34.0  # one in 200 million by chance, as four million buckets of pairs are tried
FACTORS = 4
TRAIN_ROWS = 20_000
_EDGE = b".,;:!?\"'()[]{}<>*#%&$|~_-+=/\\"
_STRIP = bytes(32 if c in _EDGE else c for c in range(256))


def hashed_terms(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of the words and word beginnings of a text, lower-cased, without ASCII punctuation."""
    return terms_and_words(text)[0]


def terms_and_words(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """``hashed_terms`` and the buckets of the words alone, in their order."""
    words = text_bytes(text and text.lower()).translate(_STRIP).split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    hashes, shift = WordHashes(words), np.uint64(64 - BUCKET_BITS)
    own = hashes.words() >> shift
    every = np.concatenate([own, *(hashes.prefixes(n) >> shift for n in PREFIXES)])
    return np.unique(every).astype(np.int64), own.astype(np.int32)


@dataclass
class FactorizationMachine:
    """Kept buckets (sorted), their weights and factors, and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        terms = hashed_terms(text)
        if len(self.buckets) and len(terms):
            at = np.searchsorted(self.buckets, terms)
            at[at == len(self.buckets)] = 0
            at = at[self.buckets[at] == terms]
        else:
            at = np.zeros(0, np.int64)
        v = self.factors[at]
        pairs = 0.5 * (v.sum(0) ** 2 - (v**2).sum(0)).sum()
        margin = self.intercept + self.weights[at].sum() + pairs
        return float(1 / (1 + np.exp(-np.clip(margin, -500, 500))))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, keep, limit: int) -> DataFrame:
    """At most ``limit`` labelled rows ``(text, y)`` of those with ``keep``, by the smallest key hash."""
    known = labels.filter(keep & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(key_hash(F.col("doc_id")), "doc_id").limit(limit)
    known = F.broadcast(stage(known, "training-labels"))  # ``limit`` rows at most
    return docs.select("doc_id", "text").join(known, "doc_id").select("text", "y")


def select_terms(rows: DataFrame, kept: int = KEPT_TERMS, min_chi2: float = MIN_CHI2) -> np.ndarray:
    """Sorted buckets with the largest chi-square between presence and label, over rows ``(y, terms)``."""
    totals = rows.agg(F.count("*").alias("n"), F.sum("y").alias("pos")).first()
    n, pos = float(totals["n"]), float(totals["pos"] or 0)
    counts = rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("y").alias("hits"))
    gap = F.col("hits") * n - F.col("df") * F.lit(pos)
    chi2 = n * gap * gap / (F.col("df") * (n - F.col("df")) * F.lit(pos * (n - pos)))
    ranked = counts.filter((F.col("df") < n) & (F.col("df") >= 3)).select("term", chi2.alias("chi2")).filter(F.col("chi2") >= min_chi2)
    best = ranked.orderBy(F.desc("chi2"), "term").limit(kept).select("term").collect() if 0 < pos < n else []
    return np.sort(np.array([r["term"] for r in best], np.int64))


def near_pairs(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Distinct pairs of words at most ``PAIR_WINDOW`` apart, as one number with the smaller bucket first; ``known`` words make none."""
    fresh, codes = ~np.isin(words, known), []
    words = words.astype(np.uint64)
    for gap in range(1, min(PAIR_WINDOW, len(words) - 1) + 1):
        a, b, both = words[:-gap], words[gap:], fresh[:-gap] & fresh[gap:] & (words[:-gap] != words[gap:])
        codes.append((np.minimum(a, b) << np.uint64(BUCKET_BITS) | np.maximum(a, b))[both])
    return np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.uint64)


def select_pairs(rows: DataFrame, known: np.ndarray, limit: int = PAIR_TERMS, min_chi2: float = MIN_PAIR_CHI2) -> np.ndarray:
    """Sorted buckets of the words in the ``limit`` pairs of largest chi-square between nearness and label, over rows ``(y, words)``.

    Equal texts of a label count once. Pairs are first counted in hashed cells, summed packed; those of cells that pass are then counted each.
    """
    shift, block = np.uint64(64 - PAIR_BITS), 1 << 16

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << PAIR_BITS), np.uint32)
        for batch in batches:
            for y, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts[y, np.unique(mix(near_pairs(np.frombuffer(words.as_py(), np.int32), known)) >> shift)] += 1
        if counts.any():
            codec = pa.Codec("zstd")
            parts = [np.ascontiguousarray(counts[:, a : a + block]).tobytes() for a in range(0, 1 << PAIR_BITS, block)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([codec.compress(p, asbytes=True) for p in parts], pa.binary())], ["block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        codec, total = pa.Codec("zstd"), np.zeros((2, block), np.float64)
        for part in table.column("counts").to_pylist():
            total += np.frombuffer(codec.decompress(part, 8 * block, asbytes=True), np.uint32).reshape(2, block)
        df, hits = total.sum(0), total[1]
        gap = hits * n - df * pos
        chi2 = n * gap * gap / np.maximum(df * (n - df) * pos * (n - pos), 1.0)
        at = np.flatnonzero((chi2 >= min_chi2) & (df >= 3))
        return pa.table({"cell": pa.array(at + block * table.column("block")[0].as_py(), pa.int64()), "chi2": pa.array(chi2[at])})

    rows = rows.filter("length(words) > 4").groupBy("y", "words").agg(F.lit(1)).select("y", "words")
    totals = rows.agg(F.count("*").alias("n"), F.sum("y").alias("pos")).first()
    n, pos = float(totals["n"]), float(totals["pos"] or 0)
    if not 0 < pos < n:
        return np.zeros(0, np.int64)
    passed = rows.mapInArrow(cells, "block int, counts binary").groupBy("block").applyInArrow(add, "cell long, chi2 double")
    passed = np.array([r["cell"] for r in passed.orderBy(F.desc("chi2"), "cell").limit(16 * limit).collect()], np.uint64)  # a cell may hold several pairs
    if not len(passed):
        return np.zeros(0, np.int64)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = near_pairs(np.frombuffer(words.as_py(), np.int32), known)
                found = found[np.isin(mix(found) >> shift, passed)].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), y, np.int32))], ["pair", "y"])

    counts = rows.mapInArrow(pairs, "pair long, y int").groupBy("pair").agg(F.count("*").alias("df"), F.sum("y").alias("hits"))
    gap = F.col("hits") * n - F.col("df") * F.lit(pos)
    chi2 = n * gap * gap / (F.col("df") * (n - F.col("df")) * F.lit(pos * (n - pos)))
    best = counts.filter((F.col("df") < n) & (F.col("df") >= 3)).select("pair", chi2.alias("chi2")).filter(F.col("chi2") >= min_chi2)
    found = np.array([r["pair"] for r in best.orderBy(F.desc("chi2"), "pair").limit(limit).collect()], np.int64)
    return np.unique(np.concatenate((found >> BUCKET_BITS, found & ((1 << BUCKET_BITS) - 1))))


def fit_machine(training: DataFrame, factors: int = FACTORS, steps: int = 120, seed: int = 17) -> FactorizationMachine:
    """Factorization machine of rows ``(text, y)``. With one class only, all scores are that class's smoothed share."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [terms_and_words(x.as_py()) for x in batch.column("text")]
            columns = [batch.column("y"), pa.array([t for t, _ in both], pa.list_(pa.int64())), pa.array([w.tobytes() for _, w in both], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["y", "terms", "words"])

    rows = stage(training.mapInArrow(terms, "y int, terms array<long>, words binary"), "training-terms")
    buckets = select_terms(rows)
    buckets = np.union1d(buckets, select_pairs(rows, buckets))
    share = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
    prior = (share["pos"] + 0.5) / (share["n"] + 1.0)
    if not len(buckets):
        return FactorizationMachine(buckets, np.zeros(0), np.zeros((0, factors)), float(np.log(prior / (1 - prior))))
    place = {int(b): i for i, b in enumerate(buckets)}
    size = len(buckets)

    @F.udf(VectorUDT())
    def vector(found: list[int]) -> SparseVector:
        at = sorted(place[t] for t in found if t in place)
        return SparseVector(size, at, [1.0] * len(at))

    data = rows.select(F.col("y").cast("double").alias("label"), vector("terms").alias("features")).persist()
    fm = FMClassifier(factorSize=factors, maxIter=steps, stepSize=0.1, regParam=1e-4, initStd=0.01, tol=1e-5, seed=seed, solver="adamW", miniBatchFraction=1.0)
    model = fm.fit(data)
    data.unpersist()
    return FactorizationMachine(buckets, model.linear.toArray(), model.factors.toArray(), float(model.intercept))


def score_texts(docs: DataFrame, machine: FactorizationMachine, key: str = "doc_id", column: str = "score") -> DataFrame:
    """``(key, score)`` for every row; null and empty texts get the score of no terms."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [machine.score(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], [key, column])

    return docs.select(F.col(key).cast("long").alias(key), "text").mapInArrow(score, f"{key} long, {column} double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, limit: int = TRAIN_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted. Rows whose id's CRC-32 leaves 1 modulo 3 teach nothing."""
    held_out = crc_fold(F.col("doc_id"), 3) == 1
    machine = fit_machine(training_rows(docs, labels, "toxic", ~held_out, limit))
    scored = score_texts(docs, machine)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, limit: int = TRAIN_ROWS) -> DataFrame:
    """Rows of ``docs`` whose own text scores under ``threshold``; one pass, no join. The columns stay."""
    held_out = crc_fold(F.col("doc_id"), 3) == 1
    machine = fit_machine(training_rows(docs, labels, "toxic", ~held_out, limit))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([machine.score(x.as_py()) for x in batch.column("text")])
            yield batch.filter(pa.array(scores < threshold, pa.bool_()))
        release_memory()

    return docs.mapInArrow(clean, docs.schema)
