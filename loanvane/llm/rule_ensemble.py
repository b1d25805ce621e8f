"""Quality scores by a sparse rule ensemble.

Trees grown over text statistics give their root-to-node paths as conjunctive rules; a logistic model with a lasso
penalty keeps a few rules and weighs them; the kept rules become one Spark column expression over the statistics.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanvane.llm.factorization import training_rows
from loanvane.llm.shared import crc_fold, stage, text_bytes

STATISTICS = (
    "n_words", "n_lines", "mean_word", "long_words", "short_words", "upper_letters", "upper_words", "digits", "punctuation",
    "symbols", "exclamations", "bars", "beyond_ascii", "distinct_words", "top_word", "repeats_next", "same_tail",
    "stop_lines", "mean_line", "worst_line_symbols", "repeated_lines",
)
TRAIN_ROWS = 20_000
TREES = 30
DEPTH = 3
LASSO = 0.001

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>@^~_=+{}[]\\/")] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,;:!?'\"()-")] = True


def text_statistics(text: str | None) -> list[float]:
    """The statistics of a whole text in the order of ``STATISTICS``; all 0 without words."""
    raw = text_bytes(text)
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n = len(words)
    byte = np.frombuffer(raw, np.uint8)
    counts = np.bincount(byte, minlength=256)
    total = float(counts.sum() - counts[[32, 9, 10, 11, 12, 13]].sum())
    letters = max(1.0, float(counts[_LETTER].sum()))
    lengths = np.fromiter(map(len, words), np.int64, n)
    # word identity as small integers, for counts and runs
    ids: dict[bytes, int] = {}
    word_id = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    tails = [w[-3:] for w in words]
    tail_runs = sum(map(bytes.__eq__, tails, tails[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    marked = 0.0
    for line in lines:
        if len(line) >= 20:
            marked = max(marked, float(_SYMBOL[np.frombuffer(line, np.uint8)].mean()))
    upper = sum(map(bytes.isupper, words))
    stops = sum(x.rstrip().endswith((b".", b"!", b"?", b'"')) for x in lines)
    return [
        float(n), float(len(lines)), float(lengths.mean()), float((lengths > 12).mean()), float((lengths < 3).mean()),
        counts[_UPPER].sum() / letters, upper / n, counts[_DIGIT].sum() / total, counts[_PUNCT].sum() / total,
        counts[_SYMBOL].sum() / total, counts[33] / n, counts[124] / n, counts[128:].sum() / total, len(ids) / n,
        float(np.bincount(word_id).max()) / n, float((word_id[1:] == word_id[:-1]).sum()) / n, tail_runs / n,
        stops / max(1, len(lines)), n / max(1, len(lines)), marked, 1 - len(set(lines)) / max(1, len(lines)),
    ]


def with_statistics(rows: DataFrame, keep: str, kind: str) -> DataFrame:
    """Column ``keep`` (of SQL type ``kind``) and one double column per statistic of ``text``."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([text_statistics(x.as_py()) for x in batch.column(1)]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in found.T)], [keep, *STATISTICS])

    schema = f"{keep} {kind}, " + ", ".join(f"{s} double" for s in STATISTICS)
    return rows.select(F.col(keep).cast(kind), "text").mapInArrow(measure, schema)


@dataclass(frozen=True)
class Rule:
    """Conjunction of conditions ``(statistic, above, bound)``: the statistic is above the bound, or not above it."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        found = F.lit(True)
        for name, above, bound in self.conditions:
            found = found & ((F.col(name) > bound) if above else (F.col(name) <= bound))
        return found

    def __str__(self) -> str:
        return " and ".join(f"{name} {'>' if above else '<='} {bound:.6g}" for name, above, bound in self.conditions)


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def column(self) -> Column:
        """Score between 0 and 1 as one expression over the statistics."""
        margin = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            margin = margin + F.when(rule.column(), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-margin))


def tree_rules(root) -> set[Rule]:
    """Rule of every node below the root of a fitted tree; conditions on one statistic are merged."""
    found: set[Rule] = set()

    def walk(node, bounds: dict[tuple[str, bool], float]) -> None:
        if bounds:
            found.add(Rule(tuple((name, above, bound) for (name, above), bound in sorted(bounds.items()))))
        if node.numDescendants() == 0:
            return
        name, cut = STATISTICS[node.split().featureIndex()], float(node.split().threshold())
        walk(node.leftChild(), {**bounds, (name, False): min(cut, bounds.get((name, False), cut))})
        walk(node.rightChild(), {**bounds, (name, True): max(cut, bounds.get((name, True), cut))})

    walk(root, {})
    return found


def fit_rules(training: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = 11) -> RuleEnsemble:
    """Rule ensemble of rows ``(text, y)``; with one class only, no rules and that class's smoothed share."""
    rows = stage(with_statistics(training, "y", "int"), "rule-statistics")
    share = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
    prior = (share["pos"] + 0.5) / (share["n"] + 1.0)
    if not 0 < share["pos"] < share["n"]:
        return RuleEnsemble((), (), float(np.log(prior / (1 - prior))))
    data = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows.withColumn("label", F.col("y").cast("double")))
    data = data.select("label", "features", *STATISTICS).persist()
    leaf = max(1, min(10, share["n"] // 50))
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, subsamplingRate=0.7, featureSubsetStrategy="0.4", maxBins=64, seed=seed
    )
    model = forest.fit(data.select("label", "features"))
    rules = sorted(set().union(*(tree_rules(tree._call_java("rootNode")) for tree in model.trees)), key=lambda r: zlib.crc32(str(r).encode()))
    flags = F.array(*[r.column().cast("double") for r in rules])
    fit = LogisticRegression(regParam=lasso, elasticNetParam=1.0, maxIter=100, standardization=True)
    lines = fit.fit(data.select("label", array_to_vector(flags).alias("features")))
    data.unpersist()
    kept = [(r, float(w)) for r, w in zip(rules, lines.coefficients.toArray(), strict=True) if abs(w) > 1e-9]
    return RuleEnsemble(tuple(r for r, _ in kept), tuple(w for _, w in kept), float(lines.intercept))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, limit: int = TRAIN_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted. Rows whose id's CRC-32 leaves 0 modulo 5 teach nothing.

    Null and empty texts have all statistics 0 and a score like any text. At most ``limit`` labelled rows teach.
    """
    held_out = crc_fold(F.col("doc_id"), 5) == 0
    ensemble = fit_rules(training_rows(docs, labels, "quality", ~held_out, limit))
    scored = with_statistics(docs, "doc_id", "long").select("doc_id", held_out.alias("held_out"), ensemble.column().alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
