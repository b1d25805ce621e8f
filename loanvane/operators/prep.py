"""Train-fitted imputation, level alignment, checks and the one-hot design."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanvane.functions.names import numeric_columns, string_columns
from loanvane.functions.scalars import is_missing
from loanvane.operators.order_stats import exact_quantiles
from loanvane.runtime import bounded_rows, small_table

UNKNOWN = "Unknown"
# Columns with more levels are aligned by a join with the level table, and cannot enter a one-hot design.
LISTED_LEVELS = 1_000
NOT_PREDICTORS = ("id", "default", "is_train", "fold")


def seen_levels(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct ``(variable, level)`` of the training rows, without missing values."""
    return (
        train.select(*columns)
        .unpivot([], list(columns), "variable", "level")
        .filter(F.col("level").isNotNull() & (F.col("level") != UNKNOWN))
        .distinct()
    )


def fit_levels(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sorted levels seen in training: ``(variable, level, level_idx)``, ``Unknown`` last; any number of levels."""
    seen = seen_levels(train, columns)
    place = F.row_number().over(Window.partitionBy("variable").orderBy("level")) - 1
    names = train.sparkSession.createDataFrame([(c,) for c in columns], "variable string")
    counts = seen.groupBy("variable").agg(F.count(F.lit(1)).cast("int").alias("level_idx"))
    last = names.join(counts, "variable", "left").select(
        "variable", F.lit(UNKNOWN).alias("level"), F.coalesce("level_idx", F.lit(0)).alias("level_idx")
    )
    return seen.select("variable", "level", place.alias("level_idx")).unionByName(last)


def align_by_join(df: DataFrame, column: str, seen: DataFrame) -> DataFrame:
    """``column`` of ``df`` with levels that ``seen`` (variable, level) does not list set to ``Unknown``, by a left join."""
    known = seen.filter(F.col("variable") == column).select(F.col("level").alias("__seen")).distinct()
    value = F.when(F.col("__seen").isNotNull(), F.col(column)).otherwise(F.lit(UNKNOWN))
    return df.join(known, F.col(column) == F.col("__seen"), "left").withColumn(column, value).drop("__seen")


def train_medians(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(variable, median)`` over the training rows, missing skipped."""
    return exact_quantiles(train, columns, [0.5]).select("variable", F.col("value").alias("median"))


@dataclass(frozen=True)
class Imputer:
    """Medians and levels fitted on training rows; apply to either split.

    Levels of columns with at most ``LISTED_LEVELS`` are lists; those of other columns stay in the table ``many``.
    Both give the same values.
    """

    medians: Mapping[str, float]
    levels: Mapping[str, list[str]] = field(default_factory=dict)
    many: DataFrame | None = None
    many_columns: tuple[str, ...] = ()

    @classmethod
    def fit(cls, train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Imputer:
        medians = {r["variable"]: r["median"] for r in bounded_rows(train_medians(train, numeric))} if numeric else {}
        if not categorical:
            return cls(medians)
        seen = small_table(seen_levels(train, categorical))  # read twice or more
        counts = {r["variable"]: r["n"] for r in seen.groupBy("variable").agg(F.count(F.lit(1)).alias("n")).collect()}
        many = tuple(c for c in categorical if counts.get(c, 0) > LISTED_LEVELS)
        listed = [c for c in categorical if c not in many]
        levels: dict[str, list[str]] = {c: [] for c in listed}
        for r in seen.filter(F.col("variable").isin(listed)).collect() if listed else []:
            levels[r["variable"]].append(r["level"])
        levels = {c: [*sorted(found), UNKNOWN] for c, found in levels.items()}
        return cls(medians, levels, seen.filter(F.col("variable").isin(list(many))) if many else None, many)

    def transform(self, df: DataFrame) -> DataFrame:
        """Missing numerics take the training median; missing or unseen levels become ``Unknown``.

        Imputed numerics are doubles: the median of a whole-number column may be a half.
        """
        floats = {n for n, t in df.dtypes if t in ("double", "float")}

        def filled(c: str, median: float) -> Column:
            value = F.col(c)
            return F.when(is_missing(value, c in floats), F.lit(median)).otherwise(value.cast("double"))

        out = {c: filled(c, m) for c, m in self.medians.items()}
        out |= {c: align_level(F.col(c), seen) for c, seen in self.levels.items()}
        aligned = df.withColumns(out)
        for c in self.many_columns:
            aligned = align_by_join(aligned, c, self.many)
        return aligned


def align_level(value: Column, levels: Sequence[str]) -> Column:
    """Value if among the training levels, else ``Unknown``."""
    return F.when(value.isin(list(levels)), value).otherwise(F.lit(UNKNOWN))


def fit_imputer(train: DataFrame, exclude: Iterable[str] = NOT_PREDICTORS) -> Imputer:
    """Imputer over every predictor of a training table."""
    return Imputer.fit(train, numeric_columns(train, exclude), string_columns(train, exclude))


def quality_checks(df: DataFrame, predictors: Sequence[str], outcome: str = "default") -> DataFrame:
    """``(check_name, violations)`` from one aggregate: label domain, split balance inputs, missing predictors."""
    doubles = {n for n, t in df.dtypes if t in ("double", "float")}
    y = F.col(outcome)
    checks = {f"{outcome} not in 0,1": F.count_if(y.isNull() | ~y.isin(0, 1))}
    for c in predictors:
        checks[f"{c} missing"] = F.count_if(is_missing(F.col(c), c in doubles))
    wide = df.agg(*[e.alias(n) for n, e in checks.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"`{n}`").alias("violations")) for n in checks]))
    return wide.select(pairs.alias("c")).select("c.*")


def split_balance(df: DataFrame, outcome: str = "default", tolerance: float = 0.01) -> DataFrame:
    """Outcome means of the two splits and whether they differ by less than ``tolerance``."""
    means = df.agg(
        F.avg(F.when(F.col("is_train"), F.col(outcome))).alias("train_mean"),
        F.avg(F.when(~F.col("is_train"), F.col(outcome))).alias("test_mean"),
    )
    gap = F.abs(F.col("train_mean") - F.col("test_mean"))
    return means.select("train_mean", "test_mean", gap.alias("gap"), (gap < tolerance).alias("balanced"))


def require_clean(df: DataFrame, predictors: Sequence[str], outcome: str = "default") -> None:
    """Raise when any quality check is violated."""
    bad = bounded_rows(quality_checks(df, predictors, outcome).filter("violations > 0"))
    if bad:
        raise ValueError("; ".join(f"{r['check_name']}: {r['violations']}" for r in bad))


@dataclass(frozen=True)
class Design:
    """One-hot design with the first level of each categorical as baseline.

    ``names`` gives the feature order; it depends on the fitted levels only, so train and
    test always share it.
    """

    numeric: tuple[str, ...]
    levels: Mapping[str, list[str]]

    @classmethod
    def fit(cls, imputer: Imputer, numeric: Sequence[str], categorical: Sequence[str], exclude: Iterable[str] = ()) -> Design:
        held = set(exclude)
        wide = [c for c in imputer.many_columns if c in set(categorical) - held]
        if wide:
            raise ValueError(f"too many levels for a one-hot design: {', '.join(wide)}")
        used = {c: list(imputer.levels[c]) for c in categorical if c not in held}
        return cls(tuple(c for c in numeric if c not in held), used)

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *[f"{c}={lv}" for c, lvs in self.levels.items() for lv in lvs[1:]]]

    def transform(self, df: DataFrame, output: str = "features", keep: Sequence[str] = ("id", "default")) -> DataFrame:
        """Keep the named columns and add the feature vector."""
        cols = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(self.numeric)]
        start = len(cols)
        hot = [(c, lv) for c, lvs in self.levels.items() for lv in lvs[1:]]
        cols += [(F.col(c) == lv).cast("double").alias(f"x{start + i}") for i, (c, lv) in enumerate(hot)]
        wide = df.select(*keep, *cols)
        assembler = VectorAssembler(inputCols=[f"x{i}" for i in range(len(cols))], outputCol=output)
        return assembler.transform(wide).select(*keep, output)


@dataclass(frozen=True)
class TreeDesign:
    """Label-indexed features for trees: nominal (split by level subsets) or ordered by level."""

    numeric: tuple[str, ...]
    levels: Mapping[str, list[str]]

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *self.levels]

    @property
    def max_bins(self) -> int:
        return max([64, *[len(lvs) for lvs in self.levels.values()]])

    def transform(
        self, df: DataFrame, output: str = "features", keep: Sequence[str] = ("id", "default"), nominal: bool = True
    ) -> DataFrame:
        cats = list(self.levels)
        keep = list(keep)
        out = df.select(
            *keep,
            *[F.col(c).cast("double").alias(f"n_{c}") for c in self.numeric],
            *[F.col(c).alias(f"c_{c}") for c in cats],
        )
        if cats:
            indexer = StringIndexerModel.from_arrays_of_labels(
                [self.levels[c] for c in cats], [f"c_{c}" for c in cats], [f"i_{c}" for c in cats]
            )
            out = indexer.transform(out)
        index = [f"i_{c}" for c in cats]
        if not nominal:
            out = out.withColumns({c: F.col(c) + F.lit(0.0) for c in index})
        inputs = [f"n_{c}" for c in self.numeric] + index
        return VectorAssembler(inputCols=inputs, outputCol=output).transform(out).select(*keep, output)
