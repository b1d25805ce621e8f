"""Exact-size stratified samples, splits and balanced folds without a wide shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanvane.functions.keys import RandomKey
from loanvane.operators.order_stats import null_safe_join, rank_cuts
from loanvane.runtime import bounded_rows, small_table

DEFAULT_SEED = 1363


def _not_above(key: Column, row_id: Column, cut_key: Column, cut_id: Column) -> Column:
    return (key < cut_key) | ((key == cut_key) & (row_id <= cut_id))


def flag_stratified(
    df: DataFrame,
    strata: Sequence[str],
    fraction: float,
    flag: str,
    key: RandomKey | None = None,
    id_column: str = "id",
) -> DataFrame:
    """Flag exactly ``floor(rows * fraction)`` rows of each stratum, drawn by random key."""
    key = key or RandomKey(DEFAULT_SEED)
    fraction = min(1.0, float(fraction))
    if fraction == 1.0:
        return df.withColumn(flag, F.lit(True))
    size = lambda n: F.array(F.floor(n.cast("double") * F.lit(fraction)).cast("long"))
    cuts = rank_cuts(df, strata, size, key, id_column).select(*strata, "cut_key", "cut_id")
    row_key, row_id = key.column(F.col(id_column)), F.col(id_column)
    if not strata:
        found = bounded_rows(cuts, 1)
        below = _not_above(row_key, row_id, F.lit(found[0]["cut_key"]), F.lit(found[0]["cut_id"])) if found else F.lit(False)
        return df.withColumn(flag, below)
    marked = null_safe_join(df, small_table(cuts), list(strata), "left")
    taken = _not_above(row_key, row_id, F.col("cut_key"), F.col("cut_id"))
    return marked.withColumn(flag, F.coalesce(taken, F.lit(False))).drop("cut_key", "cut_id")


def stratified_sample(
    df: DataFrame,
    strata: Sequence[str] = ("issue_year", "default"),
    fraction: float | None = None,
    target_rows: int | None = None,
    key: RandomKey | None = None,
    id_column: str = "id",
) -> DataFrame:
    """Same share of every stratum without replacement; ``target_rows`` sets the share from the row count."""
    if fraction is None:
        total = df.count() if target_rows is not None else 0
        fraction = min(1.0, target_rows / total) if total else 1.0
    return flag_stratified(df, strata, fraction, "__taken", key, id_column).filter("__taken").drop("__taken")


def train_test_flag(
    df: DataFrame,
    outcome: str = "default",
    fraction: float = 0.7,
    key: RandomKey | None = None,
    id_column: str = "id",
) -> DataFrame:
    """Add ``is_train``: the split drawn within each outcome class."""
    return flag_stratified(df, [outcome], fraction, "is_train", key or RandomKey(DEFAULT_SEED + 3), id_column)


def fold_column(
    df: DataFrame, folds: int = 5, key: RandomKey | None = None, id_column: str = "id"
) -> Column:
    """Balanced fold ids 1..folds: cut the random order into runs whose sizes differ by at most one."""
    key = key or RandomKey(DEFAULT_SEED + 4)

    def ends(n: Column) -> Column:
        base, extra = F.floor(n / F.lit(folds)), n % folds
        return F.array(*[base * j + F.least(F.lit(j), extra) for j in range(1, folds)])

    cuts = bounded_rows(rank_cuts(df, [], ends, key, id_column).select("target", "cut_key", "cut_id").distinct())
    row_key, row_id = key.column(F.col(id_column)), F.col(id_column)
    fold = F.lit(1)
    for cut in cuts:
        above = ~_not_above(row_key, row_id, F.lit(cut["cut_key"]), F.lit(cut["cut_id"]))
        fold = fold + above.cast("int")
    return fold


def with_folds(
    df: DataFrame, folds: int = 5, name: str = "fold", key: RandomKey | None = None, id_column: str = "id"
) -> DataFrame:
    return df.withColumn(name, fold_column(df, folds, key, id_column))


def with_near_balanced_folds(
    df: DataFrame, folds: int = 5, name: str = "fold", seed: int = DEFAULT_SEED + 4, id_column: str = "id"
) -> DataFrame:
    """Folds from the hash alone: no pass over the data, sizes equal up to chance."""
    return df.withColumn(name, (F.pmod(F.xxhash64(id_column, F.lit(seed)), F.lit(folds)) + 1).cast("int"))
