"""Feature engineering and the profile that screens the predictor shortlist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanvane.functions.names import (
    categorical_candidates,
    columns_to_drop,
    is_identifier,
    is_leakage,
    numeric_candidates,
    setdiff,
)
from loanvane.functions.scalars import band, is_missing, midpoint
from loanvane.runtime import bounded_rows

MAX_MISSING = 0.40
MIN_SPREAD = 1e-6
MAX_DOMINANCE = 0.99
RARE_SHARE = 0.02


def screen_flags(df: DataFrame) -> DataFrame:
    """``(variable, id_or_text, leakage)`` for every column name of a raw table."""
    rows = [(n, is_identifier(n), is_leakage(n)) for n in df.columns]
    return df.sparkSession.createDataFrame(rows, "variable string, id_or_text boolean, leakage boolean")


def flag_crosstab(flags: DataFrame) -> DataFrame:
    """Column counts by the two screen flags."""
    return flags.groupBy("id_or_text").agg(
        F.count_if(~F.col("leakage")).alias("leakage_false"), F.count_if(F.col("leakage")).alias("leakage_true")
    )


def drop_screened(df: DataFrame, keep: Sequence[str] = ("id",)) -> DataFrame:
    """Origination-time columns only; the row key stays as a key."""
    return df.drop(*columns_to_drop(df.columns, keep))


def add_score_midpoint(df: DataFrame) -> DataFrame:
    """Add ``fico_avg`` where both bounds exist."""
    if not {"fico_range_low", "fico_range_high"} <= set(df.columns):
        return df
    return df.withColumn("fico_avg", midpoint(F.col("fico_range_low"), F.col("fico_range_high")))


def add_score_band(df: DataFrame) -> DataFrame:
    """Add ``fico_bin`` unless present."""
    if "fico_bin" in df.columns or "fico_avg" not in df.columns:
        return df
    return df.withColumn("fico_bin", band(F.col("fico_avg")))


def lump_rare(
    df: DataFrame, column: str, min_share: float = RARE_SHARE, other: str = "other", rows: int | None = None
) -> DataFrame:
    """Replace levels below ``round(min_share * rows)`` rows by ``other``; missing stays missing.

    Levels kept number at most about 1 / ``min_share``, so the list of kept levels is small
    however many levels the column has. ``rows`` saves a count where it is known.
    """
    least = F.bround(F.lit(rows if rows is not None else df.count()) * F.lit(float(min_share)), 0)
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    kept = [r[column] for r in bounded_rows(counts.filter(F.col("n") >= least).select(column))]
    value = F.col(column)
    return df.withColumn(column, F.when(value.isNull() | value.isin(kept), value).otherwise(F.lit(other)))


def column_profile(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """``(variable, prop_na, sd)`` of all columns from one aggregate; ``sd`` of numeric ones only.

    Standard deviations are sample ones and skip missing values.
    """
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    none = F.lit(None).cast("double")
    columns, is_number = [*numeric, *categorical], set(numeric)

    def entry(c: str) -> Column:
        value = F.col(c)
        present = F.nanvl(value.cast("double"), none) if c in floats else value.cast("double")
        return F.struct(
            F.lit(c).alias("variable"),
            F.avg(is_missing(value, c in floats).cast("int")).alias("prop_na"),
            (F.stddev_samp(present) if c in is_number else none).alias("sd"),
        )

    return df.agg(F.array(*[entry(c) for c in columns]).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def missing_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(variable, prop_na)``."""
    return column_profile(df, [], columns).select("variable", "prop_na")


def spread_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(variable, sd)``."""
    return column_profile(df, columns).select("variable", "sd")


def dominance_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(variable, max_prop)``: share of the most frequent non-missing level."""
    levels = (
        df.select(*columns)
        .unpivot([], list(columns), "variable", "level")
        .filter(F.col("level").isNotNull())
        .groupBy("variable", "level")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return levels.groupBy("variable").agg((F.max("n") / F.sum("n")).alias("max_prop"))


def predictor_profile(df: DataFrame) -> DataFrame:
    """Every shortlist column with its profile and the verdict ``keep``.

    Emits ``(position, variable, kind, prop_na, sd, max_prop, keep)`` in shortlist order.
    """
    numeric, categorical = numeric_candidates(df.columns), categorical_candidates(df.columns)
    names = F.array(*[F.lit(n) for n in numeric + categorical])
    out = column_profile(df, numeric, categorical).withColumns(
        {
            "position": F.array_position(names, F.col("variable")).cast("int") - 1,
            "kind": F.when(F.col("variable").isin(numeric), "numeric").otherwise("categorical"),
        }
    )
    if categorical:
        out = out.join(dominance_profile(df, categorical), "variable", "left")
    else:
        out = out.withColumn("max_prop", F.lit(None).cast("double"))
    drop = (
        (F.col("prop_na") > MAX_MISSING)
        | F.coalesce(F.col("sd") < MIN_SPREAD, F.lit(False))
        | F.coalesce(F.col("max_prop") > MAX_DOMINANCE, F.lit(False))
    )
    return out.select("position", "variable", "kind", "prop_na", "sd", "max_prop", (~drop).alias("keep")).orderBy(
        "position"
    )


def final_predictors(profile: DataFrame) -> list[str]:
    return [r["variable"] for r in sorted(bounded_rows(profile.filter("keep")), key=lambda r: r["position"])]


def modelling_table(features: DataFrame, predictors: Sequence[str], id_column: str = "id") -> DataFrame:
    """Key, outcome, long-term flag, issue year and the chosen predictors."""
    lead = [id_column, "default", "term_60", "issue_year"]
    return features.select(*lead, *setdiff(predictors, lead))
