"""Report and figure tables: display names, digits and file output."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Display names of the four report tables.
AUDIT_NAMES = {
    "step": "Step",
    "action": "Action",
    "n_rows": "Rows",
    "rows_removed": "Rows removed",
    "n_cols": "Cols",
    "cols_dropped": "Cols dropped",
    "cols_added": "Cols added",
    "notes": "Notes",
}
OOB_NAMES = {
    "method": "Method",
    "n_trees_final": "Number of Trees",
    "oob_error_final": "OOB error (misclassification)",
    "oob_auc": "OOB AUC",
    "oob_brier": "OOB Brier",
}
METRIC_NAMES = {
    "model": "Model",
    "error": "Error",
    "accuracy": "Accuracy",
    "auc": "AUC",
    "brier": "Brier",
    "tp": "TP",
    "fp": "FP",
    "tn": "TN",
    "fn": "FN",
}
EFFECT_NAMES = {"treatment": "Treatment", "estimator": "Estimator", "effect_ci": "Effect (pp) [95% CI]"}


def shape_log(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(table_name, n_rows, n_cols)`` per named table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_cols")
        )
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def report_table(df: DataFrame, names: Mapping[str, str], digits: int | None = None) -> DataFrame:
    """Columns under their display names, doubles rounded to ``digits``."""
    doubles = {n for n, t in df.dtypes if t == "double"}
    shown = lambda c: F.round(F.col(c), digits) if digits is not None and c in doubles else F.col(c)
    return df.select(*[shown(c).alias(n) for c, n in names.items()])


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One CSV part with a header: report tables have a handful of rows."""
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)


def write_figure_data(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet table behind a figure; keeps the partitioning of the result."""
    df.write.mode(mode).parquet(path)
