"""Descriptive tables of the modelling data and the preparation audit trail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanvane.functions.scalars import round_to_grid, thousands_text

MIN_BIN_ROWS = 200

# Display labels.
TERM_LABELS = {0: "36 months", 1: "60 months"}
TERM_PANEL_LABELS = {0: "36-month loans", 1: "60-month loans"}
OUTCOME_LABELS = {0: "No default", 1: "Default"}


def label_flag(flag: Column, labels: dict[int, str]) -> Column:
    return F.when(flag == 0, labels[0]).when(flag == 1, labels[1])


def default_rate(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Default rate and row count per group."""
    return df.groupBy(*by).agg(F.avg("default").alias("def_rate"), F.count(F.lit(1)).alias("n"))


def rate_by_grade_term(df: DataFrame) -> DataFrame:
    return default_rate(df, ["grade", "term_60"]).withColumn("term_label", label_flag(F.col("term_60"), TERM_LABELS))


def rate_by_interest_bin(df: DataFrame, digits: int = 1, min_rows: int = MIN_BIN_ROWS) -> DataFrame:
    """Default rate per rounded interest rate, bins of more than ``min_rows`` loans only."""
    binned = df.withColumn("int_rate_round", round_to_grid(F.col("int_rate"), digits))
    return default_rate(binned, ["int_rate_round"]).filter(F.col("n") > min_rows)


def risk_surface(df: DataFrame) -> DataFrame:
    """Default rate over grade x score band x term for loans inside a band."""
    cells = default_rate(df.filter(F.col("fico_bin").isNotNull()), ["grade", "fico_bin", "term_60"])
    return cells.withColumn("term_label", label_flag(F.col("term_60"), TERM_PANEL_LABELS))


def group_share(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows and share of all rows per group."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*by, "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def outcome_by_year(df: DataFrame) -> DataFrame:
    """Loan counts per year, one column per outcome, zero where none."""
    wide = df.groupBy("issue_year").pivot("default", [0, 1]).agg(F.count(F.lit(1)))
    return wide.select(
        "issue_year", *[F.coalesce(F.col(str(v)), F.lit(0)).alias(f"default_{v}") for v in (0, 1)]
    )


def audit_trail(steps: DataFrame) -> DataFrame:
    """Rows removed and columns dropped or added against the previous step.

    ``steps`` has one row per pipeline stage: ``step, action, n_rows, n_cols, notes``.
    """
    previous = Window.orderBy("step")
    rows_before, cols_before = F.lag("n_rows").over(previous), F.lag("n_cols").over(previous)
    loss = lambda a, b: F.when(a.isNotNull(), F.greatest(F.lit(0).cast("long"), a - b))
    return steps.select(
        "step",
        "action",
        "n_rows",
        loss(rows_before, F.col("n_rows")).alias("rows_removed"),
        "n_cols",
        loss(cols_before, F.col("n_cols")).alias("cols_dropped"),
        F.when(cols_before.isNotNull(), F.greatest(F.lit(0).cast("long"), F.col("n_cols") - cols_before)).alias(
            "cols_added"
        ),
        "notes",
    )


def audit_display(audit: DataFrame) -> DataFrame:
    """Audit trail with thousands separators."""
    counts = ["n_rows", "rows_removed", "n_cols", "cols_dropped", "cols_added"]
    return audit.withColumns({c: thousands_text(F.col(c)) for c in counts})
