"""Outcome labelling, vintage summaries and the modelling cohort."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanvane.functions.labels import COMPLETED, default_label, is_individual, issue_year, long_term_flag, status_group
from loanvane.functions.scalars import percent_text

# Issue years with large volumes and little censoring, and columns a loan must have.
COHORT_YEARS = ["2012", "2013", "2014", "2015"]
REQUIRED_AMOUNTS = ["loan_amnt", "int_rate", "annual_inc", "dti"]


def label_loans(loans: DataFrame) -> DataFrame:
    """Add ``issue_year``, ``status_group``, ``default_prelim``; drop loans without an issue year."""
    return loans.withColumns(
        {
            "issue_year": issue_year(F.col("issue_d")),
            "status_group": status_group(F.col("loan_status")),
            "default_prelim": default_label(F.col("loan_status")),
        }
    ).filter(F.col("issue_year").isNotNull())


def vintage_summary(labelled: DataFrame) -> DataFrame:
    """Volume, censoring and completed-loan default rate per issue year."""
    group = F.col("status_group")
    share = lambda n: F.col(n) / F.col("n_total")
    return (
        labelled.groupBy("issue_year")
        .agg(
            F.count(F.lit(1)).alias("n_total"),
            F.count_if(group == "completed").alias("n_completed"),
            F.count_if(group == "in_progress").alias("n_in_prog"),
            F.count_if(group == "other").alias("n_other"),
            F.avg(F.when(group == "completed", F.col("default_prelim"))).alias("default_rate_completed"),
        )
        .select(
            "issue_year",
            "n_total",
            "n_completed",
            "n_in_prog",
            "n_other",
            share("n_completed").alias("prop_completed"),
            share("n_in_prog").alias("prop_in_prog"),
            "default_rate_completed",
        )
        .orderBy("issue_year")
    )


def mean_vintage_rate(summary: DataFrame) -> DataFrame:
    """Unweighted mean of the yearly rates, the middle year its label stands at, and the largest volume."""
    years = F.sort_array(F.collect_list("issue_year"))
    return summary.agg(
        F.avg("default_rate_completed").alias("mean_default_rate"),
        F.element_at(years, F.ceil(F.count(F.lit(1)) / F.lit(2.0)).cast("int")).alias("label_year"),
        F.max("n_total").alias("max_n_total"),
    ).withColumn("label", F.concat(F.lit("Mean default rate = "), percent_text(F.col("mean_default_rate"))))


def application_counts(labelled: DataFrame, years: Sequence[str] = COHORT_YEARS) -> DataFrame:
    """Loans per issue year and application type, most frequent first."""
    return (
        labelled.filter(F.col("issue_year").isin(list(years)))
        .groupBy("issue_year", "application_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.asc("issue_year"), F.desc("n"), F.asc_nulls_last("application_type"))
    )


def top_statuses(loans: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most frequent status texts."""
    return (
        loans.groupBy("loan_status")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc_nulls_last("loan_status"))
        .limit(k)
    )


def in_cohort(years: Sequence[str] = COHORT_YEARS, joint_prefix: bool = False) -> Column:
    """Completed, individually applied, issued in ``years``, with label and key amounts present."""
    amounts = [F.col(c).isNotNull() & ~F.isnan(c) for c in REQUIRED_AMOUNTS]
    return reduce(
        lambda a, b: a & b,
        amounts,
        F.col("issue_year").isin(list(years))
        & F.col("loan_status").isin(COMPLETED)
        & is_individual(F.col("application_type"), joint_prefix)
        & F.col("default_prelim").isNotNull(),
    )


def select_cohort(
    labelled: DataFrame, years: Sequence[str] = COHORT_YEARS, joint_prefix: bool = False
) -> DataFrame:
    """Loans of the modelling cohort with ``default`` and ``term_60``.

    ``term_60`` may stay missing: it is imputed like a feature later.
    """
    return labelled.filter(in_cohort(years, joint_prefix)).withColumns(
        {"default": F.col("default_prelim"), "term_60": long_term_flag(F.col("term"))}
    )


def cohort_counts(loans: DataFrame, years: Sequence[str] = COHORT_YEARS, joint_prefix: bool = False) -> DataFrame:
    """Row counts per ``(issue_year, default, in_cohort)``: one aggregate that feeds stage counts and strata."""
    labels = {
        "issue_year": issue_year(F.col("issue_d")),
        "default_prelim": default_label(F.col("loan_status")),
    }
    marked = loans.withColumns(labels)
    inside = F.coalesce(in_cohort(years, joint_prefix), F.lit(False))
    return (
        marked.withColumn("in_cohort", inside)
        .groupBy("issue_year", F.col("default_prelim").alias("default"), "in_cohort")
        .agg(F.count(F.lit(1)).alias("n"))
    )
