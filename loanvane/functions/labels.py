"""Outcome labels and cohort flags of a loan row, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status texts as the lending platform writes them.
COMPLETED = [
    "Fully Paid",
    "Charged Off",
    "Default",
    "Does not meet the credit policy. Status:Fully Paid",
    "Does not meet the credit policy. Status:Charged Off",
]
IN_PROGRESS = [
    "Current",
    "In Grace Period",
    "Late (16-30 days)",
    "Late (31-120 days)",
]
# The policy text exists with and without a blank after the colon; only the form without
# it counts as completed, both count as default.
DEFAULTED = [
    "Charged Off",
    "Default",
    "Does not meet the credit policy. Status: Charged Off",
    "Does not meet the credit policy. Status:Charged Off",
]
REPAID = [
    "Fully Paid",
    "Does not meet the credit policy. Status:Fully Paid",
]


def issue_year(issue_date: Column) -> Column:
    """Last four characters of the issue date text; empty becomes NULL, nothing is validated."""
    return F.when(issue_date != "", F.substring(issue_date, -4, 4))


def status_group(status: Column) -> Column:
    """``completed``, ``in_progress`` or ``other`` (also for a missing status)."""
    return (
        F.when(status.isin(COMPLETED), "completed").when(status.isin(IN_PROGRESS), "in_progress").otherwise("other")
    )


def default_label(status: Column) -> Column:
    """1 for defaulted, 0 for repaid, NULL for anything not settled."""
    return F.when(status.isin(DEFAULTED), 1).when(status.isin(REPAID), 0)


def long_term_flag(term: Column) -> Column:
    """1 when the term text holds ``60``, 0 when not, NULL when there is no text."""
    return F.when(term.contains("60"), 1).when(term.isNotNull(), 0)


def is_individual(application_type: Column, joint_prefix: bool = False) -> Column:
    """False for joint applications; a missing type stays in.

    Only the exact word (any case) is joint unless ``joint_prefix`` is set.
    """
    word = F.upper(application_type)
    joint = word.startswith("JOINT") if joint_prefix else word == "JOINT"
    return application_type.isNull() | ~joint
