"""Column names: feature blocks, the leakage screen, and ordered set algebra."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Feature blocks known at origination.
PRICE_NUMERIC = ["loan_amnt", "funded_amnt", "funded_amnt_inv", "int_rate", "installment"]
PRICE_CATEGORICAL = ["term", "grade", "sub_grade", "initial_list_status"]
INCOME_NUMERIC = ["annual_inc", "dti"]
INCOME_CATEGORICAL = ["emp_length", "home_ownership", "verification_status"]
CREDIT_NUMERIC = [
    "fico_range_low", "fico_range_high", "open_acc", "total_acc", "revol_bal", "revol_util",
    "inq_last_6mths", "delinq_2yrs", "mths_since_last_delinq", "mths_since_last_record",
    "mths_since_recent_inq", "pub_rec", "pub_rec_bankruptcies", "mort_acc",
    "collections_12_mths_ex_med", "num_rev_tl_bal_gt_0",
]
PURPOSE_CATEGORICAL = ["purpose", "application_type"]

# Names that identify a borrower or hold free text.
IDENTIFIERS = ["id", "member_id", "url", "desc", "title", "emp_title"]
QUASI_IDENTIFIERS = ["zip_code"]

# Name patterns of facts that arise after origination, and names no pattern covers.
LEAKAGE_PATTERNS = [
    "^total_pymnt",
    "^total_pymnt_inv",
    "^total_rec_",
    "^recoveries",
    "^collection_recovery_fee",
    "^last_pymnt_",
    "^next_pymnt_",
    "^last_credit_pull_d",
    "^settlement_",
    "^hardship_",
    "^debt_settlement_",
]
EXTRA_LEAKAGE = ["out_prncp", "out_prncp_inv", "last_fico_range_low", "last_fico_range_high"]
OUTCOME_HELPERS = ["loan_status", "default_prelim", "status_group"]

SCORE_BOUNDS = ["fico_range_low", "fico_range_high"]

NUMERIC_SHORTLIST = PRICE_NUMERIC + INCOME_NUMERIC + CREDIT_NUMERIC
CATEGORICAL_SHORTLIST = PRICE_CATEGORICAL + INCOME_CATEGORICAL + PURPOSE_CATEGORICAL


def unique(names: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(names))


def intersect(left: Iterable[str], right: Iterable[str]) -> list[str]:
    held = set(right)
    return [n for n in unique(left) if n in held]


def setdiff(left: Iterable[str], right: Iterable[str]) -> list[str]:
    held = set(right)
    return [n for n in unique(left) if n not in held]


def union(left: Iterable[str], right: Iterable[str]) -> list[str]:
    return unique([*left, *right])


def is_identifier(name: str) -> bool:
    return name in IDENTIFIERS or name in QUASI_IDENTIFIERS


def is_leakage(name: str) -> bool:
    return any(re.search(p, name) for p in LEAKAGE_PATTERNS)


def columns_to_drop(names: Iterable[str], keep: Iterable[str] = ("id",)) -> list[str]:
    """Identifiers, leaked facts and outcome helpers among ``names``, in the screen's order.

    ``keep`` holds names that stay although screened: the row key is carried as a key and
    never offered as a predictor.
    """
    names = list(names)
    screened = [
        *intersect(IDENTIFIERS + QUASI_IDENTIFIERS, names),
        *[n for n in names if is_leakage(n)],
        *intersect(EXTRA_LEAKAGE, names),
        *intersect(OUTCOME_HELPERS, names),
    ]
    return setdiff(screened, keep)


def numeric_candidates(names: Iterable[str]) -> list[str]:
    """Numeric shortlist present in ``names``; the midpoint replaces the two score bounds."""
    names = list(names)
    wanted = NUMERIC_SHORTLIST
    if "fico_avg" in names:
        wanted = union(setdiff(wanted, SCORE_BOUNDS), ["fico_avg"])
    return intersect(wanted, names)


def categorical_candidates(names: Iterable[str]) -> list[str]:
    return intersect(CATEGORICAL_SHORTLIST, names)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    held = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in held]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    held = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in held]


def prefixed(df: DataFrame, prefix: str) -> list[str]:
    return [n for n in df.columns if n.startswith(prefix)]
