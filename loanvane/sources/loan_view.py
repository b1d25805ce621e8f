"""Loan-shaped view over order, customer and line-item tables.

The order tables stand in for a loan book. Every value is a deterministic function of the
rows, so the same text gives the same loans in any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loanvane.functions.keys import RandomKey

# Issue years of the stand-in book that take the place of the cohort years.
VIEW_YEARS = ["1996", "1997", "1998", "1999"]
VIEW_MIN_BIN_ROWS = 20

# Predictors of the stand-in study.
VIEW_NUMERIC = [
    "loan_amnt", "int_rate", "installment", "annual_inc", "dti", "fico_avg", "revol_bal", "mths_since_last_delinq", "delinq_2yrs", "term_60",
]
VIEW_CATEGORICAL = [
    "term", "grade", "sub_grade", "home_ownership", "emp_length", "purpose", "application_type", "issue_year", "fico_bin",
]
# Keys other engines can repeat, for results compared across engines.
SAMPLE_KEY = RandomKey(101, portable=True)
SPLIT_KEY = RandomKey(211, portable=True)
FOLD_KEY = RandomKey(307, portable=True)
TIE_KEY = RandomKey(401, portable=True)

# Draws are taken below the joins: projections cannot merge across a join, so each is evaluated once a row.
_DRAW = "(((((o_orderkey + {salt}) % 2147483647) * 48271) % 2147483647) * 16807 % 2147483647)"

LOAN_SQL = f"""
li AS (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty, avg(l_discount) AS disc,
              sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS n_ret
       FROM {{lineitem}} GROUP BY l_orderkey),
o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
        CAST(substr(o_orderpriority,1,1) AS INT) AS gi,
        {_DRAW.format(salt=11)} AS h1, {_DRAW.format(salt=29)} AS h2,
        {_DRAW.format(salt=47)} AS h3, {_DRAW.format(salt=83)} AS h4
      FROM {{orders}}),
b AS (SELECT o.*, c.c_acctbal, c.c_nationkey, c.c_mktsegment, li.n_lines, li.qty, li.disc, li.n_ret
      FROM o JOIN {{customer}} c ON o_custkey=c_custkey LEFT JOIN li ON l_orderkey=o_orderkey),
b2 AS (SELECT b.*, CASE WHEN n_lines >= 6 OR h1 % 100 < 15 THEN 1 ELSE 0 END AS t60,
        600 + 300*gi + (h2 % 400) AS rate_bp FROM b),
loans AS (SELECT o_orderkey AS id,
  {{issue_d}} AS issue_d,
  CASE WHEN h3 % 1000 < 12 THEN 'Does not meet the credit policy. Status:Fully Paid'
       WHEN h3 % 1000 < 18 THEN 'Does not meet the credit policy. Status:Charged Off'
       WHEN h3 % 1000 < 21 THEN 'Does not meet the credit policy. Status: Charged Off'
       WHEN h3 % 1000 < 25 THEN 'Issued'
       WHEN o_orderstatus = 'P' AND h3 % 1000 < 250 THEN 'Current'
       WHEN o_orderstatus = 'P' AND h3 % 1000 < 270 THEN 'In Grace Period'
       WHEN o_orderstatus = 'P' AND h3 % 1000 < 290 THEN 'Late (31-120 days)'
       WHEN h4 % 1000 < 4 THEN 'Default'
       WHEN h4 % 1000 < 20 + 45*gi + 90*t60 THEN 'Charged Off'
       ELSE 'Fully Paid' END AS loan_status,
  CASE WHEN h2 % 53 = 0 THEN NULL WHEN h2 % 53 = 1 THEN 'JOINT' WHEN h2 % 53 = 2 THEN 'Joint App'
       ELSE 'Individual' END AS application_type,
  CASE WHEN h4 % 211 = 0 THEN NULL WHEN t60 = 1 THEN ' 60 months' ELSE ' 36 months' END AS term,
  o_totalprice AS loan_amnt, o_totalprice AS funded_amnt,
  CASE WHEN h1 % 97 = 0 THEN NULL ELSE rate_bp / CAST(100 AS DOUBLE) END AS int_rate,
  o_totalprice * rate_bp / CAST(120000 AS DOUBLE) AS installment,
  substr('ABCDE', gi, 1) AS grade,
  concat(substr('ABCDE', gi, 1), CAST(1 + h2 % 5 AS STRING)) AS sub_grade,
  CASE WHEN h3 % 89 = 0 THEN NULL ELSE c_acctbal END AS annual_inc,
  CASE WHEN h3 % 101 = 0 THEN NULL ELSE disc * 300 END AS dti,
  CAST(660 + 5 * (h4 % 28) AS DOUBLE) AS fico_range_low,
  CAST(664 + 5 * (h4 % 28) AS DOUBLE) AS fico_range_high,
  qty AS revol_bal,
  CASE WHEN h2 % 10 < 5 THEN NULL ELSE CAST(h2 % 80 AS DOUBLE) END AS mths_since_last_delinq,
  CAST(n_ret AS INT) AS delinq_2yrs, CAST(0 AS INT) AS collections_12_mths_ex_med,
  CASE c_nationkey % 3 WHEN 0 THEN 'RENT' WHEN 1 THEN 'OWN' ELSE 'MORTGAGE' END AS home_ownership,
  CASE WHEN h3 % 7 = 0 THEN NULL ELSE concat(CAST(h3 % 7 AS STRING), ' years') END AS emp_length,
  CASE WHEN h4 % 1000 < 8 THEN 'wedding' WHEN h4 % 1000 < 14 THEN 'other' ELSE lower(c_mktsegment) END AS purpose,
  concat(CAST(c_nationkey AS STRING), 'xx') AS zip_code,
  o_totalprice * CAST(0.5 AS DOUBLE) AS total_pymnt, CAST(0 AS DOUBLE) AS recoveries
  FROM b2)
"""


def loan_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loans built from the parquet tables in ``sf_dir``."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "lineitem")}
    text = LOAN_SQL.replace("{issue_d}", "date_format(o_orderdate, 'MMM-yyyy')")
    return spark.sql(f"WITH {text} SELECT * FROM loans", **tables)
