"""SQL counterparts of the named queries, written independently of the operators."""

from __future__ import annotations

from loanvane.plans.loan_study import AUDIT_STEPS
from loanvane.sources.loan_view import LOAN_SQL, VIEW_CATEGORICAL, VIEW_NUMERIC
from loanvane.sources.reports import AUDIT_NAMES, EFFECT_NAMES

LOANS = (
    LOAN_SQL.replace("{issue_d}", "strftime(o_orderdate, '%b-%Y')")
    .replace("{lineitem}", "lineitem")
    .replace("{orders}", "orders")
    .replace("{customer}", "customer")
)

_COMPLETED = """('Fully Paid', 'Charged Off', 'Default',
  'Does not meet the credit policy. Status:Fully Paid', 'Does not meet the credit policy. Status:Charged Off')"""
_RUNNING = "('Current', 'In Grace Period', 'Late (16-30 days)', 'Late (31-120 days)')"
_BAD = """('Charged Off', 'Default', 'Does not meet the credit policy. Status: Charged Off',
  'Does not meet the credit policy. Status:Charged Off')"""
_GOOD = "('Fully Paid', 'Does not meet the credit policy. Status:Fully Paid')"

_YEAR = "nullif(right(issue_d, 4), '')"
_GROUP = f"CASE WHEN loan_status IN {_COMPLETED} THEN 'completed' WHEN loan_status IN {_RUNNING} THEN 'in_progress' ELSE 'other' END"
_LABEL = f"CASE WHEN loan_status IN {_BAD} THEN 1 WHEN loan_status IN {_GOOD} THEN 0 END"
_LONG = "CASE WHEN term LIKE '%60%' THEN 1 WHEN term IS NOT NULL THEN 0 END"


def draw(salt: int, column: str = "id") -> str:
    return f"((((({column} + {salt}) % 2147483647) * 48271) % 2147483647) * 16807 % 2147483647)"


LABELLED = f"""{LOANS},
labelled AS (SELECT *, {_YEAR} AS issue_year, {_GROUP} AS status_group, {_LABEL} AS default_prelim
             FROM loans WHERE {_YEAR} IS NOT NULL)"""


def cohort_cte(joint: str = "upper(application_type) <> 'JOINT'") -> str:
    return f"""{LABELLED},
cohort AS (SELECT *, default_prelim AS "default", {_LONG} AS term_60,
                  0.5::DOUBLE * (fico_range_low + fico_range_high) AS fico_avg
           FROM labelled
           WHERE issue_year IN ('1996', '1997', '1998', '1999') AND loan_status IN {_COMPLETED}
             AND (application_type IS NULL OR {joint}) AND default_prelim IS NOT NULL
             AND loan_amnt IS NOT NULL AND int_rate IS NOT NULL AND annual_inc IS NOT NULL AND dti IS NOT NULL)"""


COHORT = cohort_cte()

_BAND = """CASE WHEN fico_avg < 600 THEN NULL WHEN fico_avg < 640 THEN '[600,640)' WHEN fico_avg < 660 THEN '[640,660)'
  WHEN fico_avg < 680 THEN '[660,680)' WHEN fico_avg < 700 THEN '[680,700)' WHEN fico_avg < 720 THEN '[700,720)'
  WHEN fico_avg < 740 THEN '[720,740)' WHEN fico_avg < 760 THEN '[740,760)' WHEN fico_avg <= 800 THEN '[760,800]' END"""

BANDED = f"{COHORT},\nbanded AS (SELECT *, {_BAND} AS fico_bin FROM cohort)"

SPLIT = f"""{BANDED},
split AS (SELECT *, row_number() OVER (PARTITION BY "default" ORDER BY {draw(211)}, id)
                 <= floor(CAST(count(*) OVER (PARTITION BY "default") AS DOUBLE) * 0.7::DOUBLE) AS is_train
          FROM banded)"""

LUMPED = f"""{COHORT},
purposes AS (SELECT purpose AS p, count(*) AS n, round_even(0.02::DOUBLE * sum(count(*)) OVER (), 0) AS least
             FROM cohort GROUP BY purpose),
lumped AS (SELECT cohort.* REPLACE (CASE WHEN purpose IS NULL THEN NULL WHEN n < least THEN 'other' ELSE purpose END AS purpose)
           FROM cohort LEFT JOIN purposes ON purpose = p)"""

SCORES = f"""{COHORT},
wide AS (SELECT id, "default" AS y,
           1::DOUBLE / (1::DOUBLE + exp(-(-3.2::DOUBLE + 0.09::DOUBLE * int_rate + 0.5::DOUBLE * coalesce(term_60, 0)))) AS p_logit,
           CASE grade WHEN 'A' THEN 0.05::DOUBLE WHEN 'B' THEN 0.1::DOUBLE WHEN 'C' THEN 0.15::DOUBLE
                      WHEN 'D' THEN 0.2::DOUBLE WHEN 'E' THEN 0.25::DOUBLE END AS p_cart
         FROM cohort),
scores AS (SELECT id, y, 'Logit' AS model, p_logit AS p_hat FROM wide
           UNION ALL SELECT id, y, 'CART' AS model, p_cart AS p_hat FROM wide)"""

_FOLD_SIZE = "count(*) OVER ()"
EFFECT = f"""{COHORT},
ranked AS (SELECT id, grade, CAST("default" AS DOUBLE) AS y, CAST(term_60 AS DOUBLE) AS d,
             row_number() OVER (ORDER BY {draw(307)}, id) - 1 AS place, count(*) OVER () AS n
           FROM cohort WHERE term_60 IS NOT NULL),
folded AS (SELECT id, grade, y, d, 1 + (CASE WHEN place < (n // 5 + 1) * (n % 5) THEN place // (n // 5 + 1)
             ELSE (n % 5) + (place - (n // 5 + 1) * (n % 5)) // (n // 5) END) AS fold FROM ranked)"""

NUISANCE = f"""{EFFECT},
cells AS (SELECT grade, fold, count(*) AS n, sum(y) AS sy, sum(d) AS sd FROM folded GROUP BY grade, fold),
others AS (SELECT a.grade, a.fold, sum(b.sy) / sum(b.n) AS g_hat, sum(b.sd) / sum(b.n) AS m_hat
           FROM cells a JOIN cells b ON a.grade = b.grade AND a.fold <> b.fold GROUP BY a.grade, a.fold),
resid AS (SELECT id, y, d, y - least(greatest(g_hat, 0.0001::DOUBLE), 0.9999::DOUBLE) AS ty,
            d - least(greatest(m_hat, 0.0001::DOUBLE), 0.9999::DOUBLE) AS td
          FROM folded JOIN others USING (grade, fold))"""


def query(cte: str, select: str) -> str:
    return f"WITH {cte}\n{select}"


def six(expression: str, name: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) AS {name}"


def big(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"


_SUMMARY = f"""summary AS (SELECT issue_year, count(*) AS n_total,
    count(*) FILTER (WHERE status_group = 'completed') AS n_completed,
    count(*) FILTER (WHERE status_group = 'in_progress') AS n_in_prog,
    count(*) FILTER (WHERE status_group = 'other') AS n_other,
    avg(default_prelim) FILTER (WHERE status_group = 'completed') AS default_rate_completed
  FROM labelled GROUP BY issue_year)"""

_RATES = f"round(avg(\"default\"), 6) AS def_rate, {big('count(*)', 'n')}"
_BINS = f"""bins AS (SELECT round_even(int_rate, 1) AS int_rate_round, avg("default") AS def_rate, count(*) AS n
  FROM cohort GROUP BY 1 HAVING count(*) > 20)"""

_NUMERIC = [
    "loan_amnt", "funded_amnt", "int_rate", "installment", "annual_inc", "dti", "revol_bal", "delinq_2yrs",
    "mths_since_last_delinq", "collections_12_mths_ex_med", "fico_avg",
]
_CATEGORICAL = ["term", "grade", "sub_grade", "emp_length", "home_ownership", "purpose", "application_type"]


def stacked(template: str, names: list[str]) -> str:
    return "\nUNION ALL ".join(template.format(c=c) for c in names)


def _profile_cte() -> str:
    missing = stacked("SELECT '{c}' AS variable, avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS prop_na FROM lumped", _NUMERIC + _CATEGORICAL)
    spread = stacked("SELECT '{c}' AS variable, stddev_samp({c}) AS sd FROM lumped", _NUMERIC)
    top = stacked(
        "SELECT '{c}' AS variable, max(n) / sum(n) AS max_prop FROM (SELECT {c}, count(*) AS n FROM lumped WHERE {c} IS NOT NULL GROUP BY {c})",
        _CATEGORICAL,
    )
    return f"{LUMPED},\nmissing AS ({missing}),\nspread AS ({spread}),\ntop AS ({top})"


PROFILE = _profile_cte()

_RAW = [
    "id", "issue_d", "loan_status", "application_type", "term", "loan_amnt", "funded_amnt", "int_rate", "installment",
    "grade", "sub_grade", "annual_inc", "dti", "fico_range_low", "fico_range_high", "revol_bal",
    "mths_since_last_delinq", "delinq_2yrs", "collections_12_mths_ex_med", "home_ownership", "emp_length", "purpose",
    "zip_code", "total_pymnt", "recoveries",
]
_FLAGGED = f"""{LOANS},
present AS ({stacked("SELECT '{c}' AS variable, count({c}) AS n_present FROM loans", _RAW)}),
flags AS (SELECT variable, variable IN ('id', 'zip_code') AS id_or_text,
            variable IN ('total_pymnt', 'recoveries') AS leakage, n_present FROM present)"""

_CURVE = """counts AS (SELECT model, p_hat, sum(y) AS n_pos, count(*) - sum(y) AS n_neg FROM scores GROUP BY model, p_hat),
curve AS (SELECT *, sum(n_pos) OVER w AS up_pos, sum(n_neg) OVER w AS up_neg,
            sum(n_pos) OVER (PARTITION BY model) AS all_pos, sum(n_neg) OVER (PARTITION BY model) AS all_neg
          FROM counts WINDOW w AS (PARTITION BY model ORDER BY p_hat DESC))"""

_AUC = "sum(n_pos * (all_neg - up_neg + n_neg / 2::DOUBLE)) / max(CAST(all_pos AS DOUBLE) * all_neg)"


def metrics(threshold: float) -> str:
    clamped = "least(greatest(p_hat, 0.000001::DOUBLE), 0.999999::DOUBLE)"
    return f"""{_CURVE},
auc AS (SELECT model, {_AUC} AS auc FROM curve GROUP BY model),
rows_of AS (SELECT model, y, {clamped} AS p, CASE WHEN {clamped} >= {threshold}::DOUBLE THEN 1 ELSE 0 END AS c FROM scores),
metrics AS (SELECT model, 1 - avg(CASE WHEN c = y THEN 1::DOUBLE ELSE 0 END) AS error,
    avg(CASE WHEN c = y THEN 1::DOUBLE ELSE 0 END) AS accuracy, max(auc) AS auc, avg((p - y) * (p - y)) AS brier,
    count(*) FILTER (WHERE c = 1 AND y = 1) AS tp, count(*) FILTER (WHERE c = 1 AND y = 0) AS fp,
    count(*) FILTER (WHERE c = 0 AND y = 0) AS tn, count(*) FILTER (WHERE c = 0 AND y = 1) AS fn
  FROM rows_of JOIN auc USING (model) GROUP BY model)"""


_ORDERED = f"""ordered AS (SELECT model, id, y, row_number() OVER w AS place, sum(y) OVER w AS caught,
    count(*) OVER (PARTITION BY model) AS n, sum(y) OVER (PARTITION BY model) AS pos
  FROM scores WINDOW w AS (PARTITION BY model ORDER BY p_hat DESC, {draw(401)}, id
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _formula_votes() -> str:
    parts = [
        f"SELECT id, y, {b + 1} AS tree, CASE WHEN d % 100 < 37 THEN p_logit + (d % 1000 - 500) / 1000::DOUBLE END AS vote "
        f"FROM (SELECT *, {draw(1009 + 97 * b)} AS d FROM wide)"
        for b in range(12)
    ]
    running = """running AS (SELECT id, y, tree, sum(vote) OVER w AS total, count(vote) OVER w AS n FROM votes
  WINDOW w AS (PARTITION BY id ORDER BY tree ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
path AS (SELECT tree, avg(CASE WHEN (CASE WHEN total / n > 0.5::DOUBLE THEN 1 ELSE 0 END) <> y THEN 1::DOUBLE ELSE 0 END) AS oob_error,
           count(*) AS n_rows
         FROM running WHERE n > 0 GROUP BY tree)"""
    joined = "\nUNION ALL ".join(parts)
    return f"{SCORES},\nvotes AS ({joined}),\n{running}"


VOTES = _formula_votes()

_SLOPE = """fit AS (SELECT CAST(regr_count({y}, {x}) AS DOUBLE) AS n, regr_slope({y}, {x}) AS theta,
    regr_intercept({y}, {x}) AS intercept, regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy
  FROM {t}),
est AS (SELECT *, sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS se,
    1.959963984540054::DOUBLE + 2.372271234::DOUBLE / (n - 2) + 2.822502::DOUBLE / ((n - 2) * (n - 2)) AS t975 FROM fit)"""

_FIT_COLUMNS = ", ".join(
    [six("theta", "theta"), six("intercept", "intercept"), six("se", "se"), six("theta - t975 * se", "ci_low"),
     six("theta + t975 * se", "ci_high"), six("theta / se", "t_value"), big("n - 2", "dof"), big("n", "n")]
)

_ARMS = """arms AS (SELECT avg(y) FILTER (WHERE d = 1) - avg(y) FILTER (WHERE d = 0) AS theta,
    sqrt(var_samp(y) FILTER (WHERE d = 1) / count(*) FILTER (WHERE d = 1)
       + var_samp(y) FILTER (WHERE d = 0) / count(*) FILTER (WHERE d = 0)) AS se,
    count(*) FILTER (WHERE d = 1) AS n1, count(*) FILTER (WHERE d = 0) AS n0 FROM folded)"""

ORACLES: dict[str, str] = {
    "vintage_summary": query(
        f"{LABELLED},\n{_SUMMARY}",
        f"""SELECT issue_year, {big('n_total', 'n_total')}, {big('n_completed', 'n_completed')}, {big('n_in_prog', 'n_in_prog')},
  {big('n_other', 'n_other')}, {six('n_completed / n_total', 'prop_completed')}, {six('n_in_prog / n_total', 'prop_in_prog')},
  {six('default_rate_completed', 'default_rate_completed')} FROM summary""",
    ),
    "mean_vintage_rate": query(
        f"{LABELLED},\n{_SUMMARY},\nplaced AS (SELECT *, row_number() OVER (ORDER BY issue_year) AS i, count(*) OVER () AS k FROM summary)",
        f"""SELECT {six('avg(default_rate_completed)', 'mean_default_rate')}, max(issue_year) FILTER (WHERE i = ceil(k / 2)) AS label_year,
  {big('max(n_total)', 'max_n_total')}, printf('Mean default rate = %.1f%%', avg(default_rate_completed) * 100) AS label FROM placed""",
    ),
    "volume_line": query(
        f"{LABELLED},\n{_SUMMARY}",
        f"SELECT issue_year, {big('n_total', 'n_total')}, {six('(n_completed / n_total) * (SELECT max(n_total) FROM summary)', 'completed_line')} FROM summary",
    ),
    "app_type_counts": query(
        LABELLED,
        f"""SELECT issue_year, application_type, {big('count(*)', 'n')} FROM labelled
WHERE issue_year IN ('1996', '1997', '1998', '1999') GROUP BY issue_year, application_type""",
    ),
    "status_top20": query(
        LOANS,
        f"SELECT loan_status, {big('count(*)', 'n')} FROM loans GROUP BY loan_status ORDER BY n DESC, loan_status LIMIT 20",
    ),
    "loan_labels": query(
        LOANS,
        f"""SELECT {big('id', 'id')}, {_YEAR} AS issue_year,
  CASE {_GROUP} WHEN 'completed' THEN 'Completed' WHEN 'in_progress' THEN 'In progress' ELSE 'Other' END AS status_label,
  CAST({_LABEL} AS DOUBLE) AS default_prelim, {six(_LONG, 'term_60')},
  CASE {_LONG} WHEN 0 THEN '36 months' WHEN 1 THEN '60 months' END AS term_label FROM loans""",
    ),
    "cohort_rows": query(
        COHORT,
        f"""SELECT {big('id', 'id')}, issue_year, {big('"default"', '"default"')}, {six('term_60', 'term_60')}, grade, {six('loan_amnt', 'loan_amnt')},
  {six('int_rate', 'int_rate')}, {six('annual_inc', 'annual_inc')}, {six('dti', 'dti')} FROM cohort""",
    ),
    "cohort_prefix_option": query(
        cohort_cte("upper(application_type) NOT LIKE 'JOINT%'"), f"SELECT issue_year, {_RATES} FROM cohort GROUP BY issue_year"
    ),
    "year_default_pivot": query(
        COHORT,
        """SELECT issue_year, CAST(count(*) FILTER (WHERE "default" = 0) AS BIGINT) AS default_0,
  CAST(count(*) FILTER (WHERE "default" = 1) AS BIGINT) AS default_1 FROM cohort GROUP BY issue_year""",
    ),
    "group_share": query(
        COHORT,
        f"""SELECT issue_year, {big('"default"', '"default"')}, {big('count(*)', 'n')},
  {six('count(*) / sum(count(*)) OVER ()', 'share')} FROM cohort GROUP BY issue_year, "default" """,
    ),
    "outcome_share": query(
        COHORT,
        f"""SELECT CASE "default" WHEN 0 THEN 'No default' WHEN 1 THEN 'Default' END AS outcome, {big('count(*)', 'n')},
  {six('count(*) / sum(count(*)) OVER ()', 'share')} FROM cohort GROUP BY "default" """,
    ),
    "shape_log": query(
        cohort_cte(),
        """SELECT 'loans' AS table_name, CAST(count(*) AS BIGINT) AS n_rows, CAST(25 AS BIGINT) AS n_cols FROM loans
UNION ALL SELECT 'labelled', count(*), 28 FROM labelled UNION ALL SELECT 'cohort', count(*), 30 FROM cohort""",
    ),
    "csv_scan": query(
        LOANS,
        f"""SELECT {big('id', 'id')}, issue_d, loan_status, trim(term) AS term, emp_length, {six('loan_amnt', 'loan_amnt')}, {six('int_rate', 'int_rate')},
  'Said "' || loan_status || '",' || chr(10) || grade || ', "twice"' || chr(10) || chr(10) || 'end' AS note FROM loans""",
    ),
    "csv_scan_counts": query(
        LOANS,
        f"""SELECT {big('count(*) + count(*) FILTER (WHERE id % 50 = 7)', 'n_read')}, {big('count(*) FILTER (WHERE id % 50 = 7)', 'n_bad')},
  {big('count(*) FILTER (WHERE id % 50 = 7)', 'n_apart')} FROM loans""",
    ),
    "rate_by_grade_term": query(
        COHORT,
        f"""SELECT grade, {six('term_60', 'term_60')}, {_RATES},
  CASE term_60 WHEN 0 THEN '36 months' WHEN 1 THEN '60 months' END AS term_label FROM cohort GROUP BY grade, term_60""",
    ),
    "rate_by_int_bin": query(
        f"{COHORT},\n{_BINS}",
        f"SELECT {six('int_rate_round', 'int_rate_round')}, {six('def_rate', 'def_rate')}, {big('n', 'n')} FROM bins",
    ),
    "max_bin_rate": query(
        f"{COHORT},\n{_BINS}",
        f"SELECT {six('max(def_rate)', 'y_max')}, {six('min(def_rate)', 'y_min')}, {big('count(*)', 'bins')} FROM bins",
    ),
    "risk_surface": query(
        BANDED,
        f"""SELECT grade, fico_bin, {six('term_60', 'term_60')}, {_RATES},
  CASE term_60 WHEN 0 THEN '36-month loans' WHEN 1 THEN '60-month loans' END AS term_label
FROM banded WHERE fico_bin IS NOT NULL GROUP BY grade, fico_bin, term_60""",
    ),
    "report_texts": query(
        COHORT,
        """SELECT grade, printf('%.1f%%', round_even(avg("default"), 4) * 100) AS rate_text, format('{:,}', count(*)) AS n_text,
  round_even(avg("default"), 2) AS rate_round FROM cohort GROUP BY grade""",
    ),
    "fico_bins": query(BANDED, f"SELECT {big('id', 'id')}, {six('fico_avg', 'fico_avg')}, fico_bin FROM banded"),
    "lump_purpose": query(LUMPED, f"SELECT {big('id', 'id')}, purpose FROM lumped"),
    "var_flags": query(_FLAGGED, f"SELECT variable, id_or_text, leakage, {big('n_present', 'n_present')} FROM flags"),
    "flag_crosstab": query(
        _FLAGGED,
        """SELECT id_or_text, CAST(count(*) FILTER (WHERE NOT leakage) AS BIGINT) AS leakage_false,
  CAST(count(*) FILTER (WHERE leakage) AS BIGINT) AS leakage_true FROM flags WHERE n_present > 0 GROUP BY id_or_text""",
    ),
    "model_base_columns": query(
        COHORT,
        stacked(
            "SELECT '{c}' AS variable, CAST(count(\"{c}\") AS BIGINT) AS n_present FROM cohort",
            [c for c in _RAW if c not in ("loan_status", "zip_code", "total_pymnt", "recoveries")]
            + ["issue_year", "default", "term_60"],
        ),
    ),
    "missing_profile": query(PROFILE, f"SELECT variable, {six('prop_na', 'prop_na')} FROM missing"),
    "sd_profile": query(PROFILE, f"SELECT variable, {six('sd', 'sd')} FROM spread"),
    "dominant_share": query(PROFILE, f"SELECT variable, {six('max_prop', 'max_prop')} FROM top"),
    "final_predictors": query(
        PROFILE,
        """SELECT variable, CASE WHEN s.variable IS NOT NULL THEN 'numeric' ELSE 'categorical' END AS kind
FROM missing LEFT JOIN (SELECT variable, sd FROM spread) s USING (variable) LEFT JOIN top USING (variable)
WHERE prop_na <= 0.4 AND coalesce(sd >= 0.000001, true) AND coalesce(max_prop <= 0.99, true)""",
    ),
    "audit_trail": query(
        f"""{PROFILE},
sizes AS (SELECT (SELECT count(*) FROM loans) AS n1, (SELECT count(*) FROM labelled) AS n2, (SELECT count(*) FROM cohort) AS n3,
  (SELECT sum(floor(CAST(n AS DOUBLE) * least(1, 120000 / (SELECT count(*) FROM cohort))))
   FROM (SELECT count(*) AS n FROM cohort GROUP BY issue_year, "default")) AS n4,
  (SELECT count(*) FROM missing LEFT JOIN spread USING (variable) LEFT JOIN top USING (variable)
   WHERE prop_na <= 0.4 AND coalesce(sd >= 0.000001, true) AND coalesce(max_prop <= 0.99, true)) AS k),
steps AS (SELECT 1 AS step, n1 AS n_rows, 25 AS n_cols FROM sizes UNION ALL SELECT 2, n2, 28 FROM sizes
  UNION ALL SELECT 3, n3, 30 FROM sizes UNION ALL SELECT 4, n4, 30 FROM sizes UNION ALL SELECT 5, n4, 23 FROM sizes
  UNION ALL SELECT 6, n4, 24 FROM sizes UNION ALL SELECT 7, n4, 3 + k FROM sizes)""",
        """SELECT CAST(step AS BIGINT) AS step, CAST(n_rows AS BIGINT) AS n_rows,
  CAST(greatest(0, lag(n_rows) OVER w - n_rows) * CASE WHEN step > 1 THEN 1 END AS DOUBLE) AS rows_removed, CAST(n_cols AS BIGINT) AS n_cols,
  CAST(greatest(0, lag(n_cols) OVER w - n_cols) * CASE WHEN step > 1 THEN 1 END AS DOUBLE) AS cols_dropped,
  CAST(greatest(0, n_cols - lag(n_cols) OVER w) * CASE WHEN step > 1 THEN 1 END AS DOUBLE) AS cols_added
FROM steps WINDOW w AS (ORDER BY step)""",
    ),
    "quantile75": query(
        COHORT,
        f"""SELECT 'int_rate' AS variable, {six('quantile_cont(int_rate, 0.75)', 'q75')} FROM cohort
UNION ALL SELECT 'annual_inc', {six('quantile_cont(annual_inc, 0.75)', 'q75')} FROM cohort""",
    ),
    "strat_sample": query(
        f"""{COHORT},
placed AS (SELECT id, issue_year, "default", row_number() OVER (PARTITION BY issue_year, "default" ORDER BY {draw(101)}, id) AS r,
  count(*) OVER (PARTITION BY issue_year, "default") AS n FROM cohort)""",
        f"""SELECT {big('id', 'id')}, issue_year, {big('"default"', '"default"')} FROM placed
WHERE r <= floor(CAST(n AS DOUBLE) * 0.6::DOUBLE)""",
    ),
    "train_test_split": query(
        SPLIT, f"""SELECT {big('id', 'id')}, {big('"default"', '"default"')}, {big('is_train', 'is_train')} FROM split"""
    ),
    "train_semi_join": query(
        SPLIT,
        f"""SELECT {big('id', 'id')}, grade, {six('int_rate', 'int_rate')} FROM cohort
WHERE id IN (SELECT id FROM split WHERE is_train)""",
    ),
    "split_balance": query(
        f"""{SPLIT},
m AS (SELECT avg("default") FILTER (WHERE is_train) AS a, avg("default") FILTER (WHERE NOT is_train) AS b FROM split)""",
        f"""SELECT {six('a', 'train_mean')}, {six('b', 'test_mean')}, {six('abs(a - b)', 'gap')},
  {big('abs(a - b) < 0.01', 'balanced')} FROM m""",
    ),
    "kfold_assign": query(
        f"""{COHORT},
ranked AS (SELECT id, row_number() OVER (ORDER BY {draw(307)}, id) - 1 AS place, count(*) OVER () AS n FROM cohort)""",
        f"""SELECT {big('id', 'id')}, CAST(1 + (CASE WHEN place < (n // 5 + 1) * (n % 5) THEN place // (n // 5 + 1)
  ELSE (n % 5) + (place - (n // 5 + 1) * (n % 5)) // (n // 5) END) AS BIGINT) AS fold FROM ranked""",
    ),
    "train_medians": query(
        SPLIT,
        stacked(
            "SELECT '{c}' AS variable, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median FROM split WHERE is_train",
            VIEW_NUMERIC,
        ),
    ),
    "train_levels": query(
        SPLIT,
        stacked(
            """SELECT '{c}' AS variable, level, row_number() OVER (ORDER BY level) - 1 AS level_idx
  FROM (SELECT DISTINCT {c} AS level FROM split WHERE is_train AND {c} IS NOT NULL)
UNION ALL SELECT '{c}', 'Unknown', count(DISTINCT {c}) FROM split WHERE is_train""",
            VIEW_CATEGORICAL,
        ),
    ),
    "impute_apply": query(
        SPLIT,
        "SELECT CAST(id AS BIGINT) AS id, "
        + ", ".join(
            f"round(floor(CAST(coalesce({c}, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM split WHERE is_train)) AS DOUBLE) * 1000000 + 0.4321::DOUBLE) / 1000000, 6) AS {c}"
            for c in VIEW_NUMERIC
        )
        + ", "
        + ", ".join(
            f"CASE WHEN {c} IN (SELECT {c} FROM split WHERE is_train) THEN {c} ELSE 'Unknown' END AS {c}"
            for c in VIEW_CATEGORICAL
        )
        + " FROM split",
    ),
    "unseen_levels": query(
        f"{SPLIT},\ncelled AS (SELECT id, is_train, concat_ws('-', zip_code, issue_d) AS cell FROM split)",
        f"""SELECT {big('id', 'id')}, CASE WHEN cell IN (SELECT cell FROM celled WHERE is_train) THEN cell ELSE 'Unknown' END AS cell
FROM celled WHERE NOT is_train""",
    ),
    "dq_checks": query(
        SPLIT,
        """SELECT 'default not in 0,1' AS check_name, CAST(count(*) FILTER (WHERE "default" IS NULL OR "default" NOT IN (0, 1)) AS BIGINT) AS violations FROM split
UNION ALL """
        + stacked(
            "SELECT '{c} missing' AS check_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS violations FROM split",
            VIEW_NUMERIC + VIEW_CATEGORICAL,
        ),
    ),
    "dq_checks_imputed": query(
        SPLIT,
        """SELECT 'default not in 0,1' AS check_name, CAST(count(*) FILTER (WHERE "default" IS NULL OR "default" NOT IN (0, 1)) AS BIGINT) AS violations FROM split
UNION ALL """
        + stacked(
            "SELECT '{c} missing' AS check_name, CAST(count(*) FILTER (WHERE false) AS BIGINT) AS violations FROM split",
            VIEW_NUMERIC + VIEW_CATEGORICAL,
        ),
    ),
    "design_totals": query(
        f"{SPLIT},\ntrain AS (SELECT * FROM split WHERE is_train)",
        stacked(
            """SELECT '{c}' AS feature, round(sum(coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM train))), 2) AS total
FROM train""",
            VIEW_NUMERIC,
        )
        + "\nUNION ALL "
        + stacked(
            """SELECT '{c}=' || level, CAST(n AS DOUBLE) FROM (SELECT {c} AS level, count(*) AS n, row_number() OVER (ORDER BY {c}) AS r
    FROM train WHERE {c} IS NOT NULL GROUP BY {c}) WHERE r > 1
UNION ALL SELECT '{c}=Unknown', CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) FROM train""",
            VIEW_CATEGORICAL,
        ),
    ),
    "high_rate_treatment": query(
        SPLIT,
        f"""SELECT {big('id', 'id')}, CASE WHEN int_rate >= (SELECT quantile_cont(int_rate, 0.75) FROM split WHERE is_train)
  THEN 1::DOUBLE ELSE 0::DOUBLE END AS high_rate FROM split WHERE is_train""",
    ),
    "score_expr": query(
        SCORES,
        f"""SELECT {big('id', 'id')}, {six('least(greatest((p_logit - 0.25::DOUBLE) * 4, 0.000001::DOUBLE), 0.999999::DOUBLE)', 'p_clamped')},
  {big('p_cart >= 0.15::DOUBLE', 'class_at')}, {big('p_cart > 0.15::DOUBLE', 'class_above')} FROM wide""",
    ),
    "score_unpivot": query(
        SCORES, f"SELECT {big('id', 'id')}, {big('y', 'y')}, model, {six('p_hat', 'p_hat')} FROM scores"
    ),
    "score_metrics": query(
        f"{SCORES},\n{metrics(0.2)}",
        f"""SELECT model, {six('error', 'error')}, {six('accuracy', 'accuracy')}, {six('auc', 'auc')}, {six('brier', 'brier')},
  {big('tp', 'tp')}, {big('fp', 'fp')}, {big('tn', 'tn')}, {big('fn', 'fn')} FROM metrics""",
    ),
    "model_ranking": query(
        f"{SCORES},\n{metrics(0.5)}",
        f"""SELECT model AS "Model", round(error, 3) AS "Error", round(accuracy, 3) AS "Accuracy", round(auc, 3) AS "AUC",
  round(brier, 3) AS "Brier", {big('tp', '"TP"')}, {big('fp', '"FP"')}, {big('tn', '"TN"')}, {big('fn', '"FN"')}
FROM metrics ORDER BY auc DESC""",
    ),
    "auc_exact": query(f"{SCORES},\n{metrics(0.5)}", f"SELECT model, {six('auc', 'auc')} FROM auc"),
    "auc_auto_direction": query(
        f"""{SCORES},\n{metrics(0.5)},
mid AS (SELECT model, quantile_cont(1 - p_hat, 0.5) FILTER (WHERE y = 0) AS m0, quantile_cont(1 - p_hat, 0.5) FILTER (WHERE y = 1) AS m1
  FROM scores GROUP BY model)""",
        f"SELECT model, {six('CASE WHEN m0 > m1 THEN auc ELSE 1 - auc END', 'auc')} FROM auc JOIN mid USING (model)",
    ),
    "metrics_union": query(
        f"{SCORES},\n{metrics(0.5)}",
        f"""SELECT model, {six('error', 'error')}, {six('auc', 'auc')}, {six("CASE WHEN model = 'Logit' THEN brier END", 'brier')},
  {six("CASE WHEN model = 'CART' THEN accuracy END", 'accuracy')} FROM metrics""",
    ),
    "roc_points": query(
        f"{SCORES},\n{_CURVE}",
        f"""SELECT model, {six('up_neg / all_neg', 'fpr')}, {six('up_pos / all_pos', 'tpr')} FROM curve
UNION ALL SELECT DISTINCT model, 0::DOUBLE, 0::DOUBLE FROM curve""",
    ),
    "pr_curve": query(
        f"""{SCORES},
grid AS (SELECT DISTINCT model, unnest(quantile_cont(p_hat, [{', '.join(f'{i}/249.0::DOUBLE' for i in range(250))}])) AS t
         FROM scores GROUP BY model),
swept AS (SELECT model, t, sum(y) AS tp, count(*) - sum(y) AS fp FROM grid JOIN scores USING (model) WHERE p_hat >= t GROUP BY model, t),
pos AS (SELECT model, sum(y) AS pos FROM scores GROUP BY model)""",
        f"""SELECT model, {six('t', 'threshold')}, {six('tp / pos', 'recall')}, {six('tp / (tp + fp)', 'precision')}
FROM swept JOIN pos USING (model)""",
    ),
    "gains": query(
        f"{SCORES},\n{_ORDERED}",
        f"SELECT model, {big('id', 'id')}, {six('place / n', 'frac_population')}, {six('caught / pos', 'frac_defaults_captured')} FROM ordered",
    ),
    "screening_budget": query(
        f"{SCORES},\n{_ORDERED},\nshares AS (SELECT unnest([0.01, 0.05, 0.1, 0.2, 0.3, 0.5])::DOUBLE AS s)",
        f"""SELECT model, s AS review_share, {big('place', 'reviewed')}, {big('caught', 'defaults_found')},
  {six('caught / pos', 'frac_defaults_captured')}, {six('(caught / pos) / (place / n)', 'lift')}
FROM ordered JOIN shares ON place = floor(s * CAST(n AS DOUBLE))""",
    ),
    "score_density": query(
        f"""{SCORES},
setup AS (SELECT model, y, count(*) AS n, stddev_samp(p_hat) AS sd, quantile_cont(p_hat, 0.75) - quantile_cont(p_hat, 0.25) AS iqr
          FROM scores GROUP BY model, y),
width AS (SELECT model, y, n, 0.9::DOUBLE * 1.1::DOUBLE * pow(CAST(n AS DOUBLE), -0.2::DOUBLE)
            * least(sd, CASE WHEN iqr > 0 THEN iqr / 1.34::DOUBLE ELSE sd END) AS h FROM setup),
ends AS (SELECT min(p_hat) AS a, max(p_hat) AS b FROM scores),
grid AS (SELECT a + (b - a) / 511::DOUBLE * i AS x FROM ends, range(512) r(i)),
merged AS (SELECT model, y, (p_hat - a) / ((b - a) / 1023::DOUBLE) AS spot, a, (b - a) / 1023::DOUBLE AS step, count(*) AS m
           FROM scores, ends GROUP BY model, y, p_hat, a, b),
shared AS (SELECT model, y, a, step, least(floor(spot), 1022) AS c, m * (1 - (spot - least(floor(spot), 1022))) AS w FROM merged
           UNION ALL
           SELECT model, y, a, step, least(floor(spot), 1022) + 1 AS c, m * (spot - least(floor(spot), 1022)) AS w FROM merged),
kernels AS (SELECT model, y, a + step * c AS p_hat, sum(w) AS w FROM shared GROUP BY model, y, a, step, c)""",
        f"""SELECT model, {big('y', 'y')}, {six('x', 'x')},
  {six('sum(w * exp(-0.5::DOUBLE * ((x - p_hat) / h) * ((x - p_hat) / h))) / (max(n) * max(h) * sqrt(2 * pi()))', 'density')}
FROM kernels JOIN width USING (model, y), grid GROUP BY model, y, x""",
    ),
    "oob_path": query(VOTES, f"SELECT {big('tree', 'tree')}, {six('oob_error', 'oob_error')}, {big('n_rows', 'n_rows')} FROM path"),
    "oob_summary": query(
        VOTES,
        f"""SELECT {big('count(*)', 'n_trees_final')}, {six('arg_max(oob_error, tree)', 'oob_error_final')},
  {six('min(oob_error)', 'oob_error_min')},
  (SELECT CAST(min(tree) AS BIGINT) FROM path WHERE oob_error = (SELECT min(oob_error) FROM path)) AS n_trees_at_min FROM path""",
    ),
    "oob_scores": query(
        VOTES,
        f"""SELECT {big('id', 'id')}, {big('max(y)', 'y')}, {six('avg(vote)', 'oob_prob')}, {big('count(vote)', 'n_oob')}
FROM votes GROUP BY id HAVING count(vote) > 0""",
    ),
    "naive_effect": query(
        f"{EFFECT},\n{_ARMS}",
        f"""SELECT {six('theta', 'theta')}, {six('se', 'se')}, {six('theta - 1.96::DOUBLE * se', 'ci_low')},
  {six('theta + 1.96::DOUBLE * se', 'ci_high')}, {big('n1', 'n_treated')}, {big('n0', 'n_control')} FROM arms""",
    ),
    "residuals": query(NUISANCE, f"SELECT {big('id', 'id')}, {six('ty', 'ty')}, {six('td', 'td')} FROM resid"),
    "ols_residual": query(
        f"{EFFECT},\n{_SLOPE.format(y='y', x='d', t='folded')}", f"SELECT {_FIT_COLUMNS} FROM est"
    ),
    "dml_cell_mean": query(
        f"{NUISANCE},\n{_SLOPE.format(y='ty', x='td', t='resid')}", f"SELECT {_FIT_COLUMNS} FROM est"
    ),
    "effect_table": query(
        f"""{NUISANCE},\n{_ARMS},\n{_SLOPE.format(y='ty', x='td', t='resid')},
both_rows AS (SELECT 'Naive diff-in-means' AS estimator, theta, theta - 1.96::DOUBLE * se AS ci_low, theta + 1.96::DOUBLE * se AS ci_high FROM arms
  UNION ALL SELECT 'DML (cell means, K-fold)', theta, theta - t975 * se, theta + t975 * se FROM est)""",
        f"""SELECT '60-month term (vs 36-month)' AS treatment, estimator, {six('theta', 'theta')}, {six('ci_low', 'ci_low')},
  {six('ci_high', 'ci_high')}, {six('100 * theta', 'theta_pct')}, {six('100 * ci_low', 'ci_low_pct')}, {six('100 * ci_high', 'ci_high_pct')},
  printf('%.2f [%.2f, %.2f]', 100 * theta, 100 * ci_low, 100 * ci_high) AS effect_ci FROM both_rows""",
    ),
}

_TEXTS = ", ".join(f"({i}, '{action}', '{note}')" for i, (action, note) in enumerate(AUDIT_STEPS, 1))
_COUNTS = ("n_rows", "rows_removed", "n_cols", "cols_dropped", "cols_added")
_AUDIT = {c: f"format('{{:,}}', CAST({c} AS BIGINT))" if c in _COUNTS else c for c in AUDIT_NAMES}
ORACLES["audit_report"] = (
    "SELECT " + ", ".join(f'{value} AS "{AUDIT_NAMES[c]}"' for c, value in _AUDIT.items())
    + f" FROM ({ORACLES['audit_trail']}) JOIN (VALUES {_TEXTS}) t(step, action, notes) USING (step)"
)
ORACLES["effect_report"] = "SELECT " + ", ".join(f'{c} AS "{n}"' for c, n in EFFECT_NAMES.items()) + f" FROM ({ORACLES['effect_table']})"
