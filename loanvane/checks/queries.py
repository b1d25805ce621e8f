"""Named queries over the order tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanvane.functions.labels import default_label, issue_year, long_term_flag, status_group
from loanvane.functions.scalars import (
    at_least,
    clamp_probability,
    classify,
    percent_text,
    recode,
    round_to_grid,
    thousands_text,
)
from loanvane.models import linear, pruning, trees
from loanvane.operators import cohort as cohort_ops
from loanvane.operators import describe, effects, oob, prep, profile, sampling, scores
from loanvane.operators.order_stats import exact_quantiles, scalar_quantile
from loanvane.plans import loan_study
from loanvane.runtime import shared_folder
from loanvane.sources import loan_csv, reports
from loanvane.sources.loan_view import (
    FOLD_KEY,
    SAMPLE_KEY,
    SPLIT_KEY,
    TIE_KEY,
    VIEW_CATEGORICAL,
    VIEW_MIN_BIN_ROWS,
    VIEW_NUMERIC,
    VIEW_YEARS,
    loan_view,
)

SAMPLE_FRACTION = 0.6
DECIMALS = 6
OOB_TREES = 12
MAYBE_MISSING = ["term_60", "rows_removed", "cols_dropped", "cols_added"]

def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, whole numbers to bigint: the last digits of sums differ between engines.

    Flags that may be missing become doubles, as data frames hold missing whole numbers as such.
    """
    out = {}
    for name, kind in df.dtypes:
        if name in MAYBE_MISSING:
            out[name] = F.round(F.col(name).cast("double"), DECIMALS)
        elif kind == "double":
            out[name] = F.round(F.col(name), DECIMALS)
        elif kind in ("int", "smallint", "tinyint"):
            out[name] = F.col(name).cast("long")
    return df.withColumns(out) if out else df


# --- stages -----------------------------------------------------------------------------


def loans_of(spark: SparkSession, sf: str) -> DataFrame:
    return loan_view(spark, sf)


def labelled_of(spark: SparkSession, sf: str) -> DataFrame:
    return cohort_ops.label_loans(loan_view(spark, sf))


def cohort_of(spark: SparkSession, sf: str) -> DataFrame:
    return cohort_ops.select_cohort(labelled_of(spark, sf), VIEW_YEARS)


def features_table(spark: SparkSession, sf: str) -> DataFrame:
    return profile.add_score_band(loan_study.features_of(cohort_of(spark, sf)))


def banded_of(spark: SparkSession, sf: str) -> DataFrame:
    return profile.add_score_band(profile.add_score_midpoint(cohort_of(spark, sf)))


def held(df: DataFrame) -> DataFrame:
    """Cached: exact cuts and quantiles read a table several times, and the joins below the loan view should run once."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def split_of(spark: SparkSession, sf: str) -> DataFrame:
    columns = dict.fromkeys(["id", "default", "issue_d", "zip_code", *VIEW_NUMERIC, *VIEW_CATEGORICAL])
    return sampling.train_test_flag(held(banded_of(spark, sf).select(*columns)), key=SPLIT_KEY)


def wide_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Formula scores of the cohort: a smooth one and a five-step one with heavy ties."""
    linear_part = F.lit(-3.2) + F.lit(0.09) * F.col("int_rate") + F.lit(0.5) * F.coalesce("term_60", F.lit(0))
    steps = F.lit(None).cast("double")
    for g, p in (("A", 0.05), ("B", 0.1), ("C", 0.15), ("D", 0.2), ("E", 0.25)):
        hit = F.col("grade") == g
        steps = F.when(hit, p) if g == "A" else steps.when(hit, p)
    return cohort_of(spark, sf).select(
        "id",
        F.col("default").alias("y"),
        (F.lit(1.0) / (F.lit(1.0) + F.exp(-linear_part))).alias("p_logit"),
        steps.alias("p_cart"),
    )


def scores_of(spark: SparkSession, sf: str) -> DataFrame:
    return scores.long_scores(held(wide_scores(spark, sf)))


def effect_rows_of(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome, long-term treatment, grade cell and fold of the cohort rows with a known term."""
    rows = cohort_of(spark, sf).filter(F.col("term_60").isNotNull())
    rows = rows.select("id", "grade", F.col("default").cast("double").alias("y"), F.col("term_60").cast("double").alias("d"))
    return sampling.with_folds(held(rows), 5, key=FOLD_KEY)


def nuisances_of(spark: SparkSession, sf: str) -> DataFrame:
    return effects.cell_mean_nuisances(effect_rows_of(spark, sf), ["grade"])


def study_split(spark: SparkSession, sf: str) -> loan_study.SplitData:
    data = loan_study.build_modelling_data(loan_view(spark, sf), VIEW_YEARS)
    return loan_study.split_and_impute(data.table, key=SPLIT_KEY)


# --- cohort and description -------------------------------------------------------------


def vintage_summary(spark, sf):
    return rounded(cohort_ops.vintage_summary(labelled_of(spark, sf)))


def mean_vintage_rate(spark, sf):
    summary = cohort_ops.vintage_summary(labelled_of(spark, sf))
    return rounded(cohort_ops.mean_vintage_rate(summary))


def volume_line(spark, sf):
    """Completed share drawn on the volume axis: a scalar looked up in every row."""
    summary = cohort_ops.vintage_summary(labelled_of(spark, sf))
    top = F.max("n_total").over(Window.partitionBy())
    return rounded(summary.select("issue_year", "n_total", (F.col("prop_completed") * top).alias("completed_line")))


def app_type_counts(spark, sf):
    return cohort_ops.application_counts(labelled_of(spark, sf), VIEW_YEARS)


def status_top20(spark, sf):
    return cohort_ops.top_statuses(loans_of(spark, sf))


def loan_labels(spark, sf):
    status = F.col("loan_status")
    names = {"completed": "Completed", "in_progress": "In progress", "other": "Other"}
    return rounded(
        loans_of(spark, sf).select(
            "id",
            issue_year(F.col("issue_d")).alias("issue_year"),
            recode(status_group(status), names).alias("status_label"),
            default_label(status).cast("double").alias("default_prelim"),
            long_term_flag(F.col("term")).alias("term_60"),
            describe.label_flag(long_term_flag(F.col("term")), describe.TERM_LABELS).alias("term_label"),
        )
    )


def cohort_rows(spark, sf):
    keep = ["id", "issue_year", "default", "term_60", "grade", "loan_amnt", "int_rate", "annual_inc", "dti"]
    return rounded(cohort_of(spark, sf).select(*keep))


def cohort_prefix_option(spark, sf):
    """Cohort size when every type starting with JOINT counts as joint."""
    strict = cohort_ops.select_cohort(labelled_of(spark, sf), VIEW_YEARS, joint_prefix=True)
    return describe.default_rate(strict, ["issue_year"]).transform(rounded)


def year_default_pivot(spark, sf):
    return describe.outcome_by_year(cohort_of(spark, sf))


def group_share(spark, sf):
    return rounded(describe.group_share(cohort_of(spark, sf), ["issue_year", "default"]))


def outcome_share(spark, sf):
    """Share of each outcome under its display label."""
    rows = cohort_of(spark, sf)
    return rounded(describe.group_share(rows.withColumn("outcome", describe.label_flag(F.col("default"), describe.OUTCOME_LABELS)), ["outcome"]))


def shape_log(spark, sf):
    loans = loans_of(spark, sf)
    labelled = cohort_ops.label_loans(loans)
    cohort = cohort_ops.select_cohort(labelled, VIEW_YEARS)
    return reports.shape_log({"loans": loans, "labelled": labelled, "cohort": cohort})


def scanned_of(spark: SparkSession, sf: str) -> loan_csv.ScanParts:
    """The loan view written as CSV and read back: texts with quotes, commas and line breaks, ``NA`` for missing values.

    Every fiftieth loan is written a second time with an amount that is no number.
    """
    note = F.concat(F.lit('Said "'), "loan_status", F.lit('",\n'), "grade", F.lit(', "twice"\n\nend'))
    columns = ["id", "issue_d", "loan_status", "term", "emp_length", "loan_amnt", "int_rate"]
    rows = loans_of(spark, sf).select(*columns, note.alias("note"))
    twice = F.when(F.col("id") % 50 == 7, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    rows = rows.withColumn("broken", F.explode(twice))
    amount = F.when(F.col("broken"), F.concat(F.lit("about "), F.col("loan_amnt").cast("string"))).otherwise(F.col("loan_amnt").cast("string"))
    folder = shared_folder(spark, "loan-csv")
    layout = {"header": True, "escape": '"', "nullValue": "NA", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.withColumn("loan_amnt", amount).drop("broken").write.options(**layout).csv(folder)
    return loan_csv.part_scan(loan_csv.scan_loans(spark, folder))


def csv_scan(spark, sf):
    """Loans that come back whole from CSV files."""
    return rounded(scanned_of(spark, sf).good.withColumn("id", F.col("id").cast("long")))


def csv_scan_counts(spark, sf):
    """Records read, and those kept apart as broken: as counted while they passed, and as found in their table."""
    parts = scanned_of(spark, sf)
    kept_apart = parts.bad.filter(F.col(loan_csv.BAD_RECORD).contains(",about "))
    return kept_apart.agg(F.count(F.lit(1)).alias("n_apart")).select(F.lit(parts.n_read).cast("long").alias("n_read"), F.lit(parts.n_bad).cast("long").alias("n_bad"), "n_apart")


def rate_by_grade_term(spark, sf):
    return rounded(describe.rate_by_grade_term(cohort_of(spark, sf)))


def rate_by_int_bin(spark, sf):
    return rounded(describe.rate_by_interest_bin(cohort_of(spark, sf), min_rows=VIEW_MIN_BIN_ROWS))


def max_bin_rate(spark, sf):
    bins = describe.rate_by_interest_bin(cohort_of(spark, sf), min_rows=VIEW_MIN_BIN_ROWS)
    return rounded(bins.agg(F.max("def_rate").alias("y_max"), F.min("def_rate").alias("y_min"), F.count("n").alias("bins")))


def risk_surface(spark, sf):
    return rounded(describe.risk_surface(banded_of(spark, sf)))


def report_texts(spark, sf):
    """Percent, thousands and rounded texts of the grade table."""
    rates = describe.default_rate(cohort_of(spark, sf), ["grade"])
    return rates.select(
        "grade",
        percent_text(F.bround("def_rate", 4), 1).alias("rate_text"),
        thousands_text(F.col("n")).alias("n_text"),
        round_to_grid(F.col("def_rate"), 2).alias("rate_round"),
    ).transform(rounded)


# --- features and profile ---------------------------------------------------------------


def fico_bins(spark, sf):
    return rounded(banded_of(spark, sf).select("id", "fico_avg", "fico_bin"))


def lump_purpose(spark, sf):
    return profile.lump_rare(cohort_of(spark, sf), "purpose").select("id", "purpose")


def present_counts(df: DataFrame) -> DataFrame:
    """``(variable, n_present)`` for every column from one aggregate."""
    return df.agg(*[F.count(c).alias(c) for c in df.columns]).unpivot([], df.columns, "variable", "n_present")


def var_flags(spark, sf):
    """Screen flags of every raw column with the number of values it holds."""
    loans = loans_of(spark, sf)
    return profile.screen_flags(loans).join(present_counts(loans), "variable")


def flag_crosstab(spark, sf):
    """Screen cross-tab over the columns of the raw table that hold a value."""
    loans = loans_of(spark, sf)
    held = present_counts(loans).filter("n_present > 0").select("variable")
    return profile.flag_crosstab(profile.screen_flags(loans).join(held, "variable"))


def model_base_columns(spark, sf):
    """Columns left after the screen and how many values each holds."""
    return present_counts(profile.drop_screened(cohort_of(spark, sf)))


def missing_profile(spark, sf):
    df = features_table(spark, sf)
    columns = profile.numeric_candidates(df.columns) + profile.categorical_candidates(df.columns)
    return rounded(profile.missing_profile(df, columns))


def sd_profile(spark, sf):
    df = features_table(spark, sf)
    return rounded(profile.spread_profile(df, profile.numeric_candidates(df.columns)))


def dominant_share(spark, sf):
    df = features_table(spark, sf)
    return rounded(profile.dominance_profile(df, profile.categorical_candidates(df.columns)))


def final_predictors(spark, sf):
    found = profile.predictor_profile(loan_study.features_of(cohort_of(spark, sf)))
    return found.filter("keep").select("variable", "kind")


def audit_trail(spark, sf):
    audit = loan_study.build_modelling_data(loan_view(spark, sf), VIEW_YEARS, target_rows=loan_study.TARGET_ROWS).audit
    return rounded(audit.drop("action", "notes"))


def audit_report(spark, sf):
    """The audit trail as exported: display names, counts with thousands separators."""
    audit = loan_study.build_modelling_data(loan_view(spark, sf), VIEW_YEARS, target_rows=loan_study.TARGET_ROWS).audit
    return rounded(reports.report_table(describe.audit_display(audit), reports.AUDIT_NAMES))


def quantile75(spark, sf):
    found = exact_quantiles(cohort_of(spark, sf), ["int_rate", "annual_inc"], [0.75])
    return rounded(found.select("variable", F.col("value").alias("q75")))


# --- sampling, split, imputation --------------------------------------------------------


def strat_sample(spark, sf):
    taken = sampling.stratified_sample(cohort_of(spark, sf), fraction=SAMPLE_FRACTION, key=SAMPLE_KEY)
    return rounded(taken.select("id", "issue_year", "default"))


def train_test_split(spark, sf):
    split = sampling.train_test_flag(cohort_of(spark, sf), key=SPLIT_KEY)
    return rounded(split.select("id", "default", F.col("is_train").cast("int").alias("is_train")))


def train_semi_join(spark, sf):
    """Training rows picked by membership of their id in the training ids."""
    rows = cohort_of(spark, sf)
    ids = sampling.train_test_flag(rows, key=SPLIT_KEY).filter("is_train").select("id")
    return rounded(rows.join(ids, "id", "left_semi").select("id", "grade", "int_rate"))


def split_balance(spark, sf):
    balance = prep.split_balance(sampling.train_test_flag(cohort_of(spark, sf), key=SPLIT_KEY))
    return rounded(balance.withColumn("balanced", F.col("balanced").cast("int")))


def kfold_assign(spark, sf):
    return rounded(sampling.with_folds(cohort_of(spark, sf), 5, key=FOLD_KEY).select("id", "fold"))


def train_medians(spark, sf):
    train = split_of(spark, sf).filter("is_train")
    return rounded(prep.train_medians(train, VIEW_NUMERIC))


def train_levels(spark, sf):
    return rounded(prep.fit_levels(split_of(spark, sf).filter("is_train"), VIEW_CATEGORICAL))


def impute_apply(spark, sf):
    split = split_of(spark, sf)
    imputer = prep.Imputer.fit(split.filter("is_train"), VIEW_NUMERIC, VIEW_CATEGORICAL)
    filled = imputer.transform(split).select("id", *VIEW_NUMERIC, *VIEW_CATEGORICAL)
    # six digits, cut where no value of the book lies, so that engines cannot round a tie apart
    return rounded(filled.withColumns({c: F.floor(F.col(c) * 1_000_000 + 0.4321) / 1_000_000 for c in VIEW_NUMERIC}))


def unseen_levels(spark, sf):
    """Region-by-month cells of test loans, those never seen in training set to Unknown."""
    split = split_of(spark, sf).withColumn("cell", F.concat_ws("-", "zip_code", "issue_d"))
    seen = prep.seen_levels(split.filter("is_train"), ["cell"])
    return prep.align_by_join(split.filter("not is_train").select("id", "cell"), "cell", seen)


def dq_checks(spark, sf):
    split = split_of(spark, sf)
    return prep.quality_checks(split, VIEW_NUMERIC + VIEW_CATEGORICAL)


def dq_checks_imputed(spark, sf):
    split = split_of(spark, sf)
    imputer = prep.Imputer.fit(split.filter("is_train"), VIEW_NUMERIC, VIEW_CATEGORICAL)
    return prep.quality_checks(imputer.transform(split), VIEW_NUMERIC + VIEW_CATEGORICAL)


def design_totals(spark, sf):
    """Column totals of the one-hot design over training rows."""
    split = split_of(spark, sf)
    imputer = prep.Imputer.fit(split.filter("is_train"), VIEW_NUMERIC, VIEW_CATEGORICAL)
    design = prep.Design.fit(imputer, VIEW_NUMERIC, VIEW_CATEGORICAL)
    vectors = design.transform(imputer.transform(split.filter("is_train")), keep=["id"])
    total = linear.Summarizer.metrics("sum").summary(F.col("features"))["sum"]
    values = vectors.select(linear.vector_to_array(total).alias("v"))
    names = F.array(*[F.lit(n) for n in design.names])
    pairs = values.select(F.explode(F.arrays_zip(names.alias("feature"), F.col("v"))).alias("p"))
    return pairs.select(F.col("p.feature").alias("feature"), F.round(F.col("p.v"), 2).alias("total"))


def high_rate_treatment(spark, sf):
    """High-rate flag at the training upper quartile, which is looked up as a scalar."""
    train = split_of(spark, sf).filter("is_train")
    threshold = scalar_quantile(train, "int_rate", 0.75)
    return rounded(train.select("id", at_least(F.col("int_rate"), threshold).alias("high_rate")))


# --- evaluation -------------------------------------------------------------------------


def score_expr(spark, sf):
    p = (F.col("p_logit") - 0.25) * 4
    return rounded(
        wide_scores(spark, sf).select(
            "id",
            clamp_probability(p).alias("p_clamped"),
            classify(F.col("p_cart"), 0.15).alias("class_at"),
            classify(F.col("p_cart"), 0.15, strict=True).alias("class_above"),
        )
    )


def score_unpivot(spark, sf):
    return rounded(scores_of(spark, sf))


def score_metrics(spark, sf):
    return rounded(scores.score_metrics(scores_of(spark, sf), threshold=0.2))


def model_ranking(spark, sf):
    """Metrics at one half under report names, best AUC first."""
    ranked = scores.rank_models(scores.score_metrics(scores_of(spark, sf)))
    return reports.report_table(ranked, reports.METRIC_NAMES, 3)


def auc_exact(spark, sf):
    return rounded(scores.score_metrics(scores_of(spark, sf)).select("model", "auc"))


def auc_auto_direction(spark, sf):
    """AUC of a reversed score, turned around by class medians."""
    reverse = scores_of(spark, sf).withColumn("p_hat", F.lit(1.0) - F.col("p_hat"))
    return rounded(scores.score_metrics(reverse, auto_direction=True).select("model", "auc"))


def metrics_union(spark, sf):
    """Tables of two model families under each other: a measure that one of them does not report is NULL there."""
    found = scores.score_metrics(scores_of(spark, sf))
    smooth = found.filter("model = 'Logit'").select("model", "error", "auc", "brier")
    steps = found.filter("model = 'CART'").select("model", "error", "auc", "accuracy")
    return rounded(smooth.unionByName(steps, allowMissingColumns=True))


def roc_points(spark, sf):
    return rounded(scores.roc_points(scores.score_curve(scores_of(spark, sf))).drop("threshold"))


def pr_curve(spark, sf):
    return rounded(scores.precision_recall(scores.score_curve(scores_of(spark, sf))))


def gains(spark, sf):
    return rounded(scores.cumulative_gains(scores_of(spark, sf), key=TIE_KEY))


def screening_budget(spark, sf):
    return rounded(scores.screening_budget(scores_of(spark, sf), key=TIE_KEY))


def score_density(spark, sf):
    return rounded(scores.score_density(scores_of(spark, sf)))


def formula_votes(spark, sf):
    """Formula votes of a few trees with hashed in-bag flags."""
    wide = wide_scores(spark, sf)
    votes = []
    for b in range(OOB_TREES):
        draw = sampling.RandomKey(1009 + 97 * b, portable=True).column(F.col("id"))
        vote = F.col("p_logit") + (draw % 1000 - 500) / F.lit(1000.0)
        votes.append(F.when(draw % 100 < 37, vote))
    return wide.select("id", "y", F.array(*votes).alias("oob"))


def oob_path(spark, sf):
    return rounded(oob.oob_error_path(formula_votes(spark, sf)))


def oob_summary(spark, sf):
    return rounded(oob.oob_summary(oob.oob_error_path(formula_votes(spark, sf))))


def oob_scores(spark, sf):
    return rounded(oob.oob_scores(formula_votes(spark, sf)))


# --- effects ----------------------------------------------------------------------------


def naive_effect(spark, sf):
    return rounded(effects.naive_effect(effect_rows_of(spark, sf)))


def residuals(spark, sf):
    return rounded(effects.residualise(nuisances_of(spark, sf)).select("id", "ty", "td"))


def ols_residual(spark, sf):
    rows = effect_rows_of(spark, sf).select(F.col("y").alias("ty"), F.col("d").alias("td"))
    return rounded(effects.simple_regression(rows))


def dml_cell_mean(spark, sf):
    return rounded(effects.partially_linear(nuisances_of(spark, sf)))


def effect_table(spark, sf):
    rows = effect_rows_of(spark, sf)
    parts = effects.effect_rows(
        "term_60",
        effects.naive_effect(rows),
        effects.partially_linear(effects.cell_mean_nuisances(rows, ["grade"])),
        effects.CELL_LABEL,
    )
    return rounded(effects.effect_table([parts]))


def effect_report(spark, sf):
    """The effect table as exported."""
    return effects.display_effects(effect_table(spark, sf), reports.EFFECT_NAMES)


# --- models -----------------------------------------------------------------------------


def design_matrix(spark, sf):
    data = study_split(spark, sf)
    return data.design.transform(data.train)


def logit(spark, sf):
    data = study_split(spark, sf)
    fitted = linear.fit_logit(loan_study.kept(data.design.transform(data.train)))
    return linear.score(fitted, data.design.transform(data.test), "p_hat").drop("features")


def enet_grid(spark, sf):
    """All mixing shares over the whole penalty path, five folds each."""
    data = study_split(spark, sf)
    folded = sampling.with_folds(data.train, key=FOLD_KEY)
    train = loan_study.kept(data.design.transform(folded, keep=["id", "default", "fold"]))
    penalties = linear.tune(train)
    models = linear.fit_alphas(train, penalties)
    long = linear.alpha_scores(models, penalties, data.design.transform(data.test))
    return linear.grid_table(penalties, scores.score_metrics(long))


def cart_of(spark, sf):
    data = study_split(spark, sf)
    folded = sampling.with_folds(data.train, key=FOLD_KEY)
    rows = loan_study.kept(data.tree_design.transform(folded, keep=["id", "default", "fold"]))
    return data, pruning.fit_cart(rows, data.tree_design.max_bins)


def cart(spark, sf):
    """Test scores of the classification tree, pruned unless that leaves no split, with the price that pruned it."""
    data, fitted = cart_of(spark, sf)
    scored = trees.bag_scores(data.tree_design.transform(data.test), {"p_hat": (fitted.tree, "features", False)}, ["id", "default"])
    return scored.withColumn("lambda", F.lit(fitted.cp))


def cart_prices(spark, sf):
    """Every subtree of the grown tree: its price, splits, training and cross-validated errors relative to the root's."""
    return cart_of(spark, sf)[1].cp_table(spark)


def bagging_oob(spark, sf):
    data = study_split(spark, sf)
    train = loan_study.kept(data.tree_design.transform(data.train))
    grown = trees.fit_bag(train, seed=7, max_bins=data.tree_design.max_bins, cp=trees.CP)
    return trees.out_of_bag_path(grown)


def bagging_vote(spark, sf):
    data = study_split(spark, sf)
    design = data.tree_design
    train = loan_study.kept(design.transform(data.train))
    grown = trees.fit_bag(
        train, trees.VOTE_TREES, 8, max_bins=design.max_bins, max_depth=trees.VOTE_DEPTH, min_leaf=trees.VOTE_LEAF
    )
    return trees.bag_scores(design.transform(data.test), {"p_hat": (grown, "features", True)}, ["id", "default"])


def forest(spark, sf):
    data = study_split(spark, sf)
    design = data.tree_design
    train = loan_study.kept(design.transform(data.train, nominal=False))
    grown = trees.fit_bag(
        train, trees.FOREST_TREES, 9, trees.default_mtry(len(design.names)), design.max_bins, trees.FOREST_DEPTH, trees.FOREST_LEAF
    )
    return trees.importance_table(grown, design.names, spark)


def model_comparison(spark, sf):
    return loan_study.compare_models(study_split(spark, sf), fold_key=FOLD_KEY).metrics


def dml_enet(spark, sf):
    """Effects with nuisances of the mixing share that the model choice finds best."""
    data = study_split(spark, sf)
    folded = sampling.with_folds(data.train, key=FOLD_KEY)
    train = loan_study.kept(data.design.transform(folded, keep=["id", "default", "fold"]))
    penalties = linear.tune(train)
    long = linear.alpha_scores(linear.fit_alphas(train, penalties), penalties, data.design.transform(data.test))
    best = linear.choose(linear.grid_table(penalties, scores.score_metrics(long)))
    train.unpersist()
    return loan_study.estimate_effects(data, alpha=best.alpha, key=FOLD_KEY)


ORDER = [
    vintage_summary, mean_vintage_rate, volume_line, app_type_counts, status_top20, loan_labels, cohort_rows,
    cohort_prefix_option, year_default_pivot, group_share, outcome_share, shape_log, csv_scan, csv_scan_counts, rate_by_grade_term, rate_by_int_bin,
    max_bin_rate, risk_surface, report_texts, fico_bins, lump_purpose, var_flags, flag_crosstab, model_base_columns,
    missing_profile, sd_profile, dominant_share, final_predictors, audit_trail, audit_report, quantile75, strat_sample,
    train_test_split, train_semi_join, split_balance, kfold_assign, train_medians, train_levels, impute_apply,
    unseen_levels, dq_checks, dq_checks_imputed, design_totals, high_rate_treatment, score_expr, score_unpivot,
    score_metrics, model_ranking, auc_exact, auc_auto_direction, metrics_union, roc_points, pr_curve, gains,
    screening_budget, score_density, oob_path, oob_summary, oob_scores, naive_effect, residuals, ols_residual,
    dml_cell_mean, effect_table, effect_report, design_matrix, logit, enet_grid, cart, cart_prices, bagging_oob, bagging_vote, forest,
    model_comparison, dml_enet,
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in ORDER}
