"""The three end-to-end runs: modelling table, model comparison, treatment effects."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanvane.functions.keys import RandomKey
from loanvane.functions.names import (
    CATEGORICAL_SHORTLIST,
    NUMERIC_SHORTLIST,
    intersect,
    numeric_columns,
    string_columns,
)
from loanvane.models import linear, trees
from loanvane.models.dml import DEFAULT_ALPHA, estimate_effect, high_rate_threshold, with_high_rate
from loanvane.models.pruning import fit_cart
from loanvane.operators import oob as oob_ops
from loanvane.operators.cohort import COHORT_YEARS, cohort_counts, label_loans, select_cohort
from loanvane.operators.describe import audit_trail
from loanvane.operators.effects import effect_rows, effect_table
from loanvane.operators.prep import NOT_PREDICTORS, Design, Imputer, TreeDesign, fit_imputer, require_clean
from loanvane.operators.profile import (
    add_score_band,
    add_score_midpoint,
    drop_screened,
    final_predictors,
    lump_rare,
    modelling_table,
    predictor_profile,
)
from loanvane.operators.sampling import stratified_sample, train_test_flag, with_folds
from loanvane.operators.scores import long_scores, rank_models, score_metrics
from loanvane.runtime import bounded_rows, small_table

TARGET_ROWS = 120_000

AUDIT_STEPS = [
    ("Raw loans", "every row of the source"),
    ("Dated loans", "issue year, status group and outcome added; rows without a year left out"),
    ("Cohort", "chosen years, finished single-applicant loans with known amount, rate, income and debt ratio"),
    ("Sample", "the same share of each issue year and outcome"),
    ("Screened columns", "identifiers, free text and anything known only after issue left out"),
    ("Features", "mean credit score added, rare purposes merged"),
    ("Modelling table", "outcome, term flag, issue year and the predictors that passed the profile"),
]


@dataclass(frozen=True)
class ModellingData:
    """The modelling table; ``audit`` counts the raw loans when it is asked for, as nothing else needs them."""

    table: DataFrame
    profile: DataFrame
    rows: int
    make_audit: Callable[[], DataFrame]

    @cached_property
    def audit(self) -> DataFrame:
        return self.make_audit()


@dataclass(frozen=True)
class SplitData:
    """Imputed splits with the fitted imputer and predictor lists; ``score bands`` included by default."""

    train: DataFrame
    test: DataFrame
    imputer: Imputer
    numeric: list[str]
    categorical: list[str]
    rows: int

    @property
    def design(self) -> Design:
        return Design.fit(self.imputer, self.numeric, self.categorical)

    @property
    def tree_design(self) -> TreeDesign:
        return TreeDesign(tuple(self.numeric), {c: list(self.imputer.levels[c]) for c in self.categorical})


def stage_counts(loans: DataFrame, years: Sequence[str], target_rows: int | None) -> dict[str, int]:
    """Rows of the raw, labelled, cohort and sample stages from one grouped aggregate."""
    strata = bounded_rows(cohort_counts(loans, years))  # issue years x outcomes x 2 rows
    cohort = [r["n"] for r in strata if r["in_cohort"]]
    total = sum(cohort)
    share = min(1.0, target_rows / total) if target_rows is not None and total else 1.0
    return {
        "raw": sum(r["n"] for r in strata),
        "year": sum(r["n"] for r in strata if r["issue_year"] is not None),
        "cohort": total,
        "sample": sum(int(n * share) for n in cohort),
        "share": share,
    }


def feature_columns(base: DataFrame) -> list[str]:
    """Columns the study uses: key, labels and the shortlist with the score bounds."""
    lead = ["id", "default", "term_60", "issue_year"]
    return intersect(lead + NUMERIC_SHORTLIST + CATEGORICAL_SHORTLIST, base.columns)


def features_of(sample: DataFrame, rows: int | None = None) -> DataFrame:
    """Leakage-free columns with the score midpoint and lumped purposes."""
    features = add_score_midpoint(drop_screened(sample))
    return lump_rare(features, "purpose", rows=rows) if "purpose" in features.columns else features


def kept(df: DataFrame) -> DataFrame:
    """Cached for the many passes of a fit, rows dealt by id over at least all cores: a pass is bound by arithmetic.

    No result depends on the number of partitions.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, "id").persist(StorageLevel.MEMORY_AND_DISK)


def build_modelling_data(
    loans: DataFrame,
    years: Sequence[str] = COHORT_YEARS,
    target_rows: int | None = None,
    key: RandomKey | None = None,
) -> ModellingData:
    """Raw loans to the modelling table, its predictor profile and the audit trail.

    All cohort rows are used unless ``target_rows`` asks for a stratified sample.
    """
    labelled = label_loans(loans)
    cohort = select_cohort(labelled, years)
    base = drop_screened(cohort)
    # One pass over the raw loans: every later step reads this narrow table.
    narrow = base.select(*feature_columns(base)).persist(StorageLevel.MEMORY_AND_DISK)
    strata = [r["n"] for r in bounded_rows(narrow.groupBy("issue_year", "default").agg(F.count(F.lit(1)).alias("n")))]
    share = min(1.0, target_rows / sum(strata)) if target_rows is not None and strata else 1.0
    n_sample = sum(int(n * share) for n in strata)
    features = features_of(stratified_sample(narrow, fraction=share, key=key), n_sample)
    profile = small_table(predictor_profile(features))
    table = modelling_table(features, final_predictors(profile))
    n_base = len(base.columns) - ("id" in base.columns)
    cols = [len(loans.columns), len(labelled.columns), len(cohort.columns), len(cohort.columns)]
    cols += [n_base, n_base + ("fico_avg" in features.columns), len(table.columns) - 1]

    def audit() -> DataFrame:
        counts = stage_counts(loans, years, target_rows)
        rows = [counts["raw"], counts["year"], counts["cohort"]] + [counts["sample"]] * 4
        steps = [(i + 1, a, r, c, n) for i, ((a, n), r, c) in enumerate(zip(AUDIT_STEPS, rows, cols))]
        schema = "step int, action string, n_rows long, n_cols long, notes string"
        return audit_trail(loans.sparkSession.createDataFrame(steps, schema))

    return ModellingData(table, profile, n_sample, audit)


def split_and_impute(
    table: DataFrame, use_score_band: bool = True, fraction: float = 0.7, key: RandomKey | None = None
) -> SplitData:
    """Split within outcome, fit medians and levels on the training rows, apply to both."""
    banded = add_score_band(table) if use_score_band else table
    typed = banded.withColumns({c: F.col(c).cast("int") for c in ("default", "term_60")})
    split = train_test_flag(typed, fraction=fraction, key=key).persist(StorageLevel.MEMORY_AND_DISK)
    rows = split.count()
    train, test = split.filter("is_train"), split.filter("not is_train")
    imputer = fit_imputer(train)
    numeric, categorical = numeric_columns(split, NOT_PREDICTORS), string_columns(split, NOT_PREDICTORS)
    return SplitData(imputer.transform(train), imputer.transform(test), imputer, numeric, categorical, rows)


@dataclass(frozen=True)
class Comparison:
    scores: DataFrame
    metrics: DataFrame
    alpha_grid: DataFrame
    penalty: linear.Penalty
    oob: DataFrame
    oob_path: DataFrame
    importance: DataFrame
    families: DataFrame


def model_families(metrics: DataFrame, grid: DataFrame, cart_cp: float) -> DataFrame:
    """Metrics of the regression and the tree family by name: every mixing share with its penalty and deviance, the pruned
    tree with its price as penalty; what a model does not have is NULL."""
    part = lambda names: metrics.filter(F.col("model").isin(names))
    regression = part(["Logit"]).unionByName(grid, allowMissingColumns=True).withColumn("family", F.lit("regression"))
    tree = part(["CART"]).withColumn("lambda", F.lit(cart_cp))
    others = metrics.filter(~F.col("model").isin(["Logit", "Elastic net", "CART"]))
    trees_ = tree.unionByName(others, allowMissingColumns=True).withColumn("family", F.lit("tree"))
    out = regression.unionByName(trees_, allowMissingColumns=True)
    return out.select("family", "model", "alpha", "lambda", "cv_error", *[c for c in metrics.columns if c != "model"])


def compare_models(
    data: SplitData,
    alphas: Sequence[float] = linear.ALPHAS,
    path_length: int = linear.PATH_LENGTH,
    path_ratio: float = linear.PATH_RATIO,
    bag_trees: int = trees.BAG_TREES,
    vote_trees: int = trees.VOTE_TREES,
    forest_trees: int = trees.FOREST_TREES,
    fold_key: RandomKey | None = None,
    seed: int = 1363,
) -> Comparison:
    """Fit the six models on the training rows and evaluate them on the same test rows.

    One cached table a split holds the design, nominal and ordered vectors of a row, so that scores of
    all models come from one pass and no join. The forest that is scored is the one whose out-of-bag
    error and importance are reported.
    """
    predictors = data.numeric + data.categorical
    require_clean(data.train, predictors)
    require_clean(data.test, predictors)
    x_train, x_test = kept(all_features(data, with_folds(data.train, key=fold_key))), kept(all_features(data, data.test))
    bins = data.tree_design.max_bins
    mtry = trees.default_mtry(len(predictors))

    view = lambda df, name: df.select("id", "default", *[c for c in df.columns if c == "fold"], F.col(name).alias("features"))
    design, nominal, ordered = (view(x_train, name) for name in ("design", "nominal", "ordered"))
    logit = linear.fit_logit(design)
    penalties = linear.tune(design, "default", alphas, path_length, path_ratio)
    by_alpha = linear.fit_alphas(design, penalties)
    grid = linear.grid_table(penalties, score_metrics(linear.alpha_scores(by_alpha, penalties, view(x_test, "design"))))
    penalty = linear.choose(grid)
    enet = by_alpha[[p.alpha for p in penalties].index(penalty.alpha)]
    cart = fit_cart(nominal, bins)
    bag = trees.fit_bag(nominal, bag_trees, seed + 6, max_bins=bins, cp=trees.CP)
    vote = trees.fit_bag(nominal, vote_trees, seed + 7, max_bins=bins, max_depth=trees.VOTE_DEPTH, min_leaf=trees.VOTE_LEAF)
    forest = trees.fit_bag(ordered, forest_trees, seed + 8, mtry, bins, trees.FOREST_DEPTH, trees.FOREST_LEAF)

    wide = linear.score(logit, x_test.withColumnRenamed("design", "features"), "p_logit")
    wide = linear.score(enet, wide, "p_enet").drop("features")
    tree_scores = {
        "p_cart": (cart.tree, "nominal", False), "p_bag_custom": (bag, "nominal", False),
        "p_bag_ipred": (vote, "nominal", True), "p_rf": (forest, "ordered", False),
    }
    wide = trees.bag_scores(wide, tree_scores, ["id", "default", "p_logit", "p_enet"])
    scores = kept(long_scores(wide.withColumnRenamed("default", "y")))
    metrics = rank_models(score_metrics(scores))

    bag_oob = trees.out_of_bag(bag).persist(StorageLevel.MEMORY_AND_DISK)
    path = oob_ops.oob_error_path(bag_oob)
    sets = [("custom", oob_ops.oob_scores(bag_oob)), ("ipred", trees.unseen_scores(vote, majority=True)), ("forest", trees.unseen_scores(forest))]
    stacked = None
    for name, unseen in sets:
        part = unseen.select("id", "y", F.lit(name).alias("model"), F.col("oob_prob").alias("p_hat"))
        stacked = part if stacked is None else stacked.unionByName(part)
    oob_metrics = small_table(score_metrics(stacked))
    found = {r["model"]: r for r in oob_metrics.collect()}
    others = [
        ("ipred", len(vote), found["ipred"]["error"], None),
        ("forest", len(forest), found["forest"]["error"], found["forest"]["brier"]),
    ]
    report = small_table(oob_ops.oob_report(oob_ops.oob_summary(path), oob_metrics.filter("model = 'custom'"), others))
    importance = trees.importance_table(forest, data.tree_design.names, data.train.sparkSession)
    families = model_families(small_table(metrics), small_table(grid), cart.cp)
    result = Comparison(scores, small_table(metrics), small_table(grid), penalty, report, small_table(path), importance, families)
    for table in (x_train, bag_oob, cart.tree.rows):
        table.unpersist()
    for grown in (bag, vote, forest):
        grown.release()
    return result


def all_features(data: SplitData, rows: DataFrame) -> DataFrame:
    """Row keys with the one-hot design, and the tree features with nominal and with ordered levels."""
    extra = [c for c in rows.columns if c == "fold"]
    predictors = [*data.numeric, *data.categorical]
    out = data.design.transform(rows, "design", ["id", "default", *extra, *predictors])
    out = data.tree_design.transform(out, "nominal", ["id", "default", *extra, "design", *predictors])
    return data.tree_design.transform(out, "ordered", ["id", "default", *extra, "design", "nominal"], nominal=False)


def estimate_effects(
    data: SplitData,
    alpha: float = DEFAULT_ALPHA,
    path_length: int = linear.PATH_LENGTH,
    path_ratio: float = linear.PATH_RATIO,
    defensible: bool = False,
    key: RandomKey | None = None,
) -> DataFrame:
    """Naive and cross-fitted effects of a long term and of a high rate on the training rows.

    ``defensible`` leaves out the columns each treatment is computed from.
    """
    marked = with_high_rate(data.train, high_rate_threshold(data.train))
    parts = []
    for treatment, source in (("term_60", ["term"]), ("high_rate", ["int_rate"])):
        result = estimate_effect(
            marked, data.imputer, data.numeric, data.categorical, treatment,
            exclude=source if defensible else (), alpha=alpha, path_length=path_length, path_ratio=path_ratio, key=key,
        )
        parts.append(effect_rows(treatment, result.naive, result.estimate))
    return effect_table(parts)
