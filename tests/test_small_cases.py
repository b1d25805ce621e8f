"""Hand-made cases with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from loanvane.functions import names, scalars
from loanvane.functions.labels import default_label, is_individual, issue_year, long_term_flag, status_group
from loanvane.operators import describe, effects, oob, prep, profile, sampling, scores
from loanvane.operators.order_stats import exact_quantiles


def column(spark, values, expression, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def score_rows(spark, y, p, model="m"):
    return spark.createDataFrame(
        [(i, a, model, b) for i, (a, b) in enumerate(zip(y, p))], "id long, y int, model string, p_hat double"
    )


def test_labels(spark):
    texts = ["Does not meet the credit policy. Status: Charged Off", "Current", "Fully Paid", None, "Issued", "Default"]
    assert column(spark, texts, default_label, "string") == [1, None, 0, None, None, 1]
    assert column(spark, texts, status_group, "string") == [
        "other", "in_progress", "completed", "other", "other", "completed",
    ]
    assert column(spark, ["Dec-2015", "", None, "xx"], issue_year, "string") == ["2015", None, None, "xx"]
    assert column(spark, [" 60 months", " 36 months", None], long_term_flag, "string") == [1, 0, None]
    types = [None, "Individual", "joint", "Joint App"]
    assert column(spark, types, is_individual, "string") == [True, True, False, True]
    assert column(spark, types, lambda c: is_individual(c, True), "string") == [True, True, False, False]


def test_clamp_keeps_missing(spark):
    assert column(spark, [0.0, 1.0, 0.3, None], scalars.clamp_probability) == [1e-6, 1 - 1e-6, 0.3, None]


def test_threshold_sides(spark):
    assert column(spark, [0.5, None], scalars.classify) == [1, None]
    assert column(spark, [0.5], lambda c: scalars.classify(c, strict=True)) == [0]


def test_band_edges(spark):
    values = [599.9, 600.0, 640.0, 799.0, 800.0, 800.1, None]
    wanted = [None, "[600,640)", "[640,660)", "[760,800]", "[760,800]", None, None]
    assert column(spark, values, scalars.band) == wanted


def test_half_even_grid(spark):
    assert column(spark, [0.25, 0.35, 2.5], lambda c: scalars.round_to_grid(c, 0)) == [0.0, 0.0, 2.0]


def test_type7_quantile(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,), (float("nan"),)], "v double")
    assert [r["value"] for r in exact_quantiles(df, ["v"], [0.75]).collect()] == [3.25]


def test_lump_rare(spark):
    levels = ["a"] * 98 + ["b", "c", None]
    df = spark.createDataFrame([(v,) for v in levels], "purpose string")
    out = profile.lump_rare(df, "purpose").groupBy("purpose").count().collect()
    assert {r["purpose"]: r["count"] for r in out} == {"a": 98, "other": 2, None: 1}


def test_stratified_sizes(spark):
    rows = [(i, "x" if i < 10 else "y") for i in range(13)]
    df = spark.createDataFrame(rows, "id long, s string")
    taken = sampling.stratified_sample(df, ["s"], 0.5).groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in taken} == {"x": 5, "y": 1}


@pytest.mark.parametrize("n, sizes", [(11, [3, 2, 2, 2, 2]), (3, [1, 1, 1]), (5, [1] * 5), (1, [1])])
def test_fold_sizes(spark, n, sizes):
    df = spark.range(n).select(F.col("id"))
    found = sampling.with_folds(df, 5).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in found] == sizes


def test_auc_with_ties(spark):
    row = scores.score_metrics(score_rows(spark, [0, 1, 0, 1], [0.2, 0.2, 0.1, 0.9])).head()
    assert row["auc"] == 0.875
    assert (row["tp"], row["fp"], row["tn"], row["fn"]) == (1, 0, 2, 1)


def test_auc_one_class_is_missing(spark):
    assert scores.score_metrics(score_rows(spark, [0, 0], [0.1, 0.2])).head()["auc"] is None


def test_auc_direction(spark):
    df = score_rows(spark, [1, 1, 0, 0], [0.1, 0.2, 0.8, 0.9])
    assert scores.score_metrics(df).head()["auc"] == 0.0
    assert scores.score_metrics(df, auto_direction=True).head()["auc"] == 1.0


def test_audit_lag(spark):
    steps = spark.createDataFrame(
        [(1, "a", 10, 5, ""), (2, "b", 8, 7, ""), (3, "c", 8, 4, "")],
        "step int, action string, n_rows long, n_cols long, notes string",
    )
    out = describe.audit_trail(steps).orderBy("step").collect()
    assert [r["rows_removed"] for r in out] == [None, 2, 0]
    assert [r["cols_dropped"] for r in out] == [None, 0, 3]
    assert [r["cols_added"] for r in out] == [None, 2, 0]


def test_exact_line(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0), (2.0, 5.0)], "td double, ty double")
    row = effects.simple_regression(df).head()
    assert (row["theta"], row["intercept"], row["se"], row["dof"]) == (2.0, 1.0, 0.0, 1)


def test_student_values(spark):
    known = {1: 12.706204736, 2: 4.302652730, 10: 2.228138852, 30: 2.042272456, 200: 1.971896224, 5000: 1.960439}
    for df, q in known.items():
        found = column(spark, [df], scalars.student_975, "long")[0]
        assert found == pytest.approx(q, abs=2e-6)
    assert scalars.student_p_value(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert scalars.student_p_value(1.9623390808, 1000) == pytest.approx(0.05, abs=1e-4)
    assert scalars.student_p_value(0.0, 500) == pytest.approx(1.0)


def test_unseen_level(spark):
    train = spark.createDataFrame([("a",), ("b",), (None,)], "g string")
    levels = prep.Imputer.fit(train, [], ["g"]).levels["g"]
    assert levels == ["a", "b", "Unknown"]
    assert column(spark, ["a", "z", None], lambda c: prep.align_level(c, levels), "string") == ["a", "Unknown", "Unknown"]


def test_imputed_median_may_be_a_half(spark):
    train = spark.createDataFrame([(0,), (1,), (None,)], "k int")
    out = prep.Imputer.fit(train, ["k"], []).transform(train).collect()
    assert sorted(r["k"] for r in out) == [0.0, 0.5, 1.0]


def test_error_path_forward_fills(spark):
    votes = spark.createDataFrame(
        [(1, 1, [0.9, None, 0.0]), (2, 0, [None, 0.5, None]), (3, 0, [None, None, None])],
        "id long, y int, oob array<double>",
    )
    path = {r["tree"]: (r["oob_error"], r["n_rows"]) for r in oob.oob_error_path(votes).collect()}
    # Row 1 falls to 0.45 at tree 3, row 2 stays at exactly one half, which is class 0.
    assert path == {1: (0.0, 1), 2: (0.0, 2), 3: (0.5, 2)}
    summary = oob.oob_summary(oob.oob_error_path(votes)).head()
    assert (summary["n_trees_final"], summary["oob_error_final"], summary["n_trees_at_min"]) == (3, 0.5, 1)


def test_quality_checks(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (0, float("nan"))], "default int, x double")
    found = {r["check_name"]: r["violations"] for r in prep.quality_checks(df, ["x"]).collect()}
    assert found == {"default not in 0,1": 1, "x missing": 2}
    with pytest.raises(ValueError):
        prep.require_clean(df, ["x"])


def test_screen_hits_leaks_and_spares_shortlist():
    leaked = [
        "total_pymnt", "total_pymnt_inv", "total_rec_prncp", "recoveries", "collection_recovery_fee", "last_pymnt_d",
        "next_pymnt_d", "last_credit_pull_d", "settlement_status", "hardship_flag", "debt_settlement_flag",
    ]
    assert all(names.is_leakage(n) for n in leaked)
    shortlist = names.NUMERIC_SHORTLIST + names.CATEGORICAL_SHORTLIST
    assert not [n for n in shortlist if names.is_leakage(n) or names.is_identifier(n)]
    assert names.columns_to_drop(["id", "loan_amnt", "url", "recoveries", "out_prncp", "loan_status"], keep=()) == [
        "id", "url", "recoveries", "out_prncp", "loan_status",
    ]


def test_midpoint_replaces_bounds():
    present = ["fico_range_low", "fico_range_high", "loan_amnt"]
    assert names.numeric_candidates(present) == ["loan_amnt", "fico_range_low", "fico_range_high"]
    assert names.numeric_candidates([*present, "fico_avg"]) == ["loan_amnt", "fico_avg"]


def test_density_integrates_to_one(spark):
    df = score_rows(spark, [0, 0, 0, 1, 1, 1], [0.2, 0.25, 0.3, 0.6, 0.7, 0.65])
    found = scores.score_density(df, points=2048).toPandas()
    width = (0.7 - 0.2) / 2047
    for y, centre in ((0, 0.25), (1, 0.65)):
        part = found[found.y == y]
        assert part.loc[part.density.idxmax(), "x"] == pytest.approx(centre, abs=0.01)
        assert 0.4 < part.density.sum() * width <= 1.01


def test_density_cells_agree_with_exact(spark):
    rows = [(i, i % 2, "m", 0.1 + 0.8 * ((i * 37) % 101) / 101) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, y int, model string, p_hat double")
    found = scores.score_density(df, points=64).toPandas()
    for y in (0, 1):
        p = sorted(r[3] for r in rows if r[1] == y)
        n, mean = len(p), sum(p) / len(p)
        at = lambda q: p[int(q)] + (p[min(int(q) + 1, n - 1)] - p[int(q)]) * (q - int(q))  # noqa: E731, B023
        sd = math.sqrt(sum((v - mean) ** 2 for v in p) / (n - 1))
        h = 0.9 * 1.1 * min(sd, (at(0.75 * (n - 1)) - at(0.25 * (n - 1))) / 1.34) * n**-0.2
        part = found[found.y == y]
        exact = [sum(math.exp(-(((x - v) / h) ** 2) / 2) for v in p) / (n * h * math.sqrt(2 * math.pi)) for x in part.x]
        assert max(abs(a - b) for a, b in zip(exact, part.density)) < 1e-4 * max(exact)


def test_student_p_values_at_any_size():
    assert scalars.student_p_value(4.0, 101) == pytest.approx(1.20813e-4, rel=1e-4)
    for df in (1, 2, 7, 100):
        for t in (0.0, 0.3, 2.0, 6.0):
            assert scalars.student_p_value(t, df) == pytest.approx(1 - scalars.student_cdf_two_sided(t, df), abs=1e-12)
    assert scalars.student_p_value(1.959963984540054, 10**9) == pytest.approx(0.05, rel=1e-6)


def test_bootstrap_counts_have_no_low_cap(spark):
    from loanvane.functions.keys import MOST_DRAWS, RandomKey, poisson_weight

    class Last(RandomKey):
        def column(self, id_column):
            return (F.lit(self.space) - 2048.0).cast("long")

    assert spark.range(1).select(poisson_weight(F.col("id"), 1, 1, key=Last(1)).alias("w")).head()["w"] > 15 and MOST_DRAWS == 21


def test_ranks_are_the_same_however_narrow_the_slots(spark):
    from loanvane.functions.keys import RandomKey
    from loanvane.operators.order_stats import rank_cuts

    df = spark.range(3000).withColumn("g", F.col("id") % 3)
    cuts = lambda **kw: sorted(map(tuple, rank_cuts(df, ["g"], lambda n: F.array(F.lit(1), F.floor(n / 3), n), RandomKey(5), **kw).collect()))
    assert cuts() == cuts(slots=2, order_above=4) == cuts(slots=7, order_above=1)


def test_quantiles_with_infinite_values(spark):
    rows = [(float("inf"),), (float("-inf"),), (1.0,), (2.0,), (3.0,)]
    df = spark.createDataFrame(rows, "v double")
    found = {r["prob"]: r["value"] for r in exact_quantiles(df, ["v"], [0.0, 0.5, 1.0], narrow_above=0, cells=4).collect()}
    assert found == {0.0: float("-inf"), 0.5: 2.0, 1.0: float("inf")}


def test_levels_listed_or_joined(spark, monkeypatch):
    train = spark.createDataFrame([(i, f"v{i % 40}", "a" if i % 2 else None) for i in range(200)], "id long, c string, d string")
    test = spark.createDataFrame([(1, "v3", "a"), (2, "new", "b"), (3, None, None), (4, "Unknown", "a")], "id long, c string, d string")
    aligned = lambda: sorted(map(tuple, prep.Imputer.fit(train, [], ["c", "d"]).transform(test).collect()))
    listed = aligned()
    monkeypatch.setattr(prep, "LISTED_LEVELS", 5)
    assert aligned() == listed == [(1, "v3", "a"), (2, "Unknown", "Unknown"), (3, "Unknown", "Unknown"), (4, "Unknown", "a")]
    with pytest.raises(ValueError):
        prep.Design.fit(prep.Imputer.fit(train, [], ["c"]), [], ["c"])
    many = spark.range(12_000).select(F.col("id").cast("string").alias("c"))
    assert prep.fit_levels(many, ["c"]).count() == 12_001


def test_joins_of_the_loan_view_run_once_below_many_passes(spark):
    """Cuts and quantiles read a table several times: what they read is cached."""
    from loanvane.checks import queries

    for stage in (queries.split_of, queries.scores_of, queries.effect_rows_of):
        plan = stage(spark, "/root/testdata/sf0.001")._jdf.queryExecution().withCachedData().toString()
        assert "InMemoryRelation" in plan and "lineitem" not in plan.split("InMemoryRelation")[0]
    spark.catalog.clearCache()
