"""Distributed ranks, quantiles and running totals against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanvane.functions.keys import RandomKey, poisson_weight
from loanvane.operators import order_stats, sampling, scores
from loanvane.operators.order_stats import exact_quantiles, running_totals


def tied_scores(spark, n=600, seed=5):
    """Two models: distinct scores, and five scores of which one holds most rows."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        p = rnd.random()
        rows.append((i, int(rnd.random() < p), "smooth", p))
        rows.append((i, int(rnd.random() < p), "steps", 0.3 if rnd.random() < 0.7 else round(p, 1) / 2))
    df = spark.createDataFrame(rows, "id long, y int, model string, p_hat double")
    return rows, df.repartition(7)


def brute_gains(rows, key):
    out = {}
    for model in ("smooth", "steps"):
        part = [r for r in rows if r[2] == model]
        part.sort(key=lambda r: (-r[3], key(r[0]), r[0]))
        total, caught = sum(r[1] for r in part), 0
        for place, r in enumerate(part, 1):
            caught += r[1]
            out[(model, r[0])] = (place / len(part), caught / total)
    return out


def lehmer(salt):
    return lambda i: ((i + salt) % 2147483647) * 48271 % 2147483647 * 16807 % 2147483647


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 40])
@pytest.mark.parametrize("shuffles", [1, 4, 13])
def test_gains_with_heavy_ties(spark, partitions, rows_per_bucket, shuffles):
    partitions(shuffles)
    rows, df = tied_scores(spark)
    found = scores.cumulative_gains(df, RandomKey(3, portable=True), rows_per_bucket).collect()
    wanted = brute_gains(rows, lehmer(3))
    assert len(found) == len(wanted)
    for r in found:
        assert (r["frac_population"], r["frac_defaults_captured"]) == pytest.approx(wanted[(r["model"], r["id"])])


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 40])
def test_budget_matches_gains(spark, rows_per_bucket):
    rows, df = tied_scores(spark)
    wanted = brute_gains(rows, lehmer(3))
    by_place = {(m, round(v[0] * 600)): v[1] for (m, _), v in wanted.items()}
    found = scores.screening_budget(df, (0.01, 0.1, 0.5, 1.0), RandomKey(3, portable=True), rows_per_bucket).collect()
    assert len(found) == 8
    for r in found:
        assert r["frac_defaults_captured"] == pytest.approx(by_place[(r["model"], r["reviewed"])])
        assert r["lift"] == pytest.approx(r["frac_defaults_captured"] / (r["reviewed"] / 600))


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 25])
def test_auc_and_curves_do_not_depend_on_buckets(spark, rows_per_bucket):
    rows, df = tied_scores(spark)
    found = {r["model"]: r["auc"] for r in scores.score_metrics(df, rows_per_bucket=rows_per_bucket).collect()}
    for model in ("smooth", "steps"):
        pos = [r[3] for r in rows if r[2] == model and r[1] == 1]
        neg = [r[3] for r in rows if r[2] == model and r[1] == 0]
        wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
        assert found[model] == pytest.approx(wins / len(pos) / len(neg))
    curve = scores.score_curve(df, rows_per_bucket)
    for r in scores.precision_recall(curve, 50).collect():
        part = [x for x in rows if x[2] == r["model"]]
        called = [x for x in part if x[3] >= r["threshold"]]
        assert r["precision"] == pytest.approx(sum(x[1] for x in called) / len(called))
        assert r["recall"] == pytest.approx(sum(x[1] for x in called) / sum(x[1] for x in part))
    thresholds = {r["threshold"] for r in scores.precision_recall(curve, 50).filter("model = 'smooth'").collect()}
    smooth = [x[3] for x in rows if x[2] == "smooth"]
    wanted = set(np.quantile(smooth, [i / 49 for i in range(50)]))
    assert len(thresholds) == len(wanted)
    assert sorted(thresholds) == pytest.approx(sorted(wanted))


def test_roc_ends(spark):
    _, df = tied_scores(spark)
    points = scores.roc_points(scores.score_curve(df, 30)).filter("model = 'steps'").collect()
    ends = {(r["fpr"], r["tpr"]) for r in points}
    assert (0.0, 0.0) in ends and (1.0, 1.0) in ends


@pytest.mark.parametrize("narrow_above", [1_000_000, 40, 0])
def test_quantiles_narrowed_or_not(spark, narrow_above):
    rnd = random.Random(11)
    values = [(i % 3, rnd.gauss(0, 1), float(rnd.randint(0, 4))) for i in range(3000)]
    df = spark.createDataFrame(values, "g int, a double, b double").repartition(5)
    probs = [0.0, 0.1, 0.5, 0.75, 1.0]
    found = exact_quantiles(df, ["a", "b"], probs, by=["g"], narrow_above=narrow_above, cells=7).collect()
    assert len(found) == 3 * 2 * 5
    for r in found:
        held = [v[1 if r["variable"] == "a" else 2] for v in values if v[0] == r["g"]]
        assert r["value"] == pytest.approx(np.quantile(held, r["prob"]), abs=1e-12)


def test_quantiles_of_a_heavy_tail(spark):
    """Nine in ten rows share one value and the rest spread over twelve orders of magnitude."""
    rnd = random.Random(12)
    values = [0.5] * 2700 + [10 ** rnd.uniform(-4, 8) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    probs = [0.03, 0.5, 0.93, 0.95, 0.999]
    found = {r["prob"]: r["value"] for r in exact_quantiles(df, ["v"], probs, narrow_above=20, cells=16).collect()}
    assert found == pytest.approx({p: np.quantile(values, p) for p in probs}, rel=1e-12)


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("rows_per_bucket", [10_000, 17])
def test_running_totals(spark, descending, rows_per_bucket):
    rnd = random.Random(2)
    rows = [(i % 2, rnd.random(), rnd.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, v double, m long").repartition(6)
    out = running_totals(df, ["g"], "v", ["m"], descending=descending, rows_per_bucket=rows_per_bucket).collect()
    assert len(out) == 500
    for r in out:
        held = [x for x in rows if x[0] == r["g"]]
        before = [x[2] for x in held if (x[1] >= r["v"] if descending else x[1] <= r["v"])]
        assert (r["upto_m"], r["all_m"]) == (sum(before), sum(x[2] for x in held))


@pytest.mark.parametrize("key", [RandomKey(7), RandomKey(7, portable=True)])
@pytest.mark.parametrize("shuffles", [1, 4, 13])
def test_sample_is_exact_and_stable(spark, partitions, key, shuffles):
    partitions(shuffles)
    df = spark.range(5000).select("id", (F.col("id") % 10 == 0).cast("int").alias("default"))
    split = sampling.train_test_flag(df.repartition(shuffles), key=key)
    rows = split.collect()
    sizes = {d: sum(r["is_train"] for r in rows if r["default"] == d) for d in (0, 1)}
    assert len(rows) == 5000 and sizes == {0: 3150, 1: 350}
    again = {r["id"] for r in sampling.train_test_flag(df, key=key).filter("is_train").collect()}
    assert again == {r["id"] for r in rows if r["is_train"]}


def test_missing_stratum_is_a_stratum(spark):
    rows = [(i, None if i < 40 else "a") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, s string")
    taken = sampling.stratified_sample(df, ["s"], 0.25).groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in taken} == {None: 10, "a": 15}


def test_sample_order_matches_ranks(spark):
    df = spark.range(997).select("id", F.lit(1).alias("default"))
    key = RandomKey(5, portable=True)
    taken = {r["id"] for r in sampling.train_test_flag(df, fraction=0.3, key=key).filter("is_train").collect()}
    order = sorted(range(997), key=lambda i: (lehmer(5)(i), i))
    assert taken == set(order[: int(997 * 0.3)])


def test_near_balanced_folds(spark):
    sizes = sampling.with_near_balanced_folds(spark.range(5000)).groupBy("fold").count().collect()
    assert sorted(r["fold"] for r in sizes) == [1, 2, 3, 4, 5]
    assert all(abs(r["count"] - 1000) < 150 for r in sizes)


def test_bootstrap_weights_are_poisson(spark):
    df = spark.range(20000).select(poisson_weight(F.col("id"), 1363, 2).alias("w"))
    row = df.agg(F.avg("w").alias("m"), F.var_samp("w").alias("v"), F.avg((F.col("w") == 0).cast("int")).alias("z")).head()
    assert row["m"] == pytest.approx(1, abs=0.03)
    assert row["v"] == pytest.approx(1, abs=0.06)
    assert row["z"] == pytest.approx(0.3679, abs=0.015)


@pytest.mark.parametrize("large_state", [False, True])
def test_rounds_of_a_quantile_look_up_each_value_once(spark, monkeypatch, large_state):
    """Two ranks in one interval share its counts, and values outside all intervals are left out before the join."""
    looked_up, join = [], order_stats.null_safe_join

    def recorded(left, right, keys, how="inner"):
        if left.columns == ["variable", "value"]:
            looked_up.append((left.count(), right.count()))
        return join(left, right, keys, how)

    monkeypatch.setattr(order_stats, "null_safe_join", recorded)
    if large_state:
        monkeypatch.setattr(order_stats, "small_table", lambda df: df.persist())
    nan, inf = float("nan"), float("inf")
    odd = [(None, nan), (nan, None), (inf, -inf), (-inf, inf), (-0.0, 0.0), (0.0, -0.0)]
    pairs = [(float(i), float(i % 7 - 3)) for i in range(-4_000, 4_000)] + odd
    df = spark.createDataFrame([(i, i % 3 or None, a, b) for i, (a, b) in enumerate(pairs)], "id long, g int, a double, b double")
    for by in ([], ["g"]):
        found = order_stats.exact_quantiles(df, ["a", "b"], [0.0, 0.5, 0.9, 1.0], by, narrow_above=50, cells=16).collect()
        for g in {r["g"] if by else None for r in found}:
            for v, k in (("a", 2), ("b", 3)):
                rows = sorted(r[k] for r in df.collect() if (not by or r["g"] == g) and r[k] is not None and not math.isnan(r[k]))
                got = {r["prob"]: r["value"] for r in found if r["variable"] == v and (not by or r["g"] == g)}
                assert got[0.0] == rows[0] and got[1.0] == rows[-1] and (by or rows[-1] == -rows[0] == inf)
                for p in (0.5, 0.9):
                    spot = p * (len(rows) - 1)
                    low = math.floor(spot)
                    assert got[p] == pytest.approx(rows[low] + (spot - low) * (rows[math.ceil(spot)] - rows[low]), abs=1e-9)
    looked_up.clear()
    medians = order_stats.exact_quantiles(df.filter("abs(a) < 1e9").select("a"), ["a"], [0.5], narrow_above=50, cells=16).collect()
    assert [r["value"] for r in medians] == [0.0]
    assert all(spans <= 2 for _, spans in looked_up) and looked_up[0][1] == 1 and looked_up[0][0] > 8_000 > 1_100 > looked_up[1][0] > looked_up[-1][0]
