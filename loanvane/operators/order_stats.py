"""Exact order statistics and running totals that never sort a whole group in one task.

Three building blocks:

* ``rank_cuts``: the row at given ranks of a random order, by counting slots first.
* ``exact_quantiles``: type-7 quantiles, by narrowing intervals and counting inside.
* ``running_totals``: prefix sums over an ordered group, by buckets with offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanvane.functions.keys import RandomKey
from loanvane.functions.scalars import interpolate
from loanvane.runtime import bounded_rows, small_table

HISTOGRAM_SLOTS = 8192
ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 4096
NARROW_ABOVE = 1_000_000
NARROWING_CELLS = 4096
LARGEST = 1.7976931348623157e308


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL meets NULL; right-side keys are dropped."""
    renamed = right
    condition = F.lit(True)
    for i, k in enumerate(keys):
        renamed = renamed.withColumnRenamed(k, f"__right_{i}")
        condition = condition & left[k].eqNullSafe(F.col(f"__right_{i}"))
    return left.join(renamed, condition, how).drop(*[f"__right_{i}" for i in range(len(keys))])


def rank_cuts(
    df: DataFrame,
    strata: Sequence[str],
    targets: Callable[[Column], Column],
    key: RandomKey,
    id_column: str = "id",
    slots: int = HISTOGRAM_SLOTS,
    order_above: int = NARROW_ABOVE,
) -> DataFrame:
    """The (key, id) found at given ranks of the random order within each stratum.

    ``targets`` maps the stratum size to an array of 1-based ranks; ranks outside
    1..size give no row. Emits ``strata, stratum_rows, target, cut_key, cut_id``.
    A row is among the first ``target`` rows exactly when its (key, id) is not above the cut,
    so the wide table is never shuffled: it is only compared with a handful of cuts.

    One aggregate counts rows per slot of the key space. A slot that holds a target rank is counted again
    in ``slots`` parts as long as it has more than ``order_above`` rows, and only then ordered.
    Copies of one id are counted together and fall on the same side of a cut.
    """
    strata = list(strata)
    rows = df.select(*strata, F.col(id_column).alias("cut_id"), key.column(F.col(id_column)).alias("cut_key"))
    per_stratum = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
    first = key.slot(F.col("cut_key"), slots)
    sizes = (
        rows.groupBy(*strata, first.alias("slot"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("cut_key").alias("low"), F.max("cut_key").alias("high"))
        .withColumn("upto", F.sum("n").over(per_stratum.orderBy("slot")))
        .withColumn("stratum_rows", F.sum("n").over(per_stratum))
    )
    hit = (F.col("target") > F.col("upto") - F.col("n")) & (F.col("target") <= F.col("upto"))
    hits = small_table(
        sizes.withColumn("target", F.explode(targets(F.col("stratum_rows"))))
        .filter(hit)
        .select(*strata, "stratum_rows", "target", (F.col("target") - F.col("upto") + F.col("n")).alias("place"), "n", "low", "high")
    )
    while not hits.filter((F.col("n") > order_above) & (F.col("low") < F.col("high"))).isEmpty():
        hits = small_table(_narrowed_keys(rows, hits, strata, slots))
    goal = [*strata, "target"]
    found = null_safe_join(rows, hits, strata).filter(F.col("cut_key").between(F.col("low"), F.col("high")))
    copies = found.groupBy(*goal, "stratum_rows", "place", "cut_key", "cut_id").agg(F.count(F.lit(1)).alias("n"))
    placed = copies.withColumn("upto", F.sum("n").over(Window.partitionBy(*goal).orderBy("cut_key", "cut_id")))
    return placed.filter((F.col("place") > F.col("upto") - F.col("n")) & (F.col("place") <= F.col("upto"))).select(
        *strata, "stratum_rows", "target", "cut_key", "cut_id"
    )


def _narrowed_keys(rows: DataFrame, hits: DataFrame, strata: Sequence[str], parts: int) -> DataFrame:
    """Each key interval shrunk to the one of its equal parts that holds the wanted place."""
    goal = [*strata, "stratum_rows", "target", "place"]
    # halves keep differences of 63-bit keys within a long
    width = (F.col("high") / 2 - F.col("low") / 2) / F.lit(parts)
    part = F.least(F.floor((F.col("cut_key") - F.col("low")) / 2 / F.greatest(width, F.lit(0.5))), F.lit(parts - 1))
    counted = (
        null_safe_join(rows, hits, strata)
        .filter(F.col("cut_key").between(F.col("low"), F.col("high")))
        .groupBy(*goal, part.alias("part"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("cut_key").alias("low"), F.max("cut_key").alias("high"))
        .withColumn("upto", F.sum("n").over(Window.partitionBy(*strata, "target").orderBy("part")))
    )
    held = counted.filter((F.col("place") > F.col("upto") - F.col("n")) & (F.col("place") <= F.col("upto")))
    return held.select(
        *strata, "stratum_rows", "target", (F.col("place") - F.col("upto") + F.col("n")).alias("place"), "n", "low", "high"
    )


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    narrow_above: int = NARROW_ABOVE,
    cells: int = NARROWING_CELLS,
) -> DataFrame:
    """Exact type-7 quantiles as ``by..., variable, prob, value``; NULL and NaN are skipped.

    A quantile lies between two ranks, each looked for by itself. While the interval known to hold a rank has
    more than ``narrow_above`` rows, one aggregate counts its rows in ``cells`` equal parts and
    the part with the rank, drawn in to its smallest and largest value, becomes the interval; then
    its values are counted one by one. Counts combine before the shuffle, so a round moves at most ``cells``
    rows per interval and task, whatever the distribution. Ranks in one interval share its counts, and without ``by``
    values outside all intervals of their column are left out before anything is looked up for them.
    """
    group = [*by, "variable"]
    long = _long_values(df, columns, by)
    sizes = long.groupBy(*group).agg(
        F.count(F.lit(1)).alias("inside"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    place = lambda p: F.lit(float(p)) * (F.col("inside") - 1)
    ends = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(p)), F.ceil(place(p))) for p in probs])))
    whole = sizes.select(*group, F.col("inside").alias("n"), "inside", "low", "high", F.explode(ends).alias("rank"))
    state = small_table(whole.withColumn("below", F.lit(0).cast("long")))
    while not state.filter((F.col("inside") > narrow_above) & (F.col("low") < F.col("high"))).isEmpty():
        state = small_table(_narrowed(long, state, group, cells))
        if not by:
            long = _long_values(df, columns, by, _spans(state))
    values = _in_intervals(long, state, group).groupBy(*group, "low", "high", "value").agg(F.count(F.lit(1)).alias("k"))
    counts = null_safe_join(values, state, [*group, "low", "high"]).withColumn(
        "upto", F.col("below") + F.sum("k").over(Window.partitionBy(*group, "rank").orderBy("value"))
    )
    at = F.min(F.when(F.col("upto") > F.col("rank"), F.col("value"))).alias("at")
    found = counts.groupBy(*group, "n", "rank").agg(at).groupBy(*group, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "at"))).alias("at"))
    probs_ = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    spot = F.col("prob") * (F.col("n") - 1)
    value = interpolate(F.col("at")[F.floor(spot)], F.col("at")[F.ceil(spot)], spot - F.floor(spot))
    endless = F.when(value >= LARGEST, float("inf")).when(value <= -LARGEST, float("-inf")).otherwise(value)
    return found.select(*group, "n", "at", probs_).select(*group, "prob", endless.alias("value"))


def _long_values(df: DataFrame, columns: Sequence[str], by: Sequence[str], spans: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """``by..., variable, value`` without NULL and NaN, infinite values at the ends; with ``spans`` those within their column's."""

    def value(c: str) -> Column:
        v = F.col(c).cast("double")
        held = F.when(v.isNotNull() & ~F.isnan(v), F.greatest(F.least(v, F.lit(LARGEST)), F.lit(-LARGEST)))
        return held if spans is None else F.when(held.between(*spans[c]), held) if c in spans else F.lit(None).cast("double")

    wide = df.select(*by, *[value(c).alias(c) for c in columns])
    return wide.unpivot(list(by), list(columns), "variable", "value").filter(F.col("value").isNotNull())


def _spans(state: DataFrame) -> dict[str, tuple[float, float]]:
    """Each column's smallest and largest value that an interval still holds."""
    ends = state.groupBy("variable").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return {r["variable"]: (r["low"], r["high"]) for r in ends.collect()}


def _in_intervals(long: DataFrame, state: DataFrame, group: Sequence[str]) -> DataFrame:
    """Values with the interval they lie in, once however many ranks it holds."""
    intervals = state.select(*group, "low", "high").distinct()
    return null_safe_join(long, intervals, group).filter(F.col("value").between(F.col("low"), F.col("high")))


def _narrowed(long: DataFrame, state: DataFrame, group: Sequence[str], cells: int) -> DataFrame:
    """Each interval shrunk to the cell that holds its rank."""
    # halves keep the difference of the largest doubles finite
    share = (F.col("value") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
    cell = F.when(F.col("low") < F.col("high"), F.least(F.floor(share * F.lit(cells)), F.lit(cells - 1))).otherwise(0)
    counted = (
        _in_intervals(long, state, group)
        .groupBy(*group, "low", "high", cell.alias("cell"))
        .agg(F.count(F.lit(1)).alias("k"), F.min("value").alias("least"), F.max("value").alias("most"))
    )
    ranked = null_safe_join(counted, state.drop("inside"), [*group, "low", "high"]).withColumn(
        "upto", F.col("below") + F.sum("k").over(Window.partitionBy(*group, "rank").orderBy("cell"))
    )
    before = F.col("upto") - F.col("k")
    held = ranked.filter((F.col("rank") >= before) & (F.col("rank") < F.col("upto")))
    return held.select(*group, "n", F.col("k").alias("inside"), F.col("least").alias("low"), F.col("most").alias("high"), "rank", before.alias("below"))


def scalar_quantile(df: DataFrame, column: str, prob: float) -> float:
    """One exact quantile as a driver number."""
    rows = bounded_rows(exact_quantiles(df, [column], [prob]).select("value"), 1)
    return rows[0]["value"] if rows else None


def value_buckets(
    df: DataFrame, column: str, rows_per_bucket: int = ROWS_PER_BUCKET, name: str = "bucket"
) -> tuple[DataFrame, int]:
    """Add an order-preserving bucket number so that buckets hold about ``rows_per_bucket`` rows.

    Cut points come from a quantile sketch of all rows, so one very frequent value fills a
    bucket of its own; group by value first where that matters. Beyond ``MAX_BUCKETS`` buckets
    grow instead of becoming more, which bounds the sketch and the table of bucket sums.
    """
    n = df.count()
    wanted = min(MAX_BUCKETS, -(-n // rows_per_bucket))
    if wanted <= 1:
        return df.withColumn(name, F.lit(0)), 1
    probs = [i / wanted for i in range(1, wanted)]
    cuts = df.agg(F.percentile_approx(column, probs, max(10_000, 4 * wanted)).alias("c")).head()["c"]
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    cut = Bucketizer(splits=splits, inputCol=column, outputCol=name).transform(df)
    return cut.withColumn(name, F.col(name).cast("int")), len(splits) - 1


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    measures: Sequence[str],
    then: Sequence[str] = (),
    descending: bool = True,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add ``upto_<m>`` (inclusive running sum) and ``all_<m>`` (group total) per measure.

    Rows are ordered within ``by`` by ``order`` and the ``then`` columns, which together
    must be unique. Windows run inside (group, value bucket); the bucket sums form a small
    table whose own running sums are the offsets. Bucket sums are joined on the
    window's keys, so the rows are shuffled once.
    """
    by, then = list(by), list(then)
    bucketed, n_buckets = value_buckets(df, order, rows_per_bucket)
    first = F.col(order).desc() if descending else F.col(order).asc()
    inner = Window.partitionBy(*by, "bucket").orderBy(first, *then).rowsBetween(Window.unboundedPreceding, 0)
    if n_buckets == 1:
        whole = Window.partitionBy(*by)
        for m in measures:
            bucketed = bucketed.withColumn(f"upto_{m}", F.sum(m).over(inner)).withColumn(
                f"all_{m}", F.sum(m).over(whole)
            )
        return bucketed.drop("bucket")
    group = Window.partitionBy(*by)
    steps = group.orderBy(F.col("bucket").desc() if descending else F.col("bucket").asc())
    before = steps.rowsBetween(Window.unboundedPreceding, -1)
    sums = bucketed.groupBy(*by, "bucket").agg(*[F.sum(m).alias(f"sum_{m}") for m in measures])
    offsets = sums.select(
        *by,
        "bucket",
        *[F.coalesce(F.sum(f"sum_{m}").over(before), F.lit(0)).alias(f"before_{m}") for m in measures],
        *[F.sum(f"sum_{m}").over(group).alias(f"all_{m}") for m in measures],
    )
    for m in measures:
        bucketed = bucketed.withColumn(f"upto_{m}", F.sum(m).over(inner))
    joined = null_safe_join(bucketed, small_table(offsets), [*by, "bucket"])
    for m in measures:
        joined = joined.withColumn(f"upto_{m}", F.col(f"upto_{m}") + F.col(f"before_{m}"))
    return joined.drop("bucket", *[f"before_{m}" for m in measures])
