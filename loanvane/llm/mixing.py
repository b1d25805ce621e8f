"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Among all document rates between 0 and 2 whose words meet each source's target, the one closest to rate 1 in relative
entropy is ``min(2, exp(multiplier of the source * words))``. The multipliers solve a convex dual; each Newton step is
one aggregate over the documents (counted by source and size first) and all sources move in the same step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanvane.llm.shared import WORD, key_hash, size_checked, stage

SOURCE_WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MAX_REPEATS = 2
TOLERANCE = 1e-9
MAX_STEPS = 60
FRACTION = 1 << 20
SUB_CELL_ROWS = 20_000
BROADCAST_ROWS = 2_000_000


def source_targets(sized: DataFrame, weights=SOURCE_WEIGHTS, share=TOTAL_SHARE, cap=MAX_REPEATS) -> DataFrame:
    """Rows ``(source, source_size, target)`` of rows ``(source, size)``.

    Weights repeat over the sources by code point, null last. Targets share ``share`` of all words by weight; what
    goes beyond ``cap`` times a source's size is shared again among the others. The fixed point fills sources in
    the order of cap per weight, so one running sum over the sources finds it.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    rows = sources.select("source", "source_size", weight.alias("w"), (cap * F.col("source_size")).cast("double").alias("most"))
    every = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    filled = rows.select(
        "source", "source_size", "w", "most",
        (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))).alias("left"),
        F.sum("w").over(every.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("w_left"),
    )
    # the first source whose cap is above the common level sets that level
    level = F.min(F.when(F.col("left") / F.col("w_left") <= F.col("most") / F.col("w"), F.struct(F.col("most") / F.col("w"), F.col("left") / F.col("w_left"))))
    levels = filled.withColumn("level", level.over(whole).getField("col2"))
    target = F.least(F.col("most"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("w"))
    return levels.select("source", "source_size", F.greatest(F.lit(0.0), F.round(target, 6)).alias("target"))


def balance_multipliers(cells: DataFrame, targets: DataFrame, cap: int = MAX_REPEATS) -> DataFrame:
    """Rows ``(source, scale, lam, full)``: the dual's solution for cells ``(source, size, n)``.

    Safeguarded Newton: a step that leaves the bracket of multipliers known to be too low and too high halves the bracket.
    ``full`` marks sources whose target is all they can give, where the multiplier is infinite.
    """
    stats = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.max("size").cast("double").alias("scale"))
    state = stats.join(targets, stats["source"].eqNullSafe(targets["source"]), "inner").select(
        stats["source"], F.greatest(F.col("scale"), F.lit(1.0)).alias("scale"), "target",
        (F.col("target") >= cap * F.col("words") * (1 - 1e-12)).alias("full"),
        F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
        F.lit(False).alias("met"),
    )
    state = stage(state, "mix-state")
    for _ in range(MAX_STEPS):
        joined = cells.join(state, cells["source"].eqNullSafe(state["source"]), "inner").select(
            state["source"], "scale", "target", "full", "lam", "low", "high", "n", "size"
        )
        x = F.col("size") / F.col("scale")
        rate = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        words = F.col("n") * F.col("size")
        sums = joined.groupBy("source", "scale", "target", "full", "lam", "low", "high").agg(
            F.sum(words * F.least(rate, F.lit(float(cap)))).alias("got"),
            F.sum(F.when(rate < cap, words * x * rate).otherwise(0.0)).alias("slope"),
        )
        gap = F.col("target") - F.col("got")
        low = F.when(gap > 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap < 0, F.col("lam")).otherwise(F.col("high"))
        moved = sums.select("source", "scale", "target", "full", "lam", low.alias("low"), high.alias("high"), gap.alias("gap"), "slope")
        step = F.col("lam") + F.col("gap") / F.col("slope")
        reach = F.lit(2.0) * F.greatest(F.abs(F.col("lam")), F.lit(1.0))
        middle = (
            F.when(F.col("low").isNull(), F.col("high") - reach)
            .when(F.col("high").isNull(), F.col("low") + reach)
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        inside = (F.col("slope") > 0) & (F.col("low").isNull() | (step > F.col("low"))) & (F.col("high").isNull() | (step < F.col("high")))
        near = inside & (F.abs(step - F.col("lam")) <= 4 * F.greatest(F.abs(F.col("lam")), F.lit(1.0)))
        met = F.col("full") | (F.abs(F.col("gap")) <= TOLERANCE * F.greatest(F.col("target"), F.lit(1.0)))
        state = stage(
            moved.select(
                "source", "scale", "target", "full",
                F.when(met, F.col("lam")).when(near, step).otherwise(middle).alias("lam"), "low", "high", met.alias("met"),
            ),
            "mix-state",
        )
        if state.filter(~F.col("met")).isEmpty():
            break
    return state.select("source", "scale", "lam", "full")


def round_to_copies(rated: DataFrame) -> DataFrame:
    """``rated`` rows ``(doc_id, row_no, source, size, rate)`` with ``copies``: whole part, and the rest by systematic sampling.

    Documents of a source stand in order of size, and each gets the extra copy where the running sum of fractions
    passes a whole number, so the words taken stray by about one document. The running sum is built from sums of
    (source, size band, slice of the key hash), whose rows are limited, and not over a source in one task.
    """
    part = F.round((F.col("rate") - F.floor("rate")) * FRACTION).cast("long")
    rows = rated.select("*", F.floor("rate").alias("whole"), part.alias("part"), F.floor(20 * F.log1p(F.col("size"))).cast("int").alias("band"), key_hash(F.col("doc_id")).alias("h"))
    cells = rows.groupBy("source", "band").agg(F.ceil(F.count("*") / SUB_CELL_ROWS).alias("slices"))
    in_cell = rows.join(
        cells.select(F.col("source").alias("s"), F.col("band").alias("b"), "slices"), F.col("source").eqNullSafe(F.col("s")) & (F.col("band") == F.col("b"))
    ).drop("s", "b")
    in_cell = in_cell.withColumn("slice", F.col("h") % F.col("slices"))
    slices = in_cell.groupBy("source", "band", "slice").agg(F.sum("part").alias("slice_part"))
    bands = slices.groupBy("source", "band").agg(F.sum("slice_part").alias("band_part"))
    rows_before = (Window.unboundedPreceding, -1)
    band_start = F.coalesce(F.sum("band_part").over(Window.partitionBy("source").orderBy("band").rowsBetween(*rows_before)), F.lit(0))
    slice_start = F.coalesce(F.sum("slice_part").over(Window.partitionBy("source", "band").orderBy("slice").rowsBetween(*rows_before)), F.lit(0))
    starts = slices.withColumn("slice_start", slice_start).select(F.col("source").alias("s"), F.col("band").alias("b"), F.col("slice").alias("k"), "slice_start")
    bands = bands.select(F.col("source").alias("s2"), F.col("band").alias("b2"), band_start.alias("band_start"))
    starts = starts.join(bands, F.col("s").eqNullSafe(F.col("s2")) & (F.col("b") == F.col("b2"))).select(
        "s", "b", "k", (F.col("slice_start") + F.col("band_start")).alias("start")
    )
    placed = in_cell.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("band") == F.col("b")) & (F.col("slice") == F.col("k")))
    within = Window.partitionBy("source", "band", "slice").orderBy("size", "h", "doc_id", "row_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.col("start") + F.sum("part").over(within) + FRACTION // 2
    extra = F.floor(after / FRACTION) - F.floor((after - F.col("part")) / FRACTION)
    return placed.select("doc_id", "row_no", "source", "size", "rate", (F.col("whole") + extra).alias("copies"))


def settle_rests(copies: DataFrame, targets: DataFrame, cap: int = MAX_REPEATS) -> DataFrame:
    """One document per source gets a copy more or less, the one whose size is nearest to what the source's words miss."""
    rest = copies.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("got"))
    rest = rest.join(targets, rest["source"].eqNullSafe(targets["source"])).select(rest["source"].alias("s"), (F.col("target") - F.col("got")).alias("rest"))
    near = copies.join(rest, F.col("source").eqNullSafe(F.col("s")))
    free = F.when(F.col("rest") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
    off = F.abs(F.col("size") - F.abs("rest"))
    pick = F.min(F.struct(off.alias("off"), "doc_id", "size", "row_no", F.signum("rest").cast("int").alias("sign")))
    picks = near.filter(free & (off < F.abs("rest"))).groupBy("source").agg(pick.alias("p"))
    picks = picks.select(F.col("source").alias("s"), "p.*").select("s", "sign", F.col("doc_id").alias("d"), F.col("size").alias("z"), F.col("row_no").alias("k"))
    same = F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("size") == F.col("z")) & (F.col("row_no") == F.col("k"))
    moved = copies.join(picks, same, "left")
    return moved.select("doc_id", "row_no", "source", "size", "rate", (F.col("copies") + F.coalesce(F.col("sign"), F.lit(0))).alias("copies"))


def word_count() -> Column:
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")


def row_number() -> Column:
    """Number among the rows of equal id, source and size."""
    return F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(F.lit(0)))


def mix_sources(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, rate, copies, taken.

    Size is the number of words (null text: 0). Null is a source of its own, the last. Documents without words keep
    one copy and count nothing; a source without words has target 0. Repeated rows are mixed each on its own, equal
    ids being told apart by a number that the order of equal rows cannot change the sum of. Empty input: no rows.
    """
    sized = stage(docs.select("doc_id", "source", word_count().alias("size")).withColumn("row_no", row_number()), "mix-sizes")
    targets = stage(source_targets(sized), "mix-targets")
    cells = stage(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-cells")
    lam = balance_multipliers(cells, targets)
    info = targets.join(lam, targets["source"].eqNullSafe(lam["source"])).select(
        targets["source"].alias("src"), "source_size", "target", "scale", "lam", "full"
    )
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("full"), float(MAX_REPEATS)).otherwise(
        F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(50.0))), F.lit(float(MAX_REPEATS)))
    )
    rated = sized.join(info, sized["source"].eqNullSafe(F.col("src"))).select("doc_id", "row_no", sized["source"], "size", rate.alias("rate"))
    copies = settle_rests(stage(round_to_copies(rated), "mix-copies"), targets)
    info = info.select("src", "source_size", "target")
    return copies.join(info, F.col("source").eqNullSafe(F.col("src"))).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "row_no"
    )


def repeat_rows(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` in as many copies as ``mix_sources`` gives them; the columns stay."""
    copies = stage(mix_sources(docs).select("doc_id", "source", "size", "row_no", "copies"), "mix-taken")
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("row"), *[F.col(c).alias(f"of_{c}") for c in ("doc_id", "source")], word_count().alias("of_size"))
    if copies.filter("row_no > 1").isEmpty() and copies.groupBy("doc_id").count().filter("count > 1").isEmpty():
        by_id = size_checked(copies.select("doc_id", "copies"), BROADCAST_ROWS)
        rows = rows.join(by_id, F.col("of_doc_id").eqNullSafe(F.col("doc_id")))
    else:
        number = F.row_number().over(Window.partitionBy("of_doc_id", "of_source", "of_size").orderBy(F.lit(0)))
        same = F.lit(True)
        for c in ("doc_id", "source", "size", "row_no"):
            same = same & F.col(f"of_{c}").eqNullSafe(F.col(c))
        rows = rows.withColumn("of_row_no", number).join(copies, same)
    rows = rows.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*[F.col("row")[c].alias(c) for c in columns])
