"""The data step before plotting: checks, orders, bins, curves, trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.ordered import previous_value, running_extreme, running_total, table_row_numbers
from proofline.session import materialise


def finite(column: str) -> Column:
    """The value as a finite double, else NULL."""
    value = F.col(column).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(valid rows with the columns as doubles, rejected rows as read)."""
    good = F.lit(True)
    for c in columns:
        good = good & finite(c).isNotNull()
    return df.where(good).withColumns({c: finite(c) for c in columns}), df.where(~good)


def require_complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric rows; a non-finite or missing value stops the job instead of being dropped silently."""
    fail = F.raise_error(F.lit("non-finite or missing numeric value; fix the data or drop rows explicitly"))
    return df.withColumns({c: F.coalesce(finite(c), fail.cast("double")) for c in columns})


def first_seen(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values by first appearance."""
    return df.groupBy(value).agg(F.min(order).alias("first_seen"))


def category_index(df: DataFrame, value: str, order: str) -> DataFrame:
    """0-based index of each value by first appearance."""
    return table_row_numbers(first_seen(df, value, order), ["first_seen"], "_n").select(value, (F.col("_n") - 1).alias("index"))


def explicit_order(observed: DataFrame, requested: DataFrame, value: str) -> DataFrame:
    """Requested order checked against the observed values: ``requested(value, position)``."""
    seen = observed.select(value).distinct().withColumn("_seen", F.lit(True))
    both = seen.join(requested, value, "full")
    problem = F.when(F.col("position").isNull(), "missing from the order").when(F.col("_seen").isNull(), "not observed")
    return both.select(value, "position", problem.alias("problem"))


def volcano(df: DataFrame, p: str, effect: str, p_threshold: float, effect_threshold: float) -> DataFrame:
    """-log10 p and up, down or neutral; p outside (0, 1] is marked invalid."""
    ok = (F.col(p) > 0) & (F.col(p) <= 1)
    group = (F.when(~ok, "invalid").when((F.col(p) < p_threshold) & (F.col(effect) >= effect_threshold), "up")
             .when((F.col(p) < p_threshold) & (F.col(effect) <= -effect_threshold), "down").otherwise("neutral"))
    return df.withColumn("score", F.when(ok, -F.log10(p))).withColumn("group", group)


def volcano_labels(points: DataFrame, p: str, top: int, tie: str) -> DataFrame:
    """The significant points with the smallest p: a distributed top-k."""
    return points.where(F.col("group").isin("up", "down")).orderBy(p, tie).limit(top)


def roc_auc(df: DataFrame, curve: str, fpr: str, tpr: str, row: str, rows_per_chunk: int = 1_000_000) -> DataFrame:
    """Trapezoid area per curve after a stable sort by false-positive rate, and whether input came sorted.

    A curve may hold most of the rows, so rates are aggregated first and neighbours are found inside slices of the rate
    and of the row number, with one row carried per slice.
    """
    base = df.select(curve, F.col(fpr).alias("x"), F.col(tpr).alias("y"), F.col(row).alias("row"))
    # at one rate only the first and the last row count: a rate that most rows share is one row after map-side aggregation
    rates = base.groupBy(curve, "x").agg(F.min_by("y", "row").alias("y"), F.max_by("y", "row").alias("last"), F.count("*").alias("n"))
    prior = previous_value(rates.withColumn("_slice", F.floor(F.col("x") * 1000)), [curve], "_slice", ["x"], F.struct("x", "last"), "_p")
    area = prior.groupBy(curve).agg(
        F.sum((F.col("x") - F.col("_p.x")) * (F.col("y") + F.col("_p.last")) / 2).alias("auc"), F.sum("n").alias("n"))
    base = base.withColumn("_block", F.floor(F.col("row") / rows_per_chunk))
    arrival = previous_value(base, [curve], "_block", ["row"], F.col("x"), "_before")
    order = arrival.groupBy(curve).agg(F.bool_and(F.coalesce(F.col("_before") <= F.col("x"), F.lit(True))).alias("sorted_input"))
    return area.join(order, curve)


def dot_matrix(df: DataFrame, row: str, column: str, size: str, colour: str, order: str) -> DataFrame:
    """Row and column index, marker size 12 + 160 sqrt(v / max), and min-max colour."""
    rows = category_index(df, row, order).withColumnRenamed("index", "row_index")
    cols = category_index(df, column, order).withColumnRenamed("index", "column_index")
    top = df.select(F.max(size)).scalar()
    low, high = df.select(F.min(colour)).scalar(), df.select(F.max(colour)).scalar()
    out = df.withColumn("_top", top).withColumn("_low", low).withColumn("_high", high)
    marker = F.when(F.col("_top") == 0, 30.0).otherwise(12 + 160 * F.sqrt(F.col(size) / F.col("_top")))
    shade = F.when(F.col("_high") == F.col("_low"), 0.5).otherwise(
        (F.col(colour) - F.col("_low")) / (F.col("_high") - F.col("_low")))
    out = out.withColumn("marker", marker).withColumn("shade", shade).drop("_top", "_low", "_high")
    return out.join(rows, row).join(cols, column)


def marginal_hist(df: DataFrame, group: str, value: str, bins: int) -> DataFrame:
    """Counts and densities of equal-width bins per group; the last bin is closed.

    Values are binned row by row and counted with partial aggregation.
    """
    span = df.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("total"))
    flat = F.col("lo") == F.col("hi")
    span = span.withColumn("lo", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))).withColumn(
        "hi", F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")))
    span = span.withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    slot = F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    counted = df.where(F.col(value).isNotNull()).join(span, group).groupBy(group, slot.cast("int").alias("bin")).agg(
        F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("width").alias("width"), F.first("total").alias("total"))
    return counted.select(group, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("left_edge"), "n",
                          (F.col("n") / (F.col("total") * F.col("width"))).alias("density"))


def paired(df: DataFrame, subject: str, condition: str, value: str, conditions: tuple[str, str]) -> DataFrame:
    """One row per subject: both values and whether the pair is complete, incomplete or duplicated."""
    a, b = conditions
    n = lambda c: F.count_if(F.col(condition) == c)
    v = lambda c: F.min(F.when(F.col(condition) == c, F.col(value)))
    per = df.groupBy(subject).agg(n(a).alias("_na"), n(b).alias("_nb"), v(a).alias("first_value"), v(b).alias("second_value"))
    state = (F.when((F.col("_na") > 1) | (F.col("_nb") > 1), "duplicate")
             .when((F.col("_na") == 0) | (F.col("_nb") == 0), "incomplete").otherwise("complete"))
    return per.select(subject, "first_value", "second_value", state.alias("state"))


def unexpected_conditions(df: DataFrame, condition: str, conditions: tuple[str, str]) -> DataFrame:
    """Conditions beyond the two a paired chart can show."""
    return df.where(~F.col(condition).isin(*conditions)).groupBy(condition).agg(F.count("*").alias("rows"))


def box_stats(df: DataFrame, group: str, value: str, slices: int = 1000) -> DataFrame:
    """Exact linear quartiles and 1.5 IQR whiskers per group.

    Equal values are counted first, then cumulative counts run over slices of the value range, so
    neither a hot group nor a hot value is ever gathered in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    counts = materialise(counts, "box-values")     # read four times below; one row per distinct value
    span = counts.groupBy(group).agg(F.sum("n").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wide = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * slices)).otherwise(F.lit(0))
    sliced = counts.join(span, group).withColumn("_slice", wide)
    cum = running_total(sliced, [group], "_slice", ["v"], F.col("n"), "cum")
    aggs = [F.first("total").alias("total")]
    for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        place = (F.col("total") - 1) * q
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            aggs.append(F.min(F.when(F.col("cum") > rank, F.col("v"))).alias(f"{name}_{side}"))
    per = cum.groupBy(group).agg(*aggs)
    for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        part = (F.col("total") - 1) * q - F.floor((F.col("total") - 1) * q)
        per = per.withColumn(name, F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * part)
    per = per.select(group, "total", "q1", "median", "q3")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    ends = counts.join(per, group).groupBy(group).agg(
        F.min(F.when(F.col("v") >= F.col("q1") - reach, F.col("v"))).alias("low"),
        F.max(F.when(F.col("v") <= F.col("q3") + reach, F.col("v"))).alias("high"))
    return per.join(ends, group).select(
        group, "total", "q1", "median", "q3", F.least("low", "q1").alias("whisker_low"), F.greatest("high", "q3").alias("whisker_high"))


def cumulative_trend(df: DataFrame, series: str, at: str, value: Column | None = None) -> DataFrame:
    """Running total per series over every month from its first to the table's last; empty months count 0.

    Rows are summed to months before anything is ordered.
    """
    amount = value if value is not None else F.lit(1)
    month = F.trunc(F.col(at).cast("date"), "month")
    monthly = df.groupBy(series, month.alias("month")).agg(F.sum(amount).alias("amount"))
    last = monthly.select(F.max("month")).scalar()
    spine = monthly.groupBy(series).agg(F.min("month").alias("_first")).select(
        series, F.explode(F.sequence(F.col("_first"), last, F.expr("INTERVAL 1 MONTH"))).alias("month"))
    full = spine.join(monthly, [series, "month"], "left").withColumn("amount", F.coalesce("amount", F.lit(0)))
    order = Window.partitionBy(series).orderBy("month")
    return full.withColumn("running", F.sum("amount").over(order))


def event_marks(trend: DataFrame, marks: DataFrame, series: str) -> DataFrame:
    """Series value at each marked month; marks outside the series are dropped."""
    return trend.join(marks, [series, "month"]).select(series, "month", "label", "running")


def composition(df: DataFrame, category: str, subcategory: str, stage: str) -> DataFrame:
    """Counts by category, subcategory and stage with row, column and grand totals (grouping sets)."""
    keys = [category, subcategory, stage]
    return df.groupingSets([keys, [category, subcategory], [stage], []], *keys).agg(
        F.count("*").alias("n"), F.grouping_id(*keys).alias("level"))


def stacked_base(df: DataFrame, bar: str, segment: str, value: str) -> DataFrame:
    """Height and start offset of each stacked segment; rows are summed per segment first."""
    heights = df.groupBy(bar, segment).agg(F.sum(value).alias("height"))
    below = Window.partitionBy(bar).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    return heights.withColumn("base", F.coalesce(F.sum("height").over(below), F.lit(0.0)))


def grid_direction(grid: DataFrame, series: str, pos: str, x: str, rows_per_chunk: int = 1_000_000) -> DataFrame:
    """rising, falling or unsafe per interpolation grid (duplicates and turns are unsafe)."""
    rows = previous_value(grid.withColumn("_block", F.floor(F.col(pos) / rows_per_chunk)), [series], "_block", [pos], F.col(x), "_before")
    up, down = F.col(x) > F.col("_before"), F.col(x) < F.col("_before")
    safe = F.count("*") >= 2
    return rows.groupBy(series).agg(
        F.when(safe & F.bool_and(F.coalesce(up, F.lit(True))), "rising").when(
            safe & F.bool_and(F.coalesce(down, F.lit(True))), "falling").otherwise("unsafe").alias("direction"))


def interp_monotone(targets: DataFrame, grid: DataFrame, series: str, target: str, pos: str, x: str, y: str,
                    slices: int = 1000) -> DataFrame:
    """Linear interpolation of each target on its series' grid; ends are clamped, unsafe grids give NULL.

    Grid and targets are ordered together inside slices of the x range; the neighbouring grid points
    across slices travel as one carried row, so no target is paired with a whole grid.
    """
    direction = grid_direction(grid, series, pos, x)
    span = grid.groupBy(series).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    points = grid.select(series, F.col(x).cast("double").alias("at"), F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).alias("g"),
                         F.lit(None).cast("bigint").alias("target_id"))
    wanted = targets.select(series, F.col(target).cast("double").alias("at"), F.lit(None).cast("struct<x:double,y:double>").alias("g"), "target_id")
    both = points.unionByName(wanted).join(span, series)
    wide = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("at") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * slices)).otherwise(F.lit(0))
    both = both.withColumn("_slice", F.greatest(F.lit(-1), F.least(F.lit(slices + 1), wide)))
    both = running_extreme(both, [series], "_slice", "at", F.col("g"), "before", inclusive=True)
    both = running_extreme(both, [series], "_slice", "at", F.col("g"), "after", largest=False, inclusive=True, backwards=True)
    value = (F.when(F.col("before").isNull(), F.col("after.y")).when(F.col("after").isNull() | (F.col("before.x") == F.col("after.x")), F.col("before.y"))
             .otherwise(F.col("before.y") + (F.col("after.y") - F.col("before.y")) * (F.col("at") - F.col("before.x")) / (F.col("after.x") - F.col("before.x"))))
    return both.where("target_id IS NOT NULL").join(direction, series).select(
        "target_id", series, F.col("at").alias("target"), "direction", F.when(F.col("direction") != "unsafe", value).alias("value"))


def reference_values(maximum: Column) -> Column:
    """A quarter, half and all of a maximum, each rounded to half its magnitude, distinct and positive."""
    quantum = F.pow(F.lit(10.0), F.floor(F.log10(maximum))) / 2
    values = F.array(*[F.bround(maximum * share / quantum) * quantum for share in (0.25, 0.5, 1.0)])
    return F.when(maximum > 0, F.array_sort(F.array_distinct(F.filter(values, lambda v: v > 0)))).otherwise(
        F.array().cast("array<double>"))


def qa_record(df: DataFrame, columns: Sequence[str], mapping: dict[str, str], parameters: dict[str, str]) -> DataFrame:
    """One row: input, used and excluded rows with the mapping and parameters of the chart."""
    good = F.lit(True)
    for c in columns:
        good = good & finite(c).isNotNull()
    text = lambda d: F.lit("; ".join(f"{k}={v}" for k, v in d.items()))
    return df.agg(F.count("*").alias("rows_input"), F.count_if(good).alias("rows_used"), F.count_if(~good).alias("rows_excluded")).withColumn(
        "mapping", text(mapping)).withColumn("parameters", text(parameters))
