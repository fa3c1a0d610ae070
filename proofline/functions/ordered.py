"""Ordered computations that do not put a whole key into one task.

A plain window sorts every row of a key in one task, so a key that holds a third of the table
becomes the job. These helpers split each key into chunks that follow the order (an hour, a block
of ids), work inside a chunk, carry one summary row per chunk across, and join it back.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.session import materialise


def _over(keys: Sequence[str], order):
    return Window.partitionBy(*keys).orderBy(*order)


def running_total(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence, value: Column, out: str,
                  inclusive: bool = True) -> DataFrame:
    """Cumulative sum per key in order; ``chunk`` must rise with the order inside each key."""
    groups = [*keys, chunk]
    local = Window.partitionBy(*groups).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    work = df.withColumn("_value", value)
    totals = work.groupBy(*groups).agg(F.sum("_value").alias("_chunk_total"))
    carry = totals.withColumn(
        "_carry",
        F.coalesce(F.sum("_chunk_total").over(
            _over(keys, [chunk]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).drop("_chunk_total")
    local_sum = F.coalesce(F.sum("_value").over(local), F.lit(0))
    return (
        work.withColumn("_local", local_sum).join(carry, groups)
        .withColumn(out, F.col("_local") + F.col("_carry")).drop("_local", "_carry", "_value")
    )


def running_extreme(df: DataFrame, keys: Sequence[str], chunk: str, order: str, value: Column, out: str,
                    largest: bool = True, inclusive: bool = False, backwards: bool = False) -> DataFrame:
    """Largest (or smallest) value among the rows before each row, or after it when ``backwards``.

    NULL where there is none; ``inclusive`` counts the row itself and its ties in the order.
    """
    pick = F.max if largest else F.min
    best = F.greatest if largest else F.least
    groups = [*keys, chunk]
    direction = (lambda c: F.desc(c)) if backwards else (lambda c: F.asc(c))
    if inclusive:
        local = Window.partitionBy(*groups).orderBy(direction(order)).rangeBetween(Window.unboundedPreceding, 0)
    else:
        local = Window.partitionBy(*groups).orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, -1)
    work = df.withColumn("_value", value)
    tops = work.groupBy(*groups).agg(pick("_value").alias("_top"))
    carry = tops.withColumn("_carry", pick("_top").over(
        _over(keys, [direction(chunk)]).rowsBetween(Window.unboundedPreceding, -1))).drop("_top")
    both = work.withColumn("_local", pick("_value").over(local)).join(carry, groups)
    chosen = F.when(F.col("_local").isNull(), F.col("_carry")).when(F.col("_carry").isNull(), F.col("_local")).otherwise(
        best("_local", "_carry"))
    return both.withColumn(out, chosen).drop("_local", "_carry", "_value")


def previous_value(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], value: Column,
                   out: str) -> DataFrame:
    """The value of the row just before each row; NULL for the first row of a key.

    ``order`` names columns that are unique inside a key.
    """
    groups = [*keys, chunk]
    # one-field struct: a NULL value in the previous row stays apart from "no previous row"
    work = df.withColumn("_value", F.struct(value.alias("v")))
    tails = work.groupBy(*groups).agg(F.max_by("_value", F.struct(*order)).alias("_tail"))
    carry = tails.withColumn("_carry", F.lag("_tail").over(_over(keys, [chunk]))).drop("_tail")
    local = Window.partitionBy(*groups).orderBy(*order)
    return (
        work.withColumn("_local", F.lag("_value").over(local)).join(carry, groups)
        .withColumn(out, F.coalesce(F.col("_local"), F.col("_carry"))["v"]).drop("_local", "_carry", "_value")
    )


def row_numbers(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence, out: str) -> DataFrame:
    """1-based position per key."""
    return running_total(df, keys, chunk, order, F.lit(1).cast("bigint"), out)


def table_row_numbers(df: DataFrame, order: Sequence, out: str) -> DataFrame:
    """1-based position of each row in the order of the whole table, in three levels and without a window.

    Rows are dealt by ranges of the order and sorted where they lie, which numbers them inside their range; the sizes of the
    ranges (one row a task) add up to offsets; each row adds its range's offset.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed, "ranges")                       # ranges are sampled anew at every run, so they are fixed by writing them
    part = F.shiftright("_at", 33)
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy(part.alias("part")).count().collect())
    starts = [0, *accumulate(n for _, n in sizes)]
    offsets = df.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts, strict=False)], "_part bigint, _start bigint")
    inside = F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(out, F.col("_start") + inside).drop("_at", "_part", "_start")
