"""Ordered analytics without sorting a whole table in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.operators.checkpoints import checkpointed

ROWS_PER_RANGE = 1 << 16
FAN = 1024  # summaries that are folded in one row


def in_ranges(rows: DataFrame, key: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``rows`` with ``__range``: numbers that follow the order of ``key``, about ``rows_per_range`` rows to each.

    The table is partitioned by ranges of the key once; a partition is then cut by position. Only the largest number of cuts
    in a partition reaches the driver. Rows with equal keys may lie in two ranges.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    sorted_rows = rows.repartitionByRange(parts, F.col(key)).sortWithinPartitions(key)
    numbered = checkpointed(sorted_rows.withColumn("__at", F.monotonically_increasing_id()))  # fixed, whatever is computed again
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    cut = F.floor(place / F.lit(rows_per_range))
    cuts = (numbered.agg(F.max(cut)).first()[0] or 0) + 1
    return numbered.withColumn("__range", part * F.lit(cuts) + cut).drop("__at")


def carried(values: DataFrame, merge: Callable[[Column, Column], Column], fan: int = FAN) -> DataFrame:
    """An exclusive scan: ``__range``, ``before`` (the values of all smaller ranges merged in order; null where there are
    none) for every row of ``values`` (``__range``, ``value``; one row each).

    ``merge`` is associative and gets no nulls. Values are folded in groups of neighbouring ranges; the groups' sums are
    scanned in the same way, level by level, and joined back. No task holds more than ``fan`` values, and the driver none.
    """
    kind = values.schema["value"].dataType.simpleString()

    def merged(left: Column, right: Column) -> Column:
        return F.when(left.isNull(), right).when(right.isNull(), left).otherwise(merge(left, right))

    nothing = F.lit(None).cast(kind)
    groups = values.groupBy(F.floor(F.col("__range") / fan).alias("__group")).agg(
        F.sort_array(F.collect_list(F.struct("__range", "value"))).alias("parts")
    )
    last = values.agg(F.max("__range")).first()[0] or 0
    if last < fan:
        groups = groups.withColumn("start", nothing)
    else:
        groups = checkpointed(groups)
        sums = groups.select(
            F.col("__group").alias("__range"), F.aggregate("parts", nothing, lambda sum_, part: merged(sum_, part["value"])).alias("value")
        )
        above = carried(sums, merge, fan).select(F.col("__range").alias("__group"), F.col("before").alias("start"))
        groups = groups.join(above, "__group")
    empty = F.array().cast(f"array<struct<__range:bigint,before:{kind}>>")

    def step(state: Column, part: Column) -> Column:
        told = F.struct(part["__range"].alias("__range"), state["sum"].alias("before"))
        return F.struct(merged(state["sum"], part["value"]).alias("sum"), F.concat(state["told"], F.array(told)).alias("told"))

    start = F.struct(F.col("start").alias("sum"), empty.alias("told"))
    return groups.select(F.inline(F.aggregate("parts", start, step, lambda state: state["told"])))


def first_match(rows: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """The values of each key's first row by ``order``: one bounded state per key, combined map-side."""
    first = F.min_by(F.struct(*values), F.col(order)).alias("first")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(first).select(key, *[f"first.{v}" for v in values])
