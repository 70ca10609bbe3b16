"""Joins that hold when one key carries a large share of the rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A value is heavy from this many rows on, if it is also above the fair share of one task.
HEAVY_ROWS = 1_000_000
# The fair share is this part of all rows: at 10^12 rows, 5 * 10^7 of them. It bounds the heavy values as well.
FAIR_TASKS = 20_000
TRACKED = 200_000


@dataclass(frozen=True)
class Heavy:
    """Key values (as text, None for NULL) that must not stay in one task, and how many tasks each is spread over.
    By the fair share there are at most ``FAIR_TASKS`` values, and at most twice as many tasks in all."""

    values: tuple[str | None, ...] = ()
    tasks: tuple[int, ...] = ()

    @property
    def salts(self) -> int:
        return max(self.tasks, default=1)

    def spread(self, key: Column) -> Column:
        """The number of tasks for a key: 1 unless it is heavy. Values are told apart by their classes, so that the
        expression stays small."""
        classes: dict[int, list[str | None]] = {}
        for value, tasks in zip(self.values, self.tasks):
            classes.setdefault(tasks, []).append(value)
        found = F.lit(1)
        for tasks, values in sorted(classes.items()):
            known = [value for value in values if value is not None]
            hit = F.coalesce(key.cast("string").isin(known), F.lit(False)) if known else F.lit(False)
            found = F.when(hit | key.isNull() if None in values else hit, F.lit(tasks)).otherwise(found)
        return found


NOT_HEAVY = Heavy()


def heavy_sketch(key: Column) -> Column:
    """Most frequent key values with their counts: a bounded sketch, merged map-side."""
    return F.call_function("approx_top_k", key.cast("string"), F.lit(FAIR_TASKS), F.lit(TRACKED))


def heavy_from_sketch(items, rows: int, heavy_rows: int = HEAVY_ROWS) -> Heavy:
    """Each heavy value gets a power of two of tasks, so that none of them holds more than the fair share."""
    share = max(heavy_rows, rows // FAIR_TASKS, 1)
    found = [item for item in items or () if item["count"] >= share]
    tasks = [1 << max(1, (-(-item["count"] // share) - 1).bit_length()) for item in found]
    return Heavy(tuple(item["item"] for item in found), tuple(tasks))


def measure_heavy(rows: DataFrame, *keys: str, heavy_rows: int = HEAVY_ROWS) -> list[Heavy]:
    """The heavy values of each key column, in one pass."""
    sketches = [heavy_sketch(F.col(key)).alias(f"k{n}") for n, key in enumerate(keys)]
    found = rows.agg(F.count(F.lit(1)).alias("n"), *sketches).first()
    return [heavy_from_sketch(found[f"k{n}"], found["n"], heavy_rows) for n in range(len(keys))]


def skew_join(
    many: DataFrame,
    few: DataFrame,
    many_key: str,
    few_key: str,
    row_id: str,
    how: str,
    heavy: Heavy,
    strategy: str | None = None,
    few_heavy: Heavy = NOT_HEAVY,
    few_id: str | None = None,
) -> DataFrame:
    """``many`` joined to ``few`` on one key. Rows of heavy keys in ``many`` are spread by ``row_id``
    and the matching rows of ``few`` repeated once per salt; all others join as usual.

    ``row_id`` must be stable under task retries, which is why it is a column made at the scan. For
    inner joins ``few`` may have heavy keys of its own, spread by ``few_id`` in the same way.
    """
    on = F.col(many_key) == F.col(few_key)
    if heavy.values:
        many = many.withColumn("__salt", _salt(heavy, many_key, row_id))
        few = few.withColumn("__copy", F.explode(_copies(heavy, few_key)))
        on = on & (F.col("__salt") == F.col("__copy"))
    if few_heavy.values:
        few = few.withColumn("__few_salt", _salt(few_heavy, few_key, few_id))
        many = many.withColumn("__few_copy", F.explode(_copies(few_heavy, many_key)))
        on = on & (F.col("__few_salt") == F.col("__few_copy"))
    few = few.hint(strategy) if strategy else few
    return many.join(few, on, how).drop("__salt", "__copy", "__few_salt", "__few_copy")


def _salt(heavy: Heavy, key: str, row_id: str) -> Column:
    return F.pmod(F.xxhash64(row_id), heavy.spread(F.col(key)))


def _copies(heavy: Heavy, key: str) -> Column:
    return F.sequence(F.lit(0).cast("long"), (heavy.spread(F.col(key)) - 1).cast("long"))
