"""Typed cells: the rule a spreadsheet export applies to each value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.functions.text import iso_date


def typed_cells(
    rows: DataFrame, keys: list[str], names: list[str], part: str | None = None, cells: list[str] | None = None
) -> DataFrame:
    """``cells`` are the columns that hold the values, those of ``names`` if not given. ``keys…, column, kind, text, date``: text that is exactly an ISO date becomes a date, every
    other value stays text. With ``part``, fragments of split rows are never read as dates."""
    cells = F.array(*[
        F.struct(F.lit(name).alias("column"), F.col(f"`{cell}`").alias("text")) for name, cell in zip(names, cells or names)
    ])
    kept = keys + ([part] if part else [])
    spread = rows.select(*kept, F.explode(cells).alias("cell")).select(*kept, "cell.column", "cell.text")
    date = iso_date(F.col("text"))
    if part:
        date = F.when(F.col(part) == 0, date)
    return spread.select(
        *kept, "column", F.when(date.isNotNull(), "date").otherwise("text").alias("kind"), "text", date.alias("date")
    )
