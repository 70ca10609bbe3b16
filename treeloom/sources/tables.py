"""Where tables come from: any callable from a table name to a DataFrame."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Resolve = Callable[[str], DataFrame]


def parquet_tables(spark: SparkSession, folder: str) -> Resolve:
    return lambda name: spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def session_tables(spark: SparkSession) -> Resolve:
    return spark.table


def jdbc_tables(
    spark: SparkSession, url: str, user: str, password: str, split: dict[str, dict] | None = None, **options: str
) -> Resolve:
    """Tables of a database, by name or by ``schema.name``. ``split`` gives ``partitionColumn`` and ``numPartitions`` per table; where it leaves out
    ``lowerBound`` and ``upperBound``, the database is asked for the least and the greatest key. A table without it is
    read over one connection, which large tables should not be. Statements have no time limit unless ``options``
    sets ``queryTimeout``."""

    def read(name: str) -> DataFrame:
        quoted = ".".join('"' + part.replace('"', '""') + '"' for part in name.split("."))
        parts = dict((split or {}).get(name, {}))
        if "partitionColumn" in parts and "lowerBound" not in parts:
            column = '"' + parts["partitionColumn"].replace('"', '""') + '"'
            ends = load(query=f"select min({column}) as low, max({column}) as high from {quoted}").first()
            if ends["low"] is None:
                parts = {}  # no rows
            else:
                parts |= {"lowerBound": str(ends["low"]), "upperBound": str(ends["high"])}
        return load(dbtable=quoted, **parts)

    def load(**what: str) -> DataFrame:
        reader = spark.read.format("jdbc").options(url=url, user=user, password=password, fetchsize="10000")
        return reader.options(**options).options(**what).load()

    return read


def with_views(resolve: Resolve, *names: str) -> Resolve:
    """The same tables, some also visible by name to subqueries in filters."""
    for name in names:
        resolve(name).createOrReplaceTempView(name)
    return resolve
