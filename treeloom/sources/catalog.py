"""The schema catalog: columns with keys and references, and the joins it suggests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.sources.tables import Resolve

COLUMNS = "table_name string, ordinal int, column_name string, data_type string, nullable boolean"
PRIMARY_KEYS = "table_name string, column_name string"
FOREIGN_KEYS = "table_name string, column_name string, fk_table string, fk_column string"


def catalog(columns: DataFrame, primary_keys: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """One row per column: its type, whether it is in the primary key, and its first reference."""
    on = ["table_name", "column_name"]
    keyed = primary_keys.select(*on).distinct().withColumn("primary_key", F.lit(True))
    first = foreign_keys.groupBy(*on).agg(F.min(F.struct("fk_table", "fk_column")).alias("fk"))
    return (
        columns.join(keyed, on, "left").join(first, on, "left")
        .select(
            "table_name", "ordinal", "column_name", "data_type", "nullable",
            F.coalesce("primary_key", F.lit(False)).alias("primary_key"), "fk.fk_table", "fk.fk_column",
        )
    )


def by_table(found: DataFrame) -> DataFrame:
    """The catalog as one row per table with its columns in order; a table's columns are few."""
    column = F.struct("ordinal", *[c for c in found.columns if c not in ("table_name", "ordinal")])
    return found.groupBy("table_name").agg(F.sort_array(F.collect_list(column)).alias("columns"))


def declared_catalog(
    columns: DataFrame, constraints: DataFrame, key_columns: DataFrame, referenced: DataFrame, schema: str = "public"
) -> DataFrame:
    """The catalog of a database, from frames shaped like the views of its ``information_schema``: ``columns``,
    ``table_constraints``, ``key_column_usage`` and ``constraint_column_usage``. Only these are read, no data."""
    here = F.col("table_schema") == schema
    described = columns.where(here).select(
        "table_name", F.col("ordinal_position").cast("int").alias("ordinal"), "column_name", "data_type",
        (F.upper("is_nullable") == "YES").alias("nullable"),
    )
    named = constraints.where(here).select("constraint_name", "table_name", "constraint_type")
    used = key_columns.where(here).select("constraint_name", "table_name", "column_name").join(named, ["constraint_name", "table_name"])
    primary = used.where("constraint_type = 'PRIMARY KEY'").select("table_name", "column_name")
    target = referenced.select("constraint_name", F.col("table_name").alias("fk_table"), F.col("column_name").alias("fk_column"))
    foreign = used.where("constraint_type = 'FOREIGN KEY'").join(target, "constraint_name").select("table_name", "column_name", "fk_table", "fk_column")
    return catalog(described, primary, foreign)


def information_schema(resolve: Resolve, schema: str = "public") -> DataFrame:
    """The catalog of a resolver that reads a database's ``information_schema``."""
    views = ("columns", "table_constraints", "key_column_usage", "constraint_column_usage")
    return declared_catalog(*[resolve(f"information_schema.{view}") for view in views], schema)


def schema_catalog(
    resolve: Resolve, tables: list[str], primary_keys: dict[str, str], foreign_keys: list[tuple[str, str, str, str]]
) -> DataFrame:
    """The catalog of files from their schemas and declared keys; no data is read."""
    spark = resolve(tables[0]).sparkSession
    rows = [
        (table, number, field.name, field.dataType.simpleString(), field.nullable)
        for table in tables for number, field in enumerate(resolve(table).schema.fields, 1)
    ]
    keys = spark.createDataFrame(list(primary_keys.items()), PRIMARY_KEYS)
    return catalog(spark.createDataFrame(rows, COLUMNS), keys, spark.createDataFrame(foreign_keys, FOREIGN_KEYS))


def observed_catalog(
    resolve: Resolve, tables: list[str], primary_keys: dict[str, str], foreign_keys: list[tuple[str, str, str, str]]
) -> DataFrame:
    """The catalog of files, which hold no constraints: a column is nullable when a NULL was read,
    and a declared key counts when the data bears it out."""
    columns = reduce(DataFrame.union, [_observed_columns(resolve(name), name) for name in tables])
    keys = reduce(
        DataFrame.union, [_observed_key(resolve(table), table, column) for table, column in primary_keys.items()]
    )
    spark = resolve(tables[0]).sparkSession
    return catalog(columns, keys, spark.createDataFrame(foreign_keys, FOREIGN_KEYS))


def _observed_columns(df: DataFrame, table: str) -> DataFrame:
    fields = df.schema.fields
    nulls = df.agg(*[F.coalesce(F.max(F.col(f"`{f.name}`").isNull()), F.lit(False)).alias(f"n{i}") for i, f in enumerate(fields)])
    described = F.array(*[
        F.struct(
            F.lit(i + 1).alias("ordinal"), F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"), F.col(f"n{i}").alias("nullable"),
        )
        for i, f in enumerate(fields)
    ])
    return nulls.select(F.lit(table).alias("table_name"), F.explode(described).alias("c")).select("table_name", "c.*")


def _observed_key(df: DataFrame, table: str, column: str) -> DataFrame:
    counts = df.groupBy(F.col(f"`{column}`").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    worst = counts.agg(F.max("n").alias("n"), F.max(F.col("key").isNull()).alias("empty"))
    good = worst.where("n = 1 and not empty")
    return good.select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"))


def suggest_joins(found: DataFrame, table: str, configured: list[tuple[str, str, str]] = ()) -> DataFrame:
    """Tables that refer to ``table``, without the relations that are configured already."""
    pointing = found.where((F.col("fk_table") == table) & (F.col("table_name") != table)).select(
        F.col("table_name").alias("related_table"), F.col("column_name").alias("join_key"),
        F.col("fk_column").alias("source_join_key"),
    )
    if not configured:
        return pointing
    spark: SparkSession = found.sparkSession
    known = spark.createDataFrame(list(configured), "related_table string, join_key string, source_join_key string")
    return pointing.join(known, pointing.columns, "left_anti")


def missing_columns(df: DataFrame, contract: list[str]) -> list[str]:
    """Columns a contract asks for and the export lacks."""
    return [name for name in contract if name not in df.columns]
