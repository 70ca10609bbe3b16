"""The query catalogue over the driver's tables, one entry per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.definition import (
    Envelope,
    Field,
    FieldMapping,
    FlatMapping,
    MetadataField,
    Relation,
    array,
    obj,
    root,
    scalar,
)
from treeloom.functions.text import package_file_name
from treeloom.operators.checkpoints import shared_folder
from treeloom.operators.ordered import first_match
from treeloom.plans import ledger
from treeloom.plans.cells import typed_cells
from treeloom.plans.flat import flat_export, nested_export, tree_export
from treeloom.plans.lines import csv_lines, document_lines, flat_json_lines
from treeloom.plans.shapes import flatten_any, strip_any
from treeloom.sinks.package import format_of, package_name, package_records, verify_package, write_package
from treeloom.sources.catalog import observed_catalog, schema_catalog, suggest_joins
from treeloom.sources.tables import Resolve, parquet_tables, with_views

NOW = datetime(1998, 6, 1, tzinfo=timezone.utc)
EXTRACTED_AT = datetime(2026, 6, 28, 6, tzinfo=timezone.utc)
# Records this small force every parent with children through the split form.
SPLIT_BYTES = 64


def derived(resolve: Resolve, **tables: Callable[[], DataFrame]) -> Resolve:
    return lambda name: tables[name]() if name in tables else resolve(name)


# --- flat exports -------------------------------------------------------------------------------


def project_rename(t: Resolve) -> DataFrame:
    fields = (
        Field("p_partkey", "id"), Field("p_name", "name"), Field("p_brand", "brand"),
        Field("p_type", "type", enabled=False),
    )
    return flat_export(t, FlatMapping("part", fields)).flat_rows()


def flat_export_nations(t: Resolve) -> DataFrame:
    customers = Relation(
        "customer", "c_nationkey", "n_nationkey", (Field("c_name", "customers"), Field("c_mktsegment", "segments")),
        order_by=("c_custkey",),
    )
    suppliers = Relation(
        "supplier", "s_nationkey", "n_nationkey", (Field("s_name", "suppliers"),), delimiter=" | ", order_by=("s_suppkey",)
    )
    mapping = FlatMapping("nation", (Field("n_nationkey", "id"), Field("n_name", "nation")), (customers, suppliers))
    return flat_export(t, mapping).flat_rows()


def flat_iso_dates(t: Resolve) -> DataFrame:
    mapping = FlatMapping("orders", (Field("o_orderkey", "id"), Field("o_orderdate", "ordered"), Field("o_orderstatus", "status")))
    return flat_export(t, mapping).flat_rows()


def _sparse_orders(t: Resolve) -> Resolve:
    return derived(t, sparse_orders=lambda: t("orders").select(
        "o_orderkey",
        F.expr("nullif(o_orderpriority, '1-URGENT')").alias("priority"),
        F.expr("case when o_orderstatus <> 'P' then o_orderdate end").alias("ordered"),
    ))


def flat_null_to_empty(t: Resolve) -> DataFrame:
    mapping = FlatMapping(
        "sparse_orders", (Field("o_orderkey", "id"), Field("priority", "priority"), Field("ordered", "ordered"))
    )
    return flat_export(_sparse_orders(t), mapping).flat_rows()


def _urgent_orders(t: Resolve) -> Resolve:
    return derived(t, urgent_orders=lambda: t("orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'"))


def _customer_orders(strategy: str) -> FlatMapping:
    orders = Relation(
        "urgent_orders", "o_custkey", "c_custkey", (Field("o_orderkey", "orders"), Field("o_orderdate", "dates")),
        flatten_strategy=strategy, delimiter="; ", order_by=("o_orderkey",),
    )
    return FlatMapping("customer", (Field("c_custkey", "id"), Field("c_name", "name")), (orders,))


def relation_string_join(t: Resolve) -> DataFrame:
    return flat_export(_urgent_orders(t), _customer_orders("string_join")).flat_rows()


def relation_array_join(t: Resolve) -> DataFrame:
    return flat_export(_urgent_orders(t), _customer_orders("array_join")).flat_rows()


def flat_json_records(t: Resolve) -> DataFrame:
    return flat_json_lines(flat_export(_urgent_orders(t), _customer_orders("string_join"), keys=["c_custkey"]))


def strip_denied_flat(t: Resolve) -> DataFrame:
    fields = (
        Field("s_suppkey", "id"), Field("s_name", "Contact_Name"), Field("s_nationkey", "nation"),
    )
    return flat_export(t, FlatMapping("supplier", fields)).flat_rows()


# --- nested exports -----------------------------------------------------------------------------


def object_lookup(t: Resolve) -> DataFrame:
    tree = root(
        scalar("id", "c_custkey"), scalar("name", "c_name"),
        obj("nation", "nation", "n_nationkey", "c_nationkey", scalar("name", "n_name"),
            obj("region", "region", "r_regionkey", "n_regionkey", scalar("name", "r_name"))),
    )
    return tree_export(t, "customer", tree, keys=["c_custkey"]).json_lines()


URGENT = "o_orderpriority = '1-URGENT' and o_orderstatus = 'P'"


def array_embed(t: Resolve) -> DataFrame:
    tree = root(
        scalar("id", "c_custkey"), scalar("name", "c_name"),
        array("orders", "orders", "o_custkey", "c_custkey", scalar("key", "o_orderkey"), scalar("status", "o_orderstatus"),
              filter=URGENT, order_by=("o_orderkey",)),
    )
    return tree_export(t, "customer", tree, keys=["c_custkey"]).json_lines()


def object_lookup_mixed_keys(t: Resolve) -> DataFrame:
    """A fraction as the parent's key, a whole number as the child's, every key salted and nothing broadcast."""
    typed = derived(t, typed_customer=lambda: t("customer").withColumn("c_nationkey", F.col("c_nationkey").cast("double")))
    tree = root(scalar("id", "c_custkey"), obj("nation", "nation", "n_nationkey", "c_nationkey", scalar("name", "n_name")))
    return tree_export(typed, "typed_customer", tree, keys=["c_custkey"], heavy_rows=1, broadcast_bytes=-1).json_lines()


def array_embed_mixed_keys(t: Resolve) -> DataFrame:
    typed = derived(t, typed_customer=lambda: t("customer").withColumn("c_custkey", F.col("c_custkey").cast("decimal(14,2)")))
    tree = root(
        scalar("name", "c_name"),
        array("orders", "orders", "o_custkey", "c_custkey", scalar("key", "o_orderkey"), filter=URGENT, order_by=("o_orderkey",)),
    )
    return tree_export(typed, "typed_customer", tree, keys=["c_name"], heavy_rows=1, broadcast_bytes=-1).json_lines()


def null_join_keys(t: Resolve) -> DataFrame:
    """Parents and children without a key find nothing, and nothing finds them."""
    sparse = derived(
        t, keyed_nation=lambda: t("nation").withColumn("n_regionkey", F.expr("nullif(n_regionkey, 2)")),
        keyed_customer=lambda: t("customer").withColumn("c_nationkey", F.expr("nullif(c_nationkey, 3)")),
    )
    tree = root(
        scalar("nation", "n_name"), obj("region", "region", "r_regionkey", "n_regionkey", scalar("name", "r_name")),
        array("customers", "keyed_customer", "c_nationkey", "n_nationkey", scalar("id", "c_custkey"), order_by=("c_custkey",)),
    )
    return tree_export(sparse, "keyed_nation", tree, keys=["n_nationkey"]).json_lines()


def _regions() -> object:
    return root(
        scalar("region", "r_name"),
        array("nations", "nation", "n_regionkey", "r_regionkey", scalar("name", "n_name"),
              array("customers", "customer", "c_nationkey", "n_nationkey", scalar("id", "c_custkey"),
                    scalar("name", "c_name"), order_by=("c_custkey",)),
              order_by=("n_nationkey",)),
    )


def tree_three_levels(t: Resolve) -> DataFrame:
    return tree_export(t, "region", _regions(), keys=["r_regionkey"]).json_lines()


def tree_three_levels_split(t: Resolve) -> DataFrame:
    """Every region over the budget: the pieces as they are, without their running numbers."""
    export = tree_export(t, "region", _regions(), keys=["r_regionkey"], record_bytes=SPLIT_BYTES)
    return export.json_lines().select("r_regionkey", "json")


def tree_scalars_text(t: Resolve) -> DataFrame:
    tree = root(
        scalar("key", "o_orderkey"), scalar("ordered", "o_orderdate"), scalar("status", "o_orderstatus"),
        obj("customer", "customer", "c_custkey", "o_custkey", scalar("nation", "c_nationkey")),
    )
    return tree_export(t, "orders", tree, keys=["o_orderkey"]).json_lines()


def tree_root_filter(t: Resolve) -> DataFrame:
    tree = root(
        scalar("id", "c_custkey"),
        array("orders", "orders", "o_custkey", "c_custkey", scalar("key", "o_orderkey"), order_by=("o_orderkey",)),
        filter="c_mktsegment = 'BUILDING' and c_nationkey < 10",
    )
    return tree_export(t, "customer", tree, keys=["c_custkey"]).json_lines()


def tree_node_filter(t: Resolve) -> DataFrame:
    tree = root(
        scalar("name", "c_name"),
        array("failed", "orders", "o_custkey", "c_custkey", scalar("key", "o_orderkey"),
              filter="o_orderstatus = 'F' and o_orderpriority = '5-LOW'", order_by=("o_orderkey",)),
        obj("africa", "nation", "n_nationkey", "c_nationkey", scalar("name", "n_name"), filter="n_regionkey = 0"),
    )
    return tree_export(t, "customer", tree, keys=["c_custkey"]).json_lines()


def tree_disabled_pruned(t: Resolve) -> DataFrame:
    tree = root(
        scalar("id", "c_custkey"), scalar("segment", "c_mktsegment", enabled=False),
        obj("nation", "nation", "n_nationkey", "c_nationkey", scalar("name", "n_name"), enabled=False),
        array("orders", "orders", "o_custkey", "c_custkey", scalar("key", "o_orderkey"),
              scalar("status", "o_orderstatus", enabled=False), order_by=("o_orderkey",)),
    )
    return tree_export(t, "customer", tree, keys=["c_custkey"]).json_lines()


def tree_same_table_twice(t: Resolve) -> DataFrame:
    def lines(name: str, test: str):
        return array(name, "lineitem", "l_orderkey", "o_orderkey", scalar("line", "l_linenumber"), scalar("part", "l_partkey"),
                     filter=test, order_by=("l_linenumber", "l_partkey"))

    tree = root(scalar("key", "o_orderkey"), lines("returned", "l_returnflag = 'R'"), lines("kept", "l_returnflag <> 'R'"))
    return tree_export(t, "orders", tree, keys=["o_orderkey"]).json_lines()


def _suppliers() -> object:
    return root(
        scalar("nation", "n_name"),
        obj("region", "region", "r_regionkey", "n_regionkey", scalar("name", "r_name")),
        array("suppliers", "supplier", "s_nationkey", "n_nationkey", scalar("key", "s_suppkey"), scalar("name", "s_name"),
              order_by=("s_suppkey",)),
    )


def tree_flatten_columns(t: Resolve) -> DataFrame:
    return tree_export(t, "nation", _suppliers()).flat_rows()


def tree_flatten_split(t: Resolve) -> DataFrame:
    """Every nation with suppliers over the budget: cells in fragments, delimiters included."""
    export = tree_export(t, "nation", _suppliers(), keys=["n_nationkey"], record_bytes=SPLIT_BYTES)
    return export.flat_rows().drop("part")


def scope_exists_filter(t: Resolve) -> DataFrame:
    large = "(select distinct o_custkey from orders where o_totalprice > 450000) large"
    tree = root(
        scalar("id", "c_custkey"), scalar("name", "c_name"),
        filter=f"exists (select 1 from {large} where large.o_custkey = c_custkey)",
    )
    return tree_export(with_views(t, "orders"), "customer", tree, keys=["c_custkey"]).json_lines()


def preview_first_n(t: Resolve) -> DataFrame:
    tree = root(
        scalar("key", "o_orderkey"),
        obj("customer", "customer", "c_custkey", "o_custkey", scalar("name", "c_name")),
        array("lines", "lineitem", "l_orderkey", "o_orderkey", scalar("line", "l_linenumber"), scalar("part", "l_partkey"),
              order_by=("l_linenumber", "l_partkey")),
        order_by=("o_orderkey",),
    )
    return tree_export(t, "orders", tree, keys=["o_orderkey"], limit=50).json_lines()


def nested_native_types(t: Resolve) -> DataFrame:
    mapping = FlatMapping(
        "orders", (Field("o_orderkey", "key"), Field("o_orderdate", "ordered")),
        nested_groups=(
            obj("customer", "customer", "c_custkey", "o_custkey", scalar("id", "c_custkey", FieldMapping(data_type="native")),
                scalar("name", "c_name", FieldMapping(data_type="native"))),
        ),
    )
    return nested_export(t, mapping, keys=["o_orderkey"]).json_lines()


def strip_denied_nested(t: Resolve) -> DataFrame:
    tree = root(
        scalar("id", "s_suppkey"), scalar("contact_NAME", "s_name"),
        obj("nation", "nation", "n_nationkey", "s_nationkey", scalar("name", "n_name"), scalar("contact_email", "n_name")),
        array("technician_id", "customer", "c_nationkey", "s_nationkey", scalar("id", "c_custkey")),
    )
    return tree_export(t, "supplier", tree, keys=["s_suppkey"]).json_lines()


def _talks(t: Resolve) -> DataFrame:
    """Conversations as nested records: turns with structs and maps, and the same once more as a VARIANT."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.length(F.coalesce("text", F.lit(""))).alias("size"))
    talks = t("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def nested(one):
        said = F.struct(one["size"].alias("Contact_Name"), one["role"].alias("role"))
        return F.struct(said.alias("said"), F.create_map(one["role"], one["size"]).alias("sizes"), one["turn"].alias("turn"))

    turns = F.transform("turns", nested)
    return talks.select("conv_id", turns.alias("turns"), F.parse_json(F.to_json(turns)).alias("document"))


def strip_denied_any(t: Resolve) -> DataFrame:
    found = strip_any(_talks(t), ["CONTACT_NAME", "assistant"])
    return found.select("conv_id", F.to_json("turns").alias("turns"), F.to_json("document").alias("document"))


def flattened_talks(t: Resolve) -> DataFrame:
    return flatten_any(_talks(t), ["conv_id"])


def package_flattened(t: Resolve) -> DataFrame:
    """A JSON package as the sink writes it, read back and flattened without its definition."""
    spark = t("customer").sparkSession
    folder = f"{shared_folder(spark)}/packages-{uuid.uuid4().hex}"
    tree = root(
        scalar("id", "c_custkey"), obj("nation", "nation", "n_nationkey", "c_nationkey", scalar("name", "n_name")),
        array("orders", "urgent_orders", "o_custkey", "c_custkey", scalar("key", "o_orderkey"), order_by=("o_orderkey",)),
    )
    write_package(tree_export(_urgent_orders(t), "customer", tree, keys=["c_custkey"]), folder, "json", 1, EXTRACTED_AT)
    records = package_records(spark, f"{folder}/{package_name(1, EXTRACTED_AT, 'json')}")
    found = flatten_any(records)
    return found.toDF(*[name.removeprefix("record.") for name in found.columns])


def lateral_first_match(t: Resolve) -> DataFrame:
    first = first_match(t("supplier"), "s_nationkey", "s_suppkey", ["s_suppkey", "s_name"])
    nations = t("nation")
    return nations.join(first, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(
        "n_nationkey", "n_name", "s_suppkey", "s_name"
    )


# --- field mappings -----------------------------------------------------------------------------


def _mapped(t: Resolve, table: str, key: str, column: str, mapping: FieldMapping) -> DataFrame:
    tree = root(scalar("id", key), scalar("value", column, mapping))
    return tree_export(t, table, tree).flat_rows()


def map_upper(t: Resolve) -> DataFrame:
    return _mapped(t, "part", "p_partkey", "p_name", FieldMapping(transform="uppercase"))


def map_lower(t: Resolve) -> DataFrame:
    return _mapped(t, "part", "p_partkey", "p_brand", FieldMapping(transform="lowercase"))


def map_trim(t: Resolve) -> DataFrame:
    padded = derived(t, padded=lambda: t("part").select(
        "p_partkey", F.concat(F.lit(" \t "), "p_name", F.lit(" \n")).alias("p_name")
    ))
    return _mapped(padded, "padded", "p_partkey", "p_name", FieldMapping(transform="trim"))


def map_constant(t: Resolve) -> DataFrame:
    return _mapped(_sparse_orders(t), "sparse_orders", "o_orderkey", "priority", FieldMapping(None, "constant", "EU"))


def map_default(t: Resolve) -> DataFrame:
    mapping = FieldMapping(default_value="unknown", transform="uppercase")
    return _mapped(_sparse_orders(t), "sparse_orders", "o_orderkey", "priority", mapping)


def map_date_format(t: Resolve) -> DataFrame:
    texts = derived(t, dated=lambda: t("orders").select(
        "o_orderkey",
        F.expr("case when o_orderkey % 10 = 3 then 'no date' when o_orderkey % 10 = 4 then null "
               "else date_format(o_orderdate, 'yyyy-MM-dd') end").alias("text"),
    ))
    return _mapped(texts, "dated", "o_orderkey", "text", FieldMapping(transform="dateFormat", transform_arg="MM/dd/yyyy"))


def _typed(t: Resolve, expression: str, kind: str) -> DataFrame:
    texts = derived(t, typed=lambda: t("part").select("p_partkey", F.expr(expression).alias("text")))
    tree = root(scalar("id", "p_partkey"), scalar("value", "text", FieldMapping(data_type=kind)))
    return tree_export(texts, "typed", tree, keys=["p_partkey"]).json_lines()


def map_number(t: Resolve) -> DataFrame:
    return _typed(t, """case p_partkey % 6 when 0 then concat(' ', p_size, ' ') when 1 then concat('1,', 100 + p_size, '.50')
        when 2 then concat(p_size, '-') when 3 then concat(p_size, 'e3') when 4 then p_brand else cast(null as string) end""",
        "number")


def map_number_long(t: Resolve) -> DataFrame:
    return _typed(t, """case p_partkey % 4 when 0 then concat(repeat('1234567890', 2), '12345678', p_size % 10)
        when 1 then concat('0.', repeat('3', 30), p_size) when 2 then concat('9', repeat('0', 27), p_size % 10)
        else concat('-', p_size, '.', repeat('6', 40)) end""", "number")


def map_boolean(t: Resolve) -> DataFrame:
    return _typed(t, """case p_partkey % 5 when 0 then ' TRUE ' when 1 then 'false' when 2 then 't' when 3 then '1'
        else cast(null as string) end""", "boolean")


def map_in_array(t: Resolve) -> DataFrame:
    tree = root(
        scalar("id", "c_custkey"),
        array("orders", "orders", "o_custkey", "c_custkey",
              scalar("status", "o_orderstatus", FieldMapping(transform="lowercase")),
              scalar("key", "o_orderkey", FieldMapping(data_type="number")), order_by=("o_orderkey",)),
    )
    return tree_export(t, "customer", tree, keys=["c_custkey"]).json_lines()


# --- lines, documents, cells, packages ----------------------------------------------------------


def csv_lines_conversations(t: Resolve) -> DataFrame:
    tree = root(scalar("conversation", "conv_id"), scalar("role"), scalar("text"))
    return csv_lines(tree_export(t, "conversations", tree, keys=["conv_id", "turn"]))


def csv_lines_same_names(t: Resolve) -> DataFrame:
    """Columns that repeat a name or differ in case only, beside a key column of that name."""
    orders = Relation("urgent_orders", "o_custkey", "c_custkey", (Field("o_orderkey", "c_custkey"),), delimiter="; ", order_by=("o_orderkey",))
    mapping = FlatMapping("customer", (Field("c_custkey", "c_custkey"), Field("c_name", "C_CustKey")), (orders,))
    return csv_lines(flat_export(_urgent_orders(t), mapping, keys=["c_custkey"]))


def _customers() -> object:
    return root(scalar("id", "c_custkey"), scalar("name", "c_name"))


def json_envelope(t: Resolve) -> DataFrame:
    return document_lines(tree_export(t, "customer", _customers(), keys=["c_custkey"]), None, EXTRACTED_AT).drop("record")


def json_envelope_custom(t: Resolve) -> DataFrame:
    envelope = Envelope(
        "export", "customers", "about", (MetadataField("owner", "sales"), MetadataField("at", is_timestamp=True))
    )
    return document_lines(tree_export(t, "customer", _customers(), keys=["c_custkey"]), envelope, EXTRACTED_AT).drop("record")


def order_cells(t: Resolve) -> DataFrame:
    mapping = FlatMapping("orders", (Field("o_orderdate", "ordered"), Field("o_orderstatus", "status"), Field("o_custkey", "customer")))
    export = flat_export(t, mapping, keys=["o_orderkey"])
    return typed_cells(export.flat_rows(), ["o_orderkey"], export.column_names(), "part")


def row_checksums(t: Resolve) -> DataFrame:
    whole = F.concat_ws("|", F.col("p_partkey").cast("string"), "p_name", "p_brand", "p_type", F.col("p_size").cast("string"))
    full = F.sha2(whole, 256)
    return t("part").select("p_partkey", full.alias("sha256"), F.substring(full, 1, 12).alias("sha256_short"))


def manifest_counts(t: Resolve) -> DataFrame:
    return t("orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("record_count"), F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date")
    )


def package_manifests(t: Resolve) -> DataFrame:
    """Packages of the customers with their orders as the sink writes, counts and verifies them."""
    spark = t("customer").sparkSession
    folder, found = f"{shared_folder(spark)}/packages-{uuid.uuid4().hex}", []
    for number, fmt in enumerate(("json", "csv", "xlsx"), 1):
        manifest = write_package(flat_export(_urgent_orders(t), _customer_orders("string_join")), folder, fmt, number, EXTRACTED_AT)
        name = package_name(number, EXTRACTED_AT, format_of(fmt).extension)
        found.append((fmt, manifest["RecordCount"], verify_package(spark, folder, name).count()))
    return spark.createDataFrame(found, "format string, record_count long, problems long")


def package_file_names(t: Resolve) -> DataFrame:
    name = package_file_name(F.col("o_orderkey"), F.col("o_orderdate"), "json")
    return t("orders").select("o_orderkey", name.alias("file_name"), F.replace(name, F.lit(".json"), F.lit(".manifest.json")).alias("manifest_name"))


# --- catalog ------------------------------------------------------------------------------------

PRIMARY_KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
    "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id",
    "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": "conv_id",
}
FOREIGN_KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"),
]


def catalog_columns(t: Resolve) -> DataFrame:
    return observed_catalog(t, list(PRIMARY_KEYS), PRIMARY_KEYS, FOREIGN_KEYS)


def suggested_joins(t: Resolve) -> DataFrame:
    return suggest_joins(schema_catalog(t, list(PRIMARY_KEYS), PRIMARY_KEYS, FOREIGN_KEYS), "nation", [("supplier", "s_nationkey", "n_nationkey")])


# --- ledger -------------------------------------------------------------------------------------


def _runs(t: Resolve) -> DataFrame:
    """A ledger with one run per order; failed runs of low priority left no row."""
    number = F.col("o_orderkey")
    status = F.expr("case o_orderstatus when 'F' then 'Failed' when 'O' then 'Released' else 'Pending' end")
    extracted = F.expr("case when o_orderkey % 50 = 9 then 'unknown' else date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") end")
    text = F.lit(None).cast("string")
    return t("orders").where("not (o_orderstatus = 'F' and o_orderpriority = '5-LOW')").select(
        number.cast("int").alias("id"), number.cast("int").alias("sequence_no"), extracted.alias("extracted_at"),
        F.col("o_custkey").cast("int").alias("record_count"), F.sha2(number.cast("string"), 256).alias("sha256"),
        status.alias("status"), text.alias("released_at"), text.alias("operated_by"), text.alias("approved_by"),
        F.concat(F.lit("run "), number.cast("string")).alias("data_file_name"),
        F.expr("case when o_orderkey % 4 = 0 and o_orderstatus = 'O' then 'done' end").alias("delivered_at"),
        text.alias("delivered_by"), F.lit(None).cast("int").alias("imported_record_count"), text.alias("delivery_notes"),
    )


def ledger_runs(t: Resolve) -> DataFrame:
    return ledger.newest_first(ledger.run_list(_runs(t), NOW))


def ledger_next_seq(t: Resolve) -> DataFrame:
    return ledger.next_sequence(_runs(t))


def ledger_gap_warning(t: Resolve) -> DataFrame:
    return ledger.gap_warnings(_runs(t))


def ledger_expired(t: Resolve) -> DataFrame:
    return ledger.expired(_runs(t), NOW, 365).select("sequence_no", "status", "extracted_at")


def ledger_retained(t: Resolve) -> DataFrame:
    return ledger.retained(_runs(t), NOW, 365).select("sequence_no", "status", "extracted_at")


def sequence_gaps(t: Resolve) -> DataFrame:
    return ledger.sequence_gaps(_runs(t))


def _requests(t: Resolve) -> DataFrame:
    return t("events").select(
        F.col("event_id").alias("request_no"), F.expr("cast(event_id * 3 % 17000 as int)").alias("sequence_no"),
        F.expr("case event_id % 3 when 0 then 'release' when 1 then 'deliver' else 'skip' end").alias("action"),
        F.expr("concat('u', user_id)").alias("actor"),
        F.expr("case when event_id % 11 = 0 then ' ' when event_id % 7 = 0 then concat('U', user_id) "
               "else concat('u', user_id + 1) end").alias("approver"),
        F.expr("cast(event_id % 100 as int)").alias("imported_record_count"), F.col("props").alias("notes"),
    )


def _users(t: Resolve) -> DataFrame:
    return t("events").where("value > 200").select(F.expr("concat('u', user_id)").alias("username")).distinct()


def ledger_release_check(t: Resolve) -> DataFrame:
    checked = ledger.check_requests(_runs(t), _requests(t), _users(t))
    return checked.select("request_no", "sequence_no", "action", "accepted", "reason")


def ledger_after_requests(t: Resolve) -> DataFrame:
    checked = ledger.check_requests(_runs(t), _requests(t), _users(t))
    after = ledger.apply_requests(_runs(t), checked, EXTRACTED_AT)
    return after.select("sequence_no", "status", "operated_by", "approved_by", "delivered_by", "imported_record_count")


def _turns(t: Resolve) -> DataFrame:
    """The requests dealt to few runs, so that many meet at each."""
    return _requests(t).withColumn("sequence_no", F.expr("cast(request_no % 211 * 7 as int)"))


def ledger_request_chain(t: Resolve) -> DataFrame:
    judged = ledger.judge_in_turn(_runs(t), _turns(t), _users(t))
    return judged.select("request_no", "sequence_no", "action", "accepted", "reason")


def ledger_after_chain(t: Resolve) -> DataFrame:
    after = ledger.apply_requests(_runs(t), ledger.judge_in_turn(_runs(t), _turns(t), _users(t)), EXTRACTED_AT)
    return after.select("sequence_no", "status", "operated_by", "approved_by", "delivered_by", "imported_record_count")


def audit_latest(t: Resolve) -> DataFrame:
    audit = t("events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"),
        F.col("event_type").alias("action"), F.col("props").alias("detail"),
    )
    return ledger.latest(audit, 100)


CATALOGUE: dict[str, Callable[[Resolve], DataFrame]] = {
    "project_rename": project_rename,
    "flat_export": flat_export_nations,
    "flat_iso_dates": flat_iso_dates,
    "flat_null_to_empty": flat_null_to_empty,
    "relation_string_join": relation_string_join,
    "relation_array_join": relation_array_join,
    "flat_json_records": flat_json_records,
    "strip_denied_flat": strip_denied_flat,
    "object_lookup": object_lookup,
    "array_embed": array_embed,
    "object_lookup_mixed_keys": object_lookup_mixed_keys,
    "array_embed_mixed_keys": array_embed_mixed_keys,
    "null_join_keys": null_join_keys,
    "tree_three_levels": tree_three_levels,
    "tree_three_levels_split": tree_three_levels_split,
    "tree_scalars_text": tree_scalars_text,
    "tree_root_filter": tree_root_filter,
    "tree_node_filter": tree_node_filter,
    "tree_disabled_pruned": tree_disabled_pruned,
    "tree_same_table_twice": tree_same_table_twice,
    "tree_flatten_columns": tree_flatten_columns,
    "tree_flatten_split": tree_flatten_split,
    "scope_exists_filter": scope_exists_filter,
    "preview_first_n": preview_first_n,
    "nested_native_types": nested_native_types,
    "strip_denied_nested": strip_denied_nested,
    "strip_denied_any": strip_denied_any,
    "flatten_any": flattened_talks,
    "package_flattened": package_flattened,
    "lateral_first_match": lateral_first_match,
    "map_upper": map_upper,
    "map_lower": map_lower,
    "map_trim": map_trim,
    "map_constant": map_constant,
    "map_default": map_default,
    "map_date_format": map_date_format,
    "map_number": map_number,
    "map_number_long": map_number_long,
    "map_boolean": map_boolean,
    "map_in_array": map_in_array,
    "csv_lines": csv_lines_conversations,
    "csv_lines_same_names": csv_lines_same_names,
    "json_envelope": json_envelope,
    "json_envelope_custom": json_envelope_custom,
    "typed_cells": order_cells,
    "row_checksums": row_checksums,
    "manifest_counts": manifest_counts,
    "package_manifests": package_manifests,
    "package_file_names": package_file_names,
    "catalog_columns": catalog_columns,
    "suggest_joins": suggested_joins,
    "ledger_runs": ledger_runs,
    "ledger_next_seq": ledger_next_seq,
    "ledger_gap_warning": ledger_gap_warning,
    "ledger_expired": ledger_expired,
    "ledger_retained": ledger_retained,
    "sequence_gaps": sequence_gaps,
    "ledger_release_check": ledger_release_check,
    "ledger_after_requests": ledger_after_requests,
    "ledger_request_chain": ledger_request_chain,
    "ledger_after_chain": ledger_after_chain,
    "audit_latest": audit_latest,
}


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    """Times are read and written in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return CATALOGUE[name](parquet_tables(spark, folder))
