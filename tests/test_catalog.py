from treeloom.sources.catalog import declared_catalog, information_schema, suggest_joins


def views(spark):
    columns = [
        ("public", "maker", 1, "id", "uuid", "NO"), ("public", "maker", 2, "mail", "varchar", "YES"), ("public", "address", 1, "id", "uuid", "NO"),
        ("public", "address", 2, "maker_id", "uuid", "YES"), ("other", "hidden", 1, "id", "uuid", "NO"),
    ]
    constraints = [
        ("public", "pk_m", "maker", "PRIMARY KEY"), ("public", "pk_a", "address", "PRIMARY KEY"), ("public", "fk_a", "address", "FOREIGN KEY"),
        ("public", "u_m", "maker", "UNIQUE"), ("other", "pk_h", "hidden", "PRIMARY KEY"),
    ]
    used = [("public", "pk_m", "maker", "id"), ("public", "pk_a", "address", "id"), ("public", "fk_a", "address", "maker_id"), ("public", "u_m", "maker", "mail")]
    referenced = [("pk_m", "maker", "id"), ("pk_a", "address", "id"), ("fk_a", "maker", "id"), ("u_m", "maker", "mail")]
    return {
        "columns": spark.createDataFrame(columns, "table_schema string, table_name string, ordinal_position int, column_name string, data_type string, is_nullable string"),
        "table_constraints": spark.createDataFrame(constraints, "table_schema string, constraint_name string, table_name string, constraint_type string"),
        "key_column_usage": spark.createDataFrame(used, "table_schema string, constraint_name string, table_name string, column_name string"),
        "constraint_column_usage": spark.createDataFrame(referenced, "constraint_name string, table_name string, column_name string"),
    }


def test_catalog_from_declared_constraints(spark):
    found = views(spark)
    rows = declared_catalog(*found.values()).collect()
    got = {(r["table_name"], r["column_name"]): (r["ordinal"], r["nullable"], r["primary_key"], r["fk_table"], r["fk_column"]) for r in rows}
    assert got == {
        ("maker", "id"): (1, False, True, None, None), ("maker", "mail"): (2, True, False, None, None),
        ("address", "id"): (1, False, True, None, None), ("address", "maker_id"): (2, True, False, "maker", "id"),
    }


def test_suggestions_from_a_resolver(spark):
    found = views(spark)
    resolve = lambda name: found[name.removeprefix("information_schema.")]
    assert [tuple(r) for r in suggest_joins(information_schema(resolve), "maker").collect()] == [("address", "maker_id", "id")]
