import json

import pytest
from pyspark.sql import functions as F

from brute import flat, joined, record
from treeloom.definition import DeniedFieldError, DefinitionError, FieldMapping, array, obj, root, scalar
from treeloom.plans.flat import tree_export
from treeloom.plans.tree import TreeExport, leaf_paths

ADDRESSES = array(
    "addresses", "address", "maker_id", "id", scalar("city"), scalar("zip"),
    array("phones", "phone", "address_id", "id", scalar("number"), order_by=("rank",)), order_by=("no",),
)
CITY = obj(
    "city", "city", "id", "city_id", scalar("name"),
    array("streets", "street", "city_id", "id", scalar("name"), order_by=("pos",)),
)
TREES = {
    "array": root(scalar("id"), array("addresses", "address", "maker_id", "id", scalar("city"), order_by=("no",)), scalar("name")),
    "nested arrays": root(scalar("id"), ADDRESSES, scalar("mail")),
    "object with array": root(scalar("id"), CITY, scalar("name")),
    "two arrays": root(array("first", "address", "maker_id", "id", scalar("city"), scalar("zip"), order_by=("no",)), ADDRESSES, CITY),
    "siblings": root(
        scalar("id"),
        array("low", "address", "maker_id", "id", scalar("city"), order_by=("no",)),
        array("same", "address", "maker_id", "id", scalar("zip"), scalar("town", "city"), order_by=("no",)),
    ),
    "object under array": root(
        scalar("id"),
        array("addresses", "address", "maker_id", "id", scalar("city"),
              obj("maker", "maker", "id", "maker_id", scalar("name"), CITY), order_by=("no",)),
    ),
}


@pytest.mark.parametrize("limits", [{}, {"heavy_rows": 0}, {"record_bytes": 220, "heavy_rows": 0}, {"record_bytes": 1}])
@pytest.mark.parametrize("name", TREES)
def test_records_equal_plain_loops(shop, name, limits, monkeypatch):
    resolve, tables = shop
    if "heavy_rows" in limits:  # salted joins only
        monkeypatch.setattr("treeloom.plans.tree.BROADCAST_BYTES", -1)
    tree = TREES[name]
    got = joined(TreeExport(resolve, "maker", tree, keys=["name"], **limits).json_lines(), "name", "json")
    want = {row["name"]: record(tree, row, tables) for row in tables["maker"]}
    assert {k: json.loads(v) for k, v in got.items()} == want
    assert all(list(json.loads(v)) == list(want[k]) for k, v in got.items())


@pytest.mark.parametrize("limits", [{}, {"record_bytes": 1, "heavy_rows": 0}])
@pytest.mark.parametrize("name", TREES)
def test_flat_rows_equal_plain_loops(shop, name, limits, monkeypatch):
    resolve, tables = shop
    if "heavy_rows" in limits:
        monkeypatch.setattr("treeloom.plans.tree.BROADCAST_BYTES", -1)
    tree = TREES[name]
    export = TreeExport(resolve, "maker", tree, keys=["city_id"], **limits)
    rows = sorted((tuple(r) for r in export.flat_rows().collect()), key=lambda r: r[1])
    got: dict = {}
    for key, _, *cells in rows:
        before = got.setdefault(key, [""] * len(cells))
        got[key] = [b + c for b, c in zip(before, cells)]
    want = {row["city_id"]: list(flat(tree, row, tables, leaf_paths(tree)).values()) for row in tables["maker"]}
    assert got == want


def test_split_records_come_in_rows_not_groups(shop):
    resolve, _ = shop
    export = TreeExport(resolve, "maker", TREES["nested arrays"], keys=["id"], record_bytes=1)
    lines = export.json_lines()
    assert lines.where("id = 'm1'").count() > 8
    assert lines.where("part = 0").count() == 0
    assert lines.agg(F.countDistinct("part") == F.count("part")).first()[0]


def test_only_oversize_records_are_split(shop):
    resolve, _ = shop
    lines = TreeExport(resolve, "maker", TREES["array"], keys=["id"], record_bytes=100).json_lines()
    parts = {r["name"]: r["n"] for r in lines.groupBy(F.coalesce("id", F.lit("none")).alias("name")).agg(F.count("*").alias("n")).collect()}
    assert parts["m1"] > 1 and parts["m2"] == 1 and parts["m3"] == 1 and parts["none"] == 1


@pytest.mark.parametrize("limits", [{}, {"record_bytes": 1}])
def test_object_with_two_rows_fails(shop, limits):
    resolve, _ = shop
    tree = root(scalar("id"), obj("note", "twice", "id", "id", scalar("note")))
    with pytest.raises(Exception, match="more than one row of twice"):
        TreeExport(resolve, "maker", tree, **limits).json_lines().collect()


def test_duplicate_that_nobody_refers_to_is_no_error(shop):
    resolve, _ = shop
    tree = root(scalar("id"), obj("note", "twice", "id", "id", scalar("note")), filter="id = 'm3'")
    assert TreeExport(resolve, "maker", tree).json_lines().first()["json"] == '{"id":"m3","note":{"note":"z"}}'


def test_root_and_node_filters(shop):
    resolve, _ = shop
    tree = root(scalar("id"), array("addresses", "address", "maker_id", "id", scalar("city"), filter="city = 'Austin'"), filter="name <> ''")
    got = joined(TreeExport(resolve, "maker", tree, keys=["id"]).json_lines(), "id", "json")
    assert set(got) == {"m1", "m2", None}
    assert json.loads(got["m1"])["addresses"] == [{"city": "Austin"}] * 2
    assert json.loads(got["m2"])["addresses"] == []


def test_filter_reaches_deeper_levels(shop):
    resolve, tables = shop
    tree = root(scalar("id"), ADDRESSES, filter="id = 'm1'")
    got = joined(TreeExport(resolve, "maker", tree, keys=["id"]).json_lines(), "id", "json")
    assert json.loads(got["m1"]) == record(tree, tables["maker"][0], tables)


def test_siblings_over_one_table_share_a_scan(shop):
    resolve, _ = shop
    def side(name, test):
        return array(name, "address", "maker_id", "id", scalar("city"), filter=test, order_by=("no",))
    tree = root(scalar("id"), side("low", "no < 2"), side("high", "no >= 2"))
    export = TreeExport(resolve, "maker", tree, keys=["id"])
    got = joined(export.json_lines(), "id", "json")
    assert json.loads(got["m1"]) == {"id": "m1", "low": [{"city": "Dallas"}], "high": [{"city": "Austin"}, {"city": None}, {"city": "Austin"}]}
    assert json.loads(got["m2"]) == {"id": "m2", "low": [], "high": []}
    flat_rows = {r["id"]: r for r in TreeExport(resolve, "maker", tree).flat_rows().collect()}
    assert (flat_rows["m1"]["low.city"], flat_rows["m1"]["high.city"]) == ("Dallas", "Austin, Austin")


def test_limit_keeps_children_of_the_first_rows(shop):
    resolve, tables = shop
    tree = root(scalar("id"), ADDRESSES, filter="id is not null", order_by=("id",))
    got = joined(TreeExport(resolve, "maker", tree, keys=["id"], limit=2).json_lines(), "id", "json")
    assert set(got) == {"m1", "m2"}
    assert json.loads(got["m1"]) == record(tree, tables["maker"][0], tables)


def test_limit_beyond_the_broadcast_size(shop, monkeypatch):
    resolve, tables = shop
    monkeypatch.setattr("treeloom.plans.tree.BROADCAST_ROWS", 1)
    tree = root(scalar("id"), ADDRESSES, filter="id is not null", order_by=("id",))
    got = joined(TreeExport(resolve, "maker", tree, keys=["id"], limit=3, heavy_rows=1).json_lines(), "id", "json")
    assert {k: json.loads(v) for k, v in got.items()} == {r["id"]: record(tree, r, tables) for r in tables["maker"] if r["id"]}


@pytest.mark.parametrize("text", ["json", "flat"])
def test_split_without_broadcasts(shop, monkeypatch, text):
    resolve, tables = shop
    monkeypatch.setattr("treeloom.plans.tree.BROADCAST_ROWS", 0)
    monkeypatch.setattr("treeloom.plans.tree.BROADCAST_BYTES", -1)
    tree = TREES["two arrays"]
    export = TreeExport(resolve, "maker", tree, keys=["name"], record_bytes=1, heavy_rows=1)
    if text == "json":
        got = {k: json.loads(v) for k, v in joined(export.json_lines(), "name", "json").items()}
        assert got == {r["name"]: record(tree, r, tables) for r in tables["maker"]}
        return
    rows = export.flat_rows()
    got = {}
    for row in rows.orderBy("part").collect():
        before = got.setdefault(row["name"], [""] * (len(row) - 2))
        got[row["name"]] = [b + c for b, c in zip(before, row[2:])]
    assert got == {r["name"]: list(flat(tree, r, tables, leaf_paths(tree)).values()) for r in tables["maker"]}


def test_many_oversize_keys_are_joined_out(shop, monkeypatch):
    resolve, tables = shop
    monkeypatch.setattr("treeloom.plans.tree.LISTED_KEYS", 0)
    tree = TREES["nested arrays"]
    got = joined(TreeExport(resolve, "maker", tree, keys=["name"], record_bytes=150, heavy_rows=1).json_lines(), "name", "json")
    assert {k: json.loads(v) for k, v in got.items()} == {r["name"]: record(tree, r, tables) for r in tables["maker"]}


def test_disabled_and_denied_nodes_are_absent(shop):
    resolve, _ = shop
    tree = root(
        scalar("id"), scalar("name", enabled=False), scalar("Contact_Email", "mail"),
        array("addresses", "address", "maker_id", "id", scalar("city"), scalar("operator_name", "zip"), order_by=("no",)),
        obj("technician_id", "city", "id", "city_id", scalar("name")),
    )
    row = joined(tree_export(resolve, "maker", tree, keys=["id"]).json_lines(), "id", "json")["m3"]
    assert json.loads(row) == {"id": "m3", "addresses": [{"city": "Rome\nSouth"}]}


def test_constant_does_not_revive_a_denied_key(shop):
    resolve, _ = shop
    tree = root(scalar("id"), scalar("contact_phone", "mail", FieldMapping("x", "constant", "y")))
    assert TreeExport(resolve, "maker", tree, keys=["id"]).json_lines().first()["json"] == '{"id":"m1"}'


def test_denied_source_is_refused_before_any_job(shop):
    resolve, _ = shop
    tree = root(scalar("id"), array("a", "address", "maker_id", "id", scalar("town", "city")))
    with pytest.raises(DeniedFieldError, match="a.town"):
        TreeExport(resolve, "maker", tree, denylist=["CITY"])


def test_nothing_enabled_gives_nothing(shop):
    resolve, _ = shop
    export = TreeExport(resolve, "maker", root(scalar("id", enabled=False)))
    assert export.json_lines().count() == 0 and export.flat_rows().count() == 0


def test_key_types_must_match(shop):
    resolve, _ = shop
    with pytest.raises(DefinitionError, match="different types"):
        TreeExport(resolve, "maker", root(obj("city", "city", "id", "id", scalar("name"))))
    with pytest.raises(DefinitionError, match="no column 'nope'"):
        TreeExport(resolve, "maker", root(scalar("nope")))


def test_keys_keep_their_spelling(shop):
    resolve, _ = shop
    tree = root(scalar("item's id", "id"), scalar('a.b "c"', "name"))
    row = TreeExport(resolve, "maker", tree, keys=["id"]).json_lines().where("id = 'm2'").first()
    assert json.loads(row["json"]) == {"item's id": "m2", 'a.b "c"': 'Sü"d\\'}


def test_mapped_values_inside_split_records(shop):
    resolve, _ = shop
    tree = root(array("a", "address", "maker_id", "id", scalar("c", "city", FieldMapping("none", "uppercase")),
                      scalar("z", "zip", FieldMapping(data_type="number")), order_by=("no",)))
    want = joined(TreeExport(resolve, "maker", tree, keys=["id"]).json_lines(), "id", "json")
    got = joined(TreeExport(resolve, "maker", tree, keys=["id"], record_bytes=1).json_lines(), "id", "json")
    assert got == want
    assert got["m3"] == '{"a":[{"c":"ROME\\nSOUTH","z":7.50}]}'


def test_joined_sides_are_broadcast_by_measured_size(shop, monkeypatch):
    resolve, _ = shop
    tree = TREES["object with array"]

    def plan():
        df = TreeExport(resolve, "maker", tree).json_lines()
        return df._jdf.queryExecution().executedPlan().toString()

    assert "SortMergeJoin" not in plan()
    monkeypatch.setattr("treeloom.plans.tree.BROADCAST_BYTES", -1)
    assert "BroadcastHashJoin" not in plan()


def test_plans_read_only_what_they_use(spark):
    from treeloom import queries
    df = queries.run("array_embed", spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "PushedFilters: [IsNotNull(o_orderpriority)" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan


def test_mixed_key_types_join_exactly_when_salted(spark):
    from decimal import Decimal

    kinds = {
        "double": [float(n % 7) for n in range(60)] + [-0.0, float("nan"), None], "decimal(12,3)": [Decimal(n % 7) for n in range(60)] + [Decimal("2.500"), None],
        "float": [float(n % 7) for n in range(60)], "bigint": [n % 7 for n in range(60)],
    }
    child = {"int": [(n, f"c{n}") for n in range(7)], "decimal(10,1)": [(Decimal(n), f"c{n}") for n in range(7)], "double": [(float(n), f"c{n}") for n in range(7)]}
    tree = root(scalar("n"), obj("one", "child", "k", "key", scalar("v")), array("many", "child", "k", "key", scalar("v")))
    for kind, keys in kinds.items():
        parents = spark.createDataFrame(list(enumerate(keys)), f"n int, key {kind}")
        for other, rows in child.items():
            tables = {"parent": parents, "child": spark.createDataFrame(rows, f"k {other}, v string")}
            lines = TreeExport(tables.__getitem__, "parent", tree, keys=["n"], heavy_rows=1, broadcast_bytes=-1).json_lines().collect()
            for row in lines:
                key = keys[row["n"]]
                found = None if key is None or key != key or key != int(key) else f"c{int(key)}"
                want = {"n": str(row["n"]), "one": {"v": found} if found else None, "many": [{"v": found}] if found else []}
                assert json.loads(row["json"]) == want


def test_large_lookups_are_cut_to_filtered_parents(shop):
    resolve, _ = shop
    tree = root(scalar("id"), obj("home", "city", "id", "city_id", scalar("name")), filter="name = 'Nord'")
    export = TreeExport(resolve, "maker", tree, broadcast_bytes=-1)
    df = export.json_lines()
    assert "LeftSemi" in df._jdf.queryExecution().executedPlan().toString()
    assert [json.loads(r["json"]) for r in df.collect()] == [{"id": "m1", "home": {"name": "Hub"}}]
