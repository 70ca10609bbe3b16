import pytest

from treeloom.definition import (
    DEFAULT_DENYLIST, DeniedFieldError, DefinitionError, Envelope, Field, FieldMapping, FlatMapping, Node, Relation,
    array, denied_names, denied_sources, nested_tree, obj, root, scalar, validate_flat, validate_tree,
)
from treeloom.plans.tree import leaf_paths
from treeloom.sinks.package import FORMATS, format_of, manifest_name, package_name


def test_missing_parts_of_a_tree_are_filled():
    node = Node.from_dict({
        "TargetKey": "root", "Kind": "root", "Enabled": True,
        "Children": [
            {"TargetKey": "a", "Kind": None, "Enabled": True, "Children": None},
            {"TargetKey": "b", "Kind": "scalar-field", "SourceField": "b", "Enabled": True, "Mapping": {"DefaultValue": "x"}},
            {"TargetKey": "c", "Kind": "scalar-field", "SourceField": "c"},
        ],
    })
    first, second, third = node.children
    assert (first.kind, first.children) == ("object", ())
    assert second.mapping == FieldMapping("x", "none", None, "string")
    assert not third.enabled


def test_missing_parts_of_a_mapping_are_filled():
    mapping = FlatMapping.from_dict({
        "SourceTable": "item",
        "Fields": [{"SourceName": "id", "TargetName": "ID", "Enabled": True}],
        "Relations": [{"RelatedTable": "r", "JoinKey": "k", "SourceJoinKey": "id", "Enabled": True}],
        "NestedGroups": [{"TargetKey": "g", "RelatedTable": "t", "JoinKey": "id", "SourceJoinKey": "x", "Enabled": True}],
        "JsonWrapper": {"RootKey": "out"},
    })
    relation = mapping.relations[0]
    assert (relation.fields, relation.flatten_strategy, relation.delimiter) == ((), "string_join", ", ")
    assert mapping.nested_groups[0].kind == "object"
    assert mapping.envelope == Envelope("out", None, None, ())


def test_column_lists_follow_tree_order():
    tree = root(
        scalar("id"), obj("manufacturer", "m", "id", "m_id", scalar("name"), array("addresses", "a", "m", "id", scalar("city"))),
        scalar("off", enabled=False), array("addresses", "a", "m", "id", scalar("city")),
    )
    assert [".".join(p) for p in leaf_paths(tree)] == ["id", "manufacturer.name", "manufacturer.addresses.city", "addresses.city"]
    mapping = FlatMapping(
        "t", (Field("a", "A"), Field("b", "B", False)),
        (Relation("r", "k", "a", (Field("x", "X"), Field("y", "Y", False))), Relation("q", "k", "a", (Field("z", "Z"),), enabled=False)),
    )
    assert mapping.column_names() == ["A", "X"]


def test_denylist():
    assert denied_names() == frozenset(DEFAULT_DENYLIST)
    assert denied_names(["Salary"]) == {"salary"}
    for wrong in ([" "], ["a"] * 51):
        with pytest.raises(DefinitionError):
            denied_names(wrong)
    tree = root(scalar("id"), obj("m", "t", "id", "x", scalar("who", "CONTACT_NAME"), scalar("no", "contact_email", enabled=False)))
    assert denied_sources(tree, denied_names()) == ["m.who"]
    with pytest.raises(DeniedFieldError):
        validate_tree(tree)
    with pytest.raises(DeniedFieldError, match="technician_name"):
        validate_flat(FlatMapping("t", (Field("technician_name", "tech"),)))


def nested(depth):
    node = obj("leaf", "t", "id", "x", scalar("id"))
    for _ in range(depth - 1):
        node = obj("level", "t", "id", "x", node)
    return root(node)


def test_depth_is_capped():
    validate_tree(nested(16))
    with pytest.raises(DefinitionError, match="deeper"):
        validate_tree(nested(18))


@pytest.mark.parametrize("tree, message", [
    (root(scalar("a"), scalar("a", "b")), "repeated"),
    (root(obj("o", "t", "id", "x", scalar("a"), scalar("a", "b"))), "repeated"),
    (root(obj("o", "t", "id", "x")), "no enabled child"),
    (root(obj("o", "", "id", "x", scalar("a"))), "needs a table"),
    (root(obj("o", "t", "id; drop", "x", scalar("a"))), "not an identifier"),
    (root(obj("o", "t", "id", "x", scalar("a", "1a"))), "not an identifier"),
    (root(scalar("a\nb", "a")), "control"),
    (root(Node("o", "list", related_table="t", join_key="a", source_join_key="b", children=(scalar("a"),))), "object or an array"),
    (root(scalar("a", mapping=FieldMapping(transform="shout"))), "unknown transform"),
])
def test_wrong_trees_are_refused(tree, message):
    with pytest.raises(DefinitionError, match=message):
        validate_tree(tree)


def test_wrong_mappings_are_refused():
    for mapping, message in [
        (FlatMapping(" "), "source table"),
        (FlatMapping("t", (Field("a", " "),)), "without a target name"),
        (FlatMapping("t", (), (Relation("r", "k", "", (Field("x", "X"),)),)), "relation"),
        (FlatMapping("t", (), (Relation("r", "k", "a", (Field("x", "X", False),)),)), "relation"),
        (FlatMapping("t", (Field("a", "A"), Field("b", "A"))), "repeated"),
    ]:
        with pytest.raises(DefinitionError, match=message):
            validate_flat(mapping)


def test_relations_are_not_dropped_from_nested_json():
    mapping = FlatMapping("t", (Field("a", "A"),), (Relation("r", "k", "a", (Field("x", "X"),)),), (obj("o", "t", "id", "x", scalar("a")),))
    assert mapping.wants_nesting("json") and not mapping.wants_nesting("csv")
    with pytest.raises(DefinitionError):
        nested_tree(mapping)


def test_formats_and_names():
    from datetime import datetime, timezone

    assert format_of("CSV") is FORMATS["csv"] and format_of("unknown-format") is FORMATS["json"]
    at = datetime(2026, 6, 28, 6, tzinfo=timezone.utc)
    assert package_name(42, at, "xlsx") == "export_0042_20260628T060000Z.xlsx"
    assert manifest_name("export_0042_20260628T060000Z.xlsx") == "export_0042_20260628T060000Z.manifest.json"
