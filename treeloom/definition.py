"""Export definitions: what to read, how to nest it, what must never leave.

Definitions arrive as JSON documents (``from_dict`` fills parts that older documents lack) and are
checked before any job starts (``validate_*``).
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace

MAX_DEPTH = 16

# Names of personal-data columns that are denied unless a caller passes its own list.
DEFAULT_DENYLIST = (
    "technician_name",
    "technician_id",
    "employee_id",
    "contact_name",
    "contact_email",
    "contact_phone",
    "operator_name",
)

# The accepted spellings in definition documents.
NODE_KINDS = ("root", "scalar-field", "object", "array")
TRANSFORMS = ("none", "uppercase", "lowercase", "trim", "dateFormat", "constant")
DATA_TYPES = ("string", "number", "boolean", "date")

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")

# Value type of the older nested groups: the source value keeps its own JSON type.
NATIVE = "native"


class DefinitionError(ValueError):
    """The definition cannot be run as written."""


class DeniedFieldError(DefinitionError):
    """The definition reads personal data."""


@dataclass(frozen=True)
class FieldMapping:
    default_value: str | None = None
    transform: str = "none"
    transform_arg: str | None = None
    data_type: str = "string"

    @classmethod
    def from_dict(cls, doc: dict) -> FieldMapping:
        get = _reader(doc)
        return cls(
            default_value=get("DefaultValue"),
            transform=_filled(get("Transform"), "none"),
            transform_arg=get("TransformArg"),
            data_type=_filled(get("DataType"), "string"),
        )


@dataclass(frozen=True)
class Node:
    """One node of an export tree. ``order_by`` and ``delimiter`` are ours: the order of array
    elements, and the text between them when the array is flattened into one cell."""

    target_key: str
    kind: str = "object"
    source_field: str | None = None
    related_table: str | None = None
    join_key: str | None = None
    source_join_key: str | None = None
    filter: str | None = None
    mapping: FieldMapping | None = None
    children: tuple[Node, ...] = ()
    enabled: bool = True
    order_by: tuple[str, ...] = ()
    delimiter: str = ", "

    @classmethod
    def from_dict(cls, doc: dict) -> Node:
        get = _reader(doc)
        mapping = get("Mapping")
        return cls(
            target_key=get("TargetKey") or "",
            kind=_filled(get("Kind"), "object"),
            source_field=get("SourceField"),
            related_table=get("RelatedTable"),
            join_key=get("JoinKey"),
            source_join_key=get("SourceJoinKey"),
            filter=get("Filter"),
            mapping=None if mapping is None else FieldMapping.from_dict(mapping),
            children=tuple(cls.from_dict(child) for child in get("Children") or ()),
            enabled=bool(get("Enabled")),
            order_by=tuple(get("OrderBy") or ()),
            delimiter=_default(get("Delimiter"), ", "),
        )

    @property
    def active(self) -> tuple[Node, ...]:
        return tuple(child for child in self.children if child.enabled)

    @property
    def scalars(self) -> tuple[Node, ...]:
        return tuple(child for child in self.active if child.kind == "scalar-field")

    @property
    def groups(self) -> tuple[Node, ...]:
        return tuple(child for child in self.active if child.kind != "scalar-field")


def root(*children: Node, filter: str | None = None, order_by: Iterable[str] = ()) -> Node:
    return Node("root", "root", filter=filter, children=children, order_by=tuple(order_by))


def scalar(target: str, source: str | None = None, mapping: FieldMapping | None = None, enabled: bool = True) -> Node:
    return Node(target, "scalar-field", source_field=source or target, mapping=mapping, enabled=enabled)


def obj(target: str, table: str, join_key: str, source_join_key: str, *children: Node, **more) -> Node:
    return Node(
        target, "object", related_table=table, join_key=join_key, source_join_key=source_join_key,
        children=children, **more,
    )


def array(target: str, table: str, join_key: str, source_join_key: str, *children: Node, **more) -> Node:
    return replace(obj(target, table, join_key, source_join_key, *children, **more), kind="array")


@dataclass(frozen=True)
class Field:
    source_name: str
    target_name: str
    enabled: bool = True


@dataclass(frozen=True)
class Relation:
    related_table: str
    join_key: str
    source_join_key: str
    fields: tuple[Field, ...] = ()
    enabled: bool = True
    flatten_strategy: str = "string_join"
    delimiter: str = ", "
    order_by: tuple[str, ...] = ()

    @classmethod
    def from_dict(cls, doc: dict) -> Relation:
        get = _reader(doc)
        return cls(
            related_table=get("RelatedTable"),
            join_key=get("JoinKey"),
            source_join_key=get("SourceJoinKey"),
            fields=tuple(
                Field(f("SourceField"), f("TargetField"), bool(f("Enabled")))
                for f in map(_reader, get("Fields") or ())
            ),
            enabled=bool(get("Enabled")),
            flatten_strategy=_default(get("FlattenStrategy"), "string_join"),
            delimiter=_default(get("Delimiter"), ", "),
            order_by=tuple(get("OrderBy") or ()),
        )

    @property
    def joiner(self) -> str:
        """Only ``string_join`` honours the delimiter; every other strategy joins with a comma."""
        return self.delimiter if self.flatten_strategy == "string_join" else ","


@dataclass(frozen=True)
class MetadataField:
    key: str
    value: str = ""
    is_timestamp: bool = False


@dataclass(frozen=True)
class Envelope:
    root_key: str | None = None
    items_key: str | None = None
    metadata_key: str | None = None
    metadata_fields: tuple[MetadataField, ...] = ()

    @classmethod
    def from_dict(cls, doc: dict) -> Envelope:
        get = _reader(doc)
        return cls(
            root_key=get("RootKey"),
            items_key=get("ItemsKey"),
            metadata_key=get("MetadataKey"),
            metadata_fields=tuple(
                MetadataField(m("Key"), m("Value") or "", bool(m("IsDynamicTimestamp")))
                for m in map(_reader, get("MetadataFields") or ())
            ),
        )


@dataclass(frozen=True)
class FlatMapping:
    """The older definition: renamed columns of one table plus related columns joined to text."""

    source_table: str
    fields: tuple[Field, ...] = ()
    relations: tuple[Relation, ...] = ()
    nested_groups: tuple[Node, ...] = ()
    envelope: Envelope | None = None

    @classmethod
    def from_dict(cls, doc: dict) -> FlatMapping:
        get = _reader(doc)
        wrapper = get("JsonWrapper")
        return cls(
            source_table=get("SourceTable") or "",
            fields=tuple(
                Field(f("SourceName"), f("TargetName"), bool(f("Enabled")))
                for f in map(_reader, get("Fields") or ())
            ),
            relations=tuple(Relation.from_dict(r) for r in get("Relations") or ()),
            nested_groups=tuple(_nested_group(g) for g in get("NestedGroups") or ()),
            envelope=None if wrapper is None else Envelope.from_dict(wrapper),
        )

    def column_names(self) -> list[str]:
        names = [f.target_name for f in self.fields if f.enabled]
        for relation in self.relations:
            if relation.enabled:
                names += [f.target_name for f in relation.fields if f.enabled]
        return names

    def wants_nesting(self, fmt: str) -> bool:
        return fmt == "json" and (bool(self.nested_groups) or self.envelope is not None)


def flat_tree(mapping: FlatMapping, order_by: Iterable[str] = ()) -> Node:
    """The flat mapping as a tree: one array per relation, flattened with the relation's joiner."""
    children = [scalar(f.target_name, f.source_name) for f in mapping.fields if f.enabled]
    for number, relation in enumerate(r for r in mapping.relations if r.enabled):
        children.append(
            Node(
                f"relation {number}", "array", related_table=relation.related_table,
                join_key=relation.join_key, source_join_key=relation.source_join_key,
                children=tuple(scalar(f.target_name, f.source_name) for f in relation.fields if f.enabled),
                order_by=relation.order_by, delimiter=relation.joiner,
            )
        )
    return Node("root", "root", children=tuple(children), order_by=tuple(order_by))


def nested_tree(mapping: FlatMapping, order_by: Iterable[str] = ()) -> Node:
    """The nested-JSON reading of a flat mapping: its fields and nested groups, in native types."""
    if any(r.enabled for r in mapping.relations):
        raise DefinitionError("relations have no place in nested JSON; express them as nested groups")
    native = FieldMapping(data_type=NATIVE)
    fields = tuple(scalar(f.target_name, f.source_name, native) for f in mapping.fields if f.enabled)
    return Node("root", "root", children=fields + mapping.nested_groups, order_by=tuple(order_by))


def _nested_group(doc: dict) -> Node:
    get = _reader(doc)
    fields = tuple(
        scalar(f("TargetKey"), f("SourceField"), FieldMapping(data_type=NATIVE), bool(f("Enabled")))
        for f in map(_reader, get("Fields") or ())
    )
    return Node(
        target_key=get("TargetKey") or "", kind=_filled(get("Kind"), "object"),
        related_table=get("RelatedTable"), join_key=get("JoinKey"), source_join_key=get("SourceJoinKey"),
        children=fields + tuple(_nested_group(g) for g in get("Children") or ()),
        enabled=bool(get("Enabled")),
    )


# --- checks -------------------------------------------------------------------------------------


def denied_names(override: Iterable[str] | None = None) -> frozenset[str]:
    names = list(override or ())
    if not names:
        return frozenset(DEFAULT_DENYLIST)
    if len(names) > 50 or any(not name.strip() for name in names):
        raise DefinitionError("a denylist has 1 to 50 names, none of them blank")
    return frozenset(name.lower() for name in names)


def denied_sources(node: Node, denylist: frozenset[str], path: str = "") -> list[str]:
    """Paths of enabled fields that read a denied column, at any depth."""
    found = []
    for child in node.active:
        here = f"{path}.{child.target_key}" if path else child.target_key
        if child.kind == "scalar-field":
            if (child.source_field or "").lower() in denylist:
                found.append(here)
        else:
            found += denied_sources(child, denylist, here)
    return found


def assert_no_denied(node: Node, denylist: Iterable[str] | None = None) -> None:
    found = denied_sources(node, denied_names(denylist))
    if found:
        raise DeniedFieldError("personal data must not be exported: " + ", ".join(found))


def validate_tree(node: Node, denylist: Iterable[str] | None = None) -> None:
    _check_children(node, "", 0)
    assert_no_denied(node, denylist)


def validate_flat(mapping: FlatMapping, denylist: Iterable[str] | None = None) -> None:
    if not mapping.source_table.strip():
        raise DefinitionError("a source table is required")
    unnamed = [f.source_name for f in mapping.fields if f.enabled and not (f.target_name or "").strip()]
    if unnamed:
        raise DefinitionError("enabled fields without a target name: " + ", ".join(unnamed))
    denied = denied_names(denylist)
    relations = [r for r in mapping.relations if r.enabled]
    read = [f.source_name for f in mapping.fields if f.enabled]
    read += [f.source_name for r in relations for f in r.fields if f.enabled]
    found = sorted({name for name in read if (name or "").lower() in denied})
    if found:
        raise DeniedFieldError("personal data must not be exported: " + ", ".join(found))
    for relation in relations:
        fields = [f for f in relation.fields if f.enabled]
        keys = (relation.related_table, relation.join_key, relation.source_join_key)
        if not fields or any(not (text or "").strip() for text in (*keys, *(f.target_name for f in fields))):
            raise DefinitionError(
                f"relation to {relation.related_table!r} needs a table, both keys and at least one named field"
            )
    names = [f.target_name for f in mapping.fields if f.enabled]
    _check_unique(names + [g.target_key for g in mapping.nested_groups if g.enabled], "the top level")
    for group in mapping.nested_groups:
        if group.enabled:
            _check_group(group, group.target_key, 1)
    assert_no_denied(Node("root", "root", children=mapping.nested_groups), denied)


def check_depth(node: Node, depth: int = 0, path: str = "") -> None:
    if depth > MAX_DEPTH:
        raise DefinitionError(f"{path!r} is nested deeper than {MAX_DEPTH} levels")
    for child in node.groups:
        check_depth(child, depth + 1, f"{path}.{child.target_key}" if path else child.target_key)


def _check_group(node: Node, path: str, depth: int) -> None:
    if depth > MAX_DEPTH:
        raise DefinitionError(f"{path!r} is nested deeper than {MAX_DEPTH} levels")
    parts = (node.related_table, node.join_key, node.source_join_key)
    if any(not (part or "").strip() for part in (*parts, node.target_key)):
        raise DefinitionError(f"{path!r} needs a table, both join keys and a target key")
    if node.kind not in ("object", "array"):
        raise DefinitionError(f"{path!r} must be an object or an array, not {node.kind!r}")
    for part in parts:
        if not IDENTIFIER.fullmatch(part):
            raise DefinitionError(f"{path!r}: {part!r} is not an identifier")
    if not node.active:
        raise DefinitionError(f"{path!r} has no enabled child")
    _check_children(node, path, depth)


def _check_children(node: Node, path: str, depth: int) -> None:
    _check_unique([child.target_key for child in node.active], path or "the top level")
    for child in node.active:
        here = f"{path}.{child.target_key}" if path else child.target_key
        if any(ord(c) < 32 or 127 <= ord(c) < 160 for c in child.target_key):
            raise DefinitionError(f"{here!r} contains control characters")
        if child.kind != "scalar-field":
            _check_group(child, here, depth + 1)
            continue
        if not (child.source_field or "").strip() or not child.target_key.strip():
            raise DefinitionError(f"a field of {path or 'the root'!r} lacks its source or target name")
        if not IDENTIFIER.fullmatch(child.source_field):
            raise DefinitionError(f"{here!r}: {child.source_field!r} is not an identifier")
        if child.mapping is not None:
            _check_mapping(child.mapping, here)


def _check_mapping(mapping: FieldMapping, path: str) -> None:
    if mapping.transform not in TRANSFORMS:
        raise DefinitionError(f"{path!r}: unknown transform {mapping.transform!r}")
    if mapping.data_type not in (*DATA_TYPES, NATIVE):
        raise DefinitionError(f"{path!r}: unknown data type {mapping.data_type!r}")


def _check_unique(keys: list[str], where: str) -> None:
    repeated = sorted({key for key in keys if keys.count(key) > 1})
    if repeated:
        raise DefinitionError(f"repeated export keys in {where}: " + ", ".join(repeated))


# --- documents ----------------------------------------------------------------------------------


def _reader(doc: dict):
    known = {key.replace("_", "").lower(): value for key, value in doc.items()}
    return lambda name: known.get(name.lower())


def _filled(value: str | None, default: str) -> str:
    return value if value is not None and value.strip() else default


def _default(value, default):
    return default if value is None else value
