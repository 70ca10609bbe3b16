"""The older, flat definition on the tree compiler, and the shape an export takes per format."""

from __future__ import annotations

from collections.abc import Iterable

from treeloom.definition import FlatMapping, Node, flat_tree, nested_tree, validate_flat, validate_tree
from treeloom.plans.tree import Resolve, TreeExport


def flat_export(
    resolve: Resolve, mapping: FlatMapping, *, order_by: Iterable[str] = (), denylist: Iterable[str] | None = None, **more
) -> TreeExport:
    """Text columns of one table with related columns joined to text; dates as ``yyyy-MM-dd``."""
    validate_flat(mapping, denylist)
    tree = flat_tree(mapping, order_by)
    return TreeExport(resolve, mapping.source_table, tree, denylist=denylist, dates=True, named_by_leaf=True, envelope=mapping.envelope, **more)


def nested_export(
    resolve: Resolve, mapping: FlatMapping, *, order_by: Iterable[str] = (), denylist: Iterable[str] | None = None, **more
) -> TreeExport:
    """The nested-JSON reading of a flat mapping."""
    validate_flat(mapping, denylist)
    return TreeExport(resolve, mapping.source_table, nested_tree(mapping, order_by), denylist=denylist, envelope=mapping.envelope, **more)


def tree_export(
    resolve: Resolve, root_table: str, node: Node, *, denylist: Iterable[str] | None = None, **more
) -> TreeExport:
    validate_tree(node, denylist)
    return TreeExport(resolve, root_table, node, denylist=denylist, **more)


def mapping_export(resolve: Resolve, mapping: FlatMapping, fmt: str, **more) -> TreeExport:
    """Nested for JSON with nested groups or an envelope, flat otherwise."""
    build = nested_export if mapping.wants_nesting(fmt) else flat_export
    return build(resolve, mapping, **more)
