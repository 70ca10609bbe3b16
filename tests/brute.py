"""The meaning of a tree, written as plain loops for small fixtures."""

from __future__ import annotations


def record(node, row, tables):
    out = {}
    for child in node.children:
        if not child.enabled:
            continue
        if child.kind == "scalar-field":
            value = row[child.source_field]
            out[child.target_key] = value if value is None else str(value)
            continue
        found = [
            r for r in tables[child.related_table]
            if row[child.source_join_key] is not None and r[child.join_key] == row[child.source_join_key]
        ]
        found.sort(key=lambda r: [r[name] for name in child.order_by])
        inner = [record(child, r, tables) for r in found]
        out[child.target_key] = inner if child.kind == "array" else (inner[0] if inner else None)
    return out


def values_at(value, path):
    if value is None:
        return []
    if isinstance(value, list):
        return [v for item in value for v in values_at(item, path)]
    if not path:
        return [value]
    return values_at(value.get(path[0]), path[1:])


def flat(node, row, tables, paths):
    whole = record(node, row, tables)
    return {".".join(path): ", ".join(values_at(whole, path)) for path in paths}


def joined(df, key, text):
    """Records put together from their parts."""
    parts = {}
    for row in df.collect():
        parts.setdefault(row[key], []).append((row["part"], row[text]))
    return {k: "".join(t for _, t in sorted(v)) for k, v in parts.items()}
