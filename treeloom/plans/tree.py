"""Export trees as Spark plans.

A tree is compiled bottom-up. An array node is one aggregation by its join key and one left join; an
object node is a left join to a table made unique by its key. Scalars of a row become one piece of
JSON text, so nested levels are joined as text and never rebuilt.

One parent may own a large share of a table. Its record cannot be one row, so every record over
``record_bytes`` leaves the aggregating plan and is produced as *pieces*: each row of each level
becomes a line of text with a sort position, nothing is grouped, and the pieces in ``part`` order
concatenate to exactly the record. Records within the budget are one row with ``part = 0``.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.definition import DefinitionError, DeniedFieldError, Envelope, Node, assert_no_denied, check_depth, denied_names
from treeloom.functions.mapping import field_value
from treeloom.functions.text import PLAIN_TYPES, export_text, json_key
from treeloom.operators.checkpoints import checkpointed
from treeloom.operators.skew import (
    HEAVY_ROWS,
    NOT_HEAVY,
    Heavy,
    heavy_from_sketch,
    heavy_sketch,
    measure_heavy,
    skew_join,
)

RECORD_BYTES = 16 << 20
# Key lists up to this length are written into the plan; longer ones are joined.
LISTED_KEYS = 1_000
# Tables may be broadcast up to this many bytes of text, keys and positions up to this many rows.
BROADCAST_ROWS = 10_000
BROADCAST_BYTES = 8 << 20

Resolve = Callable[[str], DataFrame]
SUBQUERY = re.compile(r"\bselect\b", re.IGNORECASE)


@dataclass
class _Planned:
    """A node of the pruned tree with the names its columns carry through the plan."""

    number: int
    node: Node
    table: str
    columns: dict[str, str] = field(default_factory=dict)
    types: dict[str, T.DataType] = field(default_factory=dict)
    groups: list[_Planned] = field(default_factory=list)
    parent: _Planned | None = None
    #: Columns made for joins whose keys differ in type: name of the new column -> (source column, common type).
    casts: dict[str, tuple[str, T.DataType]] = field(default_factory=dict)
    own_key: str | None = None
    key_above: str | None = None

    @property
    def row_id(self) -> str:
        return f"n{self.number}_row"

    @property
    def key(self) -> str:
        return self.own_key or self.columns[self.node.join_key]

    @property
    def parent_key(self) -> str:
        return self.key_above or self.parent.columns[self.node.source_join_key]

    @property
    def order(self) -> list[str]:
        return [self.columns[name] for name in self.node.order_by]

    def below(self) -> list[_Planned]:
        return [self] + [node for group in self.groups for node in group.below()]


@dataclass(frozen=True)
class _Slot:
    """Where the rows of an array belong in a template that is not aggregated."""

    child: _Planned
    path: tuple[str, ...] = ()


class TreeExport:
    """One export: ``json_lines()`` for nested records, ``flat_rows()`` for one column per leaf.

    ``keys`` are root columns to return beside each line, ``limit`` takes the first root rows by
    the root's ``order_by``. ``dates`` writes root dates as ``yyyy-MM-dd`` in flat rows.
    """

    def __init__(
        self,
        resolve: Resolve,
        root_table: str,
        node: Node,
        *,
        denylist: Iterable[str] | None = None,
        keys: Iterable[str] = (),
        limit: int | None = None,
        record_bytes: int = RECORD_BYTES,
        heavy_rows: int = HEAVY_ROWS,
        broadcast_bytes: int | None = None,
        dates: bool = False,
        named_by_leaf: bool = False,
        envelope: Envelope | None = None,
    ):
        check_depth(node)
        denied = denied_names(denylist)
        assert_no_denied(node, denied)
        self.resolve = functools.cache(resolve)
        self.keys = tuple(keys)
        hidden = sorted(key for key in self.keys if key.lower() in denied)
        if hidden:
            raise DeniedFieldError("personal data must not be exported: " + ", ".join(hidden))
        self.broadcast_bytes = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
        self.limit = limit
        self.record_bytes = record_bytes
        self.heavy_rows = heavy_rows
        self.dates = dates
        self.named_by_leaf = named_by_leaf
        self.envelope = envelope
        self._heavy: dict[int, Heavy] = {}
        self._heavy_children: dict[int, Heavy] = {}
        self._weights: dict[int, DataFrame] = {}
        self._row_ids = False
        self._divided: tuple[DataFrame, DataFrame | None] | None = None
        self._counter = 0
        self.split_records = 0
        self.root = self._plan(_pruned(node, denied), root_table, None)
        self._limited = self._take_roots() if limit is not None else None

    # --- results --------------------------------------------------------------------------------

    def json_lines(self) -> DataFrame:
        """``keys…, part, json``: one nested record per row, or its pieces in ``part`` order."""
        whole, pieces = self.json_parts()
        return whole if pieces is None else whole.unionByName(pieces.select(*[_quoted(name) for name in whole.columns]))

    def json_parts(self) -> tuple[DataFrame, DataFrame | None]:
        """Whole records, and the pieces of the oversize ones, with their ``__record``, if there are any."""
        if not self.root.node.active:
            return self._nothing("part", "json"), None
        roots, oversize = self._split()
        rows, items = self._assemble(self.root, roots, inline=True)
        whole = rows.select(*self._key_columns(), F.lit(0).cast("long").alias("part"), F.concat(*items).alias("json"))
        return whole, None if oversize is None else self._json_pieces(oversize)

    def flat_rows(self) -> DataFrame:
        """``keys…, part`` and one text column per leaf, named by its path. In the rows of a split
        record every cell is in fragments that concatenate in ``part`` order."""
        names = self.column_names()
        taken = {"part", *self.keys} & set(names)
        if taken:
            raise DefinitionError(f"flat columns and key columns share names: {sorted(taken)}")
        whole, pieces = self.flat_parts()
        rows = whole if pieces is None else whole.union(pieces.select(*whole.columns))
        return rows.toDF(*self.keys, "part", *names)

    def flat_parts(self) -> tuple[DataFrame, DataFrame | None]:
        """Whole flat rows, and the fragments of the oversize ones with their ``__record``. Cells are named by
        their place (see ``cell_name``), because targets may repeat."""
        names = [cell_name(number) for number in range(len(self.column_names()))]
        if not names:
            return self._nothing("part"), None
        roots, oversize = self._split()
        rows, outputs = self._assemble_flat(self.root, roots, inline=True)
        cells = [F.coalesce(column, F.lit("")).alias(name) for name, (_, column) in zip(names, outputs)]
        whole = rows.select(*self._key_columns(), F.lit(0).cast("long").alias("part"), *cells)
        return whole, None if oversize is None else self._flat_pieces(oversize, names)

    def column_names(self) -> list[str]:
        """Names of the flat columns: whole paths, or their last parts for flat mappings."""
        return [path[-1] if self.named_by_leaf else ".".join(path) for path in self.paths()]

    def paths(self) -> list[tuple[str, ...]]:
        return leaf_paths(self.root.node)

    def repeated_paths(self) -> set[tuple[str, ...]]:
        """Leaf paths that pass through an array."""
        return _repeated(self.root.node)

    # --- reading --------------------------------------------------------------------------------

    def _plan(self, node: Node, table: str, parent: _Planned | None) -> _Planned:
        planned = _Planned(self._counter, node, table, parent=parent)
        self._counter += 1
        schema = {f.name: f.dataType for f in self.resolve(table).schema.fields}
        wanted = [child.source_field for child in node.scalars]
        wanted += [child.source_join_key for child in node.groups] + list(node.order_by)
        wanted += [node.join_key] if parent is not None else list(self.keys)
        for name in dict.fromkeys(wanted):
            if name not in schema:
                raise DefinitionError(f"table {table!r} has no column {name!r}")
            planned.columns[name] = f"n{planned.number}_{len(planned.columns)}"
            planned.types[name] = schema[name]
        if parent is not None:
            _check_comparable(planned)
            self._align_keys(planned)
        planned.groups = [self._plan(child, child.related_table, planned) for child in node.groups]
        return planned

    def _align_keys(self, planned: _Planned) -> None:
        """Keys of different numeric types are compared in the type that SQL's ``=`` gives them, and fractions
        with one zero: sketches, salts and joins then agree on which values are equal."""
        mine, theirs = planned.types[planned.node.join_key], planned.parent.types[planned.node.source_join_key]
        if mine == theirs and not isinstance(mine, T.FractionalType):
            return
        common = mine
        if mine != theirs:
            none = self.resolve(planned.table).sparkSession.range(0)
            common = none.select(F.coalesce(*[F.lit(None).cast(kind) for kind in (mine, theirs)]).alias("key")).schema["key"].dataType
        planned.own_key, planned.key_above = f"n{planned.number}_key", f"n{planned.parent.number}_for{planned.number}"
        planned.casts[planned.own_key] = (planned.node.join_key, common)
        planned.parent.casts[planned.key_above] = (planned.node.source_join_key, common)

    def _read(self, planned: _Planned) -> DataFrame:
        if planned is self.root and self._limited is not None:
            return self._limited
        rows = self._read_table(planned)
        if self._limited is not None and planned.parent is not None:
            rows = self._reduced(planned, rows)
        return rows

    def _read_table(self, planned: _Planned) -> DataFrame:
        df = self.resolve(planned.table)
        if (planned.node.filter or "").strip():
            df = df.where(planned.node.filter)
        if planned.parent is not None:
            df = df.where(_quoted(planned.node.join_key).isNotNull())
        return self._renamed(df, planned)

    def _renamed(self, df: DataFrame, planned: _Planned, *more: Column) -> DataFrame:
        chosen = [_quoted(name).alias(alias) for name, alias in planned.columns.items()]
        chosen += [_common_key(_quoted(name), kind).alias(alias) for alias, (name, kind) in planned.casts.items()]
        if self._row_ids:
            chosen.append(F.monotonically_increasing_id().alias(planned.row_id))
        return df.select(*chosen, *more)

    def _take_roots(self) -> DataFrame:
        """The first rows, written once: without an order every reading could pick others."""
        self._row_ids = True
        rows = self._read_table(self.root)
        rows = rows.orderBy(*self.root.order) if self.root.order else rows
        return checkpointed(rows.limit(self.limit))

    def _reduced(self, planned: _Planned, rows: DataFrame) -> DataFrame:
        """Child rows of the parents that are exported, before any grouping."""
        above = planned.parent
        rows_above = self._read(above) if self._limited is not None or above is self.root else self._children(above)
        parents = rows_above.select(F.col(planned.parent_key).alias("__wanted")).distinct()
        heavy = NOT_HEAVY
        if self._limited is not None:
            if above is self.root and self.limit <= BROADCAST_ROWS:
                parents = F.broadcast(parents)
            else:
                # Groups are still whole here; otherwise oversize ones have been taken out before.
                heavy = self._heavy_child(planned, rows)
        return skew_join(rows, parents, planned.key, "__wanted", planned.row_id, "left_semi", heavy)

    # --- sizes ----------------------------------------------------------------------------------

    def _split(self) -> tuple[DataFrame, DataFrame | None]:
        """Root rows within the record budget, and those over it if there are any; measured once."""
        if self._divided is None:
            self._divided = self._divide()
        return self._divided

    def _divide(self) -> tuple[DataFrame, DataFrame | None]:
        if not self.root.groups:
            return self._read(self.root), None
        self._measure()
        if self._row_bound(self.root) <= self.record_bytes:
            return self._read(self.root), None
        self._row_ids = True
        oversize = checkpointed(self._weighed(self.root).where(F.col("__bytes") > self.record_bytes).drop("__bytes"))
        self.split_records = oversize.count()
        if self.split_records == 0:
            return self._read(self.root), None
        within = self._weighed(self.root).where(F.col("__bytes") <= self.record_bytes).drop("__bytes")
        return within, oversize

    def _measure(self) -> None:
        """How large a record can get, and which join keys are frequent enough to salt.

        One job over all nodes: per-key sums that combine map-side and read keys and text columns
        only. Frequent keys are sketched only for parents with enough rows to have any. All results
        are single rows.
        """
        nodes = self.root.below()
        checks = [
            rows.groupBy(members[0].key).agg(_facts(members)).agg(_largest(members))
            if members[0].node.kind == "array" else rows.agg(_facts(members))
            for members, rows in self._sets()
        ]
        found = functools.reduce(DataFrame.union, checks).collect()
        self._sizes = {fact["node"]: fact for row in found for fact in row["facts"]}
        sketches = [
            self._read(g.parent).agg(F.lit(g.number).alias("node"), heavy_sketch(F.col(g.parent_key)).alias("items"))
            for g in nodes
            if g.parent is not None and self._sizes[g.parent.number]["all"] > self.heavy_rows
            and not self._is_small_side(g)
        ]
        for row in functools.reduce(DataFrame.union, sketches).collect() if sketches else ():
            parent = next(g for g in nodes if g.number == row["node"]).parent
            rows = self._sizes[parent.number]["all"]
            self._heavy[row["node"]] = heavy_from_sketch(row["items"], rows, self.heavy_rows)
        self._row_ids = self._row_ids or any(heavy.values for heavy in self._heavy.values())

    def _sets(self) -> list[tuple[list[_Planned], DataFrame]]:
        """Nodes that are read together, with their rows before any reduction."""
        found, seen = [], set()
        for planned in self.root.below():
            if planned.number in seen:
                continue
            members = [planned] if planned is self.root else self._sharing(planned)
            seen |= {member.number for member in members}
            found.append((members, self._read(planned) if len(members) == 1 else self._read_together(members)))
        return found

    def _row_bound(self, planned: _Planned) -> int:
        own = self._sizes[planned.number]["most"] or 0
        return own + sum(self._group_bound(group) for group in planned.groups)

    def _group_bound(self, planned: _Planned) -> int:
        if planned.node.kind != "array":
            return self._row_bound(planned)
        group = self._sizes[planned.number]
        below = sum(self._group_bound(child) for child in planned.groups)
        return (group["bytes"] or 0) + (group["rows"] or 0) * below

    def _is_small_side(self, planned: _Planned) -> bool:
        """Whether all texts of a node, with what they embed, may be broadcast."""
        size = self._sizes[planned.number]
        below = sum(self._group_bound(child) for child in planned.groups)
        return (size["total"] or 0) + size["all"] * below <= self.broadcast_bytes

    def _weighed(self, planned: _Planned) -> DataFrame:
        """Rows with the exact size of everything they embed."""
        rows, total = self._read(planned), _row_bytes(planned)
        for group in planned.groups:
            weights = self._group_weights(group)
            rows = self._attach(rows, weights, group, weights.columns[0])
            total = total + F.coalesce(F.col(weights.columns[1]), F.lit(0))
        rows = rows.withColumn("__bytes", total)
        return rows.drop(*[f"w{group.number}" for group in planned.groups])

    def _group_weights(self, planned: _Planned) -> DataFrame:
        if planned.number not in self._weights:
            total = F.sum("__bytes") if planned.node.kind == "array" else F.max("__bytes")
            grouped = self._weighed(planned).groupBy(F.col(planned.key).alias(f"k{planned.number}"))
            self._weights[planned.number] = checkpointed(grouped.agg(total.alias(f"w{planned.number}")))
        return self._weights[planned.number]

    def _heavy_child(self, planned: _Planned, rows: DataFrame) -> Heavy:
        """Heavy values of a child's own join key, measured once."""
        if planned.number not in self._heavy_children:
            [heavy] = measure_heavy(rows, planned.key, heavy_rows=self.heavy_rows)
            self._heavy_children[planned.number] = heavy
        return self._heavy_children[planned.number]

    def _within_budget(self, planned: _Planned, rows: DataFrame) -> DataFrame:
        """Child rows without the groups that belong to oversize records."""
        if planned.number not in self._weights:
            return rows
        weights = self._weights[planned.number]
        over = weights.where(F.col(weights.columns[1]) > self.record_bytes).select(weights.columns[0])
        listed = [row[0] for row in over.take(LISTED_KEYS + 1)]
        if not listed:
            return rows
        if len(listed) <= LISTED_KEYS:
            return rows.where(~F.col(planned.key).isin(listed))
        heavy = self._heavy_child(planned, rows)
        return skew_join(rows, over, planned.key, over.columns[0], planned.row_id, "left_anti", heavy)

    # --- records within the budget --------------------------------------------------------------

    def _children(self, planned: _Planned) -> DataFrame:
        rows = self._read(planned)
        if planned.node.kind != "array":
            # A large lookup of few parents is cut to their keys before its content is shuffled.
            few = self._limited is None and _narrowed(planned) and not self._is_small_side(planned)
            return self._reduced(planned, rows) if few else rows
        rows = self._within_budget(planned, rows)
        return self._reduced(planned, rows) if self._limited is None and _narrowed(planned) else rows

    def _assemble(self, planned: _Planned, rows: DataFrame, inline: bool) -> tuple[DataFrame, list]:
        """``rows`` with all lookups attached, and the record as a list of text columns and slots."""
        items: list = []
        groups = iter(planned.groups)
        attached: dict[int, Column] = {}
        for child in planned.node.active:
            items.append(F.lit(("," if items else "{") + json_key(child.target_key)))
            if child.kind == "scalar-field":
                column, kind = F.col(planned.columns[child.source_field]), planned.types[child.source_field]
                items.append(field_value(column, kind, child.mapping).json())
                continue
            group = next(groups)
            if child.kind == "object":
                rows, inner = self._attach_object(group, rows, inline)
                items.extend(inner)
            elif inline:
                if group.number not in attached:
                    rows, texts = self._attach_arrays(self._sharing(group), rows)
                    attached.update(texts)
                items.extend([F.lit("["), attached[group.number], F.lit("]")])
            else:
                items.extend([F.lit("["), _Slot(group), F.lit("]")])
        items.append(F.lit("}" if items else "{}"))
        return rows, items

    def _sharing(self, planned: _Planned) -> list[_Planned]:
        """Sibling arrays over the same rows: one scan and one aggregation serve them all."""
        if not _is_plain(planned) or self._weights or self._limited is not None:
            return [planned]
        return [g for g in planned.parent.groups if _is_plain(g) and _source(g) == _source(planned)]

    def _attach_arrays(self, group: list[_Planned], rows: DataFrame) -> tuple[DataFrame, dict[int, Column]]:
        lead = group[0]
        if len(group) == 1:
            children, items = self._assemble(lead, self._children(lead), inline=True)
            lists = [self._list(lead, [F.concat(*items)], None)]
        else:
            children = self._read_shared(group)
            lists = []
            for member in group:
                _, items = self._assemble(member, children, inline=True)
                lists.append(self._list(member, [F.concat(*items)], F.col(f"in{member.number}")))
        key = f"k{lead.number}"
        names = [f"t{member.number}" for member in group]
        grouped = _by_key(children, lead.key, key).agg(*[l.alias(n) for l, n in zip(lists, names)])
        texts = grouped.select(
            key, *[F.array_join(_pick(n, m, 0, 1), ",").alias(n) for n, m in zip(names, group)]
        )
        joined = self._attach(rows, texts, lead, key)
        return joined, {m.number: F.coalesce(F.col(n), F.lit("")) for m, n in zip(group, names)}

    def _read_shared(self, group: list[_Planned]) -> DataFrame:
        rows = self._read_together(group)
        return self._reduced(group[0], rows) if _narrowed(group[0]) else rows

    def _read_together(self, group: list[_Planned]) -> DataFrame:
        """Rows that any of the siblings wants, flagged per sibling, each source column once."""
        lead = group[0]
        for member in group[1:]:
            for name in member.columns:
                member.columns[name] = lead.columns.setdefault(name, member.columns[name])
        df = self.resolve(lead.table).where(_quoted(lead.node.join_key).isNotNull())
        tests = [F.expr(m.node.filter) if (m.node.filter or "").strip() else F.lit(True) for m in group]
        wanted = functools.reduce(lambda left, right: left | right, tests)
        flags = [F.coalesce(test, F.lit(False)).alias(f"in{m.number}") for m, test in zip(group, tests)]
        return self._renamed(df.where(wanted), lead, *flags)

    def _list(self, planned: _Planned, outputs: list[Column], only: Column | None) -> Column:
        """The group's elements in order. With one output and no order the elements are plain."""
        if len(outputs) == 1 and not planned.order:
            element = outputs[0]
        else:
            texts = [output.alias(f"o{n}") for n, output in enumerate(outputs)]
            element = F.struct(*[F.col(name) for name in planned.order], *texts)
        return F.collect_list(element if only is None else F.when(only, element))

    def _attach_object(self, planned: _Planned, rows: DataFrame, inline: bool) -> tuple[DataFrame, list]:
        found, items = self._assemble(planned, self._children(planned), inline)
        key, value, count = f"k{planned.number}", f"t{planned.number}", f"c{planned.number}"
        whole = not any(isinstance(item, _Slot) for item in items)
        content = F.concat(*items) if whole else F.struct(*[c for c in found.columns])
        unique = found.groupBy(F.col(planned.key).alias(key)).agg(
            F.first(content).alias(value), F.count(F.lit(1)).alias(count)
        )
        rows = self._attach(rows, unique, planned, key)
        text = _only_one(F.col(value), F.col(count), planned)
        if whole:
            return rows, [F.coalesce(text, F.lit("null"))]
        rows = rows.withColumn(value, text).withColumns({c: F.col(f"{value}.{c}") for c in found.columns})
        missing = F.col(value).isNull()
        out, opened = [], False
        for item in _runs(items):
            if isinstance(item, _Slot):
                out.append(item)
                continue
            out.append(F.when(missing, F.lit("" if opened else "null")).otherwise(item))
            opened = True
        return rows, out

    def _attach(self, rows: DataFrame, right: DataFrame, planned: _Planned, key: str) -> DataFrame:
        """``right`` has one row per key. It is broadcast only by its measured size; file sizes say
        little about the text that rows become."""
        if self._is_small_side(planned):
            return rows.join(F.broadcast(right), F.col(planned.parent_key) == F.col(key), "left").drop(key)
        heavy = self._heavy.get(planned.number, NOT_HEAVY)
        joined = skew_join(rows, right, planned.parent_key, key, planned.parent.row_id, "left", heavy, "merge")
        return joined.drop(key)

    def _assemble_flat(self, planned: _Planned, rows: DataFrame, inline: bool) -> tuple[DataFrame, list]:
        """As ``_assemble``, with one nullable text per leaf instead of one record text."""
        outputs: list = []
        groups = iter(planned.groups)
        shared: dict[int, list[Column]] = {}
        for child in planned.node.active:
            if child.kind == "scalar-field":
                column, kind = F.col(planned.columns[child.source_field]), planned.types[child.source_field]
                if self.dates and planned is self.root:
                    text = export_text(column, kind)
                else:
                    text = field_value(column, kind, child.mapping).text
                outputs.append(((child.target_key,), text))
                continue
            group = next(groups)
            paths = [(child.target_key, *path) for path in leaf_paths(child)]
            if child.kind == "object":
                rows, columns = self._attach_flat_object(group, rows, inline)
            elif inline:
                if group.number not in shared:
                    rows, found = self._attach_flat_arrays(self._sharing(group), rows)
                    shared.update(found)
                columns = shared[group.number]
            else:
                columns = [_Slot(group, path) for path in leaf_paths(child)]
            outputs.extend(zip(paths, columns))
        return rows, outputs

    def _attach_flat_arrays(self, group: list[_Planned], rows: DataFrame) -> tuple[DataFrame, dict[int, list[Column]]]:
        lead, key, lists, picks = group[0], f"k{group[0].number}", [], []
        if len(group) == 1:
            children, outputs = self._assemble_flat(lead, self._children(lead), inline=True)
            members = [(lead, outputs, None)]
        else:
            children = self._read_shared(group)
            members = [(m, self._assemble_flat(m, children, inline=True)[1], F.col(f"in{m.number}")) for m in group]
        for member, outputs, only in members:
            name = f"t{member.number}"
            lists.append(self._list(member, [column for _, column in outputs], only).alias(name))
            delimiters = _delimiters(member.node, member.node.delimiter)
            for n, (path, _) in enumerate(outputs):
                texts = _pick(name, member, n, len(outputs))
                picks.append(_join_present(texts, delimiters[path]).alias(f"{name}_{n}"))
        grouped = _by_key(children, lead.key, key).agg(*lists).select(key, *picks)
        columns = {m.number: [F.col(f"t{m.number}_{n}") for n in range(len(outs))] for m, outs, _ in members}
        return self._attach(rows, grouped, lead, key), columns

    def _attach_flat_object(self, planned: _Planned, rows: DataFrame, inline: bool) -> tuple[DataFrame, list]:
        found, outputs = self._assemble_flat(planned, self._children(planned), inline)
        if not outputs:
            return rows, []
        key, value, count = f"k{planned.number}", f"t{planned.number}", f"c{planned.number}"
        texts = [c.alias(f"{value}_{n}") for n, (_, c) in enumerate(outputs) if not isinstance(c, _Slot)]
        # Slots below need the columns of this row: their join keys are read from it.
        carried = [] if inline else [F.col(c) for c in found.columns]
        unique = found.groupBy(F.col(planned.key).alias(key)).agg(
            F.first(F.struct(*carried, *texts)).alias(value), F.count(F.lit(1)).alias(count)
        )
        rows = self._attach(rows, unique, planned, key)
        rows = rows.withColumn(value, _only_one(F.col(value), F.col(count), planned))
        if carried:
            rows = rows.withColumns({c: F.col(f"{value}.{c}") for c in found.columns})
        columns = [
            c if isinstance(c, _Slot) else F.col(f"{value}.{value}_{n}") for n, (_, c) in enumerate(outputs)
        ]
        return rows, columns

    # --- records over the budget ----------------------------------------------------------------

    def _json_pieces(self, roots: DataFrame) -> DataFrame:
        carried = [self.root.columns[name] for name in self.keys]
        start = roots.withColumn("__pos", F.array(F.col(self.root.row_id))).withColumn("__lead", F.lit(""))
        ordered = _numbered(functools.reduce(DataFrame.unionByName, self._emit_json(self.root, start, carried)))
        record = F.col("__pos")[0].alias("__record")
        return ordered.select(*self._key_columns(), "part", F.col("__text").alias("json"), record)

    def _emit_json(self, planned: _Planned, rows: DataFrame, carried: list[str]) -> list[DataFrame]:
        rows, items = self._assemble(planned, rows, inline=False)
        runs = _runs(items)
        texts = [run for run in runs if not isinstance(run, _Slot)]
        texts[0] = F.concat(F.col("__lead"), texts[0])
        slots = [run for run in runs if isinstance(run, _Slot)]
        spots = F.array(*[
            F.struct(F.lit(2 * n).cast("long").alias("at"), text.alias("text")) for n, text in enumerate(texts)
        ])
        out = [
            rows.select(*carried, "__pos", F.explode(spots).alias("spot"))
            .select(*carried, F.concat("__pos", F.array("spot.at")).alias("__pos"), F.col("spot.text").alias("__text"))
        ]
        for number, slot in enumerate(slots):
            level = self._level(slot.child, rows, carried, number)
            first = level.groupBy("__above").agg(F.min("__id").alias("__first"))
            first = first.select(_position(F.col("__above"), number, F.col("__first")).alias("__head"))
            lead = F.when(F.col("__head").isNull(), F.lit(",")).otherwise(F.lit(""))
            level = _marked(level, first).withColumn("__lead", lead)
            out += self._emit_json(slot.child, level.drop("__head", "__above", "__id"), carried)
        return out

    def _level(self, planned: _Planned, parents: DataFrame, carried: list[str], slot: int) -> DataFrame:
        """Rows of one array below the oversize records, each with its place in the document."""
        above = parents.select(
            *carried, F.col("__pos").alias("__above"), F.col(planned.parent_key).alias("__wanted")
        ).where(F.col("__wanted").isNotNull())
        rows = self._read(planned)
        if _is_small(above):
            # The child table stays where it is: nothing is shuffled and no key can be hot.
            rows = rows.join(F.broadcast(above), F.col(planned.key) == F.col("__wanted"))
        else:
            [above_heavy] = measure_heavy(above, "__wanted", heavy_rows=self.heavy_rows)
            rows = skew_join(
                rows, above, planned.key, "__wanted", planned.row_id, "inner", self._heavy_child(planned, rows),
                few_heavy=above_heavy, few_id="__above",
            )
        rows = rows.drop("__wanted")
        if planned.order:
            order = [F.col(name) for name in (*planned.order, planned.row_id, "__above")]
            rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
            rows = rows.withColumn("__id", F.monotonically_increasing_id())
        else:
            rows = rows.withColumn("__id", F.col(planned.row_id))
        return checkpointed(rows.withColumn("__pos", _position(F.col("__above"), slot, F.col("__id"))))

    def _flat_pieces(self, roots: DataFrame, names: list[str]) -> DataFrame:
        """Cells in fragments, delimiters included; plain cells are in the first row of a record."""
        repeated = self.repeated_paths()
        cells = {path: f"cell{n}" for n, path in enumerate(self.paths())}
        keys = [self.root.columns[name] for name in self.keys]
        start = roots.withColumn("__pos", F.array(F.col(self.root.row_id)))
        rows, outputs = self._assemble_flat(self.root, start, inline=False)
        pieces = functools.reduce(DataFrame.unionByName, self._emit_flat(rows, outputs, keys, cells, ()))
        pieces = checkpointed(pieces.withColumn("__record", F.col("__pos")[0]))
        leaves = [path for path in cells if path in repeated]
        firsts = pieces.groupBy("__record").agg(
            *[F.min(F.when(F.col(cells[p]).isNotNull(), F.col("__pos"))).alias(cells[p]) for p in leaves]
        )
        marks = F.array(*[F.struct(F.col(cells[p]).alias("pos"), F.lit(cells[p]).alias("cell")) for p in leaves])
        heads = firsts.select(F.explode(marks).alias("m")).where("m.pos is not null")
        heads = heads.groupBy(F.col("m.pos").alias("__head")).agg(F.collect_set("m.cell").alias("__cells"))
        ordered = _numbered(_marked(pieces, heads))
        delimiters = _delimiters(self.root.node)
        shown = []
        for path, name in zip(self.paths(), names):
            cell = F.col(cells[path])
            if path in repeated:
                leads = F.coalesce(F.array_contains("__cells", cells[path]), F.lit(False))
                cell = F.when(leads, cell).otherwise(F.concat(F.lit(delimiters[path]), cell))
            shown.append(F.coalesce(cell, F.lit("")).alias(name))
        return ordered.select(*self._key_columns(), "part", *shown, "__record", (F.size("__pos") == 1).alias("__starts"))

    def _emit_flat(self, rows, outputs, carried, cells, prefix) -> list[DataFrame]:
        """The cells each row holds itself, for this level and all below."""
        values = {name: F.lit(None).cast("string") for name in cells.values()}
        slots: dict[int, tuple[_Planned, tuple]] = {}
        for path, output in outputs:
            if isinstance(output, _Slot):
                slots.setdefault(output.child.number, (output.child, path[: len(path) - len(output.path)]))
            else:
                values[cells[prefix + path]] = output
        out = [rows.select(*carried, "__pos", *[c.alias(n) for n, c in values.items()])]
        for number, (child, at) in enumerate(slots.values()):
            level = self._level(child, rows, carried, number).drop("__above", "__id")
            level, inner = self._assemble_flat(child, level, inline=False)
            out += self._emit_flat(level, inner, carried, cells, prefix + at)
        return out

    # --- small parts ----------------------------------------------------------------------------

    def _key_columns(self) -> list[Column]:
        return [F.col(self.root.columns[name]).alias(name) for name in self.keys]

    def _nothing(self, *columns: str) -> DataFrame:
        spark = self.resolve(self.root.table).sparkSession
        schema = T.StructType([T.StructField(name, self.root.types[name]) for name in self.keys])
        for name in columns:
            schema = schema.add(name, T.LongType() if name == "part" else T.StringType())
        return spark.createDataFrame([], schema)


def cell_name(number: int) -> str:
    return f"__cell{number}"


def leaf_paths(node: Node) -> list[tuple[str, ...]]:
    paths: list[tuple[str, ...]] = []
    for child in node.active:
        if child.kind == "scalar-field":
            paths.append((child.target_key,))
        else:
            paths += [(child.target_key, *path) for path in leaf_paths(child)]
    return paths


def _repeated(node: Node, inside: bool = False) -> set[tuple[str, ...]]:
    found: set[tuple[str, ...]] = set()
    for child in node.active:
        if child.kind == "scalar-field":
            if inside:
                found.add((child.target_key,))
        else:
            found |= {(child.target_key, *p) for p in _repeated(child, inside or child.kind == "array")}
    return found


def _delimiters(node: Node, current: str | None = None) -> dict[tuple[str, ...], str]:
    found = {}
    for child in node.active:
        if child.kind == "scalar-field":
            found[(child.target_key,)] = current
        else:
            inner = child.delimiter if child.kind == "array" else current
            found |= {(child.target_key, *p): d for p, d in _delimiters(child, inner).items()}
    return found


def _pruned(node: Node, denied: frozenset[str]) -> Node:
    """Without disabled nodes and without output keys on the denylist, whole subtrees included."""
    kept = tuple(_pruned(c, denied) for c in node.active if c.target_key.lower() not in denied)
    return replace(node, children=kept)


def _narrowed(planned: _Planned) -> bool:
    """Whether only some parents remain, so that children are worth reducing to theirs."""
    above = planned.parent
    if (above.node.filter or "").strip():
        return True
    return above.node.kind == "array" and _narrowed(above)


def _is_plain(planned: _Planned) -> bool:
    test = planned.node.filter or ""
    return planned.node.kind == "array" and not planned.groups and not SUBQUERY.search(test)


def _source(planned: _Planned) -> tuple:
    return planned.table, planned.node.join_key, planned.node.source_join_key


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _check_comparable(planned: _Planned) -> None:
    mine = planned.types[planned.node.join_key]
    theirs = planned.parent.types[planned.node.source_join_key]
    if isinstance(mine, T.NumericType) and isinstance(theirs, T.NumericType):
        return
    if type(mine) is not type(theirs):
        raise DefinitionError(
            f"{planned.node.target_key!r}: keys {planned.node.join_key!r} and {planned.node.source_join_key!r} "
            "have different types"
        )


def _common_key(key: Column, kind: T.DataType) -> Column:
    key = key.cast(kind)
    # Minus zero equals zero, but its text does not.
    return key + F.lit(0).cast(kind) if isinstance(kind, (T.FloatType, T.DoubleType)) else key


def _row_bytes(planned: _Planned) -> Column:
    """About the bytes a row adds to its record; reads text columns only."""
    fixed, total = 2 + sum(len(group.target_key) + 6 for group in planned.node.groups), F.lit(0)
    for child in planned.node.scalars:
        fixed += len(child.target_key) + 6
        if child.mapping is not None:
            fixed += len(child.mapping.default_value or "") + len(child.mapping.transform_arg or "")
        kind = planned.types[child.source_field]
        if isinstance(kind, PLAIN_TYPES):
            fixed += _widest(kind)
        else:
            text = F.col(planned.columns[child.source_field]).cast("string")
            total = total + F.coalesce(F.octet_length(text), F.lit(4))
    return total + F.lit(fixed).cast("long")


def _widest(kind: T.DataType) -> int:
    """Longest text of a value, with its quotes."""
    narrow = {T.BooleanType: 7, T.ByteType: 7, T.ShortType: 8, T.IntegerType: 13, T.DateType: 12, T.LongType: 22}
    return narrow.get(type(kind), 42)


def _facts(members: list[_Planned]) -> Column:
    """Per node the largest row, the bytes of all rows and their number, in one pass; here one group."""
    facts = []
    for member in members:
        mine = F.col(f"in{member.number}") if len(members) > 1 else F.lit(True)
        size = F.when(mine, _row_bytes(member))
        facts.append(F.struct(
            F.lit(member.number).alias("node"), F.max(size).alias("most"), F.sum(size).alias("bytes"),
            F.count(size).alias("rows"), F.sum(size).alias("total"), F.count(size).alias("all"),
        ))
    return F.array(*facts).alias("facts")


def _largest(members: list[_Planned]) -> Column:
    """The same over groups: the largest row, the largest group, and the sums over all."""
    facts = []
    for n, member in enumerate(members):
        fact = F.col("facts")[n]
        facts.append(F.struct(
            F.lit(member.number).alias("node"), F.max(fact["most"]).alias("most"), F.max(fact["bytes"]).alias("bytes"),
            F.max(fact["rows"]).alias("rows"), F.sum(fact["bytes"]).alias("total"),
            F.coalesce(F.sum(fact["rows"]), F.lit(0)).alias("all"),
        ))
    return F.array(*facts).alias("facts")


def _by_key(rows: DataFrame, column: str, key: str) -> GroupedData:
    """Rows grouped where they are shuffled to: collecting lists before the shuffle would not make
    them smaller."""
    return rows.repartition(column).groupBy(F.col(column).alias(key))


def _runs(items: list) -> list:
    """Neighbouring texts as one column."""
    runs: list = []
    texts: list[Column] = []
    for item in items:
        if isinstance(item, _Slot):
            runs += [F.concat(*texts), item] if texts else [item]
            texts = []
        else:
            texts.append(item)
    return runs + [F.concat(*texts)] if texts else runs


def _pick(name: str, planned: _Planned, output: int, outputs: int) -> Column:
    """One output of all elements of a list made by ``_list``, in order."""
    listed = F.sort_array(F.col(name)) if planned.order else F.col(name)
    if planned.order or outputs > 1:
        return F.transform(listed, lambda element: element.getField(f"o{output}"))
    return listed


def _join_present(texts: Column, delimiter: str) -> Column:
    """Joined text of the non-null elements, NULL when there is none."""
    present = F.exists(texts, lambda text: text.isNotNull())
    return F.when(present, F.array_join(texts, delimiter))


def _only_one(value: Column, count: Column, planned: _Planned) -> Column:
    message = f"more than one row of {planned.table} for one {planned.node.source_join_key} of an object"
    return F.when(count > 1, F.raise_error(F.lit(message))).otherwise(value)


def _position(above: Column, slot: int, identifier: Column) -> Column:
    return F.concat(above, F.array(F.lit(2 * slot + 1).cast("long"), identifier))


def _is_small(rows: DataFrame) -> bool:
    """Whether rows may be broadcast, by their counted number and text."""
    texts = [F.octet_length(F.col(f.name)) for f in rows.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    size = functools.reduce(lambda a, b: a + b, [F.coalesce(text, F.lit(0)) for text in texts], F.lit(0))
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return found["n"] <= BROADCAST_ROWS and found["bytes"] <= BROADCAST_BYTES


def _marked(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows with what is known of the few that stand first, found by their position."""
    heads = checkpointed(heads)
    return rows.join(F.broadcast(heads) if _is_small(heads) else heads, F.col("__pos") == F.col("__head"), "left")


def _numbered(pieces: DataFrame) -> DataFrame:
    """``part``, from 1, rises in document order over all partitions: the rows are range-partitioned
    and sorted."""
    ordered = pieces.repartitionByRange("__pos").sortWithinPartitions("__pos")
    return ordered.withColumn("part", F.monotonically_increasing_id() + 1)
