"""Exports as lines of text: CSV lines, flat JSON records, and the envelope around all records.

All results are ``keys…, part, line``: ``part`` 0 is a whole line, higher parts of one record are
concatenated in order.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.definition import Envelope
from treeloom.functions.text import csv_line, json_key, json_value
from treeloom.operators.checkpoints import checkpointed
from treeloom.plans.tree import TreeExport, cell_name

SCHEMA_VERSION = "2.0"


def csv_header(names: list[str]) -> str:
    quoted = [f'"{n.replace(chr(34), chr(34) * 2)}"' if any(c in n for c in ',"\n') else n for n in names]
    return ",".join(quoted)


def csv_comment(version: str, extracted_at: datetime) -> str:
    return f"# schema_version={version},extracted_at={round_trip(extracted_at)}"


def round_trip(moment: datetime) -> str:
    """ISO 8601 with seven fraction digits and the offset."""
    moment = moment.astimezone(timezone.utc) if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
    return f"{moment:%Y-%m-%dT%H:%M:%S}.{moment.microsecond:06d}0+00:00"


def csv_lines(export: TreeExport) -> DataFrame:
    return _together(csv_parts(export))


def csv_parts(export: TreeExport) -> tuple[DataFrame, DataFrame | None]:
    """Whole CSV lines, and the fragments of oversize lines if there are any."""

    def fragment(cell):
        return F.replace(cell, F.lit('"'), F.lit('""'))

    def opening(number, name):
        return '"' if number == 0 else ',"'

    return _flat_lines(export, list(enumerate(export.column_names())), csv_line, opening, fragment, "")


def flat_json_lines(export: TreeExport) -> DataFrame:
    """One JSON object of texts per flat row."""
    return _together(flat_json_parts(export))


def flat_json_parts(export: TreeExport) -> tuple[DataFrame, DataFrame | None]:
    # A repeated name keeps its place and takes the last value.
    last = {name: number for number, name in enumerate(export.column_names())}
    members = [(number, name) for name, number in last.items()]

    def whole(cells):
        texts = [F.concat(F.lit(json_key(name)), json_value(cell)) for (_, name), cell in zip(members, cells)]
        return F.concat(F.lit("{"), F.concat_ws(",", *texts), F.lit("}"))

    def fragment(cell):
        text = json_value(cell)
        return F.substring(text, F.lit(2), F.length(text) - 2)

    def opening(number, name):
        return ("{" if number == 0 else ",") + json_key(name) + '"'

    return _flat_lines(export, members, whole, opening, fragment, "}")


def nested_json_parts(export: TreeExport) -> tuple[DataFrame, DataFrame | None]:
    whole, pieces = export.json_parts()
    return whole.withColumnRenamed("json", "line"), (
        None if pieces is None else pieces.withColumnRenamed("json", "line")
    )


def _together(parts: tuple[DataFrame, DataFrame | None]) -> DataFrame:
    whole, pieces = parts
    return whole if pieces is None else whole.union(pieces.select(whole.columns))


def _flat_lines(export: TreeExport, members, whole, opening, fragment, ending: str) -> tuple[DataFrame, DataFrame | None]:
    """``members``: the number and name of each cell of a line, in order."""
    rows, pieces = export.flat_parts()
    lines = rows.select(*export.keys, "part", whole([F.col(cell_name(number)) for number, _ in members]).alias("line"))
    return lines, None if pieces is None else _split_lines(export, pieces, members, opening, fragment, ending)


def _split_lines(export: TreeExport, pieces: DataFrame, members, opening, fragment, ending: str) -> DataFrame:
    """The fragments turned from row order into line order: all of one cell, then the next cell."""
    spots = []
    for place, (number, name) in enumerate(members):
        close = '"' + (ending if place == len(members) - 1 else "")
        spots += [
            _spot(place, 0, F.when(F.col("__starts"), F.lit(opening(place, name)))),
            _spot(place, 1, fragment(F.col(cell_name(number)))),
            _spot(place, 2, F.when(F.col("__starts"), F.lit(close))),
        ]
    spread = pieces.select(*export.keys, "part", "__record", F.explode(F.array(*spots)).alias("spot"))
    spread = spread.where("length(spot.text) > 0")
    order = ["__record", "__cell", "__kind", "part"]
    spread = spread.select(
        *export.keys, "part", "__record", F.col("spot.cell").alias("__cell"), F.col("spot.kind").alias("__kind"),
        F.col("spot.text").alias("line"),
    )
    ordered = spread.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.select(*export.keys, (F.monotonically_increasing_id() + 1).alias("part"), "line", "__record")


def _spot(cell: int, kind: int, text: Column) -> Column:
    return F.struct(F.lit(cell).alias("cell"), F.lit(kind).alias("kind"), text.alias("text"))


# --- envelope -----------------------------------------------------------------------------------


def envelope_frame(
    envelope: Envelope | None, extracted_at: datetime, version: str = SCHEMA_VERSION
) -> tuple[str, str]:
    """What stands before and after the records of one document."""
    standard = [("schema_version", version), ("extracted_at", round_trip(extracted_at))]
    if envelope is None:
        envelope, metadata = Envelope(), standard
    else:
        metadata = [
            (m.key, round_trip(extracted_at) if m.is_timestamp else m.value) for m in envelope.metadata_fields
        ] or standard
    # A repeated key keeps its place and takes the last value.
    members = ",".join(json_key(k) + json_key(v)[:-1] for k, v in dict(metadata).items())
    before, after = "{", "}"
    if not _blank(envelope.root_key):
        before, after = "{" + json_key(envelope.root_key) + "{", "}}"
    if _blank(envelope.metadata_key):
        before += members + ("," if members else "")
    else:
        before += json_key(envelope.metadata_key) + "{" + members + "},"
    items = "records" if _blank(envelope.items_key) else envelope.items_key
    return before + json_key(items) + "[", "]" + after


def document_lines(
    export: TreeExport, envelope: Envelope | None, extracted_at: datetime, version: str = SCHEMA_VERSION,
    nested: bool = True,
) -> DataFrame:
    """One JSON document as ``section, keys…, record, part, line``; its text is the lines in the order of
    ``section, record, part``, with nothing between them.

    Section 0 opens the envelope, section 1 holds the records and section 2 closes it. ``record`` numbers the
    records whatever their keys; records in pieces have negative numbers, so they come first. A separator line
    (part -1) stands before every record but the first.
    """
    before, after = envelope_frame(envelope, extracted_at, version)
    whole, pieces = nested_json_parts(export) if nested else flat_json_parts(export)
    body = whole.select(*export.keys, F.monotonically_increasing_id().alias("record"), "part", "line")
    if pieces is not None:
        body = pieces.select(*export.keys, (-1 - F.col("__record")).alias("record"), "part", "line").union(body)
    # Written once: numbering, separators and lines then come from the same rows.
    body = checkpointed(body)
    least = body.agg(F.min("record")).first()[0]
    opens = F.col("record") != F.lit(least)
    if pieces is not None:
        firsts = body.where("record < 0").groupBy("record").agg(F.min(F.struct("part", *export.keys)).alias("first"))
        commas = firsts.where(opens).select(*[F.col(f"first.{_tick(key)}").alias(key) for key in export.keys], "record")
        commas = commas.union(body.where("record >= 0").where(opens).select(*export.keys, "record"))
    else:
        commas = body.where(opens).select(*export.keys, "record")
    commas = commas.select(*export.keys, "record", F.lit(-1).cast("long").alias("part"), F.lit(",").alias("line"))
    section = F.lit(1).alias("section")
    lines = body.union(commas).select(section, *export.keys, "record", "part", "line")
    nothing = [F.lit(None).cast(lines.schema[key].dataType).alias(key) for key in export.keys]
    frame = body.sparkSession.range(1).select(
        F.explode(F.array(
            F.struct(F.lit(0).alias("section"), F.lit(before).alias("line")),
            F.struct(F.lit(2).alias("section"), F.lit(after).alias("line")),
        )).alias("e")
    ).select("e.section", *nothing, F.lit(0).cast("long").alias("record"), F.lit(0).cast("long").alias("part"), "e.line")
    return frame.union(lines)


def _tick(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _blank(text: str | None) -> bool:
    return text is None or not text.strip()

