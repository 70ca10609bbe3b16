import csv
import io
import json
import os
from datetime import datetime, timedelta, timezone

import pytest

from brute import joined
from treeloom.definition import DeniedFieldError, Envelope, Field, FlatMapping, MetadataField, Relation, array, root, scalar
from treeloom.plans.cells import typed_cells
from treeloom.plans.flat import flat_export, mapping_export, tree_export
from treeloom.plans.lines import csv_lines, document_lines, flat_json_lines
from treeloom.sinks.package import (
    EmptyExportError,
    PackageError,
    expired_files,
    package_text,
    read_manifest,
    verify_package,
    write_document,
    write_package,
)

AT = datetime(2026, 6, 28, 6, tzinfo=timezone.utc)
MAPPING = FlatMapping(
    "maker", (Field("id", "ID"), Field("name", "na,me")),
    (Relation("address", "maker_id", "id", (Field("city", "cities"), Field("zip", "zips")), delimiter='; "', order_by=("no",)),
     Relation("address", "maker_id", "id", (Field("no", "numbers"),), flatten_strategy="array_join", delimiter="|", order_by=("no",))),
)
WANT = {
    1: ["m1", "Nord", 'Dallas; "Austin; "Austin', '10; "; "10', "1,2,3,4"],
    None: ["m2", 'Sü"d\\', "", "", ""],
    9: ["m3", "", "Rome\nSouth", "7.50", "1"],
    2: ["", "keyless", "", "", ""],
}


@pytest.mark.parametrize("limits", [{}, {"record_bytes": 1}])
def test_csv_and_flat_json(shop, limits):
    resolve, _ = shop
    export = flat_export(resolve, MAPPING, keys=["city_id"], **limits)
    lines = joined(csv_lines(export), "city_id", "line")
    assert {k: next(csv.reader(io.StringIO(v))) for k, v in lines.items()} == WANT
    lines = joined(flat_json_lines(export), "city_id", "line")
    names = ["ID", "na,me", "cities", "zips", "numbers"]
    assert {k: json.loads(v) for k, v in lines.items()} == {k: dict(zip(names, v)) for k, v in WANT.items()}


@pytest.mark.parametrize("limits", [{}, {"record_bytes": 1}])
@pytest.mark.parametrize("envelope, want", [
    (None, lambda r: {"schema_version": "2.0", "extracted_at": "2026-06-28T06:00:00.0000000+00:00", "records": r}),
    (Envelope("out", " ", "meta", (MetadataField("by", "me"), MetadataField("at", "x", True))),
     lambda r: {"out": {"meta": {"by": "me", "at": "2026-06-28T06:00:00.0000000+00:00"}, "records": r}}),
])
def test_document(shop, envelope, want, limits):
    resolve, _ = shop
    tree = root(scalar("id"), array("cities", "address", "maker_id", "id", scalar("city"), order_by=("no",)), filter="id is not null")
    export = tree_export(resolve, "maker", tree, keys=["id"], **limits)
    rows = document_lines(export, envelope, AT).orderBy("section", "record", "part").collect()
    got = json.loads("\n".join(r["line"] for r in rows))
    sort_records(got)
    cities = {"m1": ["Dallas", "Austin", None, "Austin"], "m2": [], "m3": ["Rome\nSouth"]}
    assert got == want([{"id": k, "cities": [{"city": c} for c in v]} for k, v in cities.items()])


def sort_records(document):
    inner = document.get("out", document)
    inner["records"].sort(key=lambda r: r["id"])


@pytest.mark.parametrize("limits", [{}, {"record_bytes": 1}, {"record_bytes": 60}])
@pytest.mark.parametrize("nested", [True, False])
def test_written_documents_need_no_unique_keys(spark, shop, tmp_path, limits, nested):
    resolve, _ = shop
    if nested:
        tree = root(scalar("n", "name"), array("cities", "address", "maker_id", "id", scalar("city"), order_by=("no",)))
        export = tree_export(resolve, "maker", tree, **limits)
    else:
        export = flat_export(resolve, MAPPING, **limits)
    write_document(document_lines(export, None, AT, nested=nested), str(tmp_path / "doc"))
    records = json.loads(whole_text(tmp_path / "doc"))["records"]
    name = "n" if nested else "na,me"
    assert sorted(r[name] for r in records) == ["", "Nord", 'Sü"d\\', "keyless"]
    if nested:
        assert {r["n"]: [c["city"] for c in r["cities"]] for r in records}[""] == ["Rome\nSouth"]
    else:
        assert sorted(list(r.values()) for r in records) == sorted(WANT.values())


def whole_text(*folders):
    found = [open(f"{d}/{f}", "rb").read() for d in folders if os.path.isdir(d) for f in sorted(os.listdir(d)) if f.startswith("part-")]
    return b"".join(found).decode()


def package_bytes(spark, path):
    parts = package_text(spark, str(path)).orderBy("section", "name").collect()
    return b"".join(bytes(p["content"]) for p in parts).decode()


@pytest.mark.parametrize("limits", [{}, {"record_bytes": 1}, {"record_bytes": 60}])
@pytest.mark.parametrize("envelope, path", [(None, ("records",)), (Envelope("ROOT", "items"), ("ROOT", "items"))])
def test_json_packages_are_one_document(spark, shop, tmp_path, limits, envelope, path):
    resolve, _ = shop
    flat = FlatMapping(MAPPING.source_table, MAPPING.fields, MAPPING.relations, envelope=envelope)
    write_package(flat_export(resolve, flat, **limits), str(tmp_path), "json", 1, AT)
    found = json.loads(package_bytes(spark, tmp_path / "export_0001_20260628T060000Z.json"))
    for key in path:
        found = found[key]
    assert sorted(list(r.values()) for r in found) == sorted(WANT.values())
    assert verify_package(spark, str(tmp_path), "export_0001_20260628T060000Z.json").count() == 0


@pytest.mark.parametrize("limits", [{}, {"record_bytes": 1}])
def test_csv_packages_are_one_file(spark, shop, tmp_path, limits):
    resolve, _ = shop
    write_package(flat_export(resolve, MAPPING, **limits), str(tmp_path), "csv", 1, AT)
    text = package_bytes(spark, tmp_path / "export_0001_20260628T060000Z.csv").split("\n", 2)[2]
    assert sorted(csv.reader(io.StringIO(text))) == sorted(WANT.values())


def test_blank_cells_carriage_returns_and_stale_staging(spark, tmp_path):
    table = spark.createDataFrame([("",), (None,), ("a\rb",), ("x",)], "v string")
    export = flat_export(lambda name: table, FlatMapping("t", (Field("v", "v"),)))
    stale = tmp_path / "export_0001_20260628T060000Z.csv.0a.tmp" / "split"
    os.makedirs(stale)
    (stale / "part-old.parquet").write_text("junk")
    manifest = write_package(export, str(tmp_path), "csv", 1, AT)
    assert manifest["RecordCount"] == 4
    assert verify_package(spark, str(tmp_path), "export_0001_20260628T060000Z.csv").count() == 0
    assert not os.path.exists(tmp_path / "export_0001_20260628T060000Z.csv" / "split")


def test_large_parts_are_written_again_smaller(spark, shop, tmp_path, monkeypatch):
    resolve, _ = shop
    monkeypatch.setattr("treeloom.sinks.package.PART_BYTES", 60)
    write_package(flat_export(resolve, MAPPING, record_bytes=60), str(tmp_path), "json", 1, AT)
    path = tmp_path / "export_0001_20260628T060000Z.json"
    assert len(json.loads(package_bytes(spark, path))["records"]) == 4
    assert verify_package(spark, str(tmp_path), path.name).count() == 0


@pytest.mark.parametrize("fmt", ["json", "csv", "xlsx"])
def test_denied_keys_never_reach_a_sink(shop, tmp_path, fmt):
    resolve, _ = shop
    with pytest.raises(DeniedFieldError):
        write_package(flat_export(resolve, FlatMapping("maker", (Field("id", "id"),)), keys=["Mail"], denylist=["mail"]), str(tmp_path), fmt, 1, AT)
    assert os.listdir(tmp_path) == []


@pytest.mark.parametrize("limits", [{}, {"record_bytes": 1}])
def test_repeated_and_case_different_names(shop, limits):
    resolve, _ = shop
    relation = Relation("address", "maker_id", "id", (Field("city", "id"), Field("zip", "Name")), order_by=("no",))
    mapping = FlatMapping("maker", (Field("id", "id"), Field("name", "name")), (relation,))
    lines = joined(csv_lines(flat_export(resolve, mapping, keys=["id"], **limits)), "id", "line")
    assert next(csv.reader(io.StringIO(lines["m3"]))) == ["m3", "", "Rome\nSouth", "7.50"]
    lines = joined(flat_json_lines(flat_export(resolve, mapping, keys=["id"], **limits)), "id", "line")
    assert json.loads(lines["m3"]) == {"id": "Rome\nSouth", "name": "", "Name": "7.50"}


def test_empty_document_and_empty_package(shop, tmp_path):
    resolve, _ = shop
    export = tree_export(resolve, "maker", root(scalar("id"), filter="id = 'none'"), keys=["id"])
    rows = document_lines(export, Envelope(), AT).orderBy("section").collect()
    assert json.loads("".join(r["line"] for r in rows))["records"] == []
    with pytest.raises(EmptyExportError):
        write_package(export, str(tmp_path), "json", 1, AT)
    assert os.listdir(tmp_path) == []


@pytest.mark.parametrize("fmt, extension", [("csv", "csv"), ("json", "json"), ("xlsx", "cells")])
def test_package_round_trip(spark, shop, tmp_path, fmt, extension):
    resolve, _ = shop
    folder = str(tmp_path)
    export = flat_export(resolve, MAPPING, keys=["city_id"], record_bytes=100)
    manifest = write_package(export, folder, fmt, 7, AT)
    name = f"export_0007_20260628T060000Z.{extension}"
    assert read_manifest(spark, folder, name) == manifest
    assert (manifest["RecordCount"], manifest["SequenceNumber"], len(manifest["Sha256Checksum"])) == (4, 7, 64)
    assert os.path.isdir(f"{folder}/{name}/split") and not [f for f in os.listdir(folder) if f.endswith(".tmp")]
    assert verify_package(spark, folder, name).count() == 0
    with pytest.raises(PackageError, match="exists"):
        write_package(export, folder, fmt, 7, AT)
    parts = [f for f in sorted(os.listdir(f"{folder}/{name}/rows")) if f.startswith("part-")]
    part = next(f for f in parts if os.path.getsize(f"{folder}/{name}/rows/{f}"))
    with open(f"{folder}/{name}/rows/{part}", "ab") as out:
        out.write(b"\n")
    if os.path.exists(f"{folder}/{name}/rows/.{part}.crc"):
        os.remove(f"{folder}/{name}/rows/.{part}.crc")
    if fmt != "xlsx":
        problems = {r["problem"] for r in verify_package(spark, folder, name).collect()}
        assert {"changed", "checksum differs"} <= problems


def test_csv_package_has_the_comment_and_header(spark, shop, tmp_path):
    resolve, _ = shop
    write_package(flat_export(resolve, MAPPING), str(tmp_path), "csv", 1, AT)
    with open(tmp_path / "export_0001_20260628T060000Z.csv" / "head.csv") as head:
        assert head.read() == '# schema_version=2.0,extracted_at=2026-06-28T06:00:00.0000000+00:00\nID,"na,me",cities,zips,numbers\n'
    assert expired_files(spark, str(tmp_path), datetime.now() + timedelta(days=1)).count() > 2
    assert expired_files(spark, str(tmp_path), datetime.now() - timedelta(days=1)).count() == 0


def test_typed_cells(spark):
    rows = spark.createDataFrame([(1, "2026-02-03", "", 0), (2, "2026-02-30", "x", 1)], "k int, d string, t string, part long")
    got = {(r["k"], r["column"]): (r["kind"], r["text"]) for r in typed_cells(rows, ["k"], ["d", "t"], "part").collect()}
    assert got == {(1, "d"): ("date", "2026-02-03"), (1, "t"): ("text", ""), (2, "d"): ("text", "2026-02-30"), (2, "t"): ("text", "x")}


def test_format_decides_the_shape(shop):
    resolve, _ = shop
    mapping = FlatMapping("maker", (Field("id", "ID"),), envelope=Envelope())
    assert not mapping_export(resolve, mapping, "json").named_by_leaf
    assert mapping_export(resolve, mapping, "csv").named_by_leaf
