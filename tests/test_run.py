import glob
import json
from datetime import datetime, timezone

from treeloom.definition import array, root, scalar
from treeloom.plans.flat import tree_export
from treeloom.plans.ledger import run_list
from treeloom.plans.lines import document_lines
from treeloom.sinks.package import verify_package, write_document
from treeloom.sinks.run import RUNS, run_export

AT = datetime(2026, 6, 28, 6, tzinfo=timezone.utc)


def test_runs_take_numbers_in_turn(spark, shop, tmp_path):
    resolve, _ = shop
    runs = spark.createDataFrame([], RUNS)
    good = tree_export(resolve, "maker", root(scalar("id")))
    first = run_export(good, str(tmp_path), "json", runs, AT, actor="ann", definition_id=3, config_version=2)
    runs = runs.union(first.run)
    empty = tree_export(resolve, "maker", root(scalar("id"), filter="false"))
    second = run_export(empty, str(tmp_path), "json", runs, AT)
    runs = runs.union(second.run)
    shown = [(r["sequence_no"], r["status"], r["record_count"], len(r["sha256_short"])) for r in run_list(runs, AT).orderBy("sequence_no").collect()]
    assert shown == [(1, "Pending", 4, 12), (2, "Failed", 0, 0)]
    assert second.error == "export 2 has no records" and second.manifest is None
    history = first.history.first()
    assert (history["export_definition_id"], history["config_version"], history["status"], history["triggered_by"]) == (3, 2, "Success", "ann")
    assert second.history.first()["error_message"] == second.error
    assert [r["action"] for r in first.audit.collect()] == ["export_started", "export_completed"]
    assert [r["detail"] for r in second.audit.collect()] == ["#2", "#2: export 2 has no records"]
    name = first.run.first()["data_file_name"]
    assert name == "export_0001_20260628T060000Z.json" and verify_package(spark, str(tmp_path), name).count() == 0


def test_document_files_in_name_order_are_the_document(shop, tmp_path):
    resolve, _ = shop
    tree = root(scalar("id"), array("a", "address", "maker_id", "id", scalar("city"), order_by=("no",)), filter="id is not null")
    export = tree_export(resolve, "maker", tree, keys=["id"], record_bytes=80)
    write_document(document_lines(export, None, AT), str(tmp_path / "doc"))
    text = "".join(open(f).read() for f in sorted(glob.glob(str(tmp_path / "doc" / "part-*"))))
    records = json.loads(text)["records"]
    assert [(r["id"], len(r["a"])) for r in records] == [("m1", 4), ("m2", 0), ("m3", 1)]
