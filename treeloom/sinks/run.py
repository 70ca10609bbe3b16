"""One export run from start to end: number, package, and the rows it adds to the ledgers."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame

from treeloom.plans import ledger
from treeloom.plans.lines import round_trip
from treeloom.plans.tree import TreeExport
from treeloom.sinks.package import EmptyExportError, PackageError, format_of, package_name, write_package

# The ledger tables. Counts are wide, exports may pass two billion records.
RUNS = (
    "sequence_no int, extracted_at string, record_count bigint, sha256 string, status string, "
    "released_at string, operated_by string, approved_by string, data_file_name string, delivered_at string, "
    "delivered_by string, imported_record_count int, delivery_notes string"
)
DEFINITION_RUNS = (
    "export_definition_id int, config_version int, started_at string, finished_at string, "
    "status string, record_count bigint, error_message string, triggered_by string, is_test_run boolean"
)
AUDIT = "timestamp string, username string, action string, detail string"


@dataclass(frozen=True)
class RunResult:
    """Rows to append to the run ledger, the definition's history and the audit log."""

    run: DataFrame
    history: DataFrame
    audit: DataFrame
    manifest: dict | None
    error: str | None


def run_export(
    export: TreeExport, folder: str, fmt: str, runs: DataFrame, extracted_at: datetime, *, actor: str = "scheduler",
    definition_id: int | None = None, config_version: int | None = None, test_run: bool = False,
) -> RunResult:
    """A package under the next sequence number. A failed or empty export publishes nothing; it
    takes its number as a failed run, so that the gap is visible."""
    spark = runs.sparkSession
    number = ledger.next_sequence(runs).first()["next_sequence"]
    started, manifest, error = datetime.now(timezone.utc), None, None
    try:
        manifest = write_package(export, folder, fmt, number, extracted_at)
    except (EmptyExportError, PackageError) as failure:
        error = str(failure)
    finished = round_trip(datetime.now(timezone.utc))
    records = manifest["RecordCount"] if manifest else 0
    state = ledger.FAILED if error else ledger.PENDING
    name = None if error else package_name(number, extracted_at, format_of(fmt).extension)
    digest = manifest["Sha256Checksum"] if manifest else ""
    run = (number, round_trip(extracted_at), records, digest, state, None, None, None, name, None, None, None, None)
    history = (
        definition_id, config_version, round_trip(started), finished, "Failed" if error else "Success", records, error,
        actor, test_run,
    )
    detail = f"#{number}: {error}" if error else f"#{number} records={records}"
    audit = [
        (round_trip(started), actor, "export_started", f"#{number}"),
        (finished, actor, "export_failed" if error else "export_completed", detail),
    ]
    return RunResult(
        spark.createDataFrame([run], RUNS), spark.createDataFrame([history], DEFINITION_RUNS),
        spark.createDataFrame(audit, AUDIT), manifest, error,
    )
