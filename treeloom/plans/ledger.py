"""Analytics over the ledger of export runs, and batches of release requests."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions.text import sha256_short
from treeloom.operators.checkpoints import checkpointed
from treeloom.operators.ordered import ROWS_PER_RANGE, carried, in_ranges
from treeloom.operators.skew import HEAVY_ROWS, measure_heavy, skew_join

# Run states.
PENDING, RELEASED, FAILED, SKIPPED = "Pending", "Released", "Failed", "Skipped"
# Fixed value: the warning of a run with unresolved predecessors.
GAP_WARNING = (
    "Sequence gap: %d earlier run(s) are unresolved (%s). Investigate or skip them before releasing #%d."
)
# Why a request is refused.
NO_APPROVER, SAME_PERSON, UNKNOWN_APPROVER, UNKNOWN_ACTION = "no_approver", "same_person", "unknown_approver", "unknown_action"
NO_RUN, NOT_PENDING, NOT_RELEASED, DELIVERED, LONG_NOTES = "no_run", "not_pending", "not_released", "delivered_before", "long_notes"
NOT_SKIPPABLE, OVERTAKEN = "not_skippable", "overtaken"
STALE_AFTER = timedelta(hours=24)
NOTES_LIMIT = 2000
GAP_SHOWN = 3
GAP_CHUNK = 10_000

def extracted_time() -> Column:
    return F.col("extracted_at").try_cast("timestamp")


def next_sequence(runs: DataFrame) -> DataFrame:
    return runs.agg((F.coalesce(F.max("sequence_no"), F.lit(0)) + 1).alias("next_sequence"))


def run_list(runs: DataFrame, now: datetime) -> DataFrame:
    """Runs for display: short checksum and whether a pending run has waited over a day."""
    old = F.coalesce(extracted_time() < F.lit(now - STALE_AFTER), F.lit(False))
    return runs.select(
        "sequence_no", "extracted_at", "record_count", sha256_short(F.col("sha256")).alias("sha256_short"), "status",
        "data_file_name", ((F.col("status") == PENDING) & old).alias("is_stale"),
    )


def newest_first(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("sequence_no"))


def latest(audit: DataFrame, count: int = 100, key: str = "id") -> DataFrame:
    return audit.orderBy(F.desc(key)).limit(count)


def gap_warnings(runs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Pending runs with up to three earlier runs that are neither released nor skipped.

    A window looks back inside a range of the sequence; what the ranges before contribute is an array of three numbers,
    from a scan over the ranges.
    """
    open_run = ~F.coalesce(F.col("status").isin(RELEASED, SKIPPED), F.lit(False))
    numbered = runs.select("sequence_no", "status", F.when(open_run, F.col("sequence_no").cast("bigint")).alias("__open"))
    placed = in_ranges(numbered, "sequence_no", rows_per_range)
    newest = F.slice(F.sort_array(F.collect_list("__open"), asc=False), 1, GAP_SHOWN)
    carry = carried(
        placed.groupBy("__range").agg(newest.alias("value")), lambda earlier, later: F.slice(F.concat(later, earlier), 1, GAP_SHOWN)
    )
    near = F.array_compact(F.array(*_lookback()))
    looked = placed.withColumn("__near", near).where(F.col("status") == PENDING).join(carry, "__range")
    found = F.slice(F.concat("__near", F.coalesce("before", F.array().cast("array<bigint>"))), 1, GAP_SHOWN)
    texts = F.transform(found, lambda n: F.concat(F.lit("#"), n.cast("string")))
    warning = F.format_string(GAP_WARNING, F.size(found), F.array_join(texts, ", "), F.col("sequence_no"))
    return looked.select("sequence_no", F.when(F.size(found) > 0, warning).alias("gap_warning"))


def _lookback() -> list[Column]:
    """The three nearest open runs before the current row in its range."""
    window = "(partition by __range order by sequence_no)"
    return [F.expr(f"cast(lag(__open, {k}) ignore nulls over {window} as bigint)") for k in range(1, GAP_SHOWN + 1)]


def sequence_gaps(runs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Sequence numbers that no run carries, between the first and the last run."""
    numbers = runs.where("sequence_no is not null").select(F.col("sequence_no").cast("bigint").alias("__seq"))
    placed = in_ranges(numbers, "__seq", rows_per_range)
    carry = carried(placed.groupBy("__range").agg(F.max("__seq").alias("value")), lambda earlier, later: later)
    back = Window.partitionBy("__range").orderBy("__seq")
    near = placed.withColumn("__near", F.lag("__seq").over(back))
    gaps = near.join(carry, "__range").withColumn("__before", F.coalesce("__near", "before")).where(
        F.col("__before") < F.col("__seq") - 1
    )
    # A wide gap is spread in two steps, so that no row holds all of its numbers.
    low, high = F.col("__before") + 1, F.col("__seq") - 1
    chunks = gaps.select(F.explode(F.sequence(low, high, F.lit(GAP_CHUNK).cast("bigint"))).alias("from"), high.alias("to"))
    upper = F.least(F.col("to"), F.col("from") + GAP_CHUNK - 1)
    return chunks.select(F.explode(F.sequence(F.col("from"), upper)).alias("missing_sequence_no"))


def is_expired(cutoff: datetime) -> Column:
    """Finished runs before the cutoff; runs whose time cannot be read are kept."""
    past = F.coalesce(extracted_time() < F.lit(cutoff), F.lit(False))
    return F.coalesce(F.col("status") != PENDING, F.lit(True)) & past


def expired(runs: DataFrame, now: datetime, retention_days: int) -> DataFrame:
    return runs.where(is_expired(now - timedelta(days=retention_days)) if retention_days > 0 else F.lit(False))


def retained(runs: DataFrame, now: datetime, retention_days: int) -> DataFrame:
    return runs.where(~is_expired(now - timedelta(days=retention_days)) if retention_days > 0 else F.lit(True))


# --- requests -----------------------------------------------------------------------------------


def check_requests(
    runs: DataFrame, requests: DataFrame, users: DataFrame, heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """Each request with ``accepted`` and a ``reason``.

    Requests: ``request_no, sequence_no, action, actor, approver, imported_record_count, notes``;
    users: ``username``. A batch changes a run once: of several acceptable requests for one run the
    lowest ``request_no`` wins.
    """
    requests = requests.withColumn("__who", F.lower("approver"))
    found = runs.select(
        F.col("sequence_no").alias("__seq"), F.col("status").alias("__status"),
        F.col("delivered_at").alias("__delivered"),
    )
    known = users.select(F.lower("username").alias("__user")).where("__user is not null").distinct()
    runs_heavy, users_heavy = measure_heavy(requests, "sequence_no", "__who", heavy_rows=heavy_rows)
    asked = skew_join(requests, found, "sequence_no", "__seq", "request_no", "left", runs_heavy)
    asked = skew_join(asked, known, "__who", "__user", "request_no", "left", users_heavy)
    # Joined once: the winners and the answers both read it.
    asked = checkpointed(asked.withColumn("reason", _refusal()).drop("__user", "__status", "__delivered", "__seq"))
    winners = asked.where("reason is null").groupBy("sequence_no").agg(F.min("request_no").alias("__first"))
    judged = asked.join(winners.select("__first"), F.col("request_no") == F.col("__first"), "left")
    accepted = F.col("__first").isNotNull()
    later = F.when(accepted, F.lit(None)).otherwise(F.lit(OVERTAKEN))
    return judged.select(
        *[c for c in requests.columns if c != "__who"], accepted.alias("accepted"),
        F.coalesce("reason", later).alias("reason"),
    )


def _form_refusal() -> Column:
    """What is wrong with a request whatever its run's state; ``__who`` and ``__user`` are its approver and the user found."""
    release = (
        F.when(F.trim(F.coalesce("approver", F.lit(""))) == "", F.lit(NO_APPROVER))
        .when(F.lower("actor") == F.col("__who"), F.lit(SAME_PERSON))
        .when(F.col("__user").isNull(), F.lit(UNKNOWN_APPROVER))
    )
    return F.when(F.col("action") == "release", release).when(~F.coalesce(F.col("action").isin("deliver", "skip"), F.lit(False)), F.lit(UNKNOWN_ACTION))


def _state_refusal() -> Column:
    """What the state of its run (``__status``, ``__delivered``) has against a request."""
    status, action = F.col("__status"), F.col("action")
    deliver = F.when(status != RELEASED, F.lit(NOT_RELEASED)).when(F.col("__delivered").isNotNull(), F.lit(DELIVERED))
    return (
        F.when(status.isNull(), F.lit(NO_RUN))
        .when((action == "release") & (status != PENDING), F.lit(NOT_PENDING))
        .when(action == "deliver", deliver)
        .when((action == "skip") & ~status.isin(PENDING, FAILED), F.lit(NOT_SKIPPABLE))
    )


def _refusal() -> Column:
    notes = F.when((F.col("action") == "deliver") & (F.length("notes") > NOTES_LIMIT), F.lit(LONG_NOTES))
    return F.coalesce(_form_refusal(), _state_refusal(), notes)


def judge_in_turn(runs: DataFrame, requests: DataFrame, users: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Each request with ``accepted`` and a ``reason``, judged by the state that the requests before it left: a run may be
    released and then delivered in one batch. Columns as in ``check_requests``; ``request_no`` is unique.

    A run can change at most twice (pending, released, delivered), so its whole course is known from two minima over its
    well-formed requests: the first that its state allows, and the first that the next state allows. Both are combined
    map-side. Every request then finds its state by comparing its number with these two; none waits for another.
    """
    asked = requests.withColumn("__who", F.lower("approver"))
    known = users.select(F.lower("username").alias("__user")).where("__user is not null").distinct()
    runs_heavy, users_heavy = measure_heavy(asked, "sequence_no", "__who", heavy_rows=heavy_rows)
    asked = checkpointed(skew_join(asked, known, "__who", "__user", "request_no", "left", users_heavy))
    well_formed = _form_refusal().isNull() & ~((F.col("action") == "deliver") & (F.coalesce(F.length("notes"), F.lit(0)) > NOTES_LIMIT))
    moves = asked.where(well_formed).select(F.col("sequence_no").alias("__seq"), "request_no", "action")

    def first(action: str) -> Column:
        return F.min(F.when(F.col("action") == action, F.col("request_no"))).alias(f"__{action}")

    course = runs.select(
        F.col("sequence_no").alias("__seq"), F.col("status").alias("__status"), F.col("delivered_at").alias("__delivered")
    ).join(moves.groupBy("__seq").agg(first("release"), first("deliver"), first("skip")), "__seq", "left")
    status = F.col("__status")
    allowed = (
        F.when(status == PENDING, F.least("__release", "__skip")).when(status == FAILED, F.col("__skip"))
        .when((status == RELEASED) & F.col("__delivered").isNull(), F.col("__deliver"))
    )
    course = course.withColumn("__first", allowed).withColumn(
        "__then", F.when((status == PENDING) & (F.col("__first") == F.col("__release")), RELEASED).when(status == RELEASED, RELEASED)
        .when(F.col("__first").isNotNull(), SKIPPED)
    )
    # Only of runs that the batch releases is a second change looked for: the first delivery after that.
    released = course.where((status == PENDING) & (F.col("__then") == RELEASED) & F.col("__delivered").isNull())
    released = released.select(F.col("__seq").alias("__released"), F.col("__first").alias("__from"))
    deliveries = skew_join(moves.where("action = 'deliver'"), released, "__seq", "__released", "request_no", "inner", runs_heavy)
    second = deliveries.where("request_no > __from").groupBy(F.col("__seq").alias("__changed")).agg(F.min("request_no").alias("__second"))
    course = course.join(second, F.col("__seq") == F.col("__changed"), "left").select(
        "__seq", status.alias("__before"), F.col("__delivered").alias("__had"), "__first", "__then", "__second"
    )
    judged = skew_join(asked, course, "sequence_no", "__seq", "request_no", "left", runs_heavy)
    later = F.coalesce(F.col("request_no") > F.col("__first"), F.lit(False))
    delivered = F.when(later & (F.col("__before") == RELEASED), F.lit("now")).when(
        F.coalesce(F.col("request_no") > F.col("__second"), F.lit(False)), F.lit("now")
    ).otherwise(F.col("__had"))
    judged = judged.withColumn("__status", F.when(later, F.col("__then")).otherwise(F.col("__before"))).withColumn("__delivered", delivered)
    judged = judged.withColumn("reason", _refusal())
    return judged.select(*requests.columns, F.col("reason").isNull().alias("accepted"), "reason")


def apply_requests(runs: DataFrame, checked: DataFrame, now: datetime) -> DataFrame:
    """The ledger after the accepted requests of a batch: of each action at most one to a run, so that their order no
    longer matters, but that a release comes before a delivery."""
    moment = F.date_format(F.lit(now), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0+00:00'")
    parts = F.struct("actor", "approver", "imported_record_count", "notes")
    done = checked.where("accepted").groupBy(F.col("sequence_no").alias("__seq")).agg(
        *[F.first(F.when(F.col("action") == action, parts), ignorenulls=True).alias(f"__{action}") for action in ("release", "deliver", "skip")]
    )

    def changed(name: str, action: str, value: Column) -> Column:
        return F.when(F.col(f"__{action}").isNotNull(), value).otherwise(F.col(name))

    updates = {
        "status": F.when(F.col("__skip").isNotNull(), SKIPPED).otherwise(changed("status", "release", F.lit(RELEASED))),
        "operated_by": changed("operated_by", "release", F.col("__release.actor")),
        "approved_by": changed("approved_by", "release", F.col("__release.approver")),
        "released_at": changed("released_at", "release", moment),
        "delivered_at": changed("delivered_at", "deliver", moment),
        "delivered_by": changed("delivered_by", "deliver", F.col("__deliver.actor")),
        "imported_record_count": changed("imported_record_count", "deliver", F.col("__deliver.imported_record_count")),
        "delivery_notes": changed("delivery_notes", "deliver", F.col("__deliver.notes")),
    }
    joined = runs.join(done, F.col("sequence_no") == F.col("__seq"), "left")
    return joined.select(*[updates.get(name, F.col(name)).alias(name) for name in runs.columns])


def audit_entries(checked: DataFrame, now: datetime) -> DataFrame:
    """What the audit log records for the accepted requests of a batch."""
    number = F.concat(F.lit("#"), F.col("sequence_no").cast("string"))
    words = F.create_map(*[F.lit(w) for pair in (("release", "export_released"), ("deliver", "export_delivered"), ("skip", "export_skipped")) for w in pair])
    detail = (
        F.when(F.col("action") == "release", F.concat(number, F.lit(" approved by "), F.col("approver")))
        .when((F.col("action") == "skip") & (F.trim(F.coalesce("notes", F.lit(""))) != ""), F.concat(number, F.lit(": "), F.col("notes")))
        .otherwise(number)
    )
    return checked.where("accepted").select(
        F.date_format(F.lit(now), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0+00:00'").alias("timestamp"),
        F.col("actor").alias("username"), words[F.col("action")].alias("action"), detail.alias("detail"),
    )
