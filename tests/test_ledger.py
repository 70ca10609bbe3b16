import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from treeloom.operators.ordered import carried, first_match, in_ranges
from treeloom.operators.skew import Heavy, measure_heavy, skew_join
from treeloom.plans import ledger
from treeloom.sources.catalog import by_table, catalog, missing_columns, observed_catalog, suggest_joins

NOW = datetime(2026, 6, 28, 6, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def numbers():
    draw = random.Random(7)
    # Dense runs, a wide hole, and a cluster: ranges of unequal density.
    found = sorted(draw.sample(range(1, 200), 120)) + [50_000] + list(range(90_000, 90_060, 2))
    states = [draw.choice([ledger.PENDING, ledger.RELEASED, ledger.FAILED, ledger.SKIPPED]) for _ in found]
    return dict(zip(found, states))


@pytest.mark.parametrize("rows", [1000, 30, 1])
def test_gap_warnings(spark, numbers, rows):
    runs = spark.createDataFrame(list(numbers.items()), "sequence_no int, status string")
    got = {r[0]: r[1] for r in ledger.gap_warnings(runs, rows).collect()}
    want = {}
    for number, state in numbers.items():
        if state != ledger.PENDING:
            continue
        earlier = [n for n, s in numbers.items() if n < number and s in (ledger.PENDING, ledger.FAILED)]
        top = sorted(earlier, reverse=True)[:3]
        want[number] = None if not top else (
            f"Sequence gap: {len(top)} earlier run(s) are unresolved ({', '.join(f'#{n}' for n in top)}). "
            f"Investigate or skip them before releasing #{number}."
        )
    assert got == want


@pytest.mark.parametrize("rows", [1000, 2])
def test_sequence_gaps(spark, numbers, rows):
    runs = spark.createDataFrame(list(numbers.items()), "sequence_no int, status string")
    got = [r[0] for r in ledger.sequence_gaps(runs, rows).collect()]
    assert sorted(got) == [n for n in range(min(numbers), max(numbers)) if n not in numbers]


def test_ranges_follow_the_key(spark, numbers):
    runs = spark.createDataFrame([(n,) for n in numbers], "sequence_no int")
    rows = in_ranges(runs, "sequence_no", 10).orderBy("sequence_no").collect()
    places = [r["__range"] for r in rows]
    assert places == sorted(places) and max(places.count(p) for p in set(places)) <= 10 and len(set(places)) >= len(numbers) / 10


@pytest.mark.parametrize("fan", [2, 5, 1024])
def test_scan_in_levels(spark, fan):
    draw = random.Random(3)
    values = {n: draw.choice([None, "a", "b", "c"]) for n in range(0, 130, 3)}
    frame = spark.createDataFrame(list(values.items()), "__range long, value string")
    got = {r["__range"]: r["before"] for r in carried(frame, lambda a, b: F.concat(a, b), fan).collect()}
    assert got == {n: "".join(v for m, v in values.items() if m < n and v) or None for n in values}
    assert carried(frame.limit(0), lambda a, b: b, fan).collect() == []


def test_a_hundred_thousand_ranges(spark):
    """One run to a range: the scan has levels, and neither plan nor driver hold the ranges."""
    states = F.expr("case when id % 1000 = 7 then 'Pending' when id % 997 = 3 then 'Failed' else 'Released' end")
    runs = spark.range(1, 100_001).where("id % 5000 <> 0").select(F.col("id").alias("sequence_no"), states.alias("status"))
    assert {r[0] for r in ledger.sequence_gaps(runs, 1).collect()} == set(range(5000, 100_000, 5000))
    got = {r[0]: r[1] for r in ledger.gap_warnings(runs, 1).collect()}
    open_runs = [n for n in range(1, 100_001) if n % 5000 and (n % 1000 == 7 or n % 997 == 3)]
    pending = [n for n in open_runs if n % 1000 == 7]
    assert set(got) == set(pending)
    for number in pending:
        top = [n for n in open_runs if n < number][-3:][::-1]
        assert got[number] is None if not top else f"({', '.join(f'#{n}' for n in top)})" in got[number]


def test_stale_expired_and_next(spark):
    runs = spark.createDataFrame([
        (1, "2026-06-26T06:00:00Z", "Pending", "a" * 64), (2, "2026-06-27T12:00:00Z", "Pending", "short"),
        (3, "never", "Pending", ""), (4, "2026-01-01T00:00:00+02:00", "Released", ""), (5, "never", "Failed", ""),
        (6, "2026-01-01T00:00:00Z", "Pending", ""),
    ], "sequence_no int, extracted_at string, status string, sha256 string").withColumn("record_count", F.lit(1)).withColumn("data_file_name", F.lit("f"))
    shown = {r["sequence_no"]: r for r in ledger.run_list(runs, NOW).collect()}
    assert [n for n, r in shown.items() if r["is_stale"]] == [1, 6]
    assert shown[1]["sha256_short"] == "a" * 12 and shown[2]["sha256_short"] == "short"
    assert [r["sequence_no"] for r in ledger.expired(runs, NOW, 30).collect()] == [4]
    assert sorted(r["sequence_no"] for r in ledger.retained(runs, NOW, 30).collect()) == [1, 2, 3, 5, 6]
    assert ledger.expired(runs, NOW, 0).count() == 0 and ledger.retained(runs, NOW, 0).count() == 6
    assert ledger.next_sequence(runs).first()[0] == 7
    assert ledger.next_sequence(runs.where("false")).first()[0] == 1
    assert [r["sequence_no"] for r in ledger.newest_first(runs).collect()] == [6, 5, 4, 3, 2, 1]


@pytest.mark.parametrize("heavy_rows", [1_000_000, 1])
def test_requests(spark, heavy_rows):
    runs = spark.createDataFrame([
        (1, "Pending", None), (2, "Released", None), (3, "Released", "2026"), (4, "Failed", None), (5, "Pending", None),
    ], "sequence_no int, status string, delivered_at string")
    for name in ("operated_by", "approved_by", "released_at", "delivered_by", "delivery_notes"):
        runs = runs.withColumn(name, F.lit(None).cast("string"))
    runs = runs.withColumn("imported_record_count", F.lit(None).cast("int"))
    asked = [
        (1, 1, "release", "ann", "ANN", None, None), (2, 1, "release", "ann", "zoe", None, None),
        (3, 1, "release", "ann", "Bob", None, None), (4, 1, "skip", "ann", None, None, None),
        (5, 2, "deliver", "ann", None, 9, "fine"), (6, 3, "deliver", "ann", None, 9, None),
        (7, 4, "skip", "ann", None, None, "broken"), (8, 2, "skip", "ann", None, None, None),
        (9, 99, "skip", "ann", None, None, None), (10, 5, "release", "ann", " ", None, None),
        (11, 5, "deliver", "ann", None, 1, None), (12, 2, "deliver", "bob", None, 1, "n" * 2001),
    ]
    requests = spark.createDataFrame(
        asked, "request_no long, sequence_no int, action string, actor string, approver string, imported_record_count int, notes string"
    )
    users = spark.createDataFrame([("ann",), ("BOB",)], "username string")
    checked = ledger.check_requests(runs, requests, users, heavy_rows)
    got = {r["request_no"]: (r["accepted"], r["reason"]) for r in checked.collect()}
    assert sorted(n for n, (ok, _) in got.items() if ok) == [3, 5, 7]
    assert got[1][1] == "same_person" and got[2][1] == "unknown_approver"
    assert got[4][1] == "overtaken" and got[6][1] == "delivered_before"
    assert got[8][1] == "not_skippable" and got[9][1] == "no_run"
    assert got[10][1] == "no_approver" and got[11][1] == "not_released" and got[12][1] == "long_notes"
    after = {r["sequence_no"]: r for r in ledger.apply_requests(runs, checked, NOW).collect()}
    assert (after[1]["status"], after[1]["operated_by"], after[1]["approved_by"]) == ("Released", "ann", "Bob")
    assert after[1]["released_at"].startswith("2026-06-28T06:00:00")
    assert (after[2]["delivered_by"], after[2]["imported_record_count"], after[2]["delivery_notes"]) == ("ann", 9, "fine")
    assert after[4]["status"] == "Skipped" and after[5]["status"] == "Pending"
    audit = {r["detail"]: r["action"] for r in ledger.audit_entries(checked, NOW).collect()}
    assert audit == {"#1 approved by Bob": "export_released", "#2": "export_delivered", "#4: broken": "export_skipped"}


@pytest.mark.parametrize("heavy_rows", [1_000_000, 5])
def test_requests_in_turn(spark, heavy_rows):
    """Against a walk through the requests one by one."""
    draw = random.Random(11)
    states = {n: (draw.choice([ledger.PENDING, ledger.PENDING, ledger.RELEASED, ledger.FAILED, ledger.SKIPPED]), draw.choice([None, None, "then"])) for n in range(12)}
    asked = [
        (no, draw.choice([0, 0, *range(14)]), draw.choice(["release", "deliver", "skip", "deliver", "reopen"]), draw.choice(["ann", "bob"]),
         draw.choice(["Ann", "BOB", "zoe", " ", None]), no, draw.choice([None, "n" * 2001, "fine"]))
        for no in range(400)
    ]
    runs = spark.createDataFrame([(n, s, d) for n, (s, d) in states.items()], "sequence_no int, status string, delivered_at string")
    for name in ("operated_by", "approved_by", "released_at", "delivered_by", "delivery_notes"):
        runs = runs.withColumn(name, F.lit(None).cast("string"))
    runs = runs.withColumn("imported_record_count", F.lit(None).cast("int"))
    requests = spark.createDataFrame(
        asked, "request_no long, sequence_no int, action string, actor string, approver string, imported_record_count int, notes string"
    )
    users = spark.createDataFrame([("ann",), ("BOB",)], "username string")
    want, now = {}, dict(states)
    for no, run, action, actor, approver, _, notes in asked:
        state, delivered = now.get(run, (None, None))
        who = (approver or "").lower()
        if action == "release" and not who.strip():
            want[no] = "no_approver"
        elif action == "release" and who == actor:
            want[no] = "same_person"
        elif action == "release" and who == "zoe":
            want[no] = "unknown_approver"
        elif action == "reopen":
            want[no] = "unknown_action"
        elif state is None:
            want[no] = "no_run"
        elif action == "release":
            want[no] = None if state == ledger.PENDING else "not_pending"
        elif action == "skip":
            want[no] = None if state in (ledger.PENDING, ledger.FAILED) else "not_skippable"
        elif state != ledger.RELEASED:
            want[no] = "not_released"
        elif delivered:
            want[no] = "delivered_before"
        else:
            want[no] = "long_notes" if notes and len(notes) > 2000 else None
        if want[no] is None:
            now[run] = {"release": (ledger.RELEASED, delivered), "skip": (ledger.SKIPPED, delivered), "deliver": (state, "now")}[action]
    judged = ledger.judge_in_turn(runs, requests, users, heavy_rows)
    assert {r["request_no"]: r["reason"] for r in judged.collect()} == want
    assert all(r["accepted"] == (r["reason"] is None) for r in judged.collect())
    after = {r["sequence_no"]: r for r in ledger.apply_requests(runs, judged, NOW).collect()}
    assert {n: r["status"] for n, r in after.items()} == {n: s for n, (s, _) in now.items()}
    assert {n for n, r in after.items() if r["delivered_by"]} == {n for n, (_, d) in now.items() if d == "now"}


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_joins_equal_plain_joins(spark, how):
    rows = [(n, "hot" if n % 3 else None if n % 2 else f"k{n}") for n in range(90)]
    many = spark.createDataFrame(rows, "n int, k string")
    few = spark.createDataFrame([("hot", 1), ("k0", 2), ("k6", 3), ("k999", 4)], "key string, v int")
    [heavy] = measure_heavy(many, "k", heavy_rows=5)
    assert set(heavy.values) == {"hot", None} and heavy.salts > 2
    def run(h):
        return sorted(map(str, skew_join(many, few, "k", "key", "n", how, h).collect()))
    assert run(heavy) == run(Heavy())


def test_both_sides_may_be_heavy(spark):
    many = spark.createDataFrame([(n, "hot" if n % 2 else f"k{n}") for n in range(40)], "n int, k string")
    few = spark.createDataFrame([(m, "hot" if m % 3 else "k4") for m in range(30)], "m int, key string")
    [left], [right] = measure_heavy(many, "k", heavy_rows=5), measure_heavy(few, "key", heavy_rows=5)
    assert "hot" in left.values and {"hot", "k4"} == set(right.values)
    plain = skew_join(many, few, "k", "key", "n", "inner", Heavy())
    salted = skew_join(many, few, "k", "key", "n", "inner", left, few_heavy=right, few_id="m")
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, plain.collect()))


def test_first_match(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("b", 5, "y"), (None, 0, "z")], "k string, o int, v string")
    assert sorted(map(tuple, first_match(rows, "k", "o", ["o", "v"]).collect())) == [("a", 1, None), ("b", 5, "y")]


def test_catalog(spark, shop):
    resolve, _ = shop
    found = observed_catalog(
        resolve, ["city", "maker", "address"], {"city": "id", "maker": "id"},
        [("maker", "city_id", "city", "id"), ("address", "maker_id", "maker", "id")],
    )
    rows = {(r["table_name"], r["column_name"]): r for r in found.collect()}
    assert rows["city", "id"]["primary_key"] and not rows["maker", "id"]["primary_key"]
    assert rows["maker", "id"]["nullable"] and not rows["city", "name"]["nullable"]
    assert (rows["maker", "city_id"]["fk_table"], rows["maker", "city_id"]["ordinal"]) == ("city", 4)
    assert [tuple(r) for r in suggest_joins(found, "maker").collect()] == [("address", "maker_id", "id")]
    assert suggest_joins(found, "maker", [("address", "maker_id", "id")]).count() == 0
    tables = {r["table_name"]: [c["column_name"] for c in r["columns"]] for r in by_table(found).collect()}
    assert tables["city"] == ["id", "name"]
    assert missing_columns(resolve("city"), ["id", "guid"]) == ["guid"]


def test_catalog_takes_one_reference_per_column(spark):
    columns = spark.createDataFrame([("t", 1, "c", "int", True)], "table_name string, ordinal int, column_name string, data_type string, nullable boolean")
    keys = spark.createDataFrame([], "table_name string, column_name string")
    references = spark.createDataFrame([("t", "c", "b", "id"), ("t", "c", "a", "id")], "table_name string, column_name string, fk_table string, fk_column string")
    rows = catalog(columns, keys, references).collect()
    assert len(rows) == 1 and rows[0]["fk_table"] == "a" and rows[0]["primary_key"] is False
