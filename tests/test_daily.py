"""The daily run: fifteen days with one planted defect each, and the cases no such day covers."""

from __future__ import annotations

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from meterline.config import default_config
from meterline.plans.backfill import backfill
from meterline.plans.daily import ENERGY, run_batches
from meterline.sources import sinks

CONFIG = default_config()
HEADERS = {
    "energy_consumption": "record_id,site_id,reading_date,energy_kwh,emissions_co2e",
    "carbon_emissions": "record_id,site_id,reading_date,emissions_co2e,scope",
    "site_master": "site_id,site_name,country,region,site_type,effective_from_date",
}
FIRST = dt.date(2026, 8, 16)
DAYS = [FIRST + dt.timedelta(i) for i in range(15)]

# (executed, passed, failed, health) by day of month
EXPECTED = {
    19: (37, 35, 2, "AMBER"), 21: (31, 30, 1, "RED"), 23: (37, 34, 2, "RED"), 25: (35, 33, 1, "RED"), 26: (35, 32, 2, "RED"),
    27: (37, 35, 2, "RED"), 28: (37, 34, 3, "RED"),
}
INCIDENTS = {
    19: [("DUPLICATE_RECORDS", "P3")], 21: [("FILE_MISSING", "P2")], 23: [("NULL_VALUES", "P2")], 25: [("SCHEMA_DRIFT", "P1")],
    26: [("CHECKSUM_MISMATCH", "P2"), ("FRESHNESS_FAILURE", "P2")], 27: [("FRESHNESS_FAILURE", "P2"), ("ROW_COUNT_MISMATCH", "P2")],
    28: [("DUPLICATE_RECORDS", "P3"), ("SLA_BREACH", "P2")],
}


def lines_of(day, dataset):
    rows = []
    for s in range(1, 25):
        if dataset == "site_master":
            rows.append(f"SITE-{s:03d},Site {s},Country {s % 5},EMEA,Office,2023-01-01")
        elif dataset == "energy_consumption":
            rows.append(f"EN-{day:%Y%m%d}-{s:03d},SITE-{s:03d},{day},{100 + s}.50,{10 + s}.25")
        else:
            rows.append(f"CE-{day:%Y%m%d}-{s:03d},SITE-{s:03d},{day},{10 + s}.25,Scope 1+2")
    return rows


def deliver(folder, day, dataset, rows, header=None, expected=None, tampered=False, sidecar=True):
    text = "\n".join([header or HEADERS[dataset], *rows]) + "\n"
    name = f"{dataset}_{day}.csv"
    digest = hashlib.sha256(text.encode()).hexdigest()
    (folder / name).write_text(text + ("\n" if tampered else ""))
    if sidecar:
        card = {"file_name": name, "expected_rows": expected if expected is not None else len(rows), "checksum_sha256": digest}
        (folder / f"{name}.manifest.json").write_text(json.dumps(card))
    return name


def plant(folder, day):
    for dataset in HEADERS:
        rows, extra = lines_of(day, dataset), {}
        if dataset == "energy_consumption":
            if day.day in (19, 28):
                rows = rows + rows[:2]
            if day.day == 23:
                # These two sites emit about 9 % of the total, so the feeds also disagree.
                rows[10:12] = [r.replace(r.split(",")[1], "") for r in rows[10:12]]
            if day.day == 25:
                extra["header"] = "record_id,reading_date,energy_kwh,emissions_co2e"
                rows = [",".join(r.split(",")[:1] + r.split(",")[2:]) for r in rows]
            extra["tampered"] = day.day == 26
            extra["expected"] = 29 if day.day == 27 else None
        if dataset == "carbon_emissions" and day.day == 21:
            continue
        deliver(folder, day, dataset, rows, **extra)


def arrivals_of(spark, days, late=()):
    rows = []
    for day in days:
        for d in CONFIG.manifest.values():
            at = dt.datetime.fromisoformat(f"{day}T{d.expected_arrival}:00") + dt.timedelta(minutes=12)
            if (day, d.name) in late:
                at += dt.timedelta(hours=5)
            rows.append((f"{d.name}_{day}.csv", at))
    return spark.createDataFrame(rows, "file_name string, received_at timestamp")


def days_table(spark, days, number=1):
    rows = [(f"B-{d:%Y%m%d}-{number:02d}", str(d), dt.datetime(d.year, d.month, d.day, 12, 30)) for d in days]
    return spark.createDataFrame(rows, "batch_id string, business_date string, as_of timestamp")


@pytest.fixture(scope="module")
def fortnight(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("zone")
    for day in DAYS:
        plant(folder, day)
    late = {(dt.date(2026, 8, 28), "energy_consumption")}
    return run_batches(spark, str(folder), days_table(spark, DAYS), CONFIG, arrivals_of(spark, DAYS, late))


def test_reports_of_fifteen_days(fortnight):
    got = {int(r.report_date[-2:]): r for r in fortnight.report.collect()}
    assert sorted(got) == [d.day for d in DAYS]
    for day, r in got.items():
        want = EXPECTED.get(day, (37, 37, 0, "GREEN"))
        assert (r.dq_checks_executed, r.dq_checks_passed, r.dq_checks_failed, r.overall_health) == want, day
        assert (r.jobs_executed, r.jobs_succeeded, r.jobs_failed) == (7, 6, 0)
        assert (r.files_expected, r.files_received, r.files_quarantined) == (3, 2 if day == 21 else 3, 1 if day in (25, 26) else 0)
        assert r.reconciliation_status == "PASS"
        assert r.open_incidents == len(INCIDENTS.get(day, []))


def test_incidents_of_fifteen_days(fortnight):
    got = {}
    rows = fortnight.incidents.orderBy("incident_id").collect()
    for r in rows:
        got.setdefault(int(r.batch_id[8:10]), []).append((r.incident_type, r.severity))
    assert {d: sorted(v) for d, v in got.items()} == INCIDENTS
    assert [r.incident_id for r in rows] == [f"INC-{i:06d}" for i in range(1, 11)]


def test_rows_balance(fortnight):
    by_batch = {r.batch_id: r["n"] for r in fortnight.fact.groupBy("batch_id").agg(F.count("*").alias("n")).collect()}
    staged = fortnight.readings.filter((F.col("dataset") == ENERGY) & (F.col("validation_status") == "VALID"))
    valid = {r.batch_id: r["n"] for r in staged.groupBy("batch_id").agg(F.count("*").alias("n")).collect()}
    assert by_batch == valid
    assert by_batch["B-20260823-01"] == 22 and "B-20260825-01" not in by_batch
    assert fortnight.rejected.count() == 6


def test_alerts_follow_incidents(fortnight):
    raised = fortnight.alerts.filter("alert_type not in ('INCIDENT_ESCALATED', 'PIPELINE_COMPLETED')")
    assert raised.count() == 10
    assert fortnight.alerts.filter("channels = 'console,email_stub,webhook_stub'").count() == fortnight.alerts.count()


def test_each_batch_ends_with_a_sweep_and_a_summary(fortnight):
    """An incident is handed over by the batch of the day after; the last day's incidents stay where they are."""
    alerts = fortnight.alerts.collect()
    done = {r.batch_id: (r.severity, r.message) for r in alerts if r.alert_type == "PIPELINE_COMPLETED"}
    assert len(done) == 15
    assert done["B-20260816-01"] == ("INFO", "Run B-20260816-01 of 2026-08-16: files 3, incidents 0")
    assert done["B-20260826-01"] == ("WARN", "Run B-20260826-01 of 2026-08-26: files 3, incidents 2, 1 handed over")
    over = [r for r in alerts if r.alert_type == "INCIDENT_ESCALATED"]
    assert len(over) == 10 and all(str(r.created_at)[8:10] == f"{int(r.batch_id[8:10]) + 1:02d}" for r in over)
    rows = fortnight.incidents.collect()
    assert all(r.escalated_flag and r.assigned_to == CONFIG.settings.escalation_group for r in rows)
    assert fortnight.notes.count() == 10 and fortnight.escalated.count() == 0


@pytest.fixture(scope="module")
def odd_days(spark, tmp_path_factory):
    """One day per case that the fortnight does not cover."""
    folder = tmp_path_factory.mktemp("odd")
    empty, broken, values, orphan, nocard = (dt.date(2026, 9, d) for d in (1, 2, 3, 4, 5))
    for day in (empty, broken, values, orphan, nocard):
        for dataset in HEADERS:
            rows = lines_of(day, dataset)
            if dataset == "energy_consumption":
                if day == empty:
                    rows = []
                if day == broken:
                    rows[4] += ",surplus"
                if day == values:
                    rows[0] = rows[0].replace(str(day), "03/09/2026")
                    rows[1] = rows[1].replace("102.50", "-102.50")
                    rows[2] = rows[2].replace("103.50", "many")
                if day == orphan:
                    rows[0] = rows[0].replace("SITE-001", "SITE-999")
            deliver(folder, day, dataset, rows, sidecar=day != nocard)
    (folder / "energy_consumption_2026-09.csv").write_text("a\n1\n")
    days = (empty, broken, values, orphan, nocard)
    return run_batches(spark, str(folder), days_table(spark, days), CONFIG, arrivals_of(spark, days))


def checks_of(result, day):
    rows = result.checks.filter((F.col("batch_id") == f"B-202609{day:02d}-01") & (F.col("status") != "PASS")).collect()
    return {(r.check_name, r.dataset): (r.status, r.actual_value) for r in rows}


def test_empty_file_is_quarantined(odd_days):
    bad = checks_of(odd_days, 1)
    assert bad[("empty_file_check", ENERGY)] == ("FAIL", "0")
    assert bad[("quarantined_file_check", None)] == ("WARN", "1")
    row = odd_days.files.filter("batch_id = 'B-20260901-01' and dataset = 'energy_consumption'").first()
    stray = odd_days.files.filter("dataset = 'unknown'").collect()
    assert [(r.batch_id, r.file_name, r.file_status, r.zone) for r in stray] == [
        ("B-20260901-01", "energy_consumption_2026-09.csv", "QUARANTINED", "QUARANTINE")
    ]
    assert odd_days.report.filter("report_date = '2026-09-01'").first().files_quarantined == 2
    assert (row.file_status, row.zone, row.error_message) == ("QUARANTINED", "QUARANTINE", "EMPTY_FILE — no data rows")


def test_file_without_a_byte_is_received_and_quarantined(spark, tmp_path):
    day = dt.date(2026, 9, 25)
    for dataset in HEADERS:
        deliver(tmp_path, day, dataset, lines_of(day, dataset))
    (tmp_path / f"{ENERGY}_{day}.csv").write_bytes(b"")
    result = run_batches(spark, str(tmp_path), days_table(spark, [day]), CONFIG, arrivals_of(spark, [day]))
    row = result.files.filter(F.col("dataset") == ENERGY).first()
    assert (row.file_status, row.error_message) == ("QUARANTINED", "EMPTY_FILE — no data rows")
    assert result.checks.filter("check_name = 'file_arrival_check'").count() == 0


def test_broken_record_fails_the_load(odd_days):
    row = odd_days.files.filter("batch_id = 'B-20260902-01' and dataset = 'energy_consumption'").first()
    assert row.file_status == "FAILED" and row.load_error == "record 6 holds 6 fields, the header 5"
    audit = {r.task_id: r.status for r in odd_days.tasks.filter("batch_id = 'B-20260902-01'").collect()}
    assert audit["load_staging_task"] == "FAILED"
    assert {t for t, s in audit.items() if s == "SKIPPED"} == {
        "run_data_quality_checks_task", "load_warehouse_task", "reconcile_source_to_target_task",
    }
    raised = odd_days.incidents.filter("batch_id = 'B-20260902-01'").collect()
    assert [(r.incident_type, r.severity) for r in raised] == [("LOAD_FAILURE", "P1")]
    report = odd_days.report.filter("report_date = '2026-09-02'").first()
    assert (report.jobs_failed, report.reconciliation_status, report.overall_health) == (1, "NO_DATA", "RED")
    assert odd_days.fact.filter("batch_id = 'B-20260902-01'").count() == 0


def test_bad_values_are_rejected(odd_days):
    bad = checks_of(odd_days, 3)
    assert bad[("date_validity_check", ENERGY)] == ("FAIL", "1")
    assert bad[("numeric_range_check", ENERGY)] == ("FAIL", "2")
    assert bad[("rejected_threshold_check", ENERGY)] == ("FAIL", "12.5%")
    got = {r.rejection_reason for r in odd_days.rejected.filter("batch_id = 'B-20260903-01'").collect()}
    assert got == {"invalid_date_format", "range_violation:energy_kwh=-102.5", "invalid_value:energy_kwh"}


def test_unknown_site_breaks_integrity_and_reconciliation(odd_days):
    bad = checks_of(odd_days, 4)
    assert bad[("referential_integrity_check", ENERGY)] == ("FAIL", "1")
    assert bad[("source_to_target_rowcount_recon", None)] == ("FAIL", "23")
    assert bad[("source_to_target_aggregate_recon", None)][0] == "FAIL"
    assert odd_days.report.filter("report_date = '2026-09-04'").first().reconciliation_status == "FAIL"


def test_missing_control_record_only_warns(odd_days):
    bad = checks_of(odd_days, 5)
    assert {k[0] for k in bad} == {"checksum_validation"}
    assert all(v == ("WARN", "no manifest sidecar") for v in bad.values())


def test_replay_is_a_new_batch_and_writes_are_idempotent(spark, tmp_path):
    folder, day = tmp_path / "zone", dt.date(2026, 9, 10)
    folder.mkdir()
    plant(folder, day)
    out = str(tmp_path / "fact")
    for number in (1, 1, 2):
        result = run_batches(spark, str(folder), days_table(spark, [day], number), CONFIG, arrivals_of(spark, [day]))
        sinks.write_batches(result.fact, out)
    got = {r.batch_id: r["n"] for r in spark.read.parquet(out).groupBy("batch_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"B-20260910-01": 24, "B-20260910-02": 24}


def stored(result):
    return {"stored_sites": result.sites, "stored_fact": result.fact, "stored_incidents": result.incidents}


def test_two_calls_equal_one_call(spark, tmp_path):
    """Sites, readings and incident numbers of an earlier call count in a later one."""
    days = [dt.date(2026, 9, 15), dt.date(2026, 9, 17)]
    for day in days:
        for dataset in HEADERS:
            rows = lines_of(day, dataset)
            if dataset == "site_master" and day == days[1]:
                rows = rows[1:]
            if dataset == "energy_consumption":
                rows = rows + rows[:2]
            deliver(tmp_path, day, dataset, rows)
    at = arrivals_of(spark, days)
    whole = run_batches(spark, str(tmp_path), days_table(spark, days), CONFIG, at)
    first = run_batches(spark, str(tmp_path), days_table(spark, days[:1]), CONFIG, at)
    second = run_batches(spark, str(tmp_path), days_table(spark, days[1:]), CONFIG, at, **stored(first))
    for name, columns in {
        "fact": ["batch_id", "record_id", "site_id"], "checks": ["batch_id", "check_name", "dataset", "status", "actual_value"],
        "incidents": ["incident_id", "batch_id", "incident_type"], "report": ["report_date", "dq_checks_failed", "overall_health"],
    }.items():
        both = getattr(first, name).select(columns).unionByName(getattr(second, name).select(columns))
        assert sorted(map(str, both.collect())) == sorted(map(str, getattr(whole, name).select(columns).collect())), name
    assert second.fact.filter("site_id = 'SITE-001'").count() == 1
    assert second.checks.filter("check_name = 'freshness_check'").first().status == "FAIL"


def test_batch_100_comes_after_99(spark, tmp_path):
    day = dt.date(2026, 9, 18)
    plant(tmp_path, day)
    first = run_batches(spark, str(tmp_path), days_table(spark, [day], 99), CONFIG, arrivals_of(spark, [day]))
    deliver(tmp_path, day, "site_master", lines_of(day, "site_master")[1:])
    second = run_batches(spark, str(tmp_path), days_table(spark, [day], 100), CONFIG, arrivals_of(spark, [day]), **stored(first))
    assert second.fact.filter("site_id = 'SITE-001'").count() == 1


SHOWN = {
    "fact": ["batch_id", "record_id", "site_id", "energy_kwh"],
    "checks": ["batch_id", "check_name", "dataset", "status", "actual_value", "error_details", "executed_at"],
    "report": None,
}


def shown(frame, columns):
    return sorted(map(str, frame.select(*(columns or frame.columns)).collect()))


def incidents_of(frame):
    """Incidents without their numbers, which a backfill leaves as they are."""
    rows = frame.select("batch_id", "business_date", "incident_type", "severity", "short_description", "error_message", "created_at").collect()
    return sorted(map(str, rows))


def saved(result, path, names=("fact", "checks")):
    for name in names:
        sinks.write_batches(getattr(result, name), f"{path}/{name}")


def written_batches(path):
    """Batch folders and the files in them."""
    return {p.name: sorted(f.name for f in p.iterdir() if f.suffix == ".parquet") for p in path.iterdir() if p.is_dir()}


def test_backfill_equals_a_fresh_run(spark, tmp_path):
    """Day 1 again after day 5, with other sites and another day's readings: as if all five days were run now."""
    days = [dt.date(2026, 10, d) for d in (1, 2, 3, 4, 5)]
    zone = tmp_path / "zone"
    zone.mkdir()
    for day in days:
        for dataset in HEADERS:
            rows = lines_of(day, dataset)
            if dataset == "site_master":
                # SITE-024 is known from day 1 only, SITE-023 from day 3 on, SITE-022 is never in a later file.
                rows = [r for r in rows if "SITE-024" not in r or day == days[0]]
                rows = [r for r in rows if "SITE-023" not in r or day >= days[2]]
                rows = [r for r in rows if "SITE-022" not in r]
            deliver(zone, day, dataset, rows)
    at = arrivals_of(spark, days)
    first = run_batches(spark, str(zone), days_table(spark, days), CONFIG, at)
    saved(first, str(tmp_path / "kept"))
    before = written_batches(tmp_path / "kept" / "fact")

    # The new file of day 1 lists SITE-022 and SITE-023 but not SITE-024; its energy feed is a day old.
    deliver(zone, days[0], "site_master", [r for r in lines_of(days[0], "site_master") if "SITE-024" not in r])
    done = backfill(spark, str(zone), days_table(spark, days[:1]), CONFIG, first, at)
    fresh = run_batches(spark, str(zone), days_table(spark, days), CONFIG, at)

    out = str(tmp_path / "kept")
    sinks.write_batches(done.run.fact, f"{out}/fact", batches=days_table(spark, days[:1]))
    sinks.write_batches(done.run.checks, f"{out}/checks")
    sinks.write_batches(done.fact, f"{out}/fact", batches=done.fact_batches)
    sinks.write_batches(done.checks, f"{out}/checks")
    for name in ("fact", "checks"):
        assert shown(spark.read.parquet(f"{out}/{name}"), SHOWN[name]) == shown(getattr(fresh, name), SHOWN[name]), name
    dates = {r.report_date for r in done.report.collect()}
    assert shown(done.report, None) == shown(fresh.report.filter(F.col("report_date").isin(*dates)), None)
    rest = first.report.filter(~F.col("report_date").isin(*dates))
    assert shown(rest, None) == shown(fresh.report.filter(~F.col("report_date").isin(*dates)), None)
    gone = done.dropped.unionByName(done.incidents.select("incident_id"))
    log = first.incidents.filter("batch_id <> 'B-20261001-01'").join(gone, "incident_id", "left_anti")
    log = log.unionByName(done.incidents, allowMissingColumns=True).unionByName(done.run.incidents, allowMissingColumns=True)
    assert incidents_of(log) == incidents_of(fresh.incidents)
    assert log.select("incident_id").distinct().count() == log.count()

    # SITE-022 and SITE-024 change days 2 to 5, SITE-023 day 2 only.
    after = written_batches(tmp_path / "kept" / "fact")
    assert {b for b in after if after[b] != before.get(b)} == {f"batch_id=B-202610{d:02d}-01" for d in (1, 2, 3, 4, 5)}


def test_backfill_without_new_sites_touches_no_later_batch(spark, tmp_path):
    days = [dt.date(2026, 10, d) for d in (11, 12, 13)]
    zone = tmp_path / "zone"
    zone.mkdir()
    for day in days:
        plant(zone, day)
    at = arrivals_of(spark, days)
    first = run_batches(spark, str(zone), days_table(spark, days), CONFIG, at)
    # Day 11 comes again as a second batch of its date, with one changed reading and one site more than ever used.
    rows = [r.replace("101.50", "999.50") for r in lines_of(days[0], "energy_consumption")]
    deliver(zone, days[0], "energy_consumption", rows)
    deliver(zone, days[0], "site_master", [*lines_of(days[0], "site_master"), "SITE-900,Site 900,Country 1,EMEA,Office,2023-01-01"])
    again = days_table(spark, days[:1], 2)
    done = backfill(spark, str(zone), again, CONFIG, first, at)
    assert done.run.fact.filter("energy_kwh = 999.5").count() == 1
    assert done.fact_batches.count() == done.check_batches.count() == done.fact.count() == done.incidents.count() == done.dropped.count() == 0
    # Only the freshness of a later batch depends on this batch, and it stays as it was.
    assert {r.report_date for r in done.report.collect()} == {"2026-10-11"}


def test_backfill_of_a_late_delivery_mends_freshness(spark, tmp_path):
    """Day 3 came without energy, so day 4 found a stale warehouse and raised an incident; the file arrives later."""
    days = [dt.date(2026, 10, d) for d in (21, 22, 23, 24)]
    zone = tmp_path / "zone"
    zone.mkdir()
    for day in days:
        for dataset in HEADERS:
            if (day, dataset) != (days[2], ENERGY):
                deliver(zone, day, dataset, lines_of(day, dataset))
    at = arrivals_of(spark, days)
    first = run_batches(spark, str(zone), days_table(spark, days), CONFIG, at)
    stale = first.incidents.filter("incident_type = 'FRESHNESS_FAILURE'").collect()
    assert [r.batch_id for r in stale] == ["B-20261024-01"]
    deliver(zone, days[2], ENERGY, lines_of(days[2], ENERGY))
    done = backfill(spark, str(zone), days_table(spark, days[2:3]), CONFIG, first, at)
    assert [r.batch_id for r in done.check_batches.collect()] == ["B-20261024-01"]
    assert done.fact_batches.count() == 0
    assert [r.incident_id for r in done.dropped.collect()] == [r.incident_id for r in stale]
    assert done.report.filter("report_date = '2026-10-24'").first().overall_health == "GREEN"


def test_a_batch_left_without_rows_loses_its_partition(spark, tmp_path):
    rows = spark.createDataFrame([("B-1", 1), ("B-2", 2)], "batch_id string, v int")
    out = str(tmp_path / "t")
    sinks.write_batches(rows, out)
    sinks.write_batches(rows.filter("batch_id = 'B-1'"), out, batches=rows)
    assert [tuple(r) for r in spark.read.parquet(out).select("batch_id", "v").collect()] == [("B-1", 1)]
    sinks.write_batches(rows.filter("v > 5"), out, batches=rows.filter("batch_id = 'B-1'"))
    assert spark.read.schema(rows.schema).parquet(out).count() == 0
