"""Lifecycle folding, escalation and acknowledgement."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from meterline.config import LIFECYCLE
from meterline.operators import incidents as inc
from meterline.operators import ops


def walk(requests):
    state, out = "OPEN", []
    for wanted in requests:
        before = state
        if wanted in LIFECYCLE[state]:
            state = wanted
        kind = "unchanged" if wanted == before else "applied" if state != before else "rejected"
        out.append((before, wanted, state, kind))
    return out


@pytest.mark.parametrize("chunk", [2, 7, 1000])
def test_fold_equals_a_step_by_step_walk(spark, chunk):
    rng = random.Random(chunk)
    # One incident owns most requests; small chunks need several levels.
    sizes = {"hot": 120, "a": 1, "b": 2, "c": 9, "d": 4}
    asked = {k: [rng.choice(list(LIFECYCLE)) if rng.random() < 0.7 else "OPEN" for _ in range(n)] for k, n in sizes.items()}
    rows = [(k, i, w) for k, ws in asked.items() for i, w in enumerate(ws)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "incident_id string, seq long, to_status string").withColumn("at", F.timestamp_seconds("seq"))
    got = {}
    for r in inc.apply_transitions(df, chunk=chunk).orderBy("incident_id", "step").collect():
        got.setdefault(r.incident_id, []).append((r.from_status, r.to_status, r.status, r.outcome))
    assert got == {k: walk(ws) for k, ws in asked.items()}


def incidents(spark):
    rows = [("I1", "OPEN", False, "2026-01-01 08:00:00"), ("I2", "IN_PROGRESS", False, "2026-01-01 07:59:59"), ("I3", "OPEN", True, "2026-01-01 01:00:00"),
            ("I4", "RESOLVED", False, "2026-01-01 01:00:00"), ("I5", "OPEN", False, "2026-01-01 13:00:00")]
    df = spark.createDataFrame(rows, "incident_id string, status string, escalated_flag boolean, at string")
    return df.select(
        "incident_id", "status", "escalated_flag", F.col("at").cast("timestamp").alias("created_at"), F.col("at").cast("timestamp").alias("updated_at"),
        F.lit("L1").alias("assigned_to"), F.lit("B").alias("batch_id"), F.lit("P1").alias("severity"), F.lit("d").alias("short_description"),
    )


def test_escalation_threshold_is_strict(spark):
    swept = {r.incident_id: r for r in inc.escalate(incidents(spark), "2026-01-01 12:00:00").collect()}
    assert {k for k, r in swept.items() if r.escalated_flag} == {"I2", "I3"}
    assert swept["I2"].assigned_to == "Data Engineering L2" and swept["I3"].assigned_to == "L1"
    due = inc.escalation_due(incidents(spark), "2026-01-01 12:00:00")
    assert inc.escalation_notes(due, "2026-01-01 12:00:00").first().author == "escalation-manager"
    alert = inc.escalation_alerts(due, "2026-01-01 12:00:00").first()
    assert (alert.alert_type, alert.message) == ("INCIDENT_ESCALATED", "I2 open longer than 240 min: d")


def test_ages_never_go_negative(spark):
    aged = {r.incident_id: r.age_minutes for r in ops.with_age(incidents(spark), "2026-01-01 12:00:00").collect()}
    assert aged == {"I1": 240, "I2": 240, "I3": 660, "I4": 660, "I5": 0}
    left = {r.incident_id: (r.remaining_minutes, r.state) for r in ops.escalation_remaining(ops.with_age(incidents(spark), "2026-01-01 12:00:00")).collect()}
    assert left == {"I1": (0, "past"), "I2": (0, "past"), "I5": (240, "in")}


def test_acknowledging_again_changes_nothing(spark):
    alerts = spark.createDataFrame([(1, False), (2, True), (3, False)], "alert_id long, acknowledged_flag boolean")
    wanted = spark.createDataFrame([(1,), (2,), (9,)], "alert_id long")
    once = inc.acknowledge(alerts, wanted, "2026-01-01 00:00:00")
    assert {r.alert_id: (r.acknowledged_flag, r.newly_acknowledged) for r in once.collect()} == {1: (True, True), 2: (True, False), 3: (False, False)}
    assert inc.acknowledge(once.select("alert_id", "acknowledged_flag"), wanted, "2026-01-02 00:00:00").filter("newly_acknowledged").count() == 0


def test_bulk_close_skips_the_transition_check(spark):
    changed, notes = inc.bulk_lifecycle(incidents(spark), spark.createDataFrame([("I1",), ("I4",)], "incident_id string"), "close", "ok", "2026-01-02 00:00:00")
    assert {r.incident_id for r in changed.filter("status = 'CLOSED'").collect()} == {"I1", "I4"}
    assert [r.note for r in notes.collect()] == ["Closed: ok"] * 2


def test_no_resolved_incident_has_no_mean(spark):
    r = ops.mttr(incidents(spark).filter("status = 'OPEN'")).first()
    assert (r.resolved, r.mttr_minutes) == (0, None)


def test_unknown_status_is_rejected_and_changes_nothing(spark):
    from meterline.operators.incidents import apply_transitions

    asked = [("A", 1, 1, "IN_PROGRESS"), ("A", 2, 2, "BOGUS"), ("A", 3, 3, "RESOLVED"), ("B", 1, 1, "BOGUS")]
    rows = apply_transitions(spark.createDataFrame(asked, "incident_id string, at long, seq long, to_status string")).collect()
    found = {(row.incident_id, row.seq): (row.from_status, row.to_status, row.status, row.outcome) for row in rows}
    assert found["A", 2] == ("IN_PROGRESS", "BOGUS", "IN_PROGRESS", "rejected")
    assert found["A", 3][0] == "IN_PROGRESS" and found["A", 3][2:] == ("RESOLVED", "applied")
    assert found["B", 1][2:] == ("OPEN", "rejected")
