"""Incident lifecycle, escalation, alerts, evidence and queries as event-log jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.config import LIFECYCLE, OPEN_STATES, RUNBOOK_TITLE, Settings
from meterline.functions.joins import lookup_join, number_rows
from meterline.functions.numbers import pad_left
from meterline.functions.times import as_timestamp
from meterline.operators.dq import runbook_of
from meterline.schemas import REJECTED_COLUMNS
from meterline.session import cut_lineage

STATES = list(LIFECYCLE)
FOLD_CHUNK = 64  # the prefix states of a chunk are built by appending, so short chunks are cheapest


# ---- lifecycle ----------------------------------------------------------------------------------


def _step_table() -> Column:
    """Next state for state*n+request: the request when allowed, else the same state."""
    nexts = []
    for state in STATES:
        for wanted in STATES:
            nexts.append(STATES.index(wanted if wanted in LIFECYCLE[state] else state))
    return F.array(*[F.lit(n) for n in nexts])


def _apply(table: Column, state: Column, wanted: Column) -> Column:
    """The next state; an unknown request changes nothing."""
    return F.when(wanted.isNull(), state).otherwise(F.element_at(table, (state * len(STATES) + wanted + 1).cast("int")))


def _identity() -> Column:
    return F.array(*[F.lit(i) for i in range(len(STATES))])


def apply_transitions(
    requests: DataFrame, incident: str = "incident_id", at: str = "at", seq: str = "seq", wanted: str = "to_status",
    initial: str = "OPEN", chunk: int = FOLD_CHUNK,
) -> DataFrame:
    """State before and after every requested transition, with its outcome.

    A run of requests is a function from state to state, and such functions
    compose. Requests of one incident are numbered and cut into chunks of a
    fixed size; each chunk is folded to its function, functions are composed
    level by level, and the start state then travels back down. No list ever
    holds more than `chunk` items, however many requests one incident has.
    """
    codes = F.create_map(*[F.lit(x) for i, s in enumerate(STATES) for x in (s, i)])
    names = F.array(*[F.lit(s) for s in STATES])
    table = _step_table()
    numbered = number_rows(requests, [incident], [F.col(at).asc(), F.col(seq).asc()], "n")
    leaf = cut_lineage(
        numbered.select(
            F.col(incident).alias("k"), (F.col("n") - 1).alias("pos"), F.col(at).alias("at"), F.col(seq).alias("seq"),
            F.try_element_at(codes, F.col(wanted)).alias("wanted"), F.col(wanted).alias("asked"),
        )
    )
    longest = leaf.agg(F.max("pos")).first()[0]

    def parent(pos: str) -> Column:
        return F.floor(F.col(pos) / chunk).cast("long")

    # Up: the function of every chunk at every level.
    level = leaf.select("k", "pos", F.transform(_identity(), lambda s: _apply(table, s, F.col("wanted"))).alias("f"))
    levels, size = [], longest
    while size is not None:
        levels.append(level)
        if size < chunk:
            break
        folded = level.groupBy("k", parent("pos").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("pos", "f"))).alias("fs"))
        composed = F.aggregate(
            "fs", _identity(), lambda acc, g: F.transform(acc, lambda s: F.element_at(g["f"], s + 1))
        )
        level = cut_lineage(folded.select("k", F.col("chunk").alias("pos"), composed.alias("f")))
        size = size // chunk

    # Down: the state in which every item starts.
    start = None
    for level in reversed(levels):
        grouped = level.groupBy("k", parent("pos").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("pos", "f"))).alias("fs"))
        if start is None:
            grouped = grouped.withColumn("s0", F.lit(STATES.index(initial)))
        else:
            grouped = grouped.join(start.select("k", F.col("pos").alias("chunk"), F.col("s").alias("s0")), ["k", "chunk"])
        states = F.aggregate(
            "fs", F.array("s0"), lambda acc, g: F.array_append(acc, F.element_at(g["f"], F.element_at(acc, -1) + 1))
        )
        # Item i starts in the state that item i-1 left behind; the state after the last item pairs with nothing.
        paired = F.explode(F.arrays_zip(F.col("fs"), states)).alias("z")
        start = grouped.select("k", paired).filter("z.fs is not null").select(
            "k", F.col("z.fs.pos").alias("pos"), F.col("z").getField("1").alias("s")
        )
    if start is None:
        start = leaf.select("k", "pos", F.lit(0).alias("s"))

    done = leaf.join(start, ["k", "pos"])
    after = _apply(table, F.col("s"), F.col("wanted"))
    unchanged, rejected = F.col("wanted") == F.col("s"), after == F.col("s")
    outcome = F.when(unchanged, "unchanged").when(rejected, "rejected").otherwise("applied")
    return done.select(
        F.col("k").alias(incident), (F.col("pos") + 1).alias("step"), "at", "seq",
        F.element_at(names, F.col("s") + 1).alias("from_status"), F.col("asked").alias("to_status"),
        F.element_at(names, after + 1).alias("status"), outcome.alias("outcome"),
    )


def final_states(applied: DataFrame, incident: str = "incident_id") -> DataFrame:
    """Last state of each incident with how many requests were applied and rejected."""
    return applied.groupBy(incident).agg(
        F.max_by("status", "step").alias("status"),
        F.count_if(F.col("outcome") == "applied").alias("applied"),
        F.count_if(F.col("outcome") == "rejected").alias("rejected"),
        F.count(F.lit(1)).alias("requests"),
    )


# ---- escalation and alerts ----------------------------------------------------------------------


def escalation_due(incidents: DataFrame, as_of: str, settings: Settings = Settings()) -> DataFrame:
    """Open, unescalated incidents created strictly before the threshold."""
    cutoff = as_timestamp(as_of) - F.make_dt_interval(mins=F.lit(settings.escalation_threshold_minutes))
    return incidents.filter(F.col("status").isin(OPEN_STATES) & ~F.col("escalated_flag") & (F.col("created_at") < cutoff))


def escalate(incidents: DataFrame, as_of: str, settings: Settings = Settings()) -> DataFrame:
    """The incident table after the sweep."""
    cutoff = as_timestamp(as_of) - F.make_dt_interval(mins=F.lit(settings.escalation_threshold_minutes))
    due = F.col("status").isin(OPEN_STATES) & ~F.col("escalated_flag") & (F.col("created_at") < cutoff)
    return (
        incidents.withColumn("_due", due)
        .withColumn("escalated_flag", F.col("escalated_flag") | F.col("_due"))
        .withColumn("assigned_to", F.when(F.col("_due"), settings.escalation_group).otherwise(F.col("assigned_to")))
        .withColumn("updated_at", F.when(F.col("_due"), as_timestamp(as_of)).otherwise(F.col("updated_at")))
        .drop("_due")
    )


def swept(incidents: DataFrame, sweeps: Column, settings: Settings = Settings()) -> DataFrame:
    """The incident table after a series of sweeps, with `escalated_at`, null where none found the incident overdue.

    `sweeps` is an array of times. Each open, unescalated incident goes to the first sweep strictly after its threshold.
    """
    threshold = F.col("created_at") + F.make_dt_interval(mins=F.lit(settings.escalation_threshold_minutes))
    first = F.array_min(F.filter("_sweeps", lambda at: at > threshold))
    due = F.when(F.col("status").isin(OPEN_STATES) & ~F.col("escalated_flag"), first)
    return (
        incidents.withColumn("_sweeps", sweeps)
        .withColumn("escalated_at", due)
        .drop("_sweeps")
        .withColumn("escalated_flag", F.col("escalated_flag") | F.col("escalated_at").isNotNull())
        .withColumn("assigned_to", F.when(F.col("escalated_at").isNotNull(), settings.escalation_group).otherwise(F.col("assigned_to")))
        .withColumn("updated_at", F.coalesce("escalated_at", "updated_at"))
    )


def escalation_notes(due: DataFrame, as_of: Column | str, settings: Settings = Settings()) -> DataFrame:
    minutes, group = settings.escalation_threshold_minutes, settings.escalation_group
    return due.select(
        "incident_id",
        F.lit(f"Open longer than {minutes} minutes; now with {group}.").alias("note"),
        F.lit("escalation-manager").alias("author"),
        as_timestamp(as_of).alias("created_at"),
    )


def _alert(kind: Column, severity: Column, message: Column, at: Column, settings: Settings) -> list[Column]:
    channels = F.array_join(F.array(*[F.lit(c) for c in settings.alert_channels or ("console",)]), ",")
    return [
        at.alias("created_at"), "batch_id", kind.alias("alert_type"), severity.alias("severity"), message.alias("message"),
        channels.alias("channels"),
    ]


def incident_alerts(incidents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    text = F.concat(F.col("incident_id"), F.lit(": "), F.col("short_description"))
    return incidents.select(*_alert(F.col("incident_type"), F.col("severity"), text, F.col("created_at"), settings))


def escalation_alerts(due: DataFrame, as_of: Column | str, settings: Settings = Settings()) -> DataFrame:
    text = F.concat(
        F.col("incident_id"), F.lit(f" open longer than {settings.escalation_threshold_minutes} min: "), F.col("short_description")
    )
    return due.select(*_alert(F.lit("INCIDENT_ESCALATED"), F.col("severity"), text, as_timestamp(as_of), settings))


def completion_alerts(batches: DataFrame, as_of: Column | str, settings: Settings = Settings()) -> DataFrame:
    """One summary per batch; `batches` has batch_id, business_date, files, incidents, escalations."""
    extra = F.when(
        F.col("escalations") > 0, F.concat(F.lit(", "), F.col("escalations").cast("string"), F.lit(" handed over"))
    ).otherwise("")
    text = F.concat(
        F.format_string("Run %s of %s: files %d, incidents %d", "batch_id", "business_date", "files", "incidents"), extra
    )
    severity = F.when(F.col("incidents") > 0, "WARN").otherwise("INFO")
    return batches.select(*_alert(F.lit("PIPELINE_COMPLETED"), severity, text, as_timestamp(as_of), settings))


def acknowledge(alerts: DataFrame, requests: DataFrame | None, as_of: str) -> DataFrame:
    """Acknowledge the requested alerts, or all of them; earlier acknowledgements stand."""
    if requests is None:
        hit = alerts.withColumn("_hit", F.lit(True))
    else:
        wanted = requests.select("alert_id").distinct().withColumn("_hit", F.lit(True))
        hit = lookup_join(alerts, wanted, ["alert_id"], "left", ["alert_id"])
    newly = F.coalesce(F.col("_hit"), F.lit(False)) & ~F.col("acknowledged_flag")
    return (
        hit.withColumn("newly_acknowledged", newly)
        .withColumn("acknowledged_flag", F.col("acknowledged_flag") | F.col("newly_acknowledged"))
        .withColumn("acknowledged_at", F.when(F.col("newly_acknowledged"), as_timestamp(as_of)))
        .drop("_hit")
    )


def bulk_lifecycle(incidents: DataFrame, ids: DataFrame, action: str, notes: str, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Resolve or close the given incidents without a transition check, with a note for each."""
    target = {"resolve": "RESOLVED", "close": "CLOSED"}[action]
    lead = {"resolve": "Resolution: ", "close": "Closed: "}[action]
    wanted = ids.select("incident_id").distinct().withColumn("_hit", F.lit(True))
    marked = lookup_join(incidents, wanted, ["incident_id"], "left", ["incident_id"])
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    changed = (
        marked.withColumn("status", F.when(hit, target).otherwise(F.col("status")))
        .withColumn("resolution_notes", F.when(hit, notes))
        .withColumn("updated_at", F.when(hit, as_timestamp(as_of)).otherwise(F.col("updated_at")))
    )
    written = changed.filter(hit).select(
        "incident_id", F.lit(lead + notes).alias("note"), F.lit("L1 Support").alias("author"), as_timestamp(as_of).alias("created_at")
    )
    return changed.drop("_hit"), written


# ---- reading ------------------------------------------------------------------------------------


def incident_detail(incidents: DataFrame, notes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each incident's header, notes (newest first) and evidence (oldest first) as ordered rows.

    Rows rather than nested lists, because the number of notes is not bounded.
    `notes` has incident_id, created_at, note_id, note; `evidence` has
    incident_id, created_at, evidence_id, evidence_type.
    """
    micros = F.unix_micros("created_at")
    head = incidents.select(
        "incident_id", F.lit(0).alias("section"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("tie"),
        F.concat_ws(" | ", "severity", "status", "short_description").alias("text"),
    )
    noted = notes.select(
        "incident_id", F.lit(1).alias("section"), (-micros).alias("place"), (-F.col("note_id")).alias("tie"), F.col("note").alias("text")
    )
    proof = evidence.select(
        "incident_id", F.lit(2).alias("section"), micros.alias("place"), F.col("evidence_id").alias("tie"),
        F.col("evidence_type").alias("text"),
    )
    return head.unionByName(noted).unionByName(proof).orderBy("incident_id", "section", "place", "tie")


def incident_query(
    incidents: DataFrame, status: str | None = None, severity: str | None = None, incident_type: str | None = None, limit: int | None = None
) -> DataFrame:
    """Matching incidents, newest first; all of them unless a limit is asked for."""
    for column, wanted in (("status", status), ("severity", severity), ("incident_type", incident_type)):
        if wanted is not None:
            incidents = incidents.filter(F.col(column) == wanted)
    ordered = incidents.orderBy(F.col("created_at").desc(), F.col("incident_id").desc())
    return ordered if limit is None else ordered.limit(int(limit))


def likely_causes(incidents: DataFrame, checks: DataFrame, considered: int = 8, shown: int = 3) -> DataFrame:
    """The newest non-passing checks of each incident's batch as up to three cause lines.

    Checks are cut to the newest eight per batch first, so each incident meets
    at most eight rows.
    """
    newest = Window.partitionBy("batch_id").orderBy(F.col("executed_at").desc(), F.col("check_id").desc())
    weak = checks.filter(F.col("status") != "PASS").withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= considered)
    line = F.concat(F.lit("- "), F.col("check_name"), F.lit(": "), F.coalesce("error_details", "status"))
    per_batch = weak.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("considered"),
        F.sort_array(F.collect_list(F.when(F.col("place") <= shown, F.struct("place", line.alias("line"))))).alias("lines"),
    )
    per_batch = cut_lineage(per_batch)
    joined = lookup_join(incidents.select("incident_id", "batch_id"), per_batch, ["batch_id"], "left", ["incident_id"])
    none = "- every check of this batch passed"
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return joined.select(
        "incident_id", F.coalesce("considered", F.lit(0)).alias("checks_considered"), F.coalesce(text, F.lit(none)).alias("causes")
    )


def handoff_lines(incidents: DataFrame, playbook: dict[str, tuple[str, Sequence[str]]] | None = None) -> DataFrame:
    """The hand-off text of every incident, one row per line.

    `playbook` maps an incident type to its impact sentence and next steps.
    """
    titles = F.create_map(*[F.lit(x) for p in RUNBOOK_TITLE.items() for x in p])
    book = runbook_of(F.col("incident_type"))
    advice = playbook or {}
    kind = F.col("incident_type")
    impact = F.coalesce(*[F.when(kind == t, F.lit(i)) for t, (i, _) in advice.items()], F.lit("Impact not assessed yet."))
    steps = F.coalesce(
        *[F.when(kind == t, F.array(*[F.lit(f"- {x}") for x in s])) for t, (_, s) in advice.items()],
        F.array().cast("array<string>"),
    )

    def labelled(label: str, value: Column) -> Column:
        return F.concat(F.lit(label), value)

    text = F.concat(
        F.array(
            labelled("# Escalation handoff: ", F.col("incident_id")),
            labelled("**Incident:** ", F.col("short_description")),
            F.concat_ws(
                " | ", labelled("**Type:** ", kind), labelled("**Severity:** ", F.col("severity")), labelled("**Status:** ", F.col("status"))
            ),
            labelled("**Runbook:** ", F.concat_ws(" ", book, titles[book])),
            labelled("**Impact:** ", impact),
            *[labelled(f"- {c.capitalize()}: ", F.coalesce(f"affected_{c}", F.lit("n/a"))) for c in ("file", "table", "check")],
        ),
        steps,
    )
    return incidents.select("batch_id", "incident_id", F.posexplode(text).alias("n", "line")).select(
        "batch_id", "incident_id", F.lit("escalation_handoff.md").alias("artefact"), pad_left("n", 4).alias("key"), "line"
    )


def evidence_lines(
    incidents: DataFrame, checks: DataFrame, rejected: DataFrame, files: DataFrame, tasks: DataFrame,
    playbook: dict[str, tuple[str, Sequence[str]]] | None = None,
) -> DataFrame:
    """The evidence packages as rows of batch, incident, artefact, ordering key and line.

    What belongs to a batch (checks, rejected rows, files, tasks) appears once
    with a null incident, however many incidents the batch raised; summaries
    and hand-offs carry their incident. Nothing is sampled.
    """

    def items(df: DataFrame, artefact: str, key: str, *fields: str | Column) -> DataFrame:
        return df.select(
            "batch_id", F.lit(None).cast("string").alias("incident_id"), F.lit(artefact).alias("artefact"),
            F.col(key).cast("string").alias("key"), F.to_json(F.struct(*fields)).alias("line"),
        )

    affected = F.struct(*[F.col(f"affected_{c}").alias(c) for c in ("file", "table", "check")]).alias("affected")
    summary = incidents.select(
        "batch_id", "incident_id", F.lit("incident_summary.json").alias("artefact"), F.lit("").alias("key"),
        F.to_json(
            F.struct(
                "incident_id", "severity", "status", "incident_type", "short_description", "batch_id", "run_id", affected,
                runbook_of(F.col("incident_type")).alias("runbook"),
            )
        ).alias("line"),
    )
    weak = checks.filter(F.col("status") != "PASS")
    return (
        summary.unionByName(handoff_lines(incidents, playbook))
        .unionByName(
            items(weak, "query_results.json", "check_id", "check_name", "status", "severity", "expected_value", "actual_value", "error_details")
        )
        .unionByName(items(rejected, "failed_rows.json", "record_id", *REJECTED_COLUMNS))
        .unionByName(items(files, "files.json", "file_name", "file_name", "dataset", "file_status"))
        .unionByName(items(tasks, "tasks.json", "sequence", "task_id", "status", "duration_seconds", "error_message"))
    )
