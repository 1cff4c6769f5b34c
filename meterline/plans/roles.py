"""The driver tables standing in for feeds, warehouse tables and operations tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.config import Check, Config, Delivery, FeedRules, default_config
from meterline.functions.times import make_batch_id
from meterline.schemas import TABLES

EVENT_TYPES = ["click", "view", "purchase", "error", "signup"]
INCIDENT_TYPES = [
    "FILE_MISSING", "FILE_CORRUPTED", "SCHEMA_DRIFT", "EMPTY_FILE", "CHECKSUM_MISMATCH", "DUPLICATE_RECORDS",
    "NULL_VALUES", "RANGE_VIOLATION", "ROW_COUNT_MISMATCH", "LOAD_FAILURE", "SLA_BREACH", "FRESHNESS_FAILURE",
]
CHECK_OF_EVENT = {
    "click": "null_check_mandatory",
    "view": "duplicate_record_check",
    "purchase": "source_to_target_rowcount_recon",
    "error": "file_arrival_check",
    "signup": "custom_check",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def readings_config() -> Config:
    """Feed rules and manifest for the five event feeds."""
    base = default_config()
    energy = base.feeds["energy_consumption"]
    feeds = {
        t: FeedRules(t, energy.required_columns, ["record_id"], energy.mandatory_not_null, energy.numeric_range)
        for t in EVENT_TYPES
    }
    manifest = {t: Delivery(t, f"{t}_{{date}}.csv", f"SRC-{t}", "06:30", 4) for t in EVENT_TYPES}
    checks = {**base.checks, "custom_check": Check("custom_check")}
    del checks["custom_check"]
    return Config(feeds=feeds, manifest=manifest, checks=checks)


def pick(options: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), index.cast("int") + 1)


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text feed with planted defects, one file per day."""
    return feed_of(table(spark, sf_dir, "events"))


def feed_of(e: DataFrame) -> DataFrame:
    """The feed columns of an events table or stream."""
    i = F.col("event_id")
    value = F.col("value").cast("decimal(18,2)")
    iso = F.date_format("ts", "yyyy-MM-dd")
    return e.select(
        i.alias("row_index"),
        F.concat(F.lit("readings_"), iso, F.lit(".csv")).alias("file_name"),
        iso.alias("business_date"),
        make_batch_id(F.col("ts"), 1).alias("batch_id"),
        F.col("event_type").alias("dataset"),
        F.when(i % 50 == 0, F.concat(F.lit("EN-U"), (F.col("user_id") % 3).cast("string")))
        .otherwise(F.concat(F.lit("EN-"), i.cast("string")))
        .alias("record_id"),
        F.when(i % 97 == 0, F.lit("")).otherwise(F.col("user_id").cast("string")).alias("site_id"),
        F.when(i % 89 == 0, F.date_format("ts", "dd-MM-yyyy"))
        .when(i % 101 == 0, F.lit("2024-02-31"))
        .otherwise(iso)
        .alias("reading_date"),
        F.when(i % 83 == 0, F.concat(F.lit("-"), value.cast("string")))
        .when(i % 103 == 0, F.lit("1d"))
        .otherwise(value.cast("string"))
        .alias("energy_kwh"),
        (value * F.lit("0.4").cast("decimal(2,1)")).cast("decimal(18,2)").cast("string").alias("emissions_co2e"),
        "ts",
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site dimension. nation has 25 rows and region 5 at every scale."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return (
        s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
        .join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
        .select(
            F.col("s_suppkey").cast("string").alias("site_id"),
            F.col("s_name").alias("site_name"),
            F.col("n_name").alias("country"),
            F.col("r_name").alias("region"),
            F.concat(F.lit("T"), (F.col("s_suppkey") % 6).cast("string")).alias("site_type"),
            (F.col("s_suppkey") % 10 != 0).alias("active_flag"),
        )
    )


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warehouse fact rows; `side` F plays the source and O the target of reconciliations."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        make_batch_id(F.col("l_shipdate"), 1).alias("batch_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("record_id"),
        F.col("l_suppkey").cast("string").alias("site_id"),
        F.to_date("l_shipdate").alias("reading_date"),
        F.col("l_quantity").alias("energy_kwh"),
        F.col("l_extendedprice").alias("emissions_co2e"),
        F.col("l_returnflag").alias("source_file_name"),
        F.col("l_linestatus").alias("side"),
        F.col("l_shipdate").alias("loaded_at"),
    )


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded check results, one per event."""
    e = table(spark, sf_dir, "events")
    name = F.lit(None).cast("string")
    for event, check in CHECK_OF_EVENT.items():
        name = F.when(F.col("event_type") == event, check).otherwise(name)
    return e.select(
        F.col("event_id").alias("check_id"),
        make_batch_id(F.col("ts"), 1).alias("batch_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("business_date"),
        name.alias("check_name"),
        F.when(F.col("event_type") == "purchase", "RECONCILIATION").otherwise("COMPLETENESS").alias("check_category"),
        F.concat(F.lit("table_"), (F.col("user_id") % 3).cast("string")).alias("table_name"),
        F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("col_"), (F.col("user_id") % 4).cast("string"))).alias(
            "column_name"
        ),
        F.when(F.col("value") < 100, "PASS").when(F.col("value") < 150, "WARN").otherwise("FAIL").alias("status"),
        F.lit("0").alias("expected_value"),
        F.col("value").cast("decimal(18,2)").cast("string").alias("actual_value"),
        F.lit("0").alias("threshold_value"),
        pick(["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"], F.col("user_id") % 5).alias("severity"),
        F.when(F.col("value") >= 100, F.concat(F.lit("value "), F.col("value").cast("decimal(18,2)").cast("string")))
        .alias("error_details"),
        F.col("ts").alias("executed_at"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task audit rows, one per order."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    start = F.col("o_orderdate") + F.make_dt_interval(mins=(k % 1440).cast("int"))
    seconds = F.when(k % 13 != 0, (c % 100).cast("double"))
    status = (
        F.when(F.col("o_orderstatus") == "P", "SUCCESS").when(F.col("o_orderstatus") == "O", "SKIPPED").otherwise("FAILED")
    )
    return o.select(
        F.concat(F.lit("run-"), k.cast("string")).alias("run_id"),
        make_batch_id(F.col("o_orderdate"), 1).alias("batch_id"),
        F.col("o_orderpriority").alias("task_id"),
        F.concat(F.lit("job "), F.col("o_orderpriority")).alias("job_name"),
        F.lit("LOAD").alias("job_type"),
        k.alias("sequence"),
        start.alias("start_time"),
        F.when(seconds.isNotNull(), start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).alias("end_time"),
        seconds.alias("duration_seconds"),
        status.alias("status"),
        c.alias("rows_read"),
        (c - c % 7).alias("rows_loaded"),
        (c % 7).alias("rows_rejected"),
        F.when(status == "FAILED", F.concat(F.lit("error in "), F.col("o_orderpriority"))).alias("error_message"),
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident log, one incident per order."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = pick(INCIDENT_TYPES, c % 12)
    incident = F.concat(F.lit("INC-"), k.cast("string"))
    return o.select(
        incident.alias("incident_id"),
        k.alias("incident_number"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=(k % 72).cast("int"))).alias("updated_at"),
        make_batch_id(F.col("o_orderdate"), 1).alias("batch_id"),
        F.concat(F.lit("run-"), k.cast("string")).alias("run_id"),
        kind.alias("incident_type"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "P1")
        .when(F.col("o_orderpriority") == "2-HIGH", "P2")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "P3")
        .otherwise("P4")
        .alias("severity"),
        F.when(F.col("o_orderstatus") == "O", "OPEN")
        .when(F.col("o_orderstatus") == "P", "IN_PROGRESS")
        .otherwise("RESOLVED")
        .alias("status"),
        F.concat(kind, F.lit(" on customer "), c.cast("string")).alias("short_description"),
        F.concat(F.lit("file_"), (c % 5).cast("string")).alias("affected_file"),
        F.lit("staging_energy_data").alias("affected_table"),
        F.when(c % 3 != 0, F.lit("null_check_mandatory")).alias("affected_check"),
        F.lit("L1 On-call").alias("assigned_to"),
        (k % 4 == 0).alias("escalated_flag"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert log, one alert per incident."""
    i = incidents(spark, sf_dir)
    return i.select(
        F.col("incident_number").alias("alert_id"),
        "created_at",
        "batch_id",
        F.col("incident_type").alias("alert_type"),
        "severity",
        F.concat_ws(": ", "incident_id", "short_description").alias("message"),
        F.lit("console,email_stub,webhook_stub").alias("channels"),
        (F.col("incident_number") % 3 == 0).alias("acknowledged_flag"),
    )


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested status changes of incident `user_id`."""
    e = table(spark, sf_dir, "events")
    wanted = (
        F.when(F.col("event_type") == "click", "IN_PROGRESS")
        .when(F.col("event_type") == "view", "RESOLVED")
        .when(F.col("event_type") == "purchase", "CLOSED")
        .when(F.col("event_type") == "error", "OPEN")
        .otherwise("IN_PROGRESS")
    )
    return e.select(
        F.col("user_id").alias("incident_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), wanted.alias("to_status")
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delivered file per event type and day, with sizes, arrival and a control record."""
    e = table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    d = e.groupBy(F.col("event_type").alias("dataset"), day.alias("business_date")).agg(
        F.count(F.lit(1)).alias("data_rows"), F.sum("event_id").alias("_ids"), F.sum(F.length("props")).alias("size_bytes")
    )
    name = F.concat(F.col("dataset"), F.lit("_"), F.col("business_date"), F.lit(".csv"))
    expected = F.to_timestamp("business_date") + F.make_dt_interval(hours=F.lit(6), mins=F.lit(30))
    received = F.to_timestamp("business_date") + F.make_dt_interval(
        hours=F.lit(6), mins=((F.col("_ids") * 37) % 420).cast("int")
    )
    digest = F.sha2(F.concat_ws(":", name, F.col("data_rows").cast("string")), 256)
    full = ["record_id", "site_id", "reading_date", "energy_kwh", "emissions_co2e"]
    form = F.col("_ids") % 7

    def header(names: list[str]) -> Column:
        return F.array(*[F.lit(n) for n in names])

    return d.select(
        "dataset",
        "business_date",
        name.alias("file_name"),
        make_batch_id(F.to_date("business_date"), 1).alias("batch_id"),
        F.when(F.col("_ids") % 29 == 0, F.lit(0)).otherwise(F.col("data_rows")).cast("long").alias("data_rows"),
        "size_bytes",
        expected.alias("expected_arrival_at"),
        received.alias("received_at"),
        digest.alias("computed_checksum"),
        F.when(F.col("_ids") % 11 == 0, F.upper(digest)).when(F.col("_ids") % 13 != 0, digest).alias("manifest_checksum"),
        F.when(F.col("_ids") % 17 == 0, F.col("data_rows") + 5).when(F.col("_ids") % 13 != 0, F.col("data_rows"))
        .cast("long")
        .alias("expected_rows"),
        F.when(form == 1, header([*full, "scope"]))
        .when(form == 2, header([c for c in full if c != "site_id"]))
        .when(form == 3, header([c for c in full if c != "emissions_co2e"]))
        .when(form == 4, header(["garbage"]))
        .otherwise(header(full))
        .alias("header"),
        (F.col("_ids") % 9 != 0).alias("in_landing"),
        (F.col("_ids") % 2 == 0).alias("in_log"),
    )
