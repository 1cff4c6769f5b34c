"""Loads, marts, lineage and reconciliation over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.operators import recon as rec
from meterline.operators import rowchecks as rc
from meterline.operators import warehouse as wh
from meterline.plans import roles
from meterline.plans.catalog_rows import RULES, staged, validated
from meterline.plans.oracle_roles import DELIVERIES, FACT, FEED, SITES, STAGED, TASKS, with_roles
from meterline.plans.shape import flat
from meterline.session import cut_lineage


def _dim_pair(spark, sf):
    """Suppliers as the current dimension, customers as staged snapshots of two batches."""
    s = roles.table(spark, sf, "supplier")
    current = s.select(
        F.col("s_suppkey").alias("site_key"), F.col("s_suppkey").cast("string").alias("site_id"),
        F.col("s_name").alias("site_name"), F.col("s_nationkey").cast("string").alias("country"),
        F.lit("B-20250101-01").alias("loaded_batch"), (F.col("s_suppkey") % 10 != 0).alias("active_flag"),
    )
    c = roles.table(spark, sf, "customer")
    staged_sites = c.select(
        F.concat(F.lit("B-2025020"), (F.col("c_custkey") % 2).cast("string"), F.lit("-01")).alias("batch_id"),
        (F.col("c_custkey") % 300).cast("string").alias("site_id"), F.col("c_custkey").alias("row_index"),
        F.col("c_name").alias("site_name"), F.col("c_nationkey").cast("string").alias("country"),
        F.when(F.col("c_custkey") % 7 == 0, "REJECTED").otherwise("VALID").alias("validation_status"),
    )
    return current, staged_sites


def e1_dim_upsert(spark, sf):
    return flat(wh.dim_upsert(*_dim_pair(spark, sf), fields=["site_name", "country"]))


def e2_fact_load(spark, sf):
    loaded = wh.fact_load(staged(spark, sf), roles.sites(spark, sf), dataset=None)
    return flat(loaded.drop("source_system"))


def e3_dim_scd2(spark, sf):
    s, c = roles.table(spark, sf, "supplier"), roles.table(spark, sf, "customer")
    history = s.select(
        F.col("s_suppkey").alias("site_key"), F.col("s_nationkey").alias("country"),
        F.when(F.col("s_suppkey") % 5 != 0, F.col("s_suppkey") % 6).alias("site_type"),
        F.lit("2024-01-01").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_current"),
    )
    snapshot = c.select(
        (F.col("c_custkey") * 2).alias("site_key"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("country"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 6).alias("site_type"),
    )
    return flat(wh.scd2_apply(history, snapshot, "site_key", ["country", "site_type"], "2025-06-01"))


def e4_fact_merge(spark, sf):
    fact = roles.fact(spark, sf)
    merged = wh.fact_merge(fact.filter("side = 'F'"), fact.filter("side = 'O'"), ["record_id"], "energy_kwh")
    return flat(merged)


REGION_CODES = {"AFRICA": "AF", "AMERICA": "AM", "ASIA": "AS", "EUROPE": "EU"}
INTENSITY = {"T0": 0.5, "T1": 1.25, "T2": 2.0}


def e5_enrich(spark, sf):
    valid = staged(spark, sf).filter("validation_status = 'VALID'")
    rich = wh.enrich(valid, roles.sites(spark, sf), REGION_CODES, INTENSITY, tie="row_index")
    return flat(
        rich.select("row_index", "site_id", "region_code", "country", "weighted_emissions", "cumulative_energy")
    )


def e6_mart_daily_energy(spark, sf):
    return flat(wh.mart_daily_energy(roles.fact(spark, sf), roles.sites(spark, sf)))


def _accepted(spark, sf):
    feed = roles.feed(spark, sf).withColumn("energy_kwh", rc.parse_number("energy_kwh"))
    return rc.collect_issues(feed, "energy_consumption").filter("accepted")


def e7_lineage_edges(spark, sf):
    return wh.lineage_edges(_accepted(spark, sf), "file_name", "row_index", "X1")


def e8_lineage_trace(spark, sf):
    edges = cut_lineage(wh.lineage_edges(_accepted(spark, sf), "file_name", "row_index", "X1"))
    starts = roles.feed(spark, sf).select(
        F.concat_ws("-", F.lit("SRC"), "file_name", F.col("row_index").cast("string")).alias("record")
    )

    def wild(stage: str, source: str, target: str):
        columns = "stage string, edge_number long, source_id string, target_id string, transformation_logic string"
        return spark.createDataFrame([(stage, 0, source, target, f"{source} to {target}")], columns)

    stages = [edges, wild("ENRICHMENT", "STG-*", "ENR-*"), wild("DIMENSION", "ENR-*", "FACT-*"), wild("AGGREGATION", "FACT-*", "MART-*")]
    traced = wh.lineage_trace(starts, stages)
    return traced.select("record", F.array_join("path", ">").alias("path"), F.array_join("chain", "; ").alias("chain"))


def e9_replay_backfill(spark, sf):
    fact = roles.fact(spark, sf).select(
        "batch_id", F.col("reading_date").cast("string").alias("business_date"), "record_id", "energy_kwh"
    )
    corrected = fact.withColumn("energy_kwh", F.col("energy_kwh") + 1)
    replayed = wh.replay_batch(fact, corrected, "1998-07-01")
    return replayed.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("energy_kwh").cast("decimal(18,2)")).cast("double").alias("kwh")
    )


def e10_next_batch_id(spark, sf):
    runs = roles.tasks(spark, sf).select(F.substring("batch_id", 3, 6).alias("month"), "batch_id")
    by_month = runs.withColumn("business_date", F.concat(F.substring("month", 1, 4), F.lit("-"), F.substring("month", 5, 2), F.lit("-01")))
    return wh.next_batch_ids(by_month)


def e11_stage_summary(spark, sf):
    stages = roles.tasks(spark, sf).select(
        F.col("rows_read").alias("records_read"), F.col("rows_rejected").alias("records_rejected"),
        (F.col("duration_seconds") * 1000).cast("long").alias("duration_ms"),
    )
    return wh.stage_summary(stages)


def _sides(spark, sf):
    fact = roles.fact(spark, sf)
    return rec.both_sides(fact.filter("side = 'F'"), fact.filter("side = 'O'"))


def f1_rowcount_recon(spark, sf):
    return rec.rowcount_recon(_sides(spark, sf))


def f2_aggregate_recon(spark, sf):
    return flat(rec.aggregate_recon(_sides(spark, sf)))


def f3_cross_dataset(spark, sf):
    rows = staged(spark, sf).filter("validation_status = 'VALID'")
    return rec.cross_dataset(rows, "click", "view").drop("base_rows", "other_rows")


def _starts(spark, sf):
    return roles.tasks(spark, sf).groupBy("batch_id").agg(F.min("start_time").alias("started_at"))


def f4_recon_history(spark, sf):
    return flat(rec.recon_history(_sides(spark, sf), _starts(spark, sf), newest=15))


def f5_layer_recon(spark, sf):
    staging = roles.feed(spark, sf).withColumn("load_timestamp", F.date_trunc("hour", "ts"))
    return flat(rec.layer_recon(staging, roles.fact(spark, sf)))


def f6_batches_balanced(spark, sf):
    return rec.balanced(rec.rowcount_recon(_sides(spark, sf)))


def f7_file_to_fact_rows(spark, sf):
    fact = roles.fact(spark, sf)
    files = fact.filter("side = 'F'").select("batch_id", F.col("source_file_name").alias("file_name")).distinct()
    return rec.file_to_fact(files, fact.filter("side = 'O'"))


def f8_partial_load_probe(spark, sf):
    fact = roles.fact(spark, sf)
    return rec.partial_load(fact.filter("side = 'F'"), fact.filter("side = 'O'"))


def f9_fact_by_source_file(spark, sf):
    return rec.fact_by_file(roles.fact(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        e1_dim_upsert, e2_fact_load, e3_dim_scd2, e4_fact_merge, e5_enrich, e6_mart_daily_energy, e7_lineage_edges,
        e8_lineage_trace, e9_replay_backfill, e10_next_batch_id, e11_stage_summary, f1_rowcount_recon, f2_aggregate_recon,
        f3_cross_dataset, f4_recon_history, f5_layer_recon, f6_batches_balanced, f7_file_to_fact_rows, f8_partial_load_probe,
        f9_fact_by_source_file,
    )
}

_TOTALS = """, totals AS (SELECT batch_id, count(*) FILTER (side = 'F') AS source_count, count(*) FILTER (side = 'O') AS target_count,
 coalesce(sum(energy_kwh) FILTER (side = 'F'), 0) AS se, coalesce(sum(energy_kwh) FILTER (side = 'O'), 0) AS te,
 coalesce(sum(emissions_co2e) FILTER (side = 'F'), 0) AS sm, coalesce(sum(emissions_co2e) FILTER (side = 'O'), 0) AS tm
 FROM fact GROUP BY 1)"""
_ACCEPTED = """, accepted AS (SELECT *, 'SRC-' || file_name || '-' || row_index AS source_id,
 row_number() OVER (ORDER BY file_name, row_index) AS n FROM feed
 WHERE site_id <> '' AND energy_kwh <> '1d' AND CAST(nullif(energy_kwh, '1d') AS DOUBLE) >= 0)"""


def _two(x: str) -> str:
    return f"floor(CAST({x} AS DOUBLE) * 100.0 + 0.5) / 100.0"


ORACLE = {
    "e1_dim_upsert": """WITH snap AS (SELECT * FROM (SELECT CAST(c_custkey % 300 AS VARCHAR) AS site_id, c_name AS site_name,
      CAST(c_nationkey AS VARCHAR) AS country, 'B-2025020' || (c_custkey % 2) || '-01' AS loaded_batch, row_number() OVER
      (PARTITION BY c_custkey % 300 ORDER BY c_custkey % 2 DESC, c_custkey DESC) AS rn FROM customer WHERE c_custkey % 7 <> 0) WHERE rn = 1),
     m AS (SELECT s_suppkey AS site_key, coalesce(n.site_id, CAST(s_suppkey AS VARCHAR)) AS site_id, coalesce(n.site_name, s_name) AS site_name,
      coalesce(n.country, CAST(s_nationkey AS VARCHAR)) AS country, coalesce(loaded_batch, 'B-20250101-01') AS loaded_batch,
      n.site_id IS NOT NULL OR s_suppkey % 10 <> 0 AS active_flag FROM supplier s FULL JOIN snap n ON CAST(s_suppkey AS VARCHAR) = n.site_id)
     SELECT coalesce(site_key, (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (PARTITION BY site_key IS NULL ORDER BY site_id)) AS site_key,
      site_id, site_name, country, loaded_batch, CAST(active_flag AS VARCHAR) AS active_flag FROM m""",
    "e2_fact_load": with_roles(STAGED, SITES)
    + """SELECT batch_id, record_id, site_id, reading_date, coalesce(CAST(energy_num AS DOUBLE), 0) AS energy_kwh,
     coalesce(CAST(emissions_num AS DOUBLE), 0) AS emissions_co2e, file_name AS source_file_name FROM staged
     WHERE validation_status = 'VALID' AND site_id IN (SELECT site_id FROM sites)""",
    "e3_dim_scd2": """WITH h AS (SELECT s_suppkey AS k, s_nationkey AS country, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 6 END AS t FROM supplier),
     s AS (SELECT c_custkey * 2 AS k, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS country,
      CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 6 END AS t FROM customer),
     j AS (SELECT h.k AS hk, h.country AS hc, h.t AS ht, s.k AS sk, s.country AS sc, s.t AS st, h.k IS NOT NULL AND s.k IS NOT NULL AND
      (h.country IS DISTINCT FROM s.country OR h.t IS DISTINCT FROM s.t) AS changed FROM h FULL JOIN s ON h.k = s.k)
     SELECT hk AS site_key, CAST(hc AS BIGINT) AS country, ht AS site_type, '2024-01-01' AS valid_from, CASE WHEN changed THEN '2025-05-31' END AS valid_to,
      CASE WHEN changed THEN 'false' ELSE 'true' END AS is_current FROM j WHERE hk IS NOT NULL
     UNION ALL SELECT sk, CAST(sc AS BIGINT), st, '2025-06-01', NULL, 'true' FROM j WHERE sk IS NOT NULL AND (hk IS NULL OR changed)""",
    "e4_fact_merge": with_roles(FACT)
    + "SELECT record_id, CAST(sum(energy_kwh) AS DOUBLE) AS energy_kwh FROM fact GROUP BY 1",
    "e5_enrich": with_roles(STAGED, SITES)
    + """SELECT row_index, staged.site_id, CASE region WHEN 'AFRICA' THEN 'AF' WHEN 'AMERICA' THEN 'AM' WHEN 'ASIA' THEN 'AS'
     WHEN 'EUROPE' THEN 'EU' ELSE 'UNKNOWN' END AS region_code, country,
     CAST(emissions_num AS DOUBLE) * CAST(CASE site_type WHEN 'T0' THEN 0.5 WHEN 'T1' THEN 1.25 WHEN 'T2' THEN 2.0 ELSE 1.0 END AS DOUBLE)
      AS weighted_emissions,
     CAST(sum(energy_num) OVER (PARTITION BY staged.site_id ORDER BY reading_date, row_index ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cumulative_energy
     FROM staged LEFT JOIN sites ON staged.site_id = sites.site_id WHERE validation_status = 'VALID'""",
    "e6_mart_daily_energy": with_roles(FACT, SITES)
    + """SELECT strftime(reading_date, '%Y-%m-%d') AS reading_date, site_id, region, CAST(total AS DOUBLE) AS daily_total_kwh,
     CAST(em AS DOUBLE) / n AS avg_intensity, n AS meter_count, rank() OVER (PARTITION BY region ORDER BY total DESC) AS region_rank
     FROM (SELECT reading_date, fact.site_id, region, sum(energy_kwh) AS total, sum(emissions_co2e) AS em, count(*) AS n
      FROM fact LEFT JOIN sites ON fact.site_id = sites.site_id GROUP BY 1, 2, 3)""",
    "e7_lineage_edges": with_roles(FEED) + _ACCEPTED[0:]
    + """SELECT 'STAGING' AS stage, n AS edge_number, source_id, 'STG-X1-' || (n - 1) AS target_id, 'STAGING_CLEANSE' AS transformation_type,
     'types checked, formats unified, rules applied' AS transformation_logic FROM accepted""",
    "e8_lineage_trace": with_roles(FEED) + _ACCEPTED
    + """, r AS (SELECT 'SRC-' || file_name || '-' || row_index AS record, file_name FROM feed)
     SELECT record, record || coalesce('>STG-X1-' || (min(n) - 1) || '>ENR-*>FACT-*>MART-*', '') AS path, CASE WHEN min(n) IS NULL THEN '' ELSE
     'STAGING: types checked, formats unified, rules applied; ENRICHMENT: STG-* to ENR-*; DIMENSION: ENR-* to FACT-*; AGGREGATION: FACT-* to MART-*' END AS chain
     FROM r LEFT JOIN accepted a ON a.file_name = r.file_name AND starts_with(record, source_id) GROUP BY 1""",
    "e9_replay_backfill": with_roles(FACT)
    + """SELECT batch_id, count(*) AS n, CAST(sum(energy_kwh) AS DOUBLE) AS kwh FROM fact GROUP BY 1 UNION ALL
     SELECT 'B-19980701-' || lpad(CAST(count(DISTINCT batch_id) + 1 AS VARCHAR), 2, '0'), count(*), CAST(sum(energy_kwh + 1) AS DOUBLE)
     FROM fact WHERE reading_date = DATE '1998-07-01' HAVING count(*) > 0""",
    "e10_next_batch_id": with_roles(TASKS)
    + """SELECT business_date, 'B-' || replace(business_date, '-', '') || '-' || lpad(CAST(n AS VARCHAR), 2, '0') AS next_batch_id FROM
     (SELECT substr(batch_id, 3, 4) || '-' || substr(batch_id, 7, 2) || '-01' AS business_date, count(DISTINCT batch_id) + 1 AS n FROM tasks GROUP BY 1)""",
    "e11_stage_summary": with_roles(TASKS)
    + """SELECT count(*) AS total_stages, CAST(sum(rows_read) AS BIGINT) AS total_processed, CAST(sum(rows_rejected) AS BIGINT) AS total_rejected,
     CAST(sum(duration_seconds) * 1000 AS BIGINT) AS total_duration_ms FROM tasks""",
    "f1_rowcount_recon": with_roles(FACT) + _TOTALS
    + """SELECT batch_id, source_count, target_count, source_count - target_count AS diff_rows,
     CASE WHEN source_count = target_count THEN 'PASS' ELSE 'FAIL' END AS status FROM totals""",
    "f2_aggregate_recon": with_roles(FACT) + _TOTALS
    + """SELECT batch_id, CAST(se - te AS DOUBLE) AS energy_diff, CAST(sm - tm AS DOUBLE) AS emissions_diff,
     CASE WHEN abs(se - te) <= 0.01 AND abs(sm - tm) <= 0.01 THEN 'PASS' ELSE 'FAIL' END AS status FROM totals""",
    "f3_cross_dataset": with_roles(STAGED)
    + """SELECT *, CASE WHEN variance_pct <= 5 THEN 'PASS' WHEN variance_pct <= 10 THEN 'WARN' ELSE 'FAIL' END AS status FROM (
     SELECT batch_id, base_total, other_total, CASE WHEN base_total > 0 THEN abs((other_total - base_total) / base_total) * 100 ELSE 0 END AS variance_pct
     FROM (SELECT batch_id, CAST(sum(emissions_num) FILTER (dataset = 'click') AS DOUBLE) AS base_total,
      CAST(sum(emissions_num) FILTER (dataset = 'view') AS DOUBLE) AS other_total FROM staged WHERE validation_status = 'VALID' GROUP BY 1
      HAVING count(*) FILTER (dataset = 'click') > 0 AND count(*) FILTER (dataset = 'view') > 0))""",
    "f4_recon_history": with_roles(FACT, TASKS) + _TOTALS
    + f""", s AS (SELECT batch_id, min(start_time) AS started_at FROM tasks GROUP BY 1),
     j AS (SELECT s.batch_id, started_at, coalesce(source_count, 0) AS sc, coalesce(target_count, 0) AS tc, coalesce(se, 0) AS se,
      coalesce(te, 0) AS te, coalesce(sm, 0) AS sm, coalesce(tm, 0) AS tm FROM s LEFT JOIN totals t ON t.batch_id = s.batch_id)
     SELECT batch_id, substr(batch_id, 3, 4) || '-' || substr(batch_id, 7, 2) || '-' || substr(batch_id, 9, 2) AS business_date,
     strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, sc AS source_count, tc AS target_count, sc - tc AS diff_rows,
     {_two('se')} AS source_energy, {_two('te')} AS target_energy, {_two('se - te')} AS energy_diff, {_two('sm')} AS source_emissions,
     {_two('tm')} AS target_emissions, CASE WHEN sc = tc AND abs(se - te) <= 0.01 THEN 'PASS' ELSE 'FAIL' END AS status
     FROM j ORDER BY j.started_at DESC, batch_id DESC LIMIT 15""",
    "f5_layer_recon": with_roles(FEED, FACT)
    + """SELECT 'STAGING' AS layer, strftime(t, '%Y-%m-%d') AS load_date, dataset, count(*) AS record_count, count(DISTINCT site_id) AS unique_sites,
     strftime(min(t), '%Y-%m-%d %H:%M:%S') AS first_load, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS last_load
     FROM (SELECT *, date_trunc('hour', ts) AS t FROM feed) GROUP BY dataset, t
     UNION ALL SELECT 'WAREHOUSE', strftime(loaded_at, '%Y-%m-%d'), 'energy_emissions', count(*), count(DISTINCT site_id),
     strftime(min(loaded_at), '%Y-%m-%d %H:%M:%S'), strftime(max(loaded_at), '%Y-%m-%d %H:%M:%S') FROM fact GROUP BY 2""",
    "f6_batches_balanced": with_roles(FACT) + _TOTALS
    + """SELECT count(*) FILTER (source_count = target_count) AS balanced, count(*) FILTER (source_count <> target_count) AS unbalanced FROM totals""",
    "f7_file_to_fact_rows": with_roles(FACT)
    + """SELECT batch_id, file_name, (SELECT count(*) FROM fact x WHERE x.side = 'O' AND x.batch_id = f.batch_id
     AND x.source_file_name = f.file_name) AS fact_rows FROM (SELECT DISTINCT batch_id, source_file_name AS file_name FROM fact WHERE side = 'F') f""",
    "f8_partial_load_probe": with_roles(FACT)
    + """SELECT batch_id, count(*) FILTER (side = 'F') AS staging_rows, count(*) FILTER (side = 'O') AS fact_rows FROM fact GROUP BY 1""",
    "f9_fact_by_source_file": with_roles(FACT)
    + """SELECT batch_id, source_file_name, count(*) AS fact_rows, CAST(round(sum(energy_kwh), 2) AS DOUBLE) AS total_kwh FROM fact GROUP BY 1, 2""",
}
