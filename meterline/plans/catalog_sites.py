"""Site and time-series queries over lineitem as the fact and events as the feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.operators import sites as st
from meterline.plans import roles
from meterline.plans.catalog_rows import judged
from meterline.plans.oracle_roles import FACT, SITES, STAGED, with_roles
from meterline.plans.shape import flat

LAST_DAY = "1998-08-14"
GAP_DAY = "2001-11-10"  # the window runs past the last reading, so its end is empty


def g1_dq_metrics_by_dataset(spark, sf):
    return flat(st.quality_by_dataset(judged(spark, sf).withColumnRenamed("ts", "load_timestamp")))


def g2_time_series(spark, sf):
    return flat(st.time_series(roles.fact(spark, sf), "1996-01-01", "1998-12-31"))


def g3_anomalies(spark, sf):
    return flat(st.anomalies(roles.fact(spark, sf), threshold=1.5))


def g3_anomalies_one_day(spark, sf):
    return flat(st.anomalies(roles.fact(spark, sf), threshold=0.5, day=LAST_DAY))


def _totals(spark, sf, top=None):
    return st.site_totals(roles.fact(spark, sf), roles.sites(spark, sf), top)


def g4_site_totals(spark, sf):
    return flat(_totals(spark, sf, 50))


def g5_site_sparkline(spark, sf):
    spark_line = st.site_sparkline(roles.fact(spark, sf), LAST_DAY)
    return spark_line.select("site_id", F.array_join(F.transform("trend", lambda v: F.format_string("%.2f", v)), ",").alias("trend"))


def g6_daily_trend_gap(spark, sf):
    return flat(st.daily_gap_trend(roles.fact(spark, sf), GAP_DAY))


def g7_site_detail(spark, sf):
    return flat(st.site_detail(roles.fact(spark, sf), roles.sites(spark, sf)).drop("site_name"))


def g7_site_daily_trend(spark, sf):
    return flat(st.site_daily_trend(roles.fact(spark, sf), LAST_DAY))


def g7_latest_readings(spark, sf):
    newest = st.latest_readings(roles.fact(spark, sf), 10, [F.col("record_id").asc(), F.col("emissions_co2e").asc()])
    return flat(newest.select("site_id", "position", "reading_date", "record_id", "emissions_co2e"))


def g8_carbon_intensity(spark, sf):
    return st.carbon_intensity(_totals(spark, sf)).select("site_id", "intensity", "band")


def g8_overall_intensity(spark, sf):
    return st.overall_intensity(_totals(spark, sf))


def g9_site_directory(spark, sf):
    listed = st.site_directory(_totals(spark, sf), sort_by="total_energy_kwh", top=12)
    return flat(listed.select("site_id", "country", "total_energy_kwh", "record_count"))


def g9_countries(spark, sf):
    return st.countries(_totals(spark, sf))


def g10_bounds_check(spark, sf):
    return flat(st.bounds(roles.fact(spark, sf)))


QUERIES = {
    f.__name__: f
    for f in (
        g1_dq_metrics_by_dataset, g2_time_series, g3_anomalies, g3_anomalies_one_day, g4_site_totals, g5_site_sparkline,
        g6_daily_trend_gap, g7_site_detail, g7_site_daily_trend, g7_latest_readings, g8_carbon_intensity, g8_overall_intensity,
        g9_site_directory, g9_countries, g10_bounds_check,
    )
}


def two(x: str, scale: float = 100.0) -> str:
    return f"floor(CAST({x} AS DOUBLE) * {scale} + 0.5) / {scale}"


def sql_round(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 2)"


TOTALS = f""", totals AS (SELECT t.site_id, coalesce(site_name, t.site_id) AS site_name, coalesce(country, '-') AS country,
 coalesce(region, '-') AS region, coalesce(site_type, '-') AS site_type, {two('e')} AS total_energy_kwh, {two('m')} AS total_emissions_co2e,
 n AS record_count, strftime(latest, '%Y-%m-%d') AS latest_reading FROM (SELECT site_id, sum(energy_kwh) AS e, sum(emissions_co2e) AS m,
  count(*) AS n, max(reading_date) AS latest FROM fact GROUP BY 1) t
 LEFT JOIN (SELECT * FROM sites WHERE active_flag) s ON s.site_id = t.site_id)"""
_CAL = f"SELECT DATE '{LAST_DAY}' - 13 + CAST(i AS INTEGER) AS day FROM range(14) t(i)"


def _anomaly_sql(threshold: float, day: str | None) -> str:
    only = f"WHERE reading_date = DATE '{day}'" if day else ""
    return f"""WITH {FACT}, cur AS (SELECT site_id, reading_date, CAST(sum(energy_kwh) AS DOUBLE) / count(*) AS today FROM fact {only} GROUP BY 1, 2),
     r AS (SELECT c.site_id, c.reading_date, {sql_round('any_value(today)')} AS current_kwh,
      {sql_round('CAST(sum(f.energy_kwh) AS DOUBLE) / count(*)')} AS avg_kwh, {sql_round('stddev_samp(CAST(f.energy_kwh AS DOUBLE))')} AS stddev_kwh
      FROM cur c JOIN fact f ON f.site_id = c.site_id AND f.reading_date >= c.reading_date - 7 AND f.reading_date < c.reading_date GROUP BY 1, 2)
     SELECT site_id, strftime(reading_date, '%Y-%m-%d') AS reading_date, avg_kwh, stddev_kwh, current_kwh,
      CASE WHEN current_kwh > avg_kwh + {threshold} * stddev_kwh THEN 'HIGH' WHEN current_kwh < avg_kwh - {threshold} * stddev_kwh THEN 'LOW'
       ELSE 'NORMAL' END AS anomaly_type, {sql_round('abs(current_kwh - avg_kwh) / nullif(stddev_kwh, 0)')} AS z_score
     FROM r WHERE abs(current_kwh - avg_kwh) > {threshold} * coalesce(stddev_kwh, 0)"""


ORACLE = {
    "g1_dq_metrics_by_dataset": with_roles(STAGED)
    + f"""SELECT dataset, business_date AS load_date, count(*) AS total_records, count(*) FILTER (validation_status = 'VALID') AS valid_records,
     count(*) FILTER (validation_status = 'REJECTED') AS rejected_records,
     {sql_round("100.0 * count(*) FILTER (validation_status = 'VALID') / count(*)")} AS quality_score FROM staged GROUP BY 1, 2""",
    "g2_time_series": with_roles(FACT)
    + """SELECT strftime(reading_date, '%Y-%m-%d') AS date, site_id, CAST(sum(energy_kwh) AS DOUBLE) AS total_kwh,
     CAST(sum(emissions_co2e) AS DOUBLE) AS total_co2e, count(*) AS record_count FROM fact
     WHERE reading_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY 1, 2""",
    "g3_anomalies": _anomaly_sql(1.5, None),
    "g3_anomalies_one_day": _anomaly_sql(0.5, LAST_DAY),
    "g4_site_totals": with_roles(FACT, SITES) + TOTALS
    + "SELECT * FROM totals ORDER BY total_energy_kwh DESC, site_id LIMIT 50",
    "g5_site_sparkline": with_roles(FACT)
    + f""", cal AS ({_CAL}), d AS (SELECT site_id, reading_date, sum(energy_kwh) AS e FROM fact GROUP BY 1, 2),
     s AS (SELECT DISTINCT site_id FROM fact)
     SELECT s.site_id, string_agg(format('{{:.2f}}', CAST(coalesce(e, 0) AS DOUBLE)), ',' ORDER BY day) AS trend
     FROM s CROSS JOIN cal LEFT JOIN d ON d.site_id = s.site_id AND d.reading_date = day GROUP BY 1""",
    "g6_daily_trend_gap": with_roles(FACT)
    + f""", cal AS ({_CAL.replace(LAST_DAY, GAP_DAY)}) SELECT strftime(day, '%Y-%m-%d') AS day, {two('sum(energy_kwh)')} AS energy_kwh,
     {two('sum(emissions_co2e)')} AS emissions_co2e FROM cal LEFT JOIN fact f ON f.reading_date = day GROUP BY 1""",
    "g7_site_detail": with_roles(FACT, SITES)
    + f"""SELECT s.site_id, any_value(country) AS country, any_value(region) AS region, any_value(site_type) AS site_type,
     CAST(any_value(active_flag) AS VARCHAR) AS active_flag, coalesce({two('sum(energy_kwh)')}, 0) AS total_energy_kwh,
     coalesce({two('sum(emissions_co2e)')}, 0) AS total_emissions_co2e, count(energy_kwh) AS record_count,
     CASE WHEN sum(energy_kwh) > 0 THEN {two('CAST(sum(emissions_co2e) AS DOUBLE) / CAST(sum(energy_kwh) AS DOUBLE)', 1000.0)} ELSE 0 END AS carbon_intensity,
     strftime(min(reading_date), '%Y-%m-%d') AS first_reading, strftime(max(reading_date), '%Y-%m-%d') AS latest_reading,
     count(DISTINCT batch_id) AS batches FROM sites s LEFT JOIN fact f ON f.site_id = s.site_id GROUP BY 1""",
    "g7_site_daily_trend": with_roles(FACT)
    + f""", cal AS ({_CAL}) SELECT s.site_id, strftime(day, '%Y-%m-%d') AS day, {two('sum(energy_kwh)')} AS energy_kwh,
     {two('sum(emissions_co2e)')} AS emissions_co2e, count(energy_kwh) AS records FROM (SELECT DISTINCT site_id FROM fact) s CROSS JOIN cal
     LEFT JOIN fact f ON f.site_id = s.site_id AND f.reading_date = day GROUP BY 1, 2""",
    "g7_latest_readings": with_roles(FACT)
    + """SELECT site_id, position, strftime(reading_date, '%Y-%m-%d') AS reading_date, record_id, CAST(emissions_co2e AS DOUBLE) AS emissions_co2e
     FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY reading_date DESC, record_id, emissions_co2e) AS position FROM fact)
     WHERE position <= 10""",
    "g8_carbon_intensity": with_roles(FACT, SITES) + TOTALS
    + """SELECT site_id, i AS intensity, CASE WHEN i > 0.5 THEN 'red' WHEN i > 0.3 THEN 'amber' ELSE 'green' END AS band FROM
     (SELECT site_id, CASE WHEN total_energy_kwh > 0 THEN total_emissions_co2e / total_energy_kwh ELSE 0 END AS i FROM totals)""",
    "g8_overall_intensity": with_roles(FACT)
    + """SELECT e AS total_energy, m AS total_emissions, n AS total_records, CASE WHEN e > 0 THEN m / e ELSE 0 END AS intensity FROM
     (SELECT CAST(sum(energy_kwh) AS DOUBLE) AS e, CAST(sum(emissions_co2e) AS DOUBLE) AS m, count(*) AS n FROM fact)""",
    "g9_site_directory": with_roles(FACT, SITES) + TOTALS
    + "SELECT site_id, country, total_energy_kwh, record_count FROM totals ORDER BY total_energy_kwh DESC, site_id LIMIT 12",
    "g9_countries": with_roles(FACT, SITES) + TOTALS + "SELECT DISTINCT country FROM totals",
    "g10_bounds_check": with_roles(FACT)
    + """SELECT batch_id, CAST(min(energy_kwh) AS DOUBLE) AS min_energy, CAST(max(energy_kwh) AS DOUBLE) AS max_energy,
     strftime(min(reading_date), '%Y-%m-%d') AS min_date, strftime(max(reading_date), '%Y-%m-%d') AS max_date FROM fact GROUP BY 1""",
}
