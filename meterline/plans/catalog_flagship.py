"""The shortest end-to-end path: raw feed, row checks, known sites, daily totals per site."""

from __future__ import annotations

from meterline.operators import sites as st
from meterline.operators import warehouse as wh
from meterline.plans import roles
from meterline.plans.catalog_rows import staged
from meterline.plans.oracle_roles import SITES, STAGED, with_roles
from meterline.plans.shape import flat


def accepted_readings_by_day(spark, sf):
    loaded = wh.fact_load(staged(spark, sf), roles.sites(spark, sf), dataset=None)
    return flat(st.time_series(loaded, "2024-01-01", "2024-12-31"))


QUERIES = {"accepted_readings_by_day": accepted_readings_by_day}

ORACLE = {
    "accepted_readings_by_day": with_roles(STAGED, SITES)
    + """SELECT reading_date AS date, site_id, CAST(sum(energy_num) AS DOUBLE) AS total_kwh, CAST(sum(emissions_num) AS DOUBLE) AS total_co2e,
     count(*) AS record_count FROM staged WHERE validation_status = 'VALID' AND site_id IN (SELECT site_id FROM sites)
     AND reading_date BETWEEN '2024-01-01' AND '2024-12-31' GROUP BY 1, 2""",
}
