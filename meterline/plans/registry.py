"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

GROUPS = [
    "catalog_flagship", "catalog_rows", "catalog_dq", "catalog_warehouse", "catalog_sites", "catalog_ops", "catalog_incidents", "catalog_files",
    "catalog_streams",
]

QUERIES: dict = {}
ORACLE: dict = {}
for _group in GROUPS:
    _module = import_module(f"meterline.plans.{_group}")
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)


def _utc(query):
    """Business dates are UTC dates whatever the session default."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    run.__name__ = query.__name__
    run.__doc__ = query.__doc__
    return run


QUERIES = {name: _utc(query) for name, query in QUERIES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["accepted_readings_by_day"](spark, sf_dir)
