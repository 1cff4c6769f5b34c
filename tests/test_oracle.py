"""Every registered query against its SQL twin."""

from __future__ import annotations

import pytest
from compare import mismatch

from meterline.plans.registry import ORACLE, QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sql, sf, name):
    assert mismatch(spark, sql, name, QUERIES[name], ORACLE[name], sf) is None
