"""Every query of the engine's own operators against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from colonnade.plans import registry
from tests import oracle

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_matches_sql(spark, con, name):
    oracle.check(con, registry.queries()[name](spark, SMALL), registry.oracle_sql()[name])


def test_every_query_has_sql():
    assert registry.queries().keys() == registry.oracle_sql().keys()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())


def test_comparison_and_columns_reach_the_scan(spark):
    plan = registry.queries()["pred_ge"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_partkey,100)" in plan
    assert "l_extendedprice" not in plan


def test_csv_import_has_no_shuffle_and_no_python(spark, tmp_path):
    from colonnade import schema
    from colonnade.sources import csv_io

    (tmp_path / "d.csv").write_text("1,a\n")
    plan = csv_io.read(spark, str(tmp_path / "d.csv"), schema.make(("a", "int32"), ("b", "string")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
