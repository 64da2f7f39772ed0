"""Every query of the catalogue against its SQL twin, or at least with a stable schema."""

import pytest

from lintel.plans import catalogue

from .compare import rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, duck, sf_dir, name):
    assert rows_of(catalogue.QUERIES[name](spark, sf_dir)) == rows_of_sql(duck, catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["area_id", "segment", "period", "n", "median", "p25", "p75", "mean", "provisional"]
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
