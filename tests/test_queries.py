"""Every raster query against its SQL, and those without SQL for rows."""

import pytest

import oracle
from tesserae.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert oracle.rows_of(QUERIES[name](spark, SF)) == oracle.rows_of_sql(con, SQL[name])


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
@pytest.mark.parametrize("name", ["wrast_rho", "interpolate_rho"])
def test_effects_at_every_scale(spark, name, sf):
    at = f"/root/testdata/sf{sf}"
    assert oracle.rows_of(QUERIES[name](spark, at)) == oracle.rows_of_sql(oracle.connect(at), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"icar_fit", "cross_validation"}))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    row = e.entry(spark).collect()
    assert len(row) == 1 and row[0].threshold >= 1
