"""Tables, plans, checks and stored rasters."""

import math

import pytest
from pyspark.sql import functions as F

from tesserae.functions import pixels
from tesserae.operators import grid, spatial
from tesserae.sources import planning, raster, vector
from tesserae.sources.raster import RasterMeta


def test_country_table_and_codes(spark, tmp_path):
    (tmp_path / "c.csv").write_text("iso3;name;iso_wdpa\nGLP;Guadeloupe;FRA\nXXX;NA;NA\n")
    t = planning.countries(spark, str(tmp_path / "c.csv"))
    assert [tuple(r) for r in t.orderBy("iso3").collect()] == [("GLP", "Guadeloupe", "FRA"), ("XXX", None, None)]
    assert [tuple(r) for r in planning.lookup_code(t, "GLP").collect()] == [("FRA",)]
    assert planning.lookup_code(t, "none").count() == 0


def test_tables_come_back_as_written(spark, tmp_path):
    rows = [(1, 0.25, "a,b"), (2, None, None)]
    planning.write_table(spark.createDataFrame(rows, "k int, v double, s string"), str(tmp_path / "t"))
    got = planning.read_table(spark, str(tmp_path / "t"), "k int, v double, s string")
    assert sorted(map(tuple, got.collect())) == rows


def test_download_plan(spark):
    present = spark.createDataFrame([("b_GLP",), ("b_GLP",)], "target string")
    plan = planning.download_plan(spark, "GLP", {"a": "https://x/{code}/a", "b": "https://x/{code}/b", "c": "https://x/c"}, {"c": False}, present)
    assert sorted(map(tuple, plan.collect())) == [("a", "https://x/GLP/a", "a_GLP", False), ("b", "https://x/GLP/b", "b_GLP", True)]


def test_area_check():
    vector.check_area("EPSG:4326")
    with pytest.raises(ValueError, match="3395"):
        vector.check_area("EPSG:3395")


def test_names_of_a_catalogue_are_sorted(spark, tmp_path):
    for n in ("slope", "altitude"):
        spark.createDataFrame([(0, 0, 1)], "y int, x int, v int").write.parquet(str(tmp_path / n))
    got = raster.catalogue(spark, {f"{n}.tif": str(tmp_path / n) for n in ("slope", "altitude")})
    assert list(got) == ["altitude", "slope"] and got["slope"].count() == 1


def test_logit_undoes_invlogit(spark):
    df = spark.createDataFrame([(z / 4,) for z in range(-30, 31)], "z double")
    for r in df.select("z", pixels.logit(pixels.invlogit(F.col("z"))).alias("back")).collect():
        assert math.isclose(r.z, r.back, abs_tol=1e-9)


def test_cells_of_a_country_and_their_neighbours(spark):
    meta = RasterMeta(100, 100, 0.0, 3000.0, 30.0, 30.0)
    ring = [{"x": x, "y": y} for x, y in ((100.0, 2900.0), (900.0, 2900.0), (900.0, 2100.0), (100.0, 2100.0))]
    area = spark.createDataFrame([(1, [ring])], f"id int, rings {vector.RINGS}")
    cells = spatial.cells_touched(area, meta, 0.5)
    nrow, ncol = grid.cell_grid(meta.extent, 0.5)
    assert (nrow, ncol) == (6, 6) and sorted(r.cell for r in cells.collect()) == [0, 1, 6, 7]
    near = grid.neighbours_within(cells, nrow, ncol, 1)
    assert near.count() == 12


def test_bucketed_rasters_join_without_a_shuffle(spark, tmp_path):
    names = ("bucketed_a", "bucketed_b")
    try:
        for i, n in enumerate(names):
            r = spark.range(400).select((F.col("id") / 20).cast("int").alias("y"), (F.col("id") % 20).cast("int").alias("x"), (F.col("id") + i).alias(f"v{i}"))
            raster.store_bucketed(r, n, buckets=4, path=str(tmp_path / n))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = spark.table(names[0]).join(spark.table(names[1]), ["y", "x"])
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.filter("v1 - v0 = 1").count() == 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS {n}")
