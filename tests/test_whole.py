"""Queries without SQL take part with every row of their tables."""

import pytest
from pyspark.sql import functions as F

from tesserae.operators import icar
from tesserae.plans import demo
from tesserae.plans.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_icar_sample_is_drawn_from_all_rows(spark, monkeypatch):
    seen = {}

    class Stop(Exception):
        pass

    def fit(text, data, neighbours, n_cells, settings):
        seen.update(data=data.select("y", "cell", "fcc23").toPandas(), n_cells=n_cells, cells=neighbours.select("cell").distinct().count())
        raise Stop

    monkeypatch.setattr(icar, "fit", fit)
    with pytest.raises(Stop):
        QUERIES["icar_fit"](spark, SF)
    d, rows = seen["data"], demo.meta_of(demo.events_grid(spark, SF)).nrow
    assert rows == 1000 and seen["n_cells"] == seen["cells"] == rows
    assert d.groupby("fcc23").size().to_dict() == {0: 500, 1: 500}
    assert (d.y < 100).mean() < 0.2 and d.y.max() > 0.95 * rows and d.cell.max() < seen["n_cells"]


def test_warp_reaches_every_source_pixel(spark, monkeypatch, tmp_path):
    """Every source pixel holds its own number, and all of them come out, also of a raster that would pass the pole."""
    number = lambda s, sf: demo.events_grid(s, sf).select("y", "x", (F.col("y") * demo.WIDTH + F.col("x")).alias("v"))
    monkeypatch.setattr(demo, "risk", number)
    spark.range(1_000_000).select(F.col("id").alias("event_id"), F.lit(1.0).alias("value"), F.lit(1).alias("user_id")).write.parquet(f"{tmp_path}/events.parquet")
    for sf, n in (("/root/testdata/sf0.01", 10_000), (SF, 100_000), (str(tmp_path), 1_000_000)):
        out = QUERIES["warp_mercator"](spark, sf)
        row = out.agg(F.count_distinct("v").alias("reached"), F.count("*").alias("n"), F.count_distinct("y", "x").alias("keys")).first()
        assert row.reached == n and row.n == row.keys
