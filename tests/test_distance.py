"""Distances on rasters of several strips, with gaps, and tall ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import spatial
from tesserae.sources.raster import RasterMeta


def brute(cells, target, xres, yres):
    ty, tx = (np.array(k, float) for k in zip(*[(y, x) for y, x, v in cells if v == target], strict=True))
    return {(y, x): int(np.sqrt((((ty - y) * yres) ** 2 + ((tx - x) * xres) ** 2).min())) for y, x, _ in cells}


@pytest.mark.parametrize("ncol,xres", [(9, 30.0), (9, 7.5), (2000, 30.0)])
def test_gaps_hide_no_target(spark, ncol, xres):
    """Where a row lacks a pixel, the targets above and below it still count; edges of strips, missing strips and nulls as well."""
    rng = np.random.default_rng(5)
    cells = [(int(y), int(x), int(rng.random() > 0.02)) for y in [*range(-40, 90), *range(200, 233)] for x in range(3, 24) if rng.random() > 0.4]
    df = spark.createDataFrame([*cells, (10, 300, None)], "y int, x int, v int")
    got = {(r.y, r.x): r.v for r in spatial.distance(df, RasterMeta(ncol, 1, xres=xres, yres=20.0), 0).collect()}
    assert got == brute([*cells, (10, 300, None)], 0, xres, 20.0)
    skipped = spatial.distance(df, RasterMeta(ncol, 1, xres=xres, yres=20.0), 0, skip=1).filter("v is not null")
    assert {(r.y, r.x): r.v for r in skipped.collect()} == {k: v for k, v in got.items() if (*k, 1) not in cells}


def test_a_tall_raster_takes_linear_time(spark):
    """One target in 400,000 rows; a frame that starts anew at every row would read 80 billion."""
    df = spark.range(400_000).select(F.col("id").cast("int").alias("y"), F.lit(0).alias("x"), (F.col("id") != 7).cast("int").alias("v"))
    row = spatial.distance(df, RasterMeta(1, 400_000), 0).select(F.count("v"), F.sum("v"), F.max("v")).first()
    steps = np.abs(np.arange(400_000) - 7) * RasterMeta(1, 1).xres
    assert tuple(row) == (400_000, int(steps.sum()), int(steps.max()))


def test_envelopes_advance_together():
    rng = np.random.default_rng(2)
    xs, at = np.sort(rng.choice(200, 40, replace=False)).astype(float), np.arange(-5.0, 210.0)
    h = np.where(rng.random((50, 40)) < 0.5, np.inf, rng.integers(0, 60, (50, 40)) ** 2.0)
    h[3] = np.inf
    want = ((at[:, None] - xs) ** 2 + h[:, None, :]).min(2)
    assert np.array_equal(spatial.lower_envelope(xs, h, at), want)
    assert np.array_equal(spatial.lower_envelope(xs, h[7], at), want[7])
