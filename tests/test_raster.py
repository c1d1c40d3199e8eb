"""Small grids with results worked out by hand or by brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.operators import aggregate, grid, icar, project, sample, spatial
from tesserae.sources import geotiff, raster, vector
from tesserae.sources.raster import RasterMeta
from tesserae.streaming import ingest


def raster_of(spark, values, kind="double"):
    rows = [(y, x, None if v is None else (float(v) if kind == "double" else int(v))) for y, line in enumerate(values) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, f"y int, x int, v {kind}")


def array_of(df, nrow, ncol):
    out = np.full((nrow, ncol), np.nan)
    for r in df.collect():
        if r.v is not None:
            out[r.y, r.x] = r.v
    return out


def test_kings_moves_on_9_by_11(spark):
    adj = grid.adjacency(grid.neighbours(spark, 9, 11)).orderBy("cell").collect()
    assert len(adj) == 99 and sum(r.n for r in adj) == 676
    assert adj[0].adj == [1, 11, 12] and adj[12].adj == [0, 1, 2, 11, 13, 22, 23, 24]


def test_masked_neighbours_are_dense(spark):
    cells = spark.createDataFrame([(0,), (1,), (5,), (24,)], "cell long")
    got = {(r.cell_id, r.neighbor_id) for r in grid.neighbours_within(cells, 5, 5).collect()}
    assert got == {(0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1)}


@pytest.mark.parametrize("quota,wanted", [(0.0, 0), (3.0, 3), (1000.0, 10)])
def test_quota_edges(spark, quota, wanted):
    risk = spark.createDataFrame([(0, i, 65535 if i < 3 else 7) for i in range(10)], "y int, x int, v int")
    meta = RasterMeta(10, 1, xres=100.0, yres=100.0)
    row = project.quota_threshold(risk, meta, quota).first()
    assert row.ndp == wanted and row.nfp == 10
    if wanted == 0:
        assert row.threshold == 65536


def test_quota_takes_the_nearer_class_and_fewer_on_ties(spark):
    meta = RasterMeta(10, 1, xres=100.0, yres=100.0)
    risk = spark.createDataFrame([(0, i, 9 if i < 2 else 5 if i < 6 else 1) for i in range(10)], "y int, x int, v int")
    assert project.quota_threshold(risk, meta, 4.0).first().ndp == 2
    assert project.quota_threshold(risk, meta, 5.0).first().ndp == 6


def test_resample_ragged(spark):
    r = raster_of(spark, np.ones((7, 5), int), "int")
    got = {(a.y, a.x): a.n for a in aggregate.resample_sum(r, 1, 3).collect()}
    assert sum(got.values()) == 35 and got[2, 1] == 2 and got[0, 0] == 9
    with pytest.raises(ValueError):
        aggregate.resample_sum(r, 1, 1001)


@given(st.lists(st.tuples(st.integers(0, 11), st.integers(0, 8)), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_lower_envelope_is_the_minimum(points):
    xs = np.array(sorted({p[0] for p in points}), dtype=float)
    hs = np.array([dict(points)[int(x)] for x in xs], dtype=float) ** 2
    at = np.arange(15.0)
    assert np.allclose(spatial.lower_envelope(xs, hs, at), ((at[:, None] - xs) ** 2 + hs).min(1))


def test_distance_is_exact(spark):
    rng = np.random.default_rng(3)
    v = (rng.random((41, 23)) > 0.03).astype(int)
    got = array_of(spatial.distance(raster_of(spark, v, "int"), RasterMeta(23, 41, xres=30.0, yres=20.0), 0), 41, 23)
    ty, tx = np.nonzero(v == 0)
    yy, xx = np.mgrid[:41, :23]
    want = np.floor(np.sqrt(((yy[..., None] - ty) * 20.0) ** 2 + ((xx[..., None] - tx) * 30.0) ** 2).min(-1))
    assert (got == want).all()
    none = spatial.distance(raster_of(spark, np.ones((3, 3), int), "int"), RasterMeta(3, 3), 0)
    assert none.filter("v is not null").count() == 0


def test_slope_of_a_plane(spark):
    yy, xx = np.mgrid[:5, :6]
    got = array_of(spatial.slope(raster_of(spark, 30.0 * xx + 0.0 * yy), RasterMeta(6, 5)), 5, 6)
    assert (got == 45).all()


def test_spline_keeps_a_constant_and_skips_missing(spark):
    g = raster_of(spark, [[2.0, 2.0, None], [2.0, 2.0, 2.0]])
    got = array_of(spatial.spline_refine(g, 2, 3, 4), 8, 12)
    assert np.allclose(got, 2.0)
    ramp = array_of(spatial.bilinear_refine(raster_of(spark, [[0.0, 4.0]]), 1, 2, 4), 4, 8)
    assert np.allclose(ramp[0], [0, 0, 0.5, 1.5, 2.5, 3.5, 4, 4])


def test_polygons(spark):
    meta = RasterMeta(10, 10, xres=1.0, yres=1.0)

    def pixels_of(rings, meta, touched=False):
        df = spark.createDataFrame([(1, [[{"x": x, "y": y} for x, y in r] for r in rings])], "id int, rings array<array<struct<x:double,y:double>>>")
        return sorted((r.y, r.x) for r in spatial.rasterize(df, meta, touched).collect())

    square = [(2.0, -2.0), (5.0, -2.0), (5.0, -5.0), (2.0, -5.0)]
    inside = pixels_of([square], meta)
    assert inside == [(y, x) for y in range(2, 5) for x in range(2, 5)]
    hole = [(3.0, -3.0), (4.0, -3.0), (4.0, -4.0), (3.0, -4.0)]
    assert (3, 3) not in pixels_of([square, hole], meta)
    thin = [(0.1, -0.1), (9.9, -9.8), (9.9, -9.9)]
    touched = pixels_of([thin], meta, touched=True)
    assert {(i, i) for i in range(10)} <= set(touched)


def test_mercator_round_trip(spark):
    df = spark.createDataFrame([(166.0, -21.5), (-61.5, 16.2), (0.0, 0.0)], "lon double, lat double")
    east, north = spatial.to_mercator(F.col("lon"), F.col("lat"))
    lon, lat = spatial.from_mercator(east, north)
    for r in df.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert math.isclose(r.lon, r.a, abs_tol=1e-9) and math.isclose(r.lat, r.b, abs_tol=1e-9)


def test_mosaic_and_overviews(spark):
    a, b = raster_of(spark, [[1, 2], [3, 4]]), raster_of(spark, [[9, None]])
    assert array_of(grid.mosaic([a, b]), 2, 2).tolist() == [[9, 2], [3, 4]]
    levels = grid.pyramid(raster_of(spark, np.arange(16).reshape(4, 4)), (2, 4))
    assert array_of(levels[4], 1, 1)[0, 0] == 7.5
    assert grid.decimation(14296, 12541, 500000) == 32


@pytest.mark.parametrize("kind", ["uint8", "uint16", "int16", "float64"])
def test_geotiff_round_trip(spark, tmp_path, kind):
    meta = RasterMeta(37, 130, 100.0, 500.0, 30.0, 30.0, "EPSG:3395", 255 if kind != "float64" else -9999.0)
    values = np.random.default_rng(1).integers(0, 255, (130, 37)).astype(kind)
    values[3, 4] = meta.nodata
    path = tmp_path / "a.tif"
    path.write_bytes(geotiff.encode(values, meta))
    got_meta = geotiff.read_meta(str(path))
    assert (got_meta.ncol, got_meta.nrow, got_meta.xmin, got_meta.ymax, got_meta.crs, got_meta.nodata) == (37, 130, 100.0, 500.0, "EPSG:3395", meta.nodata)
    geotiff.register(spark)
    got = array_of(spark.read.format("geotiff").option("blocks", "1").load(str(path)), 130, 37)
    assert np.isnan(got[3, 4]) and got[values != meta.nodata].tolist() == values[values != meta.nodata].astype(float).tolist()


def test_store_and_scan(spark, tmp_path):
    meta = RasterMeta(20, 20, nodata=0)
    df = raster_of(spark, np.arange(400).reshape(20, 20), "int")
    raster.store(df, str(tmp_path / "r"), meta, tile=8, files=3)
    window = raster.scan(spark, str(tmp_path / "r"), meta, window=(0, 0, 2, 2))
    assert sorted((r.y, r.x, r.v) for r in window.collect() if r.v is not None) == [(0, 1, 1), (1, 0, 20), (1, 1, 21)]


def test_vector_layers(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"n":1},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,2],[0,0]]]}}]}')
    box = spatial.extent(vector.vertices(vector.read_geojson(spark, str(tmp_path)))).first()
    assert tuple(box) == (0.0, 0.0, 1.0, 2.0)
    wkt = spark.createDataFrame([("POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))",)], "w string").select(vector.parse_wkt(F.col("w")).alias("rings")).first()
    assert [len(r) for r in wkt.rings] == [3, 3] and wkt.rings[0][1].x == 4.0


def test_check_forest_cover(spark):
    df = spark.createDataFrame([(0, 0, 1, 0, 1), (0, 1, 0, 1, 1)], "y int, x int, b1 int, b2 int, b3 int")
    meta = RasterMeta(2, 1, crs="EPSG:3395")
    aggregate.check_forest_cover(df, ["b1", "b2", "b3"], meta, "EPSG:3395")
    for bad in (lambda: aggregate.check_forest_cover(df, ["b1"], meta, "EPSG:3395"), lambda: aggregate.check_forest_cover(df, ["b1", "b2", "b3"], meta, "EPSG:4326"), lambda: aggregate.check_forest_cover(df.withColumn("b2", F.lit(7)), ["b1", "b2", "b3"], meta, "EPSG:3395")):
        with pytest.raises(ValueError):
            bad()


def test_diffusion_keeps_the_total():
    loss = project.diffuse([10.0, 100.0, 100.0], [20.0, 5.0, 5.0], 1)
    assert loss == [10.0, 10.0, 10.0]
    assert project.diffuse([1.0, 1.0], [5.0, 5.0], 1) == [1.0, 1.0]


def test_years_end(spark):
    tiny = spark.createDataFrame([("a", 1e9, 1e-3)], "state string, forest double, defor double")
    with pytest.raises(ValueError, match="longer"):
        project.years_to_exhaustion(tiny, 2020)
    some = spark.createDataFrame([("a", 10.0, 5.0), ("b", 30.0, 5.0)], "state string, forest double, defor double")
    assert {r.state: r.ny for r in project.years_to_exhaustion(some, 2020).collect()} == {"a": 2, "b": 4}


def test_samples_are_exact_and_repeat(spark):
    rows = raster_of(spark, np.random.default_rng(2).integers(0, 2, (40, 40)), "int")
    a, b = (sorted(map(tuple, sample.stratified(rows, 50).collect())) for _ in range(2))
    assert a == b and [sum(r[2] == k for r in a) for k in (0, 1)] == [50, 50]
    two = sample.two_stage(rows, F.floor(F.col("y") / 10), 60)
    assert two.distinct().count() == two.count() <= 120
    assert sorted(map(tuple, sample.two_stage(rows, F.floor(F.col("y") / 10), 60).collect())) == sorted(map(tuple, two.collect()))
    assert sample.adapted_size(2.0e7) == 20000 and sample.adapted_size(1.0) == 10000


def test_draws_of_large_totals_do_not_overflow(spark):
    """A draw times a total of 5e9 pixels stays a double; in 64-bit integers the product of a 32-bit draw would not fit."""
    u = spark.range(1000).select((sample.uniform(F.col("id")) * 5.0e9).alias("at")).agg(F.min("at"), F.max("at"), F.avg("at")).first()
    assert 0 <= u[0] and u[1] < 5.0e9 and 2.0e9 < u[2] < 3.0e9


def test_row_numbers_and_splits(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    got = sample.numbered(df, sample.draw_key(F.col("k")), ["k"], "place").collect()
    assert sorted(r.place for r in got) == list(range(1000))
    split = sample.holdout(df, "k", 30, 0)
    assert split.filter("is_test").count() == 300 and split.count() == 1000
    assert sample.holdout(df.filter("false"), "k", 30, 0).count() == 0


def test_lookup_moves_only_the_sample(spark):
    layers = spark.range(10_000).select((F.col("id") / 100).cast("int").alias("y"), (F.col("id") % 100).cast("int").alias("x"), F.col("id").alias("b"))
    picks = spark.createDataFrame([(3, 4, 0), (7, 8, 1), (500, 0, 1)], "y int, x int, v int")
    out = sample.lookup(picks, layers)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(3, 4, 0, 304), (7, 8, 1, 708), (500, 0, 1, None)], key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.count("broadcast") >= 2


def test_rasterize_in_bands(spark, monkeypatch):
    """Stars with holes over several bands against a test of every pixel's centre."""
    rng = np.random.default_rng(7)
    meta = RasterMeta(70, 90, 0.0, 90.0, 1.0, 1.0)

    def star(cx, cy, r, n):
        t = np.sort(rng.random(n)) * 2 * np.pi
        k = r * (0.3 + 0.7 * rng.random(n))
        return [(float(cx + a * np.cos(u)), float(cy + a * np.sin(u))) for a, u in zip(k, t, strict=True)]

    shapes = {1: [star(30, 50, 45, 17), star(30, 50, 9, 7)], 2: [star(60, 10, 20, 9)], 3: [[(-20.0, -20.0), (200.0, -20.0), (200.0, 200.0), (-20.0, 200.0)]]}

    def inside(px, py, rings):
        odd = False
        for r in rings:
            for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1], strict=True):
                if (ay <= py) != (by <= py) and px < ax + (py - ay) * (bx - ax) / (by - ay):
                    odd = not odd
        return odd

    want = {(i, y, x) for i, rings in shapes.items() for y in range(90) for x in range(70) if inside(x + 0.5, 90 - y - 0.5, rings)}
    df = spark.createDataFrame([(i, [[{"x": x, "y": y} for x, y in r] for r in rings]) for i, rings in shapes.items()], "id int, rings array<array<struct<x:double,y:double>>>")
    for band in (256, 16):
        monkeypatch.setattr(spatial, "BAND", band)
        got = [tuple(r) for r in spatial.rasterize(df, meta).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        touched = {tuple(r) for r in spatial.rasterize(df, meta, touched=True).collect()}
        assert want <= touched and len(touched) > len(want)


def test_sampler_recovers_parameters():
    rng = np.random.default_rng(5)
    cells = [(i, j) for i in range(6) for j in range(6)]
    edges = np.array([(a, b) for a, p in enumerate(cells) for b, q in enumerate(cells) if a != b and max(abs(p[0] - q[0]), abs(p[1] - q[1])) == 1])
    assert len(icar.colours(36, edges)) == 4
    rho = np.array([0.3 * (i - 2.5) for i, _ in cells])
    cell = rng.integers(0, 35, 4000)
    x = np.column_stack([np.ones(4000), rng.standard_normal(4000)])
    y = (rng.random(4000) < 1 / (1 + np.exp(-(x @ [-0.5, 0.8] + rho[cell])))).astype(float)
    draws, mean, _ = icar.sample_chain(y, x, cell, 36, edges, icar.Settings(burnin=300, mcmc=300), 1)
    assert abs(draws[:, 1].mean() - 0.8) < 0.15 and abs(draws[:, 0].mean() + 0.5) < 0.2
    assert abs(mean.sum()) < 1e-6 and np.corrcoef(mean, rho)[0, 1] > 0.9
    with pytest.raises(ValueError):
        icar.Settings(burnin=10, thin=3).check()


def test_stream_counts_once(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, 0)], "tile int, y int, x int, v int").write.parquet(src)
    for _ in range(2):
        ingest.tile_counts_stream(spark, src, "tile int, y int, x int, v int", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(1, 9, 0, 1)], "tile int, y int, x int, v int").write.mode("append").parquet(src)
    ingest.tile_counts_stream(spark, src, "tile int, y int, x int, v int", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r.v: r.n for r in ingest.totals(spark, str(tmp_path / "out")).collect()} == {0: 1, 1: 2}


def test_country_rasters(spark):
    from tesserae.plans.landcover import country_rasters

    bands = raster_of(spark, np.ones((6, 6), int), "int").select("y", "x", *[F.when(F.col("x") >= k, 1).otherwise(0).alias(f"b{k + 1}") for k in range(3)])
    area = spark.createDataFrame([(1, [[{"x": 0.0, "y": 0.0}, {"x": 180.0, "y": 0.0}, {"x": 180.0, "y": -180.0}, {"x": 0.0, "y": -180.0}]])], f"id int, rings {vector.RINGS}")
    roads = area.withColumn("highway", F.lit("primary"))
    out = country_rasters(bands, 3, RasterMeta(6, 6), area, {"roads": roads}, [bands.select("y", "x", F.col("x").cast("double").alias("v"))])
    assert {"forest_t1", "fcc12", "fcc23", "fcc13", "fcc123", "dist_edge_t3", "dist_road", "altitude", "slope"} <= set(out)
    assert out["fcc12"].filter("v = 0").count() == 6


def test_zip_and_side_files(spark, tmp_path):
    import zipfile

    from tesserae.sources import archive

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/one.tif", b"abc")
        z.writestr("two.txt", b"x")
    got = archive.read_zip(spark, str(tmp_path / "*.zip"), ".tif").collect()
    assert [(r.member, bytes(r.content)) for r in got] == [("d/one.tif", b"abc")]
    archive.write_side_file(spark, str(tmp_path / "side"), {"csize": 10})
    assert archive.read_side_file(spark, str(tmp_path / "side")) == {"csize": 10}
