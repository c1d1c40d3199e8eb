"""Raster geometry: distance, slope, spline interpolation, resampling, rasterising polygons, reprojection."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions.pixels import pixel_center
from tesserae.runtime import ship
from tesserae.sources.raster import KEY, RasterMeta


#: Least rows and, for narrow rasters, least pixels that one Python call works on; a strip of the widest rasters is a few million pixels.
STRIP, PIXELS = 32, 1 << 14


def lower_envelope(xs: np.ndarray, heights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """min over i of (at - xs[i])^2 + heights[.., i] for ascending ``xs``: envelopes of parabolas, in linear time.

    ``heights`` has one envelope, or one a row, which advance together; an infinite height is no parabola.
    """
    h = np.atleast_2d(heights)
    hull, cuts, top = np.zeros(h.shape, np.int64), np.full(h.shape, -np.inf), np.full(len(h), -1)
    for i in range(len(xs)):
        rows = np.flatnonzero(h[:, i] < np.inf)
        meet, open_ = np.full(len(h), -np.inf), rows[top[rows] >= 0]
        while len(open_):
            j = hull[open_, top[open_]]
            m = (xs[i] + xs[j]) / 2.0 + (h[open_, i] - h[open_, j]) / (2.0 * (xs[i] - xs[j]))
            meet[open_] = m
            open_ = open_[m <= cuts[open_, top[open_]]]
            top[open_] -= 1
            meet[open_[top[open_] < 0]] = -np.inf
            open_ = open_[top[open_] >= 0]
        top[rows] += 1
        hull[rows, top[rows]], cuts[rows, top[rows]] = i, meet[rows]
    out = np.full((len(h), len(at)), np.inf)
    for r in np.flatnonzero(top >= 0):
        which = hull[r, np.searchsorted(cuts[r, : top[r] + 1], at, side="right") - 1]
        out[r] = (at - xs[which]) ** 2 + h[r, which]
    return out.reshape(*np.shape(heights)[:-1], len(at))


def distance(raster: DataFrame, meta: RasterMeta, target: int = 0, skip: int | None = None) -> DataFrame:
    """(y, x, v): Euclidean distance in map units from pixel centre to the nearest pixel of value ``target``, as a truncated integer.

    Exact and separable: a strip of rows gets, for each column, the nearest targets beyond its two edges, so each of its pixels has
    a vertical distance; then each row takes the lower envelope of the parabolas of all columns, also of those that lack its pixel.
    Windows run over one row per strip and column, never over pixels. Pixels of value ``skip`` give null; without any target all are null.
    """
    ship(raster.sparkSession)
    xres, yres = meta.xres, meta.yres
    tall = max(STRIP, -(-PIXELS // max(1, meta.ncol)))
    pixels = raster.select(*KEY, "v", F.floor(F.col("y") / tall).alias("strip")).repartition("strip")
    is_target = F.when(F.col("v") == target, F.col("y"))
    ends = pixels.groupBy("strip", "x").agg(F.min(is_target).alias("first"), F.max(is_target).alias("last"))
    ends = ends.filter("first is null or first <= last")  # all are; so both stay in every use of the table, and it is computed once
    columns = ends.filter("first is not null").select("x").distinct()
    every = ends.select("strip").distinct().crossJoin(F.broadcast(columns)).join(ends, ["strip", "x"], "left")
    before = [Window.partitionBy("x").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("strip"), F.desc("strip"))]
    above, below = (F.last(c, ignorenulls=True).over(w).cast("double") for c, w in zip(("last", "first"), before, strict=True))
    near = every.select(F.col("strip").alias("part"), F.col("x").alias("column"), above.alias("above"), below.alias("below"))

    def rows(pdf: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        edges = edges.sort_values("column")
        columns = edges["column"].to_numpy()
        ys, row = np.unique(pdf["y"].to_numpy(), return_inverse=True)
        xs, column = np.unique(pdf["x"].to_numpy(), return_inverse=True)
        hit = (pdf["v"] == target).to_numpy(bool)
        spot = row[hit], np.searchsorted(columns, xs[column[hit]])
        up, down = np.full((len(ys), len(columns)), -np.inf), np.full((len(ys), len(columns)), np.inf)
        up[spot] = down[spot] = ys[row[hit]]
        up[:1] = np.fmax(up[:1], edges["above"].to_numpy(float))
        down[-1:] = np.fmin(down[-1:], edges["below"].to_numpy(float))
        up, down = np.maximum.accumulate(up), np.minimum.accumulate(down[::-1])[::-1]
        g = np.minimum(ys[:, None] - up, down - ys[:, None])
        d = np.sqrt(lower_envelope(columns * float(xres), (g * yres) ** 2, xs * float(xres)))[row, column]
        return pd.DataFrame({"y": pdf["y"], "x": pdf["x"], "d": d if skip is None else np.where(pdf["v"] == skip, np.inf, d)})

    out = pixels.groupBy("strip").cogroup(near.groupBy("part")).applyInPandas(rows, "y int, x int, d double")
    return out.select(*KEY, F.when(F.col("d") < float("inf"), F.floor("d")).cast("long").alias("v"))


def _shifted(raster: DataFrame) -> DataFrame:
    """The raster with its eight neighbours' values a..i (row-major, e is the pixel itself); null beyond the edge.

    Each pixel is sent to the pixels around it by an explode and gathered with one aggregation, a map-side-combined shuffle
    instead of windows over whole rows and columns.
    """
    names = np.array([["a", "b", "c"], ["d", "e", "f"], ["g", "h", "i"]])
    moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(str(names[1 - dy][1 - dx])).alias("as")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    sent = raster.select(*KEY, F.col("v").cast("double").alias("v"), F.explode(moves).alias("m"))
    sent = sent.select((F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x"), F.col("m.as").alias("as"), "v")
    return sent.groupBy(*KEY).agg(*[F.max(F.when(F.col("as") == n, F.col("v"))).alias(n) for n in names.ravel()]).filter("e is not null")


def slope(dem: DataFrame, meta: RasterMeta) -> DataFrame:
    """(y, x, v): slope in degrees by the 3 x 3 kernel that weighs direct neighbours twice, rounded half to even, as a short.

    A missing direct neighbour is extrapolated through the pixel from the opposite one, or takes the pixel's own value; a missing
    diagonal one lies on the plane through its two direct neighbours and the pixel. So a plane keeps its slope up to the edge.
    """
    n = _shifted(dem)
    e = F.col("e")
    v = {k: F.coalesce(F.col(k), 2.0 * e - F.col(o), e) for k, o in (("b", "h"), ("h", "b"), ("d", "f"), ("f", "d"))}
    v |= {k: F.coalesce(F.col(k), v[p] + v[q] - e) for k, p, q in (("a", "b", "d"), ("c", "b", "f"), ("g", "h", "d"), ("i", "h", "f"))}
    dx = ((v["c"] + 2.0 * v["f"] + v["i"]) - (v["a"] + 2.0 * v["d"] + v["g"])) / (8.0 * meta.xres)
    dy = ((v["g"] + 2.0 * v["h"] + v["i"]) - (v["a"] + 2.0 * v["b"] + v["c"])) / (8.0 * meta.yres)
    return n.select(*KEY, F.rint(F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))).cast("short").alias("v"))


def spline_weights(t: Column) -> list[Column]:
    """Cubic B-spline weights of the four nodes around fraction ``t``."""
    u = 1.0 - t
    return [u * u * u / 6.0, (3.0 * t * t * t - 6.0 * t * t + 4.0) / 6.0, (-3.0 * t * t * t + 3.0 * t * t + 3.0 * t + 1.0) / 6.0, t * t * t / 6.0]


def _weighted(grid: DataFrame, factor: int, nrow: int, ncol: int, reach: Sequence[int], weights) -> DataFrame:
    """Target pixels of a grid ``factor`` times finer, each the weighted mean of the source nodes around it that exist."""
    spark = grid.sparkSession
    fine = spark.range(nrow * factor * ncol * factor).select(
        F.floor(F.col("id") / (ncol * factor)).cast("int").alias("y"), (F.col("id") % (ncol * factor)).cast("int").alias("x")
    )
    sy, sx = (F.col("y") + 0.5) / factor - 0.5, (F.col("x") + 0.5) / factor - 0.5
    wy, wx = weights(sy - F.floor(sy)), weights(sx - F.floor(sx))
    nodes = lambda base, w: F.array(*[F.struct((F.floor(base) + r).cast("int").alias("at"), x.alias("w")) for r, x in zip(reach, w, strict=True)])
    spread = fine.select(*KEY, F.explode(nodes(sy, wy)).alias("ny"), nodes(sx, wx).alias("nxs")).select(*KEY, "ny", F.explode("nxs").alias("nx"))
    spread = spread.select(*KEY, F.col("ny.at").alias("gy"), F.col("nx.at").alias("gx"), (F.col("ny.w") * F.col("nx.w")).alias("w"))
    nodes_df = grid.select(F.col("y").alias("gy"), F.col("x").alias("gx"), F.col("v").cast("double").alias("gv"))
    met = spread.join(nodes_df, ["gy", "gx"]).filter("gv is not null")
    return met.groupBy(*KEY).agg(F.try_divide(F.sum(F.col("w") * F.col("gv")), F.sum("w")).alias("v"))


def spline_refine(grid: DataFrame, nrow: int, ncol: int, factor: int = 10) -> DataFrame:
    """Cubic B-spline surface through a coarse grid (y, x, v), sampled ``factor`` times finer; weights renormalise at the edge."""
    return _weighted(grid, factor, nrow, ncol, (-1, 0, 1, 2), spline_weights)


def bilinear_refine(grid: DataFrame, nrow: int, ncol: int, factor: int) -> DataFrame:
    """Bilinear resampling of a grid to one ``factor`` times finer; nulls are left out and weights renormalise."""
    return _weighted(grid, factor, nrow, ncol, (0, 1), lambda t: [1.0 - t, t])


def spatial_effects(effects: DataFrame, nrow: int, ncol: int) -> DataFrame:
    """The vector of cell effects (cell, rho) as a raster (y, x, v), cells numbered row by row."""
    return effects.select(F.floor(F.col("cell") / ncol).cast("int").alias("y"), (F.col("cell") % ncol).cast("int").alias("x"), F.col("rho").alias("v"))


def interpolate_effects(effects: DataFrame, nrow: int, ncol: int, km: int = 10, to_km: int = 1) -> DataFrame:
    """Cell effects of ``km`` wide cells as a smooth surface of ``to_km`` wide pixels."""
    return spline_refine(spatial_effects(effects, nrow, ncol), nrow, ncol, km // to_km)


#: Rows of a polygon that one task turns into runs.
BAND = 256


def band_runs(segs: np.ndarray, rows: range, ncol: int, touched: bool = False) -> list[tuple[int, int, int]]:
    """Runs (y, first x, last x) of a polygon in ``rows``: centres inside by the even-odd rule; ``touched`` adds any pixel an edge runs through.

    A pixel's upper and left borders are its own, its lower and right ones are not. ``segs`` (x1, y1, x2, y2 in pixels) are all edges of outer ring and holes that meet these rows. Runs of a row do not overlap.
    """
    x1, y1, x2, y2 = segs.T
    out = []
    for y in rows:
        line = y + 0.5
        at = (y1 <= line) != (y2 <= line)
        cuts = np.sort(x1[at] + (line - y1[at]) * (x2[at] - x1[at]) / (y2[at] - y1[at]))
        spans = [(math.ceil(a - 0.5), math.ceil(b - 0.5) - 1) for a, b in zip(cuts[::2].tolist(), cuts[1::2].tolist(), strict=True)]
        if touched:
            lo, hi = np.maximum(np.minimum(y1, y2), y), np.minimum(np.maximum(y1, y2), y + 1)
            near = (lo <= hi) & (np.minimum(y1, y2) < y + 1)
            a, b, c, d = x1[near], y1[near], x2[near], y2[near]
            flat = b == d
            run = np.where(flat, 1.0, d - b)
            xs = [np.where(flat, e, a + (t[near] - b) * (c - a) / run) for t, e in ((lo, a), (hi, c))]
            spans += zip(np.floor(np.minimum(*xs)).astype(int).tolist(), np.floor(np.maximum(*xs)).astype(int).tolist(), strict=True)
        merged: list[list[int]] = []
        for first, last in sorted((max(0, f), min(ncol - 1, t)) for f, t in spans):
            if first > last:
                continue
            if merged and first <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], last)
            else:
                merged.append([first, last])
        out += [(y, f, t) for f, t in merged]
    return out


def rasterize(polygons: DataFrame, meta: RasterMeta, touched: bool = False) -> DataFrame:
    """(id, y, x) of the pixels of each polygon; ``polygons`` has id and rings, an array of arrays of (x, y).

    Edges go to the bands of rows they meet. A task turns one band of one polygon into runs, and the runs become pixels in the JVM, so
    neither a large polygon nor its pixels are ever held in one place.
    """
    ship(polygons.sparkSession)
    ring = F.explode("rings")
    edges = F.transform("ring", lambda p, i: F.struct(p.alias("a"), F.get("ring", (i + 1) % F.size("ring")).alias("b")))
    lines = polygons.select("id", ring.alias("ring")).select("id", F.explode(edges).alias("e"))
    px = lambda p: (F.col(f"e.{p}.x").cast("double") - meta.xmin) / meta.xres
    py = lambda p: (meta.ymax - F.col(f"e.{p}.y").cast("double")) / meta.yres
    segs = lines.select("id", px("a").alias("x1"), py("a").alias("y1"), px("b").alias("x2"), py("b").alias("y2"))
    row = lambda y: F.least(F.greatest(F.floor(y), F.lit(0)), F.lit(meta.nrow - 1))
    top, bottom = F.least("y1", "y2"), F.greatest("y1", "y2")
    met = segs.filter((bottom >= 0) & (top <= meta.nrow))
    met = met.withColumn("band", F.explode(F.sequence(F.floor(row(top) / BAND), F.floor(row(bottom) / BAND))))
    kind = dict(polygons.dtypes)["id"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = range(int(key[1]) * BAND, min(meta.nrow, (int(key[1]) + 1) * BAND))
        got = band_runs(pdf[["x1", "y1", "x2", "y2"]].to_numpy(float), rows, meta.ncol, touched)
        return pd.DataFrame({"id": [key[0]] * len(got), "y": [g[0] for g in got], "a": [g[1] for g in got], "b": [g[2] for g in got]})

    runs = met.groupBy("id", "band").applyInPandas(run, f"id {kind}, y int, a int, b int")
    return runs.select("id", "y", F.explode(F.sequence("a", "b")).alias("x"))


def crop(raster: DataFrame, polygons: DataFrame, meta: RasterMeta) -> DataFrame:
    """Pixels of the raster that any polygon touches."""
    return raster.join(rasterize(polygons, meta, touched=True).select(*KEY).distinct(), [*KEY], "left_semi")


def cells_touched(polygons: DataFrame, meta: RasterMeta, km: float) -> DataFrame:
    """(cell): the spatial cells of ``km`` that any polygon touches."""
    from tesserae.operators.grid import cell_grid

    nrow, ncol = cell_grid(meta.extent, km)
    grid = RasterMeta(ncol, nrow, meta.xmin, meta.ymax, km * 1000, km * 1000, meta.crs)
    return rasterize(polygons, grid, touched=True).select((F.col("y") * F.lit(ncol) + F.col("x")).cast("long").alias("cell")).distinct()


def extent(vertices: DataFrame) -> DataFrame:
    """One row xmin, ymin, xmax, ymax of vertices (x, y)."""
    return vertices.agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))


def buffered(box: DataFrame, metres: float = 5000.0) -> DataFrame:
    """The extent moved outward by ``metres`` to whole numbers."""
    lo, hi = (lambda c: F.floor(F.col(c) - metres).cast("long").alias(c)), (lambda c: F.ceil(F.col(c) + metres).cast("long").alias(c))
    return box.select(lo("xmin"), lo("ymin"), hi("xmax"), hi("ymax"))


#: WGS 84 ellipsoid (fixed values).
A, E = 6378137.0, 0.0818191908426215


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 to EPSG:3395 in metres."""
    phi = F.radians(lat)
    s = E * F.sin(phi)
    return F.radians(lon) * A, A * F.log(F.tan(math.pi / 4 + phi / 2) * F.pow((1 - s) / (1 + s), F.lit(E / 2)))


def from_mercator(east: Column, north: Column, steps: int = 7) -> tuple[Column, Column]:
    """EPSG:3395 to EPSG:4326; the latitude by fixed-point iteration, good to 1e-12 degrees."""
    t = F.exp(-north / A)
    phi = math.pi / 2 - 2 * F.atan(t)
    for _ in range(steps):
        s = E * F.sin(phi)
        phi = math.pi / 2 - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(E / 2)))
    return F.degrees(east / A), F.degrees(phi)


def warp_nearest(target: DataFrame, target_meta: RasterMeta, source: DataFrame, meta: RasterMeta) -> DataFrame:
    """The source raster on the target's pixels: centres are projected into the source's system, then an equi-join on its pixels.

    The systems are EPSG:4326 and EPSG:3395, or equal.
    """
    east, north = pixel_center(target_meta)
    if target_meta.crs != meta.crs:
        if {target_meta.crs, meta.crs} != {"EPSG:4326", "EPSG:3395"}:
            raise ValueError(f"no projection from {target_meta.crs} to {meta.crs}")
        east, north = from_mercator(east, north) if meta.crs == "EPSG:4326" else to_mercator(east, north)
    keyed = target.select(*KEY, F.floor((east - meta.xmin) / meta.xres).cast("int").alias("sx"), F.floor((meta.ymax - north) / meta.yres).cast("int").alias("sy"))
    return keyed.join(source.select(F.col("y").alias("sy"), F.col("x").alias("sx"), "v"), ["sy", "sx"], "left").select(*KEY, "v")


def snapped(box: tuple[float, float, float, float], res: float) -> tuple[float, float, float, float]:
    """An extent moved outward to multiples of the resolution."""
    xmin, ymin, xmax, ymax = box
    return math.floor(xmin / res) * res, math.floor(ymin / res) * res, math.ceil(xmax / res) * res, math.ceil(ymax / res) * res


def warped_meta(spark: SparkSession, meta: RasterMeta, res: float) -> RasterMeta:
    """The EPSG:3395 grid of ``res`` metres that covers a raster in EPSG:4326: its projected corners, moved outward."""
    xmin, ymin, xmax, ymax = meta.extent
    corners = [c for lon, lat in ((xmin, ymin), (xmax, ymax)) for c in to_mercator(F.lit(lon), F.lit(lat))]
    # Rounded to the micrometre, so that a corner on the grid adds no row for its rounding error.
    x0, y0, x1, y1 = snapped(tuple(round(float(c), 6) for c in spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(corners)]).first()), res)
    return RasterMeta(round((x1 - x0) / res), round((y1 - y0) / res), x0, y1, res, res, "EPSG:3395")
