"""Pipelines that turn source layers into the named rasters of a country."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.pixels import inside_area, kept_forest, period_code, with_nodata
from tesserae.operators.grid import mosaic
from tesserae.operators.spatial import bilinear_refine, buffered, crop, distance, extent, rasterize, slope
from tesserae.sources.raster import KEY, RasterMeta
from tesserae.sources.vector import places, protected_areas, roads, vertices, waterways


def forest_rasters(bands: DataFrame, dates: int, meta: RasterMeta, area: DataFrame | None = None) -> dict[str, DataFrame]:
    """forest_t*, fcc*, dist_edge_t*, dist_defor_t*, fcc13 or fcc12345-like codes from one column per date (b1, b2, ...).

    Three dates are t1 to t3, four are t0 to t3; any other number is an error. ``area`` (y, x) limits the result.
    """
    if dates not in (3, 4):
        raise ValueError("3 or 4 dates are needed")
    first = 4 - dates
    named = {f"t{i}": F.col(f"b{i - first + 1}") for i in range(first, 4)}
    base = bands if area is None else bands.join(area.select(*KEY, F.lit(1).alias("__in")), [*KEY], "left")
    inside = F.lit(1) if area is None else F.coalesce("__in", F.lit(0))
    out = {f"forest_{t}": base.select(*KEY, (c * inside).cast("short").alias("v")) for t, c in named.items()}
    steps = list(named)
    for a, b in [*zip(steps[:-1], steps[1:], strict=True), ("t1", "t3")]:
        v = inside_area(with_nodata(kept_forest(named[a], named[b])), inside)
        out[f"fcc{a[1]}{b[1]}"] = base.select(*KEY, v.cast("short").alias("v"))
    out["fcc123"] = base.select(*KEY, (period_code(named["t1"], named["t2"], named["t3"]) * inside).cast("short").alias("v"))
    for t in steps:
        out[f"dist_edge_{t}"] = distance(out[f"forest_{t}"], meta, target=0)
    if dates == 4:
        for a, b in zip(steps[:-1], steps[1:], strict=True):
            out[f"dist_defor_{b}"] = distance(out[f"fcc{a[1]}{b[1]}"], meta, target=0)
    return out


def mapped_distances(features: Mapping[str, DataFrame], grid: DataFrame, meta: RasterMeta) -> dict[str, DataFrame]:
    """Distance to the nearest road, town and river pixel; ``features`` has tables named roads, towns and rivers with rings."""
    rules = {"roads": ("dist_road", roads), "towns": ("dist_town", places), "rivers": ("dist_river", waterways)}
    out = {}
    for name, (to, rule) in rules.items():
        if name in features:
            burnt = rasterize(rule(features[name]), meta, touched=True).select(*KEY).distinct().withColumn("b", F.lit(1))
            marked = grid.select(*KEY).join(burnt, [*KEY], "left").select(*KEY, F.coalesce("b", F.lit(0)).alias("v"))
            out[to] = distance(marked, meta, target=1)
    return out


def elevation_rasters(tiles: list[DataFrame], meta: RasterMeta, refine: int = 1) -> dict[str, DataFrame]:
    """altitude and slope from elevation tiles on one grid, resampled bilinearly ``refine`` times finer."""
    dem = mosaic(tiles)
    if refine > 1:
        dem = bilinear_refine(dem, meta.nrow, meta.ncol, refine)
        meta = RasterMeta(meta.ncol * refine, meta.nrow * refine, meta.xmin, meta.ymax, meta.xres / refine, meta.yres / refine, meta.crs)
    return {"altitude": dem.select(*KEY, F.rint("v").cast("int").alias("v")), "slope": slope(dem, meta)}


def protected_raster(areas: DataFrame, grid: DataFrame, meta: RasterMeta, where: str | None = None) -> DataFrame:
    """1 in protected areas, else 0."""
    burnt = rasterize(protected_areas(areas, where), meta).select(*KEY).distinct().withColumn("b", F.lit(1))
    return grid.select(*KEY).join(burnt, [*KEY], "left").select(*KEY, F.coalesce("b", F.lit(0)).cast("short").alias("v"))


def biomass_raster(tiles: list[DataFrame], factor: int = 1, meta: RasterMeta | None = None) -> DataFrame:
    """Biomass from one or more tiles, bilinear if it is refined."""
    whole = mosaic(tiles)
    return bilinear_refine(whole, meta.nrow, meta.ncol, factor) if factor > 1 and meta is not None else whole


def area_box(area: DataFrame, buffer_m: float = 5000.0) -> DataFrame:
    """Buffered integer extent of a layer with rings."""
    return buffered(extent(vertices(area)), buffer_m)


def country_rasters(bands: DataFrame, dates: int, meta: RasterMeta, area: DataFrame, features: Mapping[str, DataFrame], elevation: list[DataFrame] = (), protected: DataFrame | None = None, biomass: list[DataFrame] = ()) -> dict[str, DataFrame]:  # noqa: E501
    """All rasters of a country that its sources allow, lazily: only what is written or read gets computed."""
    inside = rasterize(area, meta, touched=True).select(*KEY).distinct()
    grid = bands.select(*KEY)
    out = forest_rasters(bands, dates, meta, inside)
    out |= mapped_distances(features, grid, meta)
    if elevation:
        out |= elevation_rasters(list(elevation), meta)
    if protected is not None:
        out["pa"] = protected_raster(protected, grid, meta)
    if biomass:
        out["AGB"] = biomass_raster(list(biomass))
    return {n: crop(r, area, meta) if n in ("altitude", "slope", "AGB") else r for n, r in out.items()}
