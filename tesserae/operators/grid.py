"""Grids: blocks, alignment, stacks, mosaics, overviews, spatial cells and their neighbours."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions.pixels import pixel_center
from tesserae.sources.raster import KEY, RasterMeta


def tiles(spark: SparkSession, meta: RasterMeta, width: int, height: int) -> DataFrame:
    """Row-major tiles (tile, x0, y0, nx, ny); the last ones of a row or column may be smaller."""
    across, down = -(-meta.ncol // width), -(-meta.nrow // height)
    t = F.col("id")
    x0, y0 = (t % across) * width, F.floor(t / across) * height
    return spark.range(across * down).select(
        t.alias("tile"),
        x0.cast("int").alias("x0"),
        y0.cast("int").alias("y0"),
        F.least(F.lit(width), meta.ncol - x0).cast("int").alias("nx"),
        F.least(F.lit(height), meta.nrow - y0).cast("int").alias("ny"),
    )


def blocks(spark: SparkSession, meta: RasterMeta, rows: int = 128) -> DataFrame:
    """Blocks of whole rows, or squares of 256 pixels if ``rows`` is not positive."""
    return tiles(spark, meta, meta.ncol, rows) if rows > 0 else tiles(spark, meta, 256, 256)


def squares(spark: SparkSession, meta: RasterMeta, size: int = 33) -> DataFrame:
    return tiles(spark, meta, size, size)


def square_of(size: int, ncol: int) -> Column:
    return (F.floor(F.col("y") / size) * (-(-ncol // size)) + F.floor(F.col("x") / size)).cast("long")


def align(base: DataFrame, base_meta: RasterMeta, layer: DataFrame, meta: RasterMeta, small: bool = False) -> DataFrame:
    """Left join of a raster on another grid by nearest neighbour: the source pixel that holds the base pixel's centre.

    The key is computed, so this is an equi-join; ``small`` broadcasts a coarse layer whose size the caller has checked.
    """
    east, north = pixel_center(base_meta)
    sx = F.floor((east - meta.xmin) / meta.xres).cast("int")
    sy = F.floor((meta.ymax - north) / meta.yres).cast("int")
    other = layer.withColumnsRenamed({"y": "__y", "x": "__x"})
    keyed = base.withColumns({"__y": sy, "__x": sx})
    return keyed.join(F.broadcast(other) if small else other, ["__y", "__x"], "left").drop("__y", "__x")


def stack(base: DataFrame, base_meta: RasterMeta, layers: Mapping[str, tuple[DataFrame, RasterMeta]]) -> DataFrame:
    """The base with one column per layer (value column ``v``), each aligned to the base's pixels.

    Layers on the same grid all join on (y, x), so one shuffle of each side serves every join.
    """
    out = base
    for name, (layer, meta) in layers.items():
        one = layer.select(*KEY, F.col("v").alias(name))
        same = (meta.xmin, meta.ymax, meta.xres, meta.yres) == (base_meta.xmin, base_meta.ymax, base_meta.xres, base_meta.yres)
        out = out.join(one, [*KEY], "left") if same else align(out, base_meta, one, meta)
    return out


def complete(stacked: DataFrame, forest: str | None, bands: Sequence[str]) -> DataFrame:
    """Pixels without a null in any band, also unused ones, and with forest where a mask is named."""
    kept = stacked.dropna(subset=list(bands))
    return kept.filter(F.col(forest) == 1) if forest else kept


def mosaic(rasters: Sequence[DataFrame]) -> DataFrame:
    """One raster from tiles; where they overlap, the later one wins unless it is null."""
    numbered = [r.select(*KEY, "v", F.lit(i).alias("__n")) for i, r in enumerate(rasters)]
    whole = reduce(DataFrame.unionByName, numbered)
    return whole.groupBy(*KEY).agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.col("__n"))).alias("v"))


def decimation(ncol: int, nrow: int, maxpixels: int) -> int:
    """The power of two by which both axes shrink so that at most ``maxpixels`` remain."""
    factor = 1
    while (ncol * nrow) // (factor * factor) > maxpixels:
        factor *= 2
    return factor


def overview_nearest(raster: DataFrame, factor: int) -> DataFrame:
    """Every ``factor``-th pixel of every ``factor``-th row."""
    kept = raster.filter((F.col("y") % factor == 0) & (F.col("x") % factor == 0))
    return kept.withColumns({"y": F.floor(F.col("y") / factor).cast("int"), "x": F.floor(F.col("x") / factor).cast("int")})


def overview_average(raster: DataFrame, factor: int) -> DataFrame:
    """Mean of the non-null pixels of each ``factor`` x ``factor`` window."""
    keys = [F.floor(F.col(k) / factor).cast("int").alias(k) for k in KEY]
    return raster.groupBy(*keys).agg(F.avg("v").alias("v"))


def pyramid(raster: DataFrame, factors: Sequence[int] = (2, 4, 8, 16, 32)) -> dict[int, DataFrame]:
    """Averaged overviews; each level sums the sums and counts of the level before, never the full raster again."""
    level = raster.select(*KEY, F.col("v").cast("double").alias("s"), F.when(F.col("v").isNotNull(), 1).otherwise(0).alias("n"))
    out, done = {}, 1
    for f in factors:
        keys = [F.floor(F.col(k) / (f // done)).cast("int").alias(k) for k in KEY]
        level, done = level.groupBy(*keys).agg(F.sum("s").alias("s"), F.sum("n").alias("n")), f
        out[f] = level.select(*KEY, F.try_divide(F.col("s"), F.col("n")).alias("v"))
    return out


def cell_grid(extent: tuple[float, float, float, float], km: float) -> tuple[int, int]:
    """(rows, columns) of the grid of ``km`` wide cells over (xmin, ymin, xmax, ymax)."""
    xmin, ymin, xmax, ymax = extent
    return -int(-(ymax - ymin) // (km * 1000)), -int(-(xmax - xmin) // (km * 1000))


def _around(cells: DataFrame, nrow: int, ncol: int, rank: int) -> DataFrame:
    """(cell, neighbor): king's moves up to ``rank`` that stay on the grid; an explode of offsets, never a theta join."""
    steps = F.sequence(F.lit(-rank), F.lit(rank))
    i, j = F.floor(F.col("cell") / ncol), F.col("cell") % ncol
    moved = cells.select("cell", i.alias("i"), j.alias("j"), F.explode(steps).alias("di")).select("*", F.explode(steps).alias("dj"))
    ni, nj = F.col("i") + F.col("di"), F.col("j") + F.col("dj")
    on = (ni >= 0) & (ni < nrow) & (nj >= 0) & (nj < ncol) & ~((F.col("di") == 0) & (F.col("dj") == 0))
    return moved.filter(on).select("cell", (ni * ncol + nj).cast("long").alias("neighbor"))


def neighbours(spark: SparkSession, nrow: int, ncol: int, rank: int = 1) -> DataFrame:
    """(cell, neighbor) for every cell of the grid, cells numbered row by row, the cell itself left out."""
    return _around(spark.range(nrow * ncol).select(F.col("id").alias("cell")), nrow, ncol, rank)


def neighbours_within(cells: DataFrame, nrow: int, ncol: int, rank: int = 1) -> DataFrame:
    """Neighbours among the kept ``cells`` only, both sides renumbered densely from 0 in the order of the cells.

    The table of cells is the coarse spatial grid (a few thousand rows per country), hence the single window.
    """
    kept = cells.select("cell").distinct()
    dense = kept.select("cell", (F.row_number().over(Window.orderBy("cell")) - 1).cast("long").alias("id"))
    edges = _around(kept, nrow, ncol, rank)
    there = dense.select(F.col("cell").alias("neighbor"), F.col("id").alias("neighbor_id"))
    return edges.join(there, "neighbor").join(dense, "cell").select("cell", F.col("id").alias("cell_id"), "neighbor", "neighbor_id")


def adjacency(edges: DataFrame) -> DataFrame:
    """(cell, n, adj): the number of neighbours and their ascending list."""
    return edges.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("neighbor")).alias("adj"))


def offsets(adjacent: DataFrame) -> DataFrame:
    """(cell, n, start): where each cell's stretch begins in the flat neighbour list. One row per coarse spatial cell."""
    upto = F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return adjacent.select("cell", "n", (upto - F.col("n")).alias("start"))
