"""Rasters as relations: one row per pixel, keyed by (y, x), with a small description beside the table.

``y`` and ``x`` are zero-based row and column; row 0 is the northern edge. Values may span several columns (bands).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.pixels import null_if_nodata

KEY = ("y", "x")


@dataclass(frozen=True)
class RasterMeta:
    """Grid of a raster: size in pixels, north-west corner, resolution (both positive), reference system, nodata, type."""

    ncol: int
    nrow: int
    xmin: float = 0.0
    ymax: float = 0.0
    xres: float = 30.0
    yres: float = 30.0
    crs: str = "EPSG:3395"
    nodata: float | None = None
    dtype: str = "short"

    @property
    def pixel_ha(self) -> float:
        return self.xres * self.yres / 10000.0

    @property
    def extent(self) -> tuple[float, float, float, float]:
        """(xmin, ymin, xmax, ymax)."""
        return self.xmin, self.ymax - self.nrow * self.yres, self.xmin + self.ncol * self.xres, self.ymax

    def coarser(self, factor: int) -> RasterMeta:
        return replace(self, ncol=-(-self.ncol // factor), nrow=-(-self.nrow // factor), xres=self.xres * factor, yres=self.yres * factor)


def from_keys(table: DataFrame, key: str, width: int, **values: Column) -> DataFrame:
    """A raster from a dense row number: y = key div width, x = key mod width, then the value columns."""
    k = F.col(key)
    return table.select(
        F.floor(k / width).cast("int").alias("y"), (k % width).cast("int").alias("x"), *[v.alias(n) for n, v in values.items()]
    )


def scan(spark: SparkSession, path: str, meta: RasterMeta | None = None, bands: tuple[str, ...] = ("v",), window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Read a Parquet raster: chosen bands, an optional pixel window (x0, y0, nx, ny), nodata as NULL.

    Band pruning and the window reach the Parquet scan; tables written by ``store`` are sorted by tile, so row groups
    outside the window are skipped.
    """
    df = spark.read.parquet(path).select(*KEY, *bands)
    if window is not None:
        x0, y0, nx, ny = window
        df = df.filter((F.col("x") >= x0) & (F.col("x") < x0 + nx) & (F.col("y") >= y0) & (F.col("y") < y0 + ny))
    if meta is not None and meta.nodata is not None:
        df = df.withColumns({b: null_if_nodata(F.col(b), meta.nodata) for b in bands})
    return df


def tile_of(size: int, ncol: int) -> Column:
    """Row-major tile number of a pixel for square tiles of ``size``."""
    return F.floor(F.col("y") / size) * (-(-ncol // size)) + F.floor(F.col("x") / size)


def store(df: DataFrame, path: str, meta: RasterMeta, tile: int = 1024, files: int | None = None) -> None:
    """Write a raster as Parquet, range-partitioned and sorted by tile, zstd-compressed."""
    key = F.col("__tile")
    tiled = df.withColumn("__tile", tile_of(tile, meta.ncol))
    ranged = tiled.repartitionByRange(files, key) if files else tiled.repartitionByRange(key)
    ranged.sortWithinPartitions("__tile", *KEY).drop("__tile").write.mode("overwrite").option("compression", "zstd").parquet(path)


def store_bucketed(df: DataFrame, table: str, buckets: int = 256, path: str | None = None) -> None:
    """Save as a table bucketed by (y, x), at ``path`` if given: rasters of one grid then join pixel by pixel without a shuffle."""
    writer = df.write.mode("overwrite").bucketBy(buckets, *KEY).sortBy(*KEY)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def catalogue(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Named rasters in the order of their names; the name is the part of the base name before the first dot."""
    return {n.split(".")[0]: spark.read.parquet(p) for n, p in sorted(paths.items())}


#: The four sets of dated rasters and the undated names they are bound to (fixed names).
VARIABLE_SETS = {
    "calibration": {"fcc": "fcc12", "forest": "forest_t1", "dist_edge": "dist_edge_t1", "dist_defor": "dist_defor_t1"},
    "validation": {"fcc": "fcc23", "forest": "forest_t2", "dist_edge": "dist_edge_t2", "dist_defor": "dist_defor_t2"},
    "historical": {"fcc": "fcc13", "forest": "forest_t1", "dist_edge": "dist_edge_t1", "dist_defor": "dist_defor_t1"},
    "forecast": {"fcc": "fcc23", "forest": "forest_t3", "dist_edge": "dist_edge_t3", "dist_defor": "dist_defor_t3"},
}


def bind_variable_sets(rasters: dict[str, DataFrame]) -> dict[str, dict[str, DataFrame]]:
    """The rasters of each set under their undated names; a missing raster is an error."""
    missing = sorted({n for s in VARIABLE_SETS.values() for n in s.values()} - set(rasters))
    if missing:
        raise KeyError(f"rasters not found: {', '.join(missing)}")
    return {s: {undated: rasters[dated] for undated, dated in names.items()} for s, names in VARIABLE_SETS.items()}
