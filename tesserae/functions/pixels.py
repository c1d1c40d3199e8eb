"""Column functions on pixel values. All stay inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from tesserae.sources.raster import RasterMeta

# Fixed values of the probability map: classes 1 to 65535 stand for probabilities from 1e-6 to 1.
CLASSES = 65535
NODATA = 255


def invlogit(x: Column) -> Column:
    """Inverse logit that never exponentiates a positive number."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def logit(p: Column) -> Column:
    return F.log(p) - F.log1p(-p)


def rescale(p: Column) -> Column:
    """Probability to class 1..65535, truncated; probabilities below 1e-6 count as 1e-6."""
    clamped = F.greatest(p, F.lit(1e-6))
    return ((clamped * 1e6 - 1.0) * float(CLASSES - 1) / 999999.0 + 1.0).cast("int")


def class_rate(cat: Column) -> Column:
    """The probability that a class stands for."""
    return ((cat - 1.0) * 999999.0 / float(CLASSES - 1) + 1.0) * 1e-6


def null_if_nodata(v: Column, nodata: float) -> Column:
    return F.when(v != F.lit(nodata), v)


def kept_forest(before: Column, after: Column) -> Column:
    """Forest at both dates 1, lost 0, anything else nodata."""
    return F.when(before == 1, F.when(after == 1, 1).when(after == 0, 0)).otherwise(None)


def with_nodata(v: Column, nodata: int = NODATA) -> Column:
    return F.coalesce(v, F.lit(nodata))


def inside_area(v: Column, area: Column, nodata: int = NODATA) -> Column:
    """0 and 1 stay inside the area, everything else is nodata."""
    return F.when((area == 1) & v.isin(0, 1), v).otherwise(nodata)


def period_code(*dates: Column) -> Column:
    """Number of dates with forest."""
    return reduce(lambda a, b: a + b, dates)


def projected(risk: Column, threshold: Column) -> Column:
    """Future map: nodata where there is no risk class, 0 (deforested) from the threshold on, 1 below it."""
    return F.when(F.coalesce(risk, F.lit(0)) == 0, NODATA).when(risk >= threshold, 0).otherwise(1)


def difference(a: Column, b: Column) -> Column:
    """0 and 1 where both agree, 2 missed change, 3 false change; where B has other values, A's value."""
    return F.when((a == 1) & (b == 0), 2).when((a == 0) & (b == 1), 3).otherwise(a)


def annual_rate(lost: Column, forest: Column, years: float) -> Column:
    """Yearly rate from the share lost over ``years``; null where there was no forest."""
    return 1.0 - F.pow(1.0 - F.try_divide(lost, forest), F.lit(1.0 / years))


def pixel_center(meta: RasterMeta) -> tuple[Column, Column]:
    """(east, north) of the pixel's centre."""
    return (F.col("x") + 0.5) * meta.xres + meta.xmin, meta.ymax - (F.col("y") + 0.5) * meta.yres


def spatial_cell(meta: RasterMeta, km: float) -> Column:
    """Row-major number of the ``km`` wide cell that holds the pixel's centre."""
    size = km * 1000.0
    east, north = pixel_center(meta)
    columns = -int(-(meta.extent[2] - meta.extent[0]) // size)
    across = F.floor((east - meta.xmin) / size)
    down = F.floor((meta.ymax - north) / size)
    return (down * columns + across).cast("long")
