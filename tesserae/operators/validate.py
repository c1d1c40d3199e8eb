"""Validation of maps and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.project import PERIODS
from tesserae.sources.raster import KEY, RasterMeta

INDICES = ("OA", "EA", "FOM", "Sen", "Spe", "TSS", "K")


def indices(matrix: DataFrame, event: int = 1, decimals: int | None = None) -> DataFrame:
    """OA, EA, FOM, Sen, Spe, TSS, K of a confusion row (first digit: prediction), with class ``event`` as the positive one.

    An index whose denominator is 0 is null. Rounding is half to even.
    """
    n = {k: F.col(k).cast("double") for k in ("n00", "n01", "n10", "n11")}
    hit, rest = (n["n11"], n["n00"]) if event == 1 else (n["n00"], n["n11"])
    # Positive in the prediction only, and in the observation only.
    false_, missed = (n["n10"], n["n01"]) if event == 1 else (n["n01"], n["n10"])
    total = n["n00"] + n["n01"] + n["n10"] + n["n11"]
    div = F.try_divide
    oa = div(n["n00"] + n["n11"], total)
    ea = div((n["n11"] + n["n10"]) * (n["n11"] + n["n01"]) + (n["n00"] + n["n01"]) * (n["n00"] + n["n10"]), total * total)
    sen, spe = div(hit, hit + missed), div(rest, rest + false_)
    out = {"OA": oa, "EA": ea, "FOM": div(hit, hit + n["n10"] + n["n01"]), "Sen": sen, "Spe": spe, "TSS": sen + spe - 1.0, "K": div(oa - ea, 1.0 - ea)}
    rounded = {k: v if decimals is None else F.bround(v, decimals) for k, v in out.items()}
    return matrix.select(*[v.alias(k) for k, v in rounded.items()])


def map_indices(matrix: DataFrame) -> DataFrame:
    """The indices of a map of forest counts: deforestation (0) is the event; sensitivity is taken over the first row."""
    n = {k: F.col(k).cast("double") for k in ("n00", "n01", "n10", "n11")}
    total = n["n00"] + n["n01"] + n["n10"] + n["n11"]
    div = F.try_divide
    oa = div(n["n00"] + n["n11"], total)
    ea = div((n["n11"] + n["n10"]) * (n["n11"] + n["n01"]) + (n["n00"] + n["n01"]) * (n["n00"] + n["n10"]), total * total)
    sen, spe = div(n["n00"], n["n00"] + n["n10"]), div(n["n11"], n["n11"] + n["n01"])
    return matrix.select(
        oa.alias("OA"), ea.alias("EA"), div(n["n00"], n["n00"] + n["n10"] + n["n01"]).alias("FOM"), sen.alias("Sen"), spe.alias("Spe"),
        (sen + spe - 1.0).alias("TSS"), div(oa - ea, 1.0 - ea).alias("K"),
    )


def predicted_and_observed(fcc123: DataFrame, risk: DataFrame, rates: DataFrame, meta: RasterMeta, years: float, period: str = "calibration", pixels: int = 300) -> DataFrame:
    """Per coarse cell of ``pixels`` x ``pixels``: cell, nfor_obs, ndefor_obs, nfor_obs_ha, ndefor_obs_ha, ndefor_pred_ha.

    Only cells with forest at the start. The prediction sums the density of every pixel with a class; the class table
    (65535 rows) is broadcast.
    """
    start, lost = PERIODS[period]
    pairs = fcc123.select(*KEY, F.col("v").alias("f")).join(risk.select(*KEY, F.col("v").alias("cat")), [*KEY])
    dens = pairs.join(F.broadcast(rates.select("cat", "defor_dens")), "cat", "left")
    cell = (F.floor(F.col("y") / pixels) * (-(-meta.ncol // pixels)) + F.floor(F.col("x") / pixels)).cast("long")
    per_cell = dens.groupBy(cell.alias("cell")).agg(
        F.count_if(F.col("f") > start).alias("nfor_obs"), F.count_if(F.col("f").isin(*lost)).alias("ndefor_obs"),
        F.coalesce(F.sum(F.col("defor_dens") * float(years)), F.lit(0.0)).alias("ndefor_pred_ha"),
    )
    ha = F.lit(meta.pixel_ha)
    return per_cell.filter("nfor_obs > 0").select(
        "cell", "nfor_obs", "ndefor_obs", (F.col("nfor_obs") * ha).alias("nfor_obs_ha"), (F.col("ndefor_obs") * ha).alias("ndefor_obs_ha"), "ndefor_pred_ha"
    )


def cell_errors(cells: DataFrame, pixels: int, meta: RasterMeta) -> DataFrame:
    """One row: RMSE, wRMSE (weighted by forest area), MedAE, R2, ncell, csize_coarse_grid, csize_coarse_grid_ha."""
    e = F.col("ndefor_pred_ha") - F.col("ndefor_obs_ha")
    weighted = F.sqrt(F.try_divide(F.sum(e * e * F.col("nfor_obs_ha")), F.sum("nfor_obs_ha")))
    r = F.corr("ndefor_pred_ha", "ndefor_obs_ha")
    return cells.agg(
        F.bround(F.sqrt(F.avg(e * e)), 2).alias("RMSE"), F.bround(weighted, 2).alias("wRMSE"), F.bround(F.median(F.abs(e)), 2).alias("MedAE"),
        F.bround(r * r, 2).alias("R2"), F.count(F.lit(1)).alias("ncell"),
    ).withColumns({"csize_coarse_grid": F.lit(pixels), "csize_coarse_grid_ha": F.lit(pixels * pixels * meta.pixel_ha)})


def above_quantile(scored: DataFrame, score: str, share: float) -> DataFrame:
    """``scored`` with ``pred``: 1 strictly above the (1 - share) quantile (linear interpolation), else 0."""
    cut = scored.agg(F.percentile(score, F.lit(1.0 - share)).alias("__cut"))
    return scored.crossJoin(F.broadcast(cut)).withColumn("pred", F.when(F.col(score) > F.col("__cut"), 1).otherwise(0)).drop("__cut")
