"""Aggregations over rasters: counts, histograms, confusion, windows, emissions, rank statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.pixels import CLASSES
from tesserae.operators.grid import square_of
from tesserae.sources.raster import KEY, RasterMeta


def count_pixels(raster: DataFrame, meta: RasterMeta, value: int = 1) -> DataFrame:
    """One row: pixels with ``value`` and their area in hectares."""
    n = F.count_if(F.col("v") == value)
    return raster.agg(n.alias("npix")).withColumn("area", F.col("npix") * F.lit(meta.pixel_ha))


def counts_by_tile(raster: DataFrame, tile: Column, zero: int = 0, one: int = 1) -> DataFrame:
    """Per tile: pixels of two classes."""
    return raster.groupBy(tile.alias("tile")).agg(
        F.count_if(F.col("v") == zero).alias("n_zero"), F.count_if(F.col("v") == one).alias("n_one")
    )


def histogram(risk: DataFrame, value: str = "v") -> DataFrame:
    """(cat, n) for every class from 1 to 65535, empty ones too; other values are left out."""
    counted = risk.filter(F.col(value).between(1, CLASSES)).groupBy(F.col(value).cast("int").alias("cat")).agg(F.count(F.lit(1)).alias("n"))
    classes = risk.sparkSession.range(1, CLASSES + 1).select(F.col("id").cast("int").alias("cat"))
    return classes.join(counted, "cat", "left").select("cat", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def band_statistics(raster: DataFrame, value: str = "v") -> DataFrame:
    v = F.col(value).cast("double")
    return raster.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def check_forest_cover(raster: DataFrame, bands: Sequence[str], meta: RasterMeta, crs: str, least: int = 3, strict: bool = False) -> None:
    """Raise ValueError unless there are enough bands, the reference system is ``crs`` and every band runs from 0 or 1 to 0 or 1.

    Only the extremes are tested; ``strict`` also rejects values between them and nulls.
    """
    if len(bands) < least:
        raise ValueError(f"{len(bands)} bands, at least {least} are needed")
    if meta.crs != crs:
        raise ValueError(f"reference system {meta.crs} is not {crs}")
    row = raster.agg(
        *[f(F.col(b)).alias(f"{n}_{b}") for b in bands for n, f in (("lo", F.min), ("hi", F.max))],
        *[F.count_if(F.col(b).isNull() | ~F.col(b).isin(0, 1)).alias(f"odd_{b}") for b in bands],
    ).first()
    for b in bands:
        if row[f"lo_{b}"] not in (0, 1) or row[f"hi_{b}"] not in (0, 1) or (strict and row[f"odd_{b}"]):
            raise ValueError(f"band {b} has values other than 0 and 1")


def minmax(raster: DataFrame, bands: Sequence[str]) -> DataFrame:
    """(band, lo, hi) from one pass over all bands."""
    pairs = F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("v")) for b in bands])
    return raster.select(F.explode(pairs).alias("p")).groupBy(F.col("p.band").alias("band")).agg(F.min("p.v").alias("lo"), F.max("p.v").alias("hi"))


def confusion(pairs: DataFrame, pred: str = "pred", obs: str = "obs") -> DataFrame:
    """One row n00, n01, n10, n11; the first digit is the prediction. Values other than 0 and 1 count nowhere."""
    is_ = lambda p, o: F.count_if((F.col(pred) == p) & (F.col(obs) == o))
    return pairs.agg(is_(0, 0).alias("n00"), is_(0, 1).alias("n01"), is_(1, 0).alias("n10"), is_(1, 1).alias("n11"))


def difference_matrix(diff: DataFrame, value: str = "v") -> DataFrame:
    """The confusion row from a raster of difference classes."""
    n = lambda k: F.count_if(F.col(value) == k)
    return diff.agg(n(0).alias("n00"), n(3).alias("n01"), n(2).alias("n10"), n(1).alias("n11"))


def count_confusion(grids: DataFrame) -> DataFrame:
    """Confusion from count grids joined as o0, o1, p0, p1: agreement is the smaller count, excess of the prediction the error."""
    over = lambda p, o: F.sum(F.greatest(F.lit(0), F.col(p) - F.col(o)))
    return grids.agg(
        F.sum(F.least("o0", "p0")).alias("n00"), over("p1", "o1").alias("n10"), over("p0", "o0").alias("n01"), F.sum(F.least("o1", "p1")).alias("n11")
    )


def resample_sum(raster: DataFrame, value: int, window: int) -> DataFrame:
    """(y, x, n): pixels with ``value`` in each window; windows at the ragged edge hold what is there."""
    if not 1 <= window <= 1000:
        raise ValueError("window must be between 1 and 1000")
    keys = [F.floor(F.col(k) / window).cast("int").alias(k) for k in KEY]
    return raster.groupBy(*keys).agg(F.count_if(F.col("v") == value).alias("n"))


def counts_by_square(pairs: DataFrame, meta: RasterMeta, size: int = 33, forest: int = 1, lost: int = 0) -> DataFrame:
    """Per square: observed and predicted pixels of both classes, squares numbered row by row."""
    n = lambda c, v: F.count_if(F.col(c) == v)
    return pairs.groupBy(square_of(size, meta.ncol).alias("square")).agg(
        n("obs", forest).alias("obs_f"), n("pred", forest).alias("pred_f"), n("obs", lost).alias("obs_d"), n("pred", lost).alias("pred_d")
    )


def emissions(stocked: DataFrame, meta: RasterMeta, coefficient: float = 0.47, forest: str = "v", stock: str = "stock") -> DataFrame:
    """One row: tonnes of carbon on pixels that lose forest; negative stocks count 0, missing ones not at all; half to even."""
    lost = F.when(F.col(forest) == 0, F.greatest(F.col(stock), F.lit(0.0)))
    total = F.coalesce(F.sum(lost), F.lit(0.0))
    return stocked.agg(F.rint(total * F.lit(coefficient) * F.lit(meta.pixel_ha)).cast("long").alias("carbon"))


def auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: exact area under the ROC curve (ties count half) and the numbers of positives and negatives.

    Scores are reduced to one row per distinct value. Those are summed up within 4096 equal ranges between the least and the
    largest score, and the ranges' totals give what lies below each, so no task sees all distinct values.
    """
    tied = scored.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q")
    )
    ends = scored.agg(F.min(F.col(score).cast("double")).alias("lo"), F.max(F.col(score).cast("double")).alias("hi"))
    share = F.coalesce(F.try_divide(F.col("s") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    # ``ends`` is one row.
    cells = tied.crossJoin(F.broadcast(ends)).withColumn("cell", F.floor(share * 4096).cast("long")).drop("lo", "hi")
    inside = Window.partitionBy("cell").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_cell = cells.groupBy("cell").agg(F.sum("q").alias("cq"))
    before = per_cell.select("cell", (F.sum("cq").over(Window.orderBy("cell")) - F.col("cq")).alias("below"))
    ranked = cells.withColumn("upto", F.sum("q").over(inside)).join(F.broadcast(before), "cell")
    wins = F.sum(F.col("p") * (F.col("below") + F.col("upto") - F.col("q") / 2.0))
    out = ranked.agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), wins.alias("w"))
    return out.select(F.try_divide(F.col("w"), F.col("n_pos") * F.col("n_neg")).alias("auc"), "n_pos", "n_neg")


def sampled_auc(scored: DataFrame, key: str, draws: int = 100_000, seed: int = 1234, score: str = "score", label: str = "label") -> DataFrame:
    """Monte-Carlo estimate from ``draws`` random pairs, drawn with replacement by row numbers; ``key`` is an integer that tells rows apart."""
    from tesserae.operators.sample import draw_key, numbered, uniform

    def side(y: int, name: str, place: str) -> tuple[DataFrame, int]:
        rows = scored.filter(F.col(label) == y).select(F.col(score).alias(name), F.col(key).alias("__key"))
        return numbered(rows, draw_key(F.col("__key"), seed=seed), ["__key"], place).drop("__key"), rows.count()

    (pos, n_pos), (neg, n_neg) = side(1, "sp", "i"), side(0, "sn", "j")
    at = lambda n, k: F.floor(uniform(F.col("id"), seed=seed + k) * n).alias("i" if k == 1 else "j")
    joined = scored.sparkSession.range(draws).select(at(n_pos, 1), at(n_neg, 2)).join(pos, "i").join(neg, "j")
    return joined.agg(F.avg(F.when(F.col("sp") > F.col("sn"), 1.0).when(F.col("sp") == F.col("sn"), 0.5).otherwise(0.0)).alias("auc"))


def deviance(scored: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """One row: deviance of the model, of the constant model, and the share explained in percent."""
    ll = lambda prob: F.sum(F.when(F.col(y) == 1, F.log(prob)).otherwise(F.log1p(-prob)))
    base = scored.agg(F.avg(F.col(y).cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    model = scored.agg((-2.0 * ll(F.col(p))).alias("deviance"))
    null = base.select((-2.0 * F.col("n") * (F.col("m") * F.log("m") + (1 - F.col("m")) * F.log1p(-F.col("m")))).alias("null_deviance"))
    both = model.crossJoin(F.broadcast(null))
    return both.withColumn("explained", 100.0 * (1.0 - F.col("deviance") / F.col("null_deviance")))


def quantile_bins(data: DataFrame, value: str, success: str, bins: int = 10, closed: str = "right") -> DataFrame:
    """Per quantile bin: bounds, mid-point, rows, success rate and its standard error.

    Bins are (lower, upper] with ``closed="right"`` (the minimum falls out) or [lower, upper).
    """
    steps = [i / bins for i in range(bins + 1)]
    cuts = data.agg(F.percentile(value, F.array(*[F.lit(s) for s in steps])).alias("q"))
    table = cuts.select(F.posexplode(F.arrays_zip(F.slice("q", 1, bins).alias("lower"), F.slice("q", 2, bins).alias("upper"))))
    table = table.select((F.col("pos") + 1).cast("int").alias("bin"), "col.lower", "col.upper")
    v = F.col(value)
    hit = (v > F.col("lower")) & (v <= F.col("upper")) if closed == "right" else (v >= F.col("lower")) & (v < F.col("upper"))
    # The bin table has ``bins`` rows.
    joined = data.join(F.broadcast(table), hit)
    n, s = F.count(F.lit(1)), F.sum(F.col(success).cast("double"))
    out = joined.groupBy("bin", "lower", "upper").agg(n.alias("n"), s.alias("s"))
    ph = (F.col("s") + 0.5) / (F.col("n") + 1)
    return out.select(
        "bin", ((F.col("lower") + F.col("upper")) / 2).alias("mid"), "n", (F.col("s") / F.col("n")).alias("rate"), F.sqrt(ph * (1 - ph) / (F.col("n") + 1)).alias("se")
    )


def fixed_bins(data: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) of equally wide bins; the upper end belongs to the last one."""
    b = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)) + 1, F.lit(bins)).cast("int")
    inside = data.filter(F.col(value).between(low, high))
    return inside.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def posterior_summary(chains: DataFrame, names: Sequence[str]) -> DataFrame:
    """(parameter, mean, std, q025, q975) of the named columns, nulls and NaN left out."""
    pairs = F.array(*[F.struct(F.lit(n).alias("parameter"), F.nanvl(F.col(n).cast("double"), F.lit(None).cast("double")).alias("v")) for n in names])
    long = chains.select(F.explode(pairs).alias("p")).select("p.*")
    q = F.percentile("v", F.array(F.lit(0.025), F.lit(0.975)))
    return long.groupBy("parameter").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.get(q, F.lit(0)).alias("q025"), F.get(q, F.lit(1)).alias("q975")
    )
