"""Projection of change: rates per risk class, area quotas, allocation, and diffusion over states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions.pixels import annual_rate, class_rate, projected
from tesserae.operators.aggregate import histogram
from tesserae.sources.raster import KEY, RasterMeta

#: Which period codes count as forest at the start (greater than) and as lost (any of), by period (fixed values).
PERIODS = {"calibration": (0, (1,)), "validation": (1, (2,)), "historical": (0, (1, 2)), "forecast": (0, (1, 2))}


def rates_by_class(fcc123: DataFrame, risk: DataFrame, meta: RasterMeta, years: float, period: str = "calibration") -> DataFrame:
    """The table of all 65535 risk classes: cat, nfor, ndefor, rate_obs, rate_mod, rate_abs, time_interval, pixel_area, defor_dens."""
    start, lost = PERIODS[period]
    pairs = fcc123.select(*KEY, F.col("v").alias("f")).join(risk.select(*KEY, F.col("v").alias("cat")), [*KEY])
    per_class = (
        pairs.filter("cat between 1 and 65535")
        .groupBy("cat")
        .agg(F.count_if(F.col("f") > start).alias("nfor"), F.count_if(F.col("f").isin(*lost)).alias("ndefor"))
    )
    classes = fcc123.sparkSession.range(1, 65536).select(F.col("id").cast("int").alias("cat"))
    zero = F.lit(0).cast("long")
    full = classes.join(per_class, "cat", "left").select("cat", F.coalesce("nfor", zero).alias("nfor"), F.coalesce("ndefor", zero).alias("ndefor"))
    full = full.withColumns({"rate_obs": annual_rate(F.col("ndefor"), F.col("nfor"), years), "rate_mod": class_rate(F.col("cat"))})
    # Modelled rates are whole multiples of 1e-6 / 65534, so their sum is taken in whole numbers, exact in any order.
    parts = F.sum(F.col("nfor") * ((F.col("cat") - 1).cast("decimal(12,0)") * 999999 + 65534)).cast("double")
    factor = per_class.agg(F.try_divide(F.sum("ndefor") * F.lit(65534.0e6), parts).alias("factor"))
    # ``factor`` is one row.
    scaled = full.crossJoin(F.broadcast(factor)).withColumn("rate_abs", F.col("factor") * F.col("rate_mod"))
    return scaled.select(
        "cat", "nfor", "ndefor", "rate_obs", "rate_mod", "rate_abs", F.lit(float(years)).alias("time_interval"), F.lit(meta.pixel_ha).alias("pixel_area"),
        (F.col("rate_abs") * meta.pixel_ha / years).alias("defor_dens"),
    )


def quota_threshold(risk: DataFrame, meta: RasterMeta, hectares: float) -> DataFrame:
    """One row: threshold, ndp, nfp, hectares, error, error_perc.

    The quota in pixels is cut from the top of the class histogram, at the class boundary that comes nearer to it; on a tie
    the smaller area. Beyond the highest class nothing is deforested. A quota of at least the forest takes all of it. The
    windows run over the 65535 classes, never over pixels.
    """
    h = histogram(risk)
    down = Window.orderBy(F.desc("cat")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = F.lit(hectares) * 10000.0 / F.lit(meta.xres * meta.yres)
    w = h.select("cat", "n", F.sum("n").over(down).alias("cum")).withColumn("nfp", F.sum("n").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    w = w.withColumn("k", F.rint(wanted).cast("long"))
    cut = w.filter("cum >= k").agg(F.max(F.struct("cat", "cum", "n", "nfp", "k")).alias("t")).select("t.*")
    total = w.agg(F.max("nfp").alias("nfp_all"), F.max("k").alias("k_all"))
    left = total.join(F.broadcast(cut), F.lit(True), "left")
    all_ = F.col("k_all") >= F.col("nfp_all")
    higher = (F.col("cum") - F.col("k")) >= (F.col("k") - (F.col("cum") - F.col("n")))
    out = left.select(
        F.when(all_, 1).when(higher, F.col("cat") + 1).otherwise(F.col("cat")).cast("int").alias("threshold"),
        F.when(all_, F.col("nfp_all")).when(higher, F.col("cum") - F.col("n")).otherwise(F.col("cum")).alias("ndp"),
        F.col("nfp_all").alias("nfp"),
        F.lit(float(hectares)).alias("hectares"),
        all_.alias("__all"),
    )
    error = F.when(F.col("__all"), 0.0).otherwise(F.col("ndp") * meta.pixel_ha - F.col("hectares"))
    return out.withColumn("error", error).withColumn("error_perc", F.bround(F.try_divide(100.0 * F.col("error"), F.col("hectares")), 2)).drop("__all")


def deforest(risk: DataFrame, meta: RasterMeta, hectares: float) -> tuple[DataFrame, DataFrame]:
    """(statistics, future map): one pass for the histogram, one narrow pass that broadcasts the single threshold row."""
    stats = quota_threshold(risk, meta, hectares)
    future = risk.crossJoin(F.broadcast(stats.select("threshold"))).select(*KEY, projected(F.col("v"), F.col("threshold")).cast("int").alias("v"))
    return stats, future


def allocate(risk_in_project: DataFrame, rates: DataFrame, juris_ha: float, years: float) -> DataFrame:
    """(period, length (yr), deforestation (ha)) for one year and for the whole period.

    The jurisdiction's area is spread over classes by their modelled rate; a project gets the part of its own classes.
    """
    factor = rates.agg((F.lit(juris_ha) / (F.first("pixel_area") * F.sum(F.col("nfor") * F.col("rate_mod")))).alias("factor"), F.first("pixel_area").alias("pixel"))
    counts = histogram(risk_in_project).filter("n > 0")
    joined = counts.join(rates.select("cat", "rate_mod"), "cat", "left").crossJoin(F.broadcast(factor))
    annual = joined.agg(F.coalesce(F.sum(F.col("n") * F.col("rate_mod") * F.col("factor") * F.col("pixel") / years), F.lit(0.0)).alias("annual"))
    rows = F.array(
        F.struct(F.lit("annual").alias("period"), F.lit(1).alias("length (yr)"), F.bround("annual", 1).alias("deforestation (ha)")),
        F.struct(F.lit("entire").alias("period"), F.lit(int(years)).alias("length (yr)"), F.bround(F.col("annual") * years, 1).alias("deforestation (ha)")),
    )
    return annual.select(F.inline(rows))


def density_map(risk: DataFrame, rates: DataFrame, nodata: float = -9999.0) -> DataFrame:
    """Deforestation density (ha per pixel and year) of each pixel's class; nodata where there is no class.

    The class table has 65535 rows of two numbers and is broadcast.
    """
    table = rates.select(F.col("cat").alias("v"), "defor_dens")
    return risk.join(F.broadcast(table), "v", "left").select(*KEY, F.coalesce("defor_dens", F.lit(nodata)).alias("v"))


def diffuse(forest: list[float], annual: list[float], years: float) -> list[float]:
    """Deforestation per state after ``years``; what a state cannot lose is shared equally among states with forest left."""
    loss, spent = [a * years for a in annual], [False] * len(forest)
    while True:
        over = [i for i, (d, f) in enumerate(zip(loss, forest, strict=True)) if d > f]
        if not over:
            return loss
        excess = sum(loss[i] - forest[i] for i in over)
        for i in over:
            loss[i], spent[i] = forest[i], True
        open_ = [i for i, s in enumerate(spent) if not s]
        if not open_:
            return loss
        for i in open_:
            loss[i] += excess / len(open_)


def deforest_diffusion(states: DataFrame, t0: int, t: int) -> DataFrame:
    """(state, forest_t0, forest_t, defor): the table of states (tens of rows) is worked on the driver."""
    rows = states.select("state", F.col("forest").cast("double"), F.col("defor").cast("double")).orderBy("state").collect()
    loss = diffuse([r.forest for r in rows], [r.defor for r in rows], t - t0)
    out = [(r.state, r.forest, r.forest - d, d) for r, d in zip(rows, loss, strict=True)]
    return states.sparkSession.createDataFrame(out, f"state {dict(states.dtypes)['state']}, forest_t0 double, forest_t double, defor double")


def years_to_exhaustion(states: DataFrame, t0: int, most: int = 100_000) -> DataFrame:
    """(state, ny, year): how many years until each state's forest is gone under yearly diffusion.

    If the whole forest would last longer than ``most`` years at the rates given, it is an error: years are worked one by one.
    """
    rows = states.select("state", F.col("forest").cast("double"), F.col("defor").cast("double")).orderBy("state").collect()
    forest, annual = [r.forest for r in rows], [r.defor for r in rows]
    gone: list[int | None] = [None] * len(rows)
    t = 0
    if sum(annual) > 0:
        if sum(forest) > most * sum(annual):
            raise ValueError(f"at these rates the forest lasts longer than {most} years")
        while sum(annual) * t < sum(forest):
            for i, d in enumerate(diffuse(forest, annual, t)):
                if gone[i] is None and d >= forest[i]:
                    gone[i] = t
            t += 1
    out = [(r.state, g if g is not None else t, (g if g is not None else t) + t0) for r, g in zip(rows, gone, strict=True)]
    return states.sparkSession.createDataFrame(out, f"state {dict(states.dtypes)['state']}, ny int, year int")
