"""Sampling of pixels and splitting of samples. Draws are ranks of hashes, so they repeat exactly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.pixels import pixel_center, spatial_cell
from tesserae.sources.raster import KEY, RasterMeta

#: Knuth's multiplicative hash; plain arithmetic, so any engine can repeat a draw.
MULTIPLIER, MODULUS = 2654435761, 4294967296


def draw_key(*keys: Column, seed: int = 1234) -> Column:
    """A pseudo-random 32-bit rank of integer keys."""
    h = F.lit(seed % MODULUS).cast("long")
    for k in keys:
        h = (F.pmod(h + k.cast("long") + 1, F.lit(MODULUS)) * (MULTIPLIER // 2) + F.shiftright(h, 16)) % MODULUS
    return h


def adapted_size(hectares: float, least: int = 10_000, most: int = 50_000) -> int:
    """1000 per million hectares and class, at least and at most."""
    return max(least, min(most, round(1000.0 * hectares / 1e6)))


def smallest_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: int, cells: int = 256) -> DataFrame:
    """The ``n`` first rows of each group: first within ``cells`` salted parts of it, then among what these keep.

    Each part keeps up to ``n`` rows, so a group that holds most rows is cut down in parallel.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(cells))
    part = Window.partitionBy(*group, "__salt").orderBy(*order)
    kept = df.withColumn("__salt", salt).withColumn("__r", F.row_number().over(part)).filter(F.col("__r") <= n).drop("__r", "__salt")
    whole = Window.partitionBy(*group).orderBy(*order)
    return kept.withColumn("__r", F.row_number().over(whole)).filter(F.col("__r") <= n).drop("__r")


def stratified(fcc: DataFrame, per_class: int, seed: int = 1234) -> DataFrame:
    """``per_class`` pixels of class 0 and of class 1 (all, if there are fewer), deforested ones first in meaning, not in order."""
    keyed = fcc.filter(F.col("v").isin(0, 1)).select(*KEY, "v", draw_key(F.col("y"), F.col("x"), seed=seed).alias("h"))
    return smallest_per_group(keyed, ["v"], ["h", *KEY], per_class).drop("h")


#: Stretches of the cumulated pixel counts that draws and blocks meet in.
STRETCHES = 4096


def uniform(*keys: Column, seed: int = 1234) -> Column:
    """A double in [0, 1) from 52 bits: two draws, the second seeded apart."""
    return (draw_key(*keys, seed=seed) * 1048576 + F.shiftright(draw_key(*keys, seed=seed + 7919), 12)) / float(1 << 52)


def numbered(df: DataFrame, h: Column, ties: Sequence[str], name: str) -> DataFrame:
    """``df`` with row numbers from 0 in the order of the 32-bit draw ``h`` and then ``ties``.

    Rows are counted per upper half of the draw, and numbered inside it, so no window sees more than about a 65536th of them. The
    table of counts has at most 65536 rows and is broadcast.
    """
    keyed = df.withColumn("__h", h).withColumn("__b", F.shiftright("__h", 16))
    per = keyed.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = per.select("__b", (upto - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy("__h", *ties)) - 1
    out = keyed.withColumn("__inside", inside).join(F.broadcast(before), "__b")
    return out.withColumn(name, F.col("__before") + F.col("__inside")).drop("__h", "__b", "__inside", "__before")


def two_stage(fcc: DataFrame, tile: Column, per_class: int, seed: int = 1234) -> DataFrame:
    """Blocks drawn with replacement in proportion to their pixels of the class, then pixels without replacement in each block.

    A block that is drawn more often than it has pixels gives all of them. Each of ``per_class`` uniform numbers falls into one
    block's part of the cumulated counts of the class. These are cut into STRETCHES equal stretches, and a draw meets the blocks of
    its stretch only. The windows run over the table of blocks.
    """
    cells = fcc.filter(F.col("v").isin(0, 1)).select(*KEY, "v", tile.alias("tile"), draw_key(F.col("y"), F.col("x"), seed=seed).alias("h"))
    counts = cells.groupBy("v", "tile").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("v").orderBy("tile").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("n").over(Window.partitionBy("v"))
    ranges = counts.select("v", "tile", (upto - F.col("n")).alias("lo"), upto.alias("hi"), total.alias("total"))
    stretch = lambda at: F.floor(at * (float(STRETCHES) / F.col("total"))).cast("int")
    ranges = ranges.withColumn("stretch", F.explode(F.sequence(stretch(F.col("lo")), stretch(F.col("hi") - 1))))
    draws = fcc.sparkSession.range(per_class).select(F.col("id"), uniform(F.col("id"), seed=seed + 1).alias("u"))
    totals = counts.groupBy("v").agg(F.sum("n").alias("total"))
    # Two classes at most.
    drawn = draws.crossJoin(F.broadcast(totals)).withColumn("at", F.least(F.floor(F.col("u") * F.col("total")), F.col("total") - 1))
    drawn = drawn.select("v", "at", stretch(F.col("at")).alias("stretch"))
    hit = drawn.join(ranges, ["v", "stretch"]).filter((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    wanted = hit.groupBy("v", "tile").agg(F.count(F.lit(1)).alias("want"))
    ranked = cells.join(wanted, ["v", "tile"]).withColumn("k", F.row_number().over(Window.partitionBy("v", "tile").orderBy("h", *KEY)))
    return ranked.filter(F.col("k") <= F.col("want")).select(*KEY, "v")


#: A sample of at most so many pixels (two integers each) is broadcast.
BROADCAST_PIXELS = 200_000


def lookup(sampled: DataFrame, layers: DataFrame, at_most: int | None = None) -> DataFrame:
    """Sampled pixels with the values of the stacked layers, null where there is no such pixel.

    If the sample has ``at_most`` rows, or is counted to be small, its keys are broadcast to the layers, so the layers are
    filtered where they lie and nothing of them but the sampled pixels moves.
    """
    if at_most is None:
        at_most = sampled.limit(BROADCAST_PIXELS + 1).count()
    keys = sampled.select(*KEY).distinct()
    if at_most <= BROADCAST_PIXELS:
        return sampled.join(F.broadcast(layers.join(F.broadcast(keys), [*KEY], "left_semi")), [*KEY], "left")
    return sampled.join(layers, [*KEY], "left")


def sample(fcc: DataFrame, layers: DataFrame, meta: RasterMeta, tile: Column, per_class: int | None = None, csize: float = 10.0, seed: int = 1234) -> DataFrame:
    """The table a model is fitted on: y, x, v, the layers, ``east`` and ``north`` of the pixel's centre, its spatial ``cell`` of ``csize`` km.

    Without ``per_class`` the size follows the forest's area (``adapted_size``). Pixels come by ``two_stage``; rows with missing layers
    stay, since what a model needs is its own matter.
    """
    if per_class is None:
        per_class = adapted_size(fcc.filter(F.col("v").isin(0, 1)).count() * meta.pixel_ha)
    east, north = pixel_center(meta)
    drawn = lookup(two_stage(fcc, tile, per_class, seed), layers, at_most=2 * per_class)
    return drawn.withColumns({"east": east, "north": north, "cell": spatial_cell(meta, csize)})


def holdout(sample: DataFrame, key: str, ratio: float, repetition: int, seed: int = 1234) -> DataFrame:
    """``sample`` with ``is_test``: exactly round(n * ratio / 100) rows of it are true, others in each repetition. ``key`` is an integer."""
    wanted = round(sample.count() * ratio / 100.0)
    placed = numbered(sample, draw_key(F.col(key), F.lit(repetition), seed=seed), [key], "__place")
    return placed.withColumn("is_test", F.col("__place") < wanted).drop("__place")


def bootstrap(sample: DataFrame, n: int, key: str, seed: int = 1234) -> DataFrame:
    """``n`` rows drawn with replacement by random row number; ``key`` is an integer that tells rows apart."""
    placed = numbered(sample, draw_key(F.col(key), seed=seed), [key], "__i")
    size = sample.count()
    draws = sample.sparkSession.range(n).select(F.floor(uniform(F.col("id"), seed=seed + 1) * size).alias("__i"))
    return draws.join(placed, "__i").drop("__i")
