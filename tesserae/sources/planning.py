"""Which remote files an area needs: tile arithmetic and download plans. Nothing here opens a connection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TILE_DEGREES = 5


def tile_range(box: DataFrame) -> DataFrame:
    """(left, right, top, bottom, tile_long, tile_lat) of the 5-degree elevation tiles over xmin, ymin, xmax, ymax.

    A range of a single tile is widened by one.
    """
    col = lambda edge: F.ceil((edge + 180) / TILE_DEGREES).cast("int")
    row = lambda edge: F.ceil((60 - edge) / TILE_DEGREES).cast("int")
    left, right = col(F.floor("xmin")), col(F.ceil("xmax"))
    top, bottom = row(F.ceil("ymax")), row(F.floor("ymin"))
    wide = box.select("*", left.alias("left"), right.alias("right"), top.alias("top"), bottom.alias("bottom"))
    wide = wide.withColumns({
        "right": F.when(F.col("left") == F.col("right"), F.col("right") + 1).otherwise(F.col("right")),
        "bottom": F.when(F.col("top") == F.col("bottom"), F.col("bottom") + 1).otherwise(F.col("bottom")),
    })
    text = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    return wide.withColumns({"tile_long": F.concat_ws("-", text("left"), text("right")), "tile_lat": F.concat_ws("-", text("top"), text("bottom"))})


def tiles(ranges: DataFrame) -> DataFrame:
    """One row per tile of each range: the product of two short sequences."""
    out = ranges.withColumn("i", F.explode(F.sequence("left", "right"))).withColumn("j", F.explode(F.sequence("top", "bottom")))
    name = F.concat(F.lit("srtm_"), F.lpad(F.col("i").cast("string"), 2, "0"), F.lit("_"), F.lpad(F.col("j").cast("string"), 2, "0"))
    return out.select("i", "j", name.alias("tile"))


def countries(spark: SparkSession, path: str) -> DataFrame:
    """The country table: semicolon-separated with a header, NA is null."""
    return spark.read.csv(path, sep=";", header=True, nullValue="NA")


def lookup_code(table: DataFrame, code: str, key: str = "iso3", value: str = "iso_wdpa") -> DataFrame:
    return table.filter(F.col(key) == code).select(value)


def download_plan(spark: SparkSession, code: str, templates: dict[str, str], wanted: dict[str, bool], present: DataFrame) -> DataFrame:
    """(source, url, target, done): one row per source that is switched on; a target that is present is done.

    ``templates`` map a source to a URL with ``{code}``; ``present`` lists the targets there are.
    """
    rows = [(s, url.format(code=code), f"{s}_{code}") for s, url in templates.items() if wanted.get(s, True)]
    plan = spark.createDataFrame(rows, "source string, url string, target string")
    there = present.select("target", F.lit(True).alias("done")).distinct()
    return plan.join(there, "target", "left").select("source", "url", "target", F.coalesce("done", F.lit(False)).alias("done"))


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A comma-separated table with a header and a stated schema."""
    return spark.read.csv(path, header=True, schema=schema)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


