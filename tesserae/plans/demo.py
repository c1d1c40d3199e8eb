"""The rasters that the registered queries run on: the star-schema tables read as grids 100 pixels wide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.pixels import null_if_nodata, rescale
from tesserae.sources.raster import KEY, RasterMeta, from_keys

WIDTH = 100
YEARS = 10.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fcc123(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period codes: 1 lost first, 2 lost later, 3 kept, 0 nodata."""
    status = F.col("o_orderstatus")
    v = F.when(F.col("o_orderpriority") == "5-LOW", 0).when(status == "F", 1).when(status == "P", 2).otherwise(3)
    return from_keys(table(spark, sf_dir, "orders"), "o_orderkey", WIDTH, v=v)


def fcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("v") == 1, 0).when(F.col("v") >= 2, 1).otherwise(255)
    return fcc123(spark, sf_dir).select(*KEY, v.alias("v"))


def risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk classes 1..65535, 0 nodata."""
    v = F.when(F.col("event_type") == "error", 0).otherwise(rescale(F.least(F.col("value") / 500.0, F.lit(1.0))))
    return from_keys(table(spark, sf_dir, "events"), "event_id", WIDTH, v=v)


def events_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_keys(table(spark, sf_dir, "events"), "event_id", WIDTH, value=F.col("value"), user_id=F.col("user_id"))


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coarse grid: one of its pixels covers 2 rows and 5 columns of the others."""
    return from_keys(table(spark, sf_dir, "customer"), "c_custkey", WIDTH // 5, v=F.col("c_acctbal"))


def meta_of(raster: DataFrame) -> RasterMeta:
    """The description of a 100-wide grid: its height is one number, read off the data."""
    return RasterMeta(WIDTH, int(raster.agg(F.max("y")).first()[0]) + 1)


#: The grids' heights grow with the data, but only width and resolution enter most operators.
META = RasterMeta(WIDTH, 1)
STOCK_META = RasterMeta(WIDTH // 5, 1, xres=150.0, yres=60.0)


def future(spark: SparkSession, sf_dir: str, share: float = 0.3) -> DataFrame:
    """The projected map after a quota of ``share`` of the forest pixels."""
    from tesserae.operators.project import deforest

    r = risk(spark, sf_dir)
    return deforest(r, META, quota_ha(r, share))[1]


def quota_ha(r: DataFrame, share: float) -> float:
    n = r.filter(F.col("v") > 0).count()
    return round(share * n) * META.pixel_ha


def observed_and_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, x, obs, pred) on the pixels that both maps have."""
    a = fcc(spark, sf_dir).select(*KEY, F.col("v").alias("obs"))
    return a.join(future(spark, sf_dir).select(*KEY, F.col("v").alias("pred")), [*KEY])


def masked(raster: DataFrame, nodata: float) -> DataFrame:
    return raster.withColumn("v", null_if_nodata(F.col("v"), nodata))
