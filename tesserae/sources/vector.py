"""Vector layers as tables: (id, attributes..., rings), from GeoJSON or WKT text; predicates on tags and protected areas."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.runtime import ship

RINGS = "array<array<struct<x:double,y:double>>>"


def _rings(geometry: dict) -> list[list[dict]]:
    kind, c = geometry["type"], geometry["coordinates"]
    lines = {"Point": lambda: [[c]], "MultiPoint": lambda: [c], "LineString": lambda: [c], "MultiLineString": lambda: c, "Polygon": lambda: c}
    parts = lines[kind]() if kind in lines else [r for p in c for r in p]
    out = []
    for part in parts:
        closed = "Polygon" in kind and len(part) > 1 and part[0] == part[-1]
        out.append([{"x": float(p[0]), "y": float(p[1])} for p in (part[:-1] if closed else part)])
    return out


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(id, properties, kind, rings) of each feature of GeoJSON feature collections; properties stay JSON text."""
    ship(spark)
    files = spark.read.text(path, wholetext=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text in pdf["value"]:
                rows = [(i, json.dumps(f.get("properties") or {}), f["geometry"]["type"], _rings(f["geometry"])) for i, f in enumerate(json.loads(text)["features"]) if f.get("geometry")]
                yield pd.DataFrame(rows, columns=["id", "properties", "kind", "rings"])

    return files.mapInPandas(run, f"id long, properties string, kind string, rings {RINGS}")


def parse_wkt(wkt: Column) -> Column:
    """Rings of WKT points, lines and polygons, with built-in functions; a polygon's closing vertex is left out."""
    body = F.regexp_replace(wkt, r"^\s*[A-Za-z]+\s*", "")
    rings = F.regexp_extract_all(body, F.lit(r"\(([^()]*)\)"), F.lit(1))
    point = lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("y"))
    shaped = F.transform(rings, lambda r: F.transform(F.split(r, ","), point))
    polygon = F.upper(F.ltrim(wkt)).startswith("POLYGON") | F.upper(F.ltrim(wkt)).startswith("MULTIPOLYGON")
    return F.when(polygon, F.transform(shaped, lambda r: F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(1))))).otherwise(shaped)


def vertices(layer: DataFrame, *keep: str) -> DataFrame:
    """One row per vertex: the columns ``keep``, ring, place, x, y."""
    rings = layer.select(*keep, F.posexplode("rings").alias("ring", "points"))
    return rings.select(*keep, "ring", F.posexplode("points").alias("place", "p")).select(*keep, "ring", "place", "p.x", "p.y")


#: Tag values of the three layers of mapped features (fixed values).
ROADS, PLACES, WATERWAYS = ("motorway", "trunk"), ("city", "town", "village"), ("river", "canal")


def roads(features: DataFrame, column: str = "highway") -> DataFrame:
    """Motorways, trunk roads and everything that ends in -ary; missing tags fall out."""
    tag = F.col(column)
    return features.filter(tag.isNotNull() & (tag.isin(*ROADS) | tag.endswith("ary")))


def places(features: DataFrame, column: str = "place") -> DataFrame:
    return features.filter(F.col(column).isin(*PLACES))


def waterways(features: DataFrame, column: str = "waterway") -> DataFrame:
    return features.filter(F.col(column).isin(*WATERWAYS))


#: Status of protected areas that count, and of those that count if proposed before 2010 (fixed values).
PROTECTED = ("Designated", "Inscribed", "Established")


def protected_areas(areas: DataFrame, where: str | None = None) -> DataFrame:
    """Areas in force, or proposed before 2010 (year at characters 7 to 10 of the date); ``where`` replaces the rule."""
    if where is not None:
        return areas.filter(where)
    year = F.try_to_number(F.substring("date", 7, 4), F.lit("9999")).cast("int")
    return areas.filter(F.col("status").isin(*PROTECTED) | ((F.col("status") == "Proposed") & (year < 2010)))


def check_area(crs: str, wanted: str = "EPSG:4326") -> None:
    if crs != wanted:
        raise ValueError(f"reference system {crs} is not {wanted}")


