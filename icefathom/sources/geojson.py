"""GeoJSON in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Nesting of ``coordinates`` per geometry type.
_DEPTH = {"Point": 1, "MultiPoint": 2, "LineString": 2, "MultiLineString": 3, "Polygon": 3, "MultiPolygon": 4}


def _nested(depth: int) -> T.DataType:
    kind: T.DataType = T.DoubleType()
    for _ in range(depth):
        kind = T.ArrayType(kind)
    return kind


def read_geojson(
    spark: SparkSession, path: str, properties: T.StructType, geometry: str = "Point", lines: bool = False
) -> DataFrame:
    """One row per feature: properties as columns, ``coordinates`` as an array.

    ``lines=True`` reads one feature per line (splittable, for large sets);
    otherwise each file is one FeatureCollection. Features of another
    geometry type keep their properties and get null coordinates.
    """
    body = T.StructType(
        [T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]
    )
    feature = T.StructType(
        [
            T.StructField("type", T.StringType()),
            T.StructField("properties", properties),
            T.StructField("geometry", body),
        ]
    )
    if lines:
        features = spark.read.schema(feature).json(path)
    else:
        collection = T.StructType([T.StructField("features", T.ArrayType(feature))])
        features = spark.read.schema(collection).json(path, multiLine=True).select(F.inline("features"))
    depth = _nested(_DEPTH[geometry]).simpleString()
    coords = F.when(F.col("geometry.type") == geometry, F.from_json("geometry.coordinates", depth))
    return features.select("properties.*", F.col("geometry.type").alias("geometry_type"), coords.alias("coordinates"))


def _feature(kind: str, coordinates: Column, properties: Column) -> Column:
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"),
            properties.alias("properties"),
        )
    )


def to_geojson_points(df: DataFrame, properties: list[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One Point feature string per row."""
    return df.select(*properties, _feature("Point", F.array(F.col(lon), F.col(lat)), F.struct(*properties)).alias("feature"))


def to_geojson_lines(lines: DataFrame, properties: list[str], coords: str = "coords") -> DataFrame:
    """One LineString feature string per nested line (see ``part_lines``); a line of one
    position, which GeoJSON does not allow, becomes a Point."""
    pairs = F.transform(coords, lambda p: F.array(p["lon"], p["lat"]))
    point = _feature("Point", F.array(F.col(coords)[0]["lon"], F.col(coords)[0]["lat"]), F.struct(*properties))
    line = _feature("LineString", pairs, F.struct(*properties))
    return lines.select(*properties, F.when(F.size(coords) > 1, line).otherwise(point).alias("feature"))


def to_geojson_routes(routes: DataFrame, properties: list[str], lines: str = "lines") -> DataFrame:
    """One MultiLineString feature string per route (see ``route_lines``)."""
    nested = F.transform(lines, lambda line: F.transform(line, lambda p: F.array(p["lon"], p["lat"])))
    return routes.select(*properties, _feature("MultiLineString", nested, F.struct(*properties)).alias("feature"))


def write_features(features: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One feature per line, readable again with ``read_geojson(lines=True)``."""
    features.select("feature").write.mode(mode).text(path)
