"""Track files: CSV fixes with a fixed schema."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
TRACK_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("fix_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
    ]
)


def read_tracks(
    spark: SparkSession, path: str, schema: T.StructType = TRACK_SCHEMA, header: bool = True, sep: str = ","
) -> DataFrame:
    """Fixes from CSV; a malformed line keeps its text in ``_corrupt_record``.

    A line is malformed if it has more or fewer fields than the schema, or a field that
    is not empty and not of its type. The test is an expression over the whole line, so
    it does not depend on the columns a caller selects. With ``header`` the lines that
    name the schema's columns are left out.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    if header:
        names = sep.join(f.name for f in schema.fields).lower()
        lines = lines.filter(F.lower(F.trim("value")) != names)
    # Separators inside quotes do not count.
    bare = F.regexp_replace("value", '"(?:[^"]|"")*"', "")
    n_fields = F.size(F.split(bare, re.escape(sep), -1))
    raw = ", ".join(f"`{f.name}` string" for f in schema.fields)
    parsed = lines.withColumn("_f", F.from_csv("value", raw, {"sep": sep}))
    broken = n_fields != len(schema.fields)
    columns = []
    for field in schema.fields:
        text = F.trim(F.col("_f")[field.name])
        value = text.try_cast(field.dataType)
        broken = broken | F.coalesce((text != "") & value.isNull(), F.lit(False))
        columns.append(value.alias(field.name))
    return parsed.select(*columns, F.when(broken, F.col("value")).alias(CORRUPT))


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable rows without the corrupt column, and the unreadable lines."""
    return df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), df.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)
