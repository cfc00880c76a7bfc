"""Joins that stay spread out when one key, cell or bucket is hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from icefathom.session import stored

PARAM_ROWS = 256
BLOCK_ROWS = 20_000
SPREAD = 64


def fan_out(df: DataFrame, params: DataFrame, max_rows: int = PARAM_ROWS) -> DataFrame:
    """One copy of every row per parameter row (profiles, scenarios, drafts).

    Up to ``max_rows`` parameter rows, checked here, become a literal array
    that each row explodes: no join and no shuffle. A longer parameter table
    is spread over a salt and met through an ordinary equi-join on it; there are
    as many salts as the left side fills shuffle partitions, four times over.
    """
    rows = params.limit(max_rows + 1).collect()
    if len(rows) <= max_rows:
        fields = params.schema.fields
        structs = [
            F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in fields]) for row in rows
        ]
        if not structs:
            shape = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
            literal = F.filter(F.array(shape), lambda _: F.lit(False))
        else:
            literal = F.array(*structs)
        return df.select("*", F.inline(literal))
    spread = max(SPREAD, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = params.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return (
        df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(spread)).cast("int"))
        .join(salted, "_salt")
        .drop("_salt")
    )


def block_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_id: str,
    right_id: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Inner equi-join on ``keys`` whose hot keys are cut into blocks.

    A key with more than ``block_rows`` rows on a side is split on that side
    by a hash of its id and repeated on the other, so one task never meets
    more than ``block_rows`` x ``block_rows`` rows of a key. Hot keys are
    found with one partially aggregated count per side, and stored, so that the
    sides are not shuffled to meet them; when there are none the join is left as it is.
    """
    n_left = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nl"))
    n_right = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nr"))
    hot = stored(
        n_left.join(n_right, keys)
        .filter((F.col("_nl") > block_rows) | (F.col("_nr") > block_rows))
        .select(
            *keys,
            F.ceil(F.col("_nl") / block_rows).cast("int").alias("_bl"),
            F.ceil(F.col("_nr") / block_rows).cast("int").alias("_br"),
        )
    )
    if hot.isEmpty():
        return left.join(right, keys)

    def split(df: DataFrame, row_id: str, mine: str, other: str) -> DataFrame:
        blocks = df.join(hot, keys, "left")
        own = F.pmod(F.xxhash64(F.col(row_id)), F.coalesce(F.col(mine), F.lit(1))).cast("int")
        copies = F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)
        return blocks.withColumn("_own", own).withColumn("_copy", F.explode(copies)).drop("_bl", "_br")

    a = split(left, left_id, "_bl", "_br").withColumnRenamed("_own", "_blk_l").withColumnRenamed("_copy", "_blk_r")
    b = split(right, right_id, "_br", "_bl").withColumnRenamed("_own", "_blk_r").withColumnRenamed("_copy", "_blk_l")
    return a.join(b, [*keys, "_blk_l", "_blk_r"]).drop("_blk_l", "_blk_r")


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key under ``order``.

    ``row_number() = 1`` is pruned to one row per key and task before the
    shuffle, so a key with a third of the rows costs a row per task.
    """
    ranked = df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") == 1).drop("_rn")
