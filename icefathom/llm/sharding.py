"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in SQL functions only.

Every shard puts ``virtual`` points on a ring of ``cells`` cells; a key hashes to a cell
and belongs to the shard of the first point at or after it. A shard takes rows (or
weight) up to its capacity; the keys of a full shard continue clockwise to the next
shard that has room. All keys of a cell meet the shards in one order, so the overflow
is settled between cells: one aggregate gives the load of each cell, the settlement
(at most ``cells`` x ``shards`` numbers, whatever the size of the table) says which part
of each cell goes where, and rows pick their part by their rank in the cell. Ranks come
from windows over (cell, bucket) with as many buckets as the counted rows ask for. Rows equal
in every column are ranked as one row with its count and made again in bounded pieces, so no
window grows with the table. (Columns of a type that cannot be grouped, maps, are not taken.)

With ``slack`` 0 the capacities are the exact shares (counts at most one apart). A larger
slack leaves more keys where the plain ring puts them and moves fewer when a shard joins.

Defined cases: a null or repeated key hashes like any other; rows with the same key and
tie value are interchangeable. An empty table gives an empty result. The input's other
columns stay; one called like an output (``shard``, ``slot``) is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from icefathom.llm.columns import shield

#: Rows that one ranking window should hold, about.
BUCKET_ROWS = 200_000
#: Equal rows that one task makes again in a piece.
PIECE_ROWS = 100_000


def ring_hash(*keys: Column) -> Column:
    """60-bit place of a key, from a digest that other engines have too."""
    parts = [F.coalesce(k.cast("string"), F.lit("\0")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("\1", *parts)), 1, 15), 16, 10).cast("long")


def ring_points(spark: SparkSession, shards: int, virtual: int, cells: int) -> list[list[int]]:
    """For each cell the shards in the order a key there meets them, clockwise."""
    made = (
        spark.range(shards * virtual)
        .select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("point"))
        .select("shard", ring_hash(F.lit("shard"), F.col("shard"), F.col("point")).alias("place"))
        .select("shard", "place", (F.col("place") % cells).cast("int").alias("cell"))
        .collect()
    )
    points = sorted((row["cell"], row["place"], row["shard"]) for row in made)
    orders: list[list[int]] = []
    at = 0
    for cell in range(cells):
        while at < len(points) and points[at][0] < cell:
            at += 1
        order: list[int] = []
        for step in range(len(points)):
            shard = points[(at + step) % len(points)][2]
            if shard not in order:
                order.append(shard)
                if len(order) == shards:
                    break
        orders.append(order)
    return orders


@dataclass(frozen=True)
class Part:
    """Load ``low`` to ``high`` of a cell goes to ``shard``, from ``base`` in that shard."""

    cell: int
    shard: int
    low: int
    high: int
    base: int


def settle(loads: dict[int, int], orders: list[list[int]], capacity: list[int]) -> list[Part]:
    """Bounded loads: each round, cells offer what is left to their next shard with room."""
    room = list(capacity)
    left = {cell: load for cell, load in sorted(loads.items()) if load > 0}
    done = dict.fromkeys(left, 0)
    filled = [0] * len(capacity)
    parts: list[Part] = []
    while left:
        open_shards = {s for s, r in enumerate(room) if r > 0}
        if not open_shards:
            raise ValueError("the capacities are below the load")
        for cell in list(left):
            # Shards that fill up within a round refuse the later cells of that round.
            shard = next(s for s in orders[cell] if s in open_shards)
            take = min(left[cell], room[shard])
            if take:
                parts.append(Part(cell, shard, done[cell], done[cell] + take, filled[shard]))
                room[shard] -= take
                filled[shard] += take
                done[cell] += take
                left[cell] -= take
            if not left[cell]:
                del left[cell]
    return parts


def capacities(total: int, shards: int, slack: float) -> list[int]:
    """Exact shares, the first ones a row larger, widened by ``slack``."""
    exact = [total // shards + (s < total % shards) for s in range(shards)]
    return [share + int(share * slack) for share in exact]


def _expanded(ranked: DataFrame) -> DataFrame:
    """One row for each of the ``_n`` equal rows, ranked from ``_rank`` on.

    More than PIECE_ROWS of them are cut into pieces that are dealt to other tasks first.
    """
    last = F.col("_rank") + F.col("_n") - 1
    many = F.col("_n") > PIECE_ROWS
    few = ranked.filter(~many).withColumn("_end", last)
    pieces = ranked.filter(many).withColumn("_end", last).withColumn("_rank", F.explode(F.sequence("_rank", "_end", F.lit(PIECE_ROWS).cast("long"))))
    pieces = pieces.withColumn("_end", F.least(F.col("_rank") + PIECE_ROWS - 1, "_end")).repartition("_rank")
    both = few.unionByName(pieces)
    return both.withColumn("_rank", F.explode(F.sequence("_rank", "_end"))).drop("_n", "_end")


def assign(
    docs: DataFrame,
    shards: int,
    key: str = "doc_id",
    tie: tuple[str, ...] = (),
    virtual: int = 128,
    cells: int = 4096,
    slack: float = 0.0,
) -> DataFrame:
    """Adds ``shard`` and ``slot`` (gapless from 0 in each shard) to every row."""
    docs, restore = shield(docs, (key, *tie), ("shard", "slot"))
    spark = docs.sparkSession
    placed = docs.withColumn("_place", ring_hash(F.col(key))).withColumn("_cell", (F.col("_place") % cells).cast("int"))
    loads = {r["_cell"]: r["n"] for r in placed.groupBy("_cell").agg(F.count("*").alias("n")).collect()}  # <= cells rows
    total = sum(loads.values())
    buckets = max(1, -(-max(loads.values(), default=0) // BUCKET_ROWS))
    parts = settle(loads, ring_points(spark, shards, virtual, cells), capacities(total, shards, slack))

    tied = ring_hash(F.col(key), *[F.col(c) for c in tie])
    placed = placed.withColumn("_bucket", (tied % buckets).cast("int"))
    # Equal rows are counted and ranked as one, whatever their number.
    counted = placed.groupBy(*placed.columns).agg(F.count("*").alias("_n"))
    window = Window.partitionBy("_cell", "_bucket").orderBy("_place", key, *tie).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("_rank", F.coalesce(F.sum("_n").over(window), F.lit(0)))
    if buckets > 1:
        sizes = placed.groupBy("_cell", "_bucket").agg(F.count("*").alias("_size"))
        running = Window.partitionBy("_cell").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.select("_cell", "_bucket", F.coalesce(F.sum("_size").over(running), F.lit(0)).alias("_before"))
        ranked = ranked.join(sizes, ["_cell", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_before")
    ranked = _expanded(ranked)
    # At most cells x shards parts, so this table's size does not depend on the data.
    table = spark.createDataFrame(
        [(p.cell, p.shard, p.low, p.high, p.base) for p in parts],
        "_cell int, shard int, low long, high long, base long",
    )
    by_cell = table.groupBy("_cell").agg(F.collect_list(F.struct("shard", "low", "high", "base")).alias("_parts"))
    chosen = ranked.join(F.broadcast(by_cell), "_cell").withColumn(
        "_parts", F.filter("_parts", lambda p: (p["low"] <= F.col("_rank")) & (F.col("_rank") < p["high"]))[0]
    )
    slot = F.col("_parts.base") + F.col("_rank") - F.col("_parts.low")
    return restore(chosen.select(*docs.columns, F.col("_parts.shard").alias("shard"), slot.alias("slot")))
