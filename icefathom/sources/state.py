"""Keyed state kept as a table, also one that a stream keeps.

The kept table is a folder of Parquet files in key buckets. Every batch of updates writes
the buckets it touches anew under its own number and then a manifest, which names for every
bucket the batch that wrote it last. A reader sees the newest complete manifest, so a batch
that was broken off leaves no trace and one that is repeated changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icefathom.operators.spread import latest_by


def merge_state(current: DataFrame, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key; ``order`` lists time then id, and an update wins a full tie."""
    both = current.withColumn("_src", F.lit(0)).unionByName(updates.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    newest_first = [F.col(c).desc() for c in [*order, "_src"]]
    return latest_by(both, keys, newest_first).drop("_src")


def upsert_batches(path: str, keys: list[str], order: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch``: merges each micro-batch into the table at ``path``.

    The newest row of a key stays (``merge_state``; an update wins a full tie). A batch
    reads and writes only the buckets its keys fall in, in one shuffle of the batch and those
    buckets; a bucket holds one row per key, so more keys need more ``buckets``, whose number
    stays as the first batch set it. Batch numbers are those of one stream checkpoint: a
    number not above the newest complete one is taken for a repeat and skipped. Rows with
    null keys are one key. An empty batch writes nothing.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = state_versions(spark, path)
        if done and number <= done[-1]:
            return
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        batch = batch.persist()
        touched = {r["b"] for r in batch.select(bucket.alias("b")).distinct().collect()}  # <= buckets rows
        if touched:
            held = _manifest(spark, path, done[-1], buckets) if done else {}
            current = _read_buckets(spark, path, {b: v for b, v in held.items() if b in touched}, batch)
            merged = merge_state(current, batch, keys, order).withColumn("_bucket", bucket)
            parts = merged.repartition(min(buckets, len(touched)), "_bucket")
            parts.write.partitionBy("_bucket").mode("overwrite").parquet(f"{path}/data/{number}")
            named = [(b, v, buckets) for b, v in {**held, **dict.fromkeys(touched, number)}.items()]
            table = spark.createDataFrame(named, "bucket int, version long, buckets int").coalesce(1)
            table.write.mode("overwrite").parquet(f"{path}/manifest/{number}")
        batch.unpersist()

    return each


def read_state(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of batch ``version``, of the newest complete batch if none is given."""
    done = state_versions(spark, path)
    if not done:
        raise ValueError(f"no complete batch at {path}")
    return _read_buckets(spark, path, _manifest(spark, path, done[-1] if version is None else version))


def state_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete batches, oldest first."""
    files, folder = _files(spark, f"{path}/manifest")
    found = files.listStatus(folder) if files.exists(folder) else []
    whole = [f.getPath() for f in found if files.exists(_path(spark, f"{f.getPath().toString()}/_SUCCESS"))]
    return sorted(int(p.getName()) for p in whole)


def vacuum_state(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes what none of the last ``keep`` versions names; returns the bucket folders deleted.

    Data of batches newer than the last complete one is left: they may be at work.
    """
    done = state_versions(spark, path)
    kept = done[-max(1, keep) :]
    used = {(v, b) for number in kept for b, v in _manifest(spark, path, number).items()}
    files, root = _files(spark, path)
    for number in done[: len(done) - len(kept)]:
        files.delete(_path(spark, f"{path}/manifest/{number}"), True)
    gone = 0
    data = _path(spark, f"{path}/data")
    for batch in files.listStatus(data) if files.exists(data) else []:
        number = int(batch.getPath().getName())
        if done and number <= done[-1]:
            own = [f.getPath() for f in files.listStatus(batch.getPath()) if f.getPath().getName().startswith("_bucket=")]
            stale = [p for p in own if (number, int(p.getName().split("=")[1])) not in used]
            for folder in [batch.getPath()] if len(stale) == len(own) else stale:
                files.delete(folder, True)
            gone += len(stale)
    return gone


def _manifest(spark: SparkSession, path: str, number: int, buckets: int | None = None) -> dict[int, int]:
    """Which batch wrote each bucket last; one row per bucket."""
    rows = spark.read.parquet(f"{path}/manifest/{number}").collect()
    if buckets is not None and any(r["buckets"] != buckets for r in rows):
        raise ValueError(f"the table at {path} was begun with another number of buckets than {buckets}")
    return {r["bucket"]: r["version"] for r in rows}


def _read_buckets(spark: SparkSession, path: str, held: dict[int, int], like: DataFrame | None = None) -> DataFrame:
    if not held:
        return spark.createDataFrame([], like.schema)
    reader = spark.read if like is None else spark.read.schema(like.schema)
    return reader.parquet(*[f"{path}/data/{v}/_bucket={b}" for b, v in sorted(held.items())])


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    """The file system of ``path``, and ``path`` for it."""
    folder = _path(spark, path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder
