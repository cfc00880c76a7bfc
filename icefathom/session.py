"""Session defaults and the checkpoint folder used by iterative jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution does the physical tuning: it coalesces small shuffle
# partitions, splits skewed ones and picks broadcast only from measured sizes.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # session_window merges sessions before the shuffle, so a chatty vessel
    # sends a few sessions instead of every fix.
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A batch is held by the JVM and by Python at once; by rows alone, long texts make it 64 MB.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def build_session(app: str = "icefathom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the library defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # Checkpoints of rounds that nothing refers to any more are removed (set at start only).
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Sets the library defaults on a session somebody else built."""
    for key, value in SESSION_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def bound_batches(spark: SparkSession) -> SparkSession:
    """Sets the size of Arrow batches alone, for tasks that hold whole texts."""
    spark.conf.set(BATCH_BYTES, SESSION_DEFAULTS[BATCH_BYTES])
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints, taken from ``spark.checkpoint.dir``.

    A machine-local folder is only ever used under a ``local`` master: on a
    cluster a lost executor would take such a checkpoint with it.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="icefathom-checkpoint-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back, for loops that join a round with the last.

    A checkpoint keeps the planner's size estimate, and a join multiplies those of its sides:
    where a round joins the last with itself, the number doubles its digits every round until
    it fills the driver. A file is estimated by its length.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
