"""Spark session helpers.

Operators never create sessions; they take DataFrames.  These helpers exist
for tests, the bench and the driver entry point.  On a cluster the session
comes from the platform and only the checkpoint directory is read from it.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job of this package relies on; all are plain Spark confs.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "knowspark") -> SparkSession:
    """Local session for tests and the bench (UI off, UTC, AQE on)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("KS_DRIVER_MEMORY", "8g"))
    b = b.config("spark.checkpoint.dir", os.environ.get("KS_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="ks-ckpt-"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names a shared (HDFS/S3/ABFS) folder and is
    used as is.  Only a local master may leave it unset (tests, bench): a fresh
    scratch folder is then created and registered.  A cluster must name one,
    since a folder of the driver's machine is not shared.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # the setting of a running session cannot be changed, so its own folder is remembered by what it is set to
        d = _LOCAL.setdefault(spark.sparkContext.applicationId, None) or tempfile.mkdtemp(prefix="ks-ckpt-")
        _LOCAL[spark.sparkContext.applicationId] = d
    spark.sparkContext.setCheckpointDir(d)
    return d


#: scratch folders of local sessions that name none, by application
_LOCAL: dict[str, str | None] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A per-job folder below the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    import uuid
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def held(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the scratch folder once and read back, for plans that use it several times."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends, and not when the driver happens to collect garbage.

    For jobs that each write a table: no frame is run twice, and the caller's setting comes back.
    """
    before = spark.conf.get(_CLEANED, None)
    spark.conf.set(_CLEANED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANED)
        else:
            spark.conf.set(_CLEANED, before)


#: rows of keys that are sent to all tasks instead of shuffling the texts or postings that they are joined with
SENT = 1 << 20


def sent_if_few(keys: DataFrame, rows: int | None) -> DataFrame:
    """``keys`` for a join, to be broadcast if its ``rows`` are known and few."""
    return F.broadcast(keys) if rows is not None and rows <= SENT else keys
