"""Structured Streaming jobs.

``stream_transcripts``  tail JSONL transcripts -> turns -> redaction -> items
``stream_files``        new note files (binaryFile stream) -> items
``stream_alerts``       findings -> de-duplicated (path, family) alerts

Each micro-batch is written with ``foreachBatch`` to ``<out>/batch_id=<n>``
in overwrite mode, so a batch replayed after a failure replaces its own
output (exactly-once effect); checkpoints live under the shared
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import files as FL
from ..operators import observe as OB
from ..operators import redact as R
from ..session import ensure_checkpoint_dir
from ..sources import tail as TAIL
from ..sources import transcripts as TR


def _batch_writer(out: str):
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch_id={batch_id}")
    return write


def _batch_upsert(root: str, source_id: str, kind: str):
    """Upsert each batch into the entry store at ``root``; the store remembers the batch, so a replay changes nothing."""
    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        kinds = spark.createDataFrame([(source_id, kind)], "source_id string, kind string")
        now = spark.sql("select cast(current_timestamp() as timestamp_ntz)").first()[0]
        items = df.withColumn("seq", F.col("line_no")) if "line_no" in df.columns else df
        OB.upsert_batch(spark, root, items, kinds, str(now), source_id, batch_id)
    return write


def transcript_turns_stream(spark: SparkSession, paths: list[str], source_id: str, fmt: str = "claude_code",
                            key_by: str = "path", **opts) -> DataFrame:
    """Streaming DataFrame of redacted turn items from growing JSONL files."""
    TAIL.register(spark)
    lines = (spark.readStream.format("jsonl_tail").option("paths", json.dumps(paths))
             .option("key_by", key_by).load())
    return R.redact(TR.turns(lines, source_id, fmt, **opts), "content", "redacted")


def stream_transcripts(spark: SparkSession, paths: list[str], source_id: str, out: str,
                       checkpoint: str | None = None, fmt: str = "claude_code", available_now: bool = True,
                       upsert: bool = False, **opts):
    """Start the transcript job; returns the StreamingQuery.  ``upsert``: ``out`` is an entry store, else a folder of batches."""
    ck = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{source_id}"
    q = transcript_turns_stream(spark, paths, source_id, fmt, **opts).writeStream \
        .foreachBatch(_batch_upsert(out, source_id, "agent_transcripts") if upsert else _batch_writer(out)).option("checkpointLocation", ck)
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="30 seconds")
    return q.start()


def stream_files(spark: SparkSession, root: str, source_id: str, out: str, pattern: str = "*.md",
                 checkpoint: str | None = None, max_files: int = 1000):
    """New note files under ``root`` -> redacted items (one per file)."""
    ck = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/files-{source_id}"
    files = (spark.readStream.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(root))
    items = files.filter(~P.is_excluded("path")).select(
        F.lit(source_id).alias("source_id"), F.col("path").alias("key"),
        F.concat(F.lit(f"observed/{source_id}/"), P.path_key(F.regexp_replace("path", "^file:", ""))).alias("name"),
        FL.decode_utf8("content").alias("content"),
        F.lit(f"{pattern.lstrip('*.')},{source_id}").alias("tags"), F.lit("{}").alias("meta"),
        F.concat_ws(":", (F.unix_micros("modificationTime") * 1000).cast("string"),
                    F.col("length").cast("string")).alias("fingerprint"),
        F.col("path").alias("source_path"))
    return (R.redact(items, "content", "redacted").writeStream.foreachBatch(_batch_writer(out))
            .option("checkpointLocation", ck).trigger(availableNow=True).start())


def alert_stream(items: DataFrame, cloud_root: str) -> DataFrame:
    """Streaming findings under the cloud root, each (path, family) once
    (streaming dropDuplicates keeps the seen pairs in state)."""
    f = R.findings(items, "source_path", "redacted")
    return f.filter(R.under_root("path", cloud_root)).dropDuplicates(["path", "family"])
