"""Folder sync as a job: the drop folder is drained into the store, the rest of the home folder is observed.

Order of a run: blobs are written (content-addressed, so a second run writes the
same files), then all entries of the run are committed as one version, then the
absorbed files are removed.  A run that is lost in between can be run again.
Files that cannot be read leave an error entry and stay where they are.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..sources import files as FI
from ..sources.file_sink import write_files
from . import commits
from . import files as FL
from . import segments as SG

_CHANGE = ["name", "type", "content", "tags", "meta", "pinned"]


def absorbed_entries(plan: DataFrame, blobs: str) -> DataFrame:
    """Entries of an absorb plan, with what export needs in meta (``blob_path``, ``original_name``)."""
    blob = F.when(F.col("blob_hash").isNotNull(), F.concat(F.lit(blobs.rstrip("/") + "/"), blob_name()))
    meta = F.to_json(F.struct("original_path", F.col("name").alias("original_name"), "size", F.lit(True).alias("absorbed"), "absorbed_at", "mimetype",
                              blob.alias("blob_path"), "blob_hash", "storage"))
    return plan.select("name", "type", "content", "tags", meta.alias("meta"), "pinned")


def blob_name(path: str = "original_path"):
    return F.concat("blob_hash", P.suffix(path))


def home_files(spark: SparkSession, home: str) -> DataFrame:
    """Files of the home folder that are observed, with ``content`` for text only: binaries are not opened."""
    f = FI.listing(spark, home, ["**/*"]).filter(~P.is_internal("rel"))
    f = f.withColumn("modificationTime", (F.col("mtime_ns") / 1e9).cast("timestamp").cast("timestamp_ntz"))
    text = F.lower(P.suffix("rel")).isin(*P.OBSERVE_TEXT_SUFFIXES)
    keep = ["path", "rel", "length", "modificationTime", "content", "error"]
    read = FI.with_bytes(f.filter(text).drop("modificationTime")).join(f.select("path", "modificationTime"), "path")
    rest = f.filter(~text).withColumn("content", F.lit(None).cast("binary")).withColumn("error", F.lit(None).cast("string"))
    return read.select(*keep).unionByName(rest.select(*keep))


def observed_entries(files: DataFrame) -> DataFrame:
    o = FL.observe_plan(files.withColumn("content", F.when(F.col("error").isNotNull(), F.encode(
        F.format_string("[Nicht lesbar: %s]", P.suffix("rel")), "UTF-8")).otherwise(F.col("content"))))
    return o.withColumn("pinned", F.lit(False))


def sync(spark: SparkSession, home: str, root: str, blobs: str, now: str, mode: str = "selective", drop_dir: str = ".absorber",
         direct: int = FL.BLOB_THRESHOLD_DIRECT, warn: int = FL.BLOB_THRESHOLD_WARN) -> dict:
    """One sync run; {"absorbed", "observed", "failed", "mode"}.  ``mode`` ``always_absorb`` absorbs the whole folder."""
    draft = f"{root}/draft-{uuid.uuid4().hex}"
    dropped = FI.listing(spark, f"{home.rstrip('/')}/{drop_dir}", ["**/*"], rules=False)
    if mode == "always_absorb":
        dropped = dropped.unionByName(FI.listing(spark, home, ["**/*"]).filter(~P.is_internal("rel")))
    try:
        FI.with_bytes(dropped).write.parquet(f"{draft}/dropped")  # read once, for blobs and entries
        files = spark.read.parquet(f"{draft}/dropped")
        good, bad = files.filter("error is null"), files.filter("error is not null")
        plan = FL.absorb_plan(good.select("path", "length", "content"), direct, warn, now)
        kept = plan.filter("blob_hash is not null").select("original_path", blob_name().alias("filename"))
        os.makedirs(blobs, exist_ok=True)
        write_files(kept.join(good.select(F.col("path").alias("original_path"), "content"), "original_path").dropDuplicates(["filename"]), blobs, keep=True)
        changes = absorbed_entries(plan, blobs)
        errors = FL.error_entries(bad).withColumn("meta", F.lit("{}")).withColumn("pinned", F.lit(False))
        changes = changes.unionByName(errors.select(*_CHANGE))
        n_observed = 0
        if mode != "always_absorb":
            seen = observed_entries(home_files(spark, home)).select(*_CHANGE)
            seen.write.parquet(f"{draft}/seen")
            seen = spark.read.schema(seen.schema).parquet(f"{draft}/seen")
            n_observed = seen.count()
            current = SG.read(spark, root).entries.filter("store = 'user'")
            same = [F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("content", "tags", "meta")]
            changes = changes.unionByName(seen.alias("s").join(current.alias("c"), [F.col("s.name") == F.col("c.name"), *same], "left_anti"))
        changes = changes.withColumn("store", F.lit("user"))
        if not changes.isEmpty():
            SG.update(spark, root, changes, None, now)
        n_absorbed, n_failed = good.count(), bad.count()
        good.select("path").foreachPartition(_remove)
        return {"absorbed": n_absorbed, "observed": n_observed, "failed": n_failed, "mode": mode}
    finally:
        commits.remove(spark, draft)


def _remove(rows) -> None:
    for r in rows:
        try:
            os.remove(r["path"])
        except FileNotFoundError:  # a task that ran twice
            pass


def export(entries: DataFrame, dest: str) -> None:
    """Write entries as files in ``dest``: blobs under their original names, else the text; all or none.

    Two entries that would get one file name make the export fail.
    """
    e = entries.withColumn("_blob", F.get_json_object(F.coalesce("meta", F.lit("{}")), "$.blob_path"))
    plan = FL.export_plan(e).select("name", "filename", "source")
    rows = e.select("name", "content", "_blob").join(plan, "name")
    text = rows.filter("source = 'text'").select("filename", F.encode(F.coalesce("content", F.lit("")), "UTF-8").alias("content"))
    stored = FI.with_bytes(rows.filter("source = 'blob'").select(F.col("_blob").alias("path"), "filename"))
    stored = stored.withColumn("content", F.when(F.col("error").isNull(), F.col("content")).otherwise(F.raise_error(F.col("error"))))
    os.makedirs(dest, exist_ok=True)
    write_files(text.unionByName(stored.select("filename", "content")), dest)
