"""Change-only refresh of federated sources into the entry table.

Items from all enabled sources are unioned, redacted once, compared with the
stored fingerprint (``meta.source_fingerprint``) by a left join on name, and
only new or changed items are upserted as ``observed`` user entries.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.json import json_patch
from ..schema import ITEM_COLUMNS
from . import entries as E
from . import redact as R

# The source kinds the catalog accepts.
SOURCE_KINDS = ("markdown_dir", "remember_files", "sqlite_table", "agent_transcripts")


def federate(items: list[DataFrame]) -> DataFrame:
    """Union of the adapters' item frames, redacted once."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), items)
    return R.redact(u.select(*ITEM_COLUMNS), "content", "redacted")


def refresh_diff(items: DataFrame, current: DataFrame) -> DataFrame:
    """Items with action insert / update / skip against the user store.

    An item is skipped when the stored entry's source fingerprint equals the
    item's (null-safe).  Of several items of one name the last counts: by
    ``seq`` where the items have it, else the greatest.
    """
    rest = [F.col(c).desc_nulls_last() for c in ("fingerprint", "content", "tags", "meta", "source_id") if c in items.columns]
    last = Window.partitionBy("name").orderBy(*([F.col("seq").desc()] if "seq" in items.columns else []), *rest)
    items = items.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn")
    old = (current.filter(F.col("store") == "user")
                  .select("name", F.get_json_object(F.coalesce("meta", F.lit("{}")), "$.source_fingerprint")
                          .alias("_old_fp"), F.lit(True).alias("_exists")))
    j = items.join(old, "name", "left")
    action = (F.when(F.col("_exists").isNull(), "insert")
               .when(F.col("_old_fp").eqNullSafe(F.col("fingerprint")), "skip").otherwise("update"))
    return j.withColumn("action", action).drop("_old_fp", "_exists")


def refresh_changes(diff: DataFrame, kinds: DataFrame) -> DataFrame:
    """Upsert rows for the non-skipped items: observed, unpinned, user store,
    meta extended by source_id / source_kind / source_fingerprint / observed
    (all other fields keep their JSON value and type)."""
    d = diff.filter(F.col("action") != "skip").join(kinds, "source_id", "left")
    meta = json_patch("meta", {"source_id": F.col("source_id"), "source_kind": F.col("kind"),
                               "source_fingerprint": F.col("fingerprint"), "observed": F.lit(True)})
    return d.select(F.lit("user").alias("store"), "name", F.lit("observed").alias("type"), "content", "tags",
                    meta.alias("meta"), F.lit(False).alias("pinned"),
                    *(["seq"] if "seq" in d.columns else []))


def refresh(items: DataFrame, current: DataFrame, kinds: DataFrame, now) -> DataFrame:
    """The entry table after one refresh of ``items`` (source_id, ..., fingerprint; optional seq)."""
    return E.upsert(current, refresh_changes(refresh_diff(items, current), kinds), now)


def refresh_stats(diff: DataFrame) -> DataFrame:
    """Per source: indexed (insert+update) and skipped counts."""
    return diff.groupBy("source_id").agg(
        F.count_if(F.col("action") != "skip").alias("indexed"),
        F.count_if(F.col("action") == "skip").alias("skipped"))


def scan_pending(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files that must be (re)read and the byte offset to start at.

    files: (file_key, size, mtime); state: (file_key, offset, mtime, line_no).
    Unchanged (offset == size and same mtime) files are not opened; a file
    shorter than its offset was truncated/rotated and restarts at 0.
    """
    s = state.select("file_key", F.col("offset").alias("_off"), F.col("mtime").alias("_mtime"),
                     F.col("line_no").alias("_line"))
    j = files.join(s, "file_key", "left")
    start = F.when(F.col("_off").isNull() | (F.col("size") < F.col("_off")), F.lit(0)).otherwise(F.col("_off"))
    line = F.when(F.col("_off").isNull() | (F.col("size") < F.col("_off")), F.lit(0)).otherwise(F.col("_line"))
    unchanged = (F.col("_off") == F.col("size")) & (F.col("_mtime") == F.col("mtime"))
    return (j.filter(~F.coalesce(unchanged, F.lit(False)))
             .select("file_key", "size", start.cast("long").alias("start_offset"), line.cast("long").alias("start_line")))


# --------------------------------------------------------------------------
# Source catalog (a small JSON-backed table)
# --------------------------------------------------------------------------

CATALOG_SCHEMA = "source_id string, kind string, enabled boolean, params string"


def catalog_add(catalog: DataFrame, adds: DataFrame) -> DataFrame:
    """Add or replace sources; unknown kinds raise (checked on the small frame)."""
    bad = adds.filter(~F.col("kind").isin(*SOURCE_KINDS)).select("kind").limit(1).collect()
    if bad:
        raise ValueError(f"unknown source kind: {bad[0][0]}")
    return catalog.join(adds.select("source_id"), "source_id", "left_anti").unionByName(adds)


def catalog_remove(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """Drop sources from the catalog (their indexed entries stay)."""
    return catalog.join(ids.select("source_id"), "source_id", "left_anti")


def catalog_enabled(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.coalesce("enabled", F.lit(True)))


def catalog_from_json(spark: SparkSession, text: str) -> DataFrame:
    """{source_id: {kind, enabled?, ...params}} -> catalog frame."""
    cfg = json.loads(text or "{}")
    rows = [(sid, c.get("kind"), c.get("enabled", True),
             json.dumps({k: v for k, v in c.items() if k not in ("kind", "enabled")}, sort_keys=True))
            for sid, c in cfg.items()]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)
