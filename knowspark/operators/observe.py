"""Refresh job: each source is scanned and committed by itself.

A source's kind names its adapter in :data:`ADAPTERS`.  The job scans one source
after the other; what a source brings (changed items, its scan state, its
alerts) becomes one version of the entry store, or, if the source fails, one
error entry does.  So a broken source neither stops the others nor leaves half
of its items behind.

The store is a segmented index (:mod:`segments`); a version's manifest also
names the state folder of each source and the folders of alerts, so items and
the state that says they were read appear together.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ITEM_COLUMNS
from ..sources import files as FI
from ..sources import table as TB
from . import commits
from . import redact as R
from . import refresh as RF
from . import segments as SG

#: (spark, source_id, params, seen(name, fingerprint), state) -> (items, new state or None)
Adapter = Callable[[SparkSession, str, dict, DataFrame, DataFrame], tuple[DataFrame, DataFrame | None]]


def _table(spark, source_id, params, seen, state):
    df = spark.read.format(params.get("format", "parquet")).load(params["path"])
    columns = dict(params["columns"])
    items = TB.table_items(df, source_id, params["table"], columns.pop("content"), db_path=str(params["path"]), **columns)
    return items, None


def _transcripts(spark, source_id, params, seen, state):
    files = FI.listing(spark, params["path"], params.get("patterns") or ["**/*.jsonl"])
    options = {k: v for k, v in params.items() if k not in ("path", "patterns")}
    return FI.scan_transcripts(files, state, source_id, options.pop("format", "claude_code"), **options)


ADAPTERS: dict[str, Adapter] = {
    "markdown_dir": lambda spark, sid, params, seen, state: (FI.markdown_dir(spark, sid, params, seen), None),
    "remember_files": lambda spark, sid, params, seen, state: (FI.remember_files(spark, sid, params, seen), None),
    "sqlite_table": _table,
    "agent_transcripts": _transcripts,
}

STATS = "source_id string, kind string, indexed long, skipped long, alerts long, new_alerts long, errors long, error string"
_ERROR = "name string, type string, content string, tags string, meta string, pinned boolean, store string, seq int"


def _error_rows(spark: SparkSession, failed: list[tuple[str, str]]) -> DataFrame:
    """Entries that tell what could not be read: sync-error/<name>."""
    return spark.createDataFrame([(f"sync-error/{n}", "memory", e, "error,sync", "{}", False, "user", 0) for n, e in failed], _ERROR)


def state_of(spark: SparkSession, root: str, manifest: dict, source_id: str) -> DataFrame:
    folder = manifest.get("states", {}).get(source_id)
    return spark.read.schema(FI.STATE).parquet(f"{root}/{folder}") if folder else spark.createDataFrame([], FI.STATE)


def alerts(spark: SparkSession, root: str) -> DataFrame:
    """(path, family) of the secrets found so far in files under the cloud root."""
    folders = commits.latest(spark, root)[1].get("alerts", [])
    none = spark.createDataFrame([], "path string, family string")
    return reduce(DataFrame.unionByName, [spark.read.schema(none.schema).parquet(f"{root}/{f}") for f in folders], none)


def observe_source(spark: SparkSession, root: str, source: dict, now: str, cloud_root: str | None = None,
                   adapters: dict[str, Adapter] | None = None) -> tuple:
    """Scan one source and commit what it brings; a row of :data:`STATS`.  Raises what the source raises."""
    sid, kind, params = source["source_id"], source["kind"], source.get("params") or {}
    adapter = (adapters or ADAPTERS).get(kind)
    if adapter is None:
        raise ValueError(f"unknown source kind: {kind}")
    manifest = commits.latest(spark, root)[1]
    current = SG.read(spark, root).entries
    mine = current.filter(F.col("store") == "user").filter(F.col("name").startswith(f"observed/{sid}/"))
    seen = mine.select("name", F.get_json_object("meta", "$.source_fingerprint").alias("fingerprint"))
    items, state = adapter(spark, sid, params, seen, state_of(spark, root, manifest, sid))
    draft = f"{root}/draft-{uuid.uuid4().hex}"
    try:
        if "error" not in items.columns:
            items = items.withColumn("error", F.lit(None).cast("string"))
        order = [F.col("line_no").cast("long") if "line_no" in items.columns else F.lit(0).cast("long")]
        items = R.redact(items.select(*ITEM_COLUMNS, order[0].alias("seq"), "error"), "content", "redacted")
        items.write.parquet(f"{draft}/items")  # the source is read once, and fails here if it fails
        items = spark.read.schema(items.schema).parquet(f"{draft}/items")
        bad = [tuple(r) for r in items.filter("error is not null").select("key", "error").limit(1000).collect()]
        n_bad = items.filter("error is not null").count()
        diff = RF.refresh_diff(items.filter("error is null").drop("error"), current)
        counts = {r["source_id"]: r for r in RF.refresh_stats(diff).collect()}.get(sid)  # a row: one source
        kinds = spark.createDataFrame([(sid, kind)], "source_id string, kind string")
        changes = RF.refresh_changes(diff, kinds)
        if bad:
            changes = changes.unionByName(_error_rows(spark, [(f"{sid}/{k}", e) for k, e in bad]))
        extra = {}
        if state is not None:
            folder = f"state-{uuid.uuid4().hex}"
            state.write.parquet(f"{root}/{folder}")
            extra["states"] = {**manifest.get("states", {}), sid: folder}
        n_alerts = new = 0
        if cloud_root:
            found = R.findings(items.filter("error is null")).filter(R.under_root("path", cloud_root))
            fresh = R.alert_new(found, alerts(spark, root), cloud_root)
            folder = f"alerts-{uuid.uuid4().hex}"
            fresh.write.parquet(f"{root}/{folder}")
            n_alerts, new = found.count(), spark.read.schema(fresh.schema).parquet(f"{root}/{folder}").count()
            if new:
                extra["alerts"] = [*manifest.get("alerts", []), folder]
        indexed = counts["indexed"] if counts else 0
        if indexed or bad:
            SG.update(spark, root, changes, None, now, extra)
        elif extra:
            SG.annotate(spark, root, extra)
        # files whose fingerprint is stored were not opened, so they are not among the items
        skipped = (counts["skipped"] if counts else 0) + (max(0, mine.count() - indexed) if kind in ("markdown_dir", "remember_files") else 0)
        return sid, kind, indexed, skipped, n_alerts, new, n_bad, None
    finally:
        commits.remove(spark, draft)


def observe(spark: SparkSession, root: str, sources: list[dict], now: str, cloud_root: str | None = None,
            adapters: dict[str, Adapter] | None = None) -> DataFrame:
    """Refresh all enabled sources ({source_id, kind, params, enabled}); :data:`STATS`, a row a source."""
    rows = []
    for source in sources:
        if not source.get("enabled", True):
            continue
        try:
            rows.append(observe_source(spark, root, source, now, cloud_root, adapters))
        except commits.Conflict:
            raise
        except Exception as e:  # noqa: BLE001  one source's failure is its own
            said = f"{type(e).__name__}: {str(e).splitlines()[0][:500] if str(e) else ''}"
            SG.update(spark, root, _error_rows(spark, [(source["source_id"], said)]), None, now)
            rows.append((source["source_id"], source["kind"], 0, 0, 0, 0, 1, said))
    return spark.createDataFrame(rows, STATS)


def forget_source(spark: SparkSession, root: str, source_id: str) -> None:
    """Drop a source's scan state: added again, it is read from the start.  Its entries stay."""
    states = dict(commits.latest(spark, root)[1].get("states", {}))
    if states.pop(source_id, None):
        SG.annotate(spark, root, {"states": states})


def upsert_batch(spark: SparkSession, root: str, items: DataFrame, kinds: DataFrame, now: str, query: str, batch_id: int) -> bool:
    """Upsert a micro-batch of redacted items; False if the batch was committed before (a replay).

    The manifest records the last batch of each streaming query with the items.
    """
    manifest = commits.latest(spark, root)[1]
    if manifest.get("batches", {}).get(query, -1) >= batch_id:
        return False
    extra = {"batches": {**manifest.get("batches", {}), query: batch_id}}
    diff = RF.refresh_diff(items, SG.read(spark, root).entries)
    SG.update(spark, root, RF.refresh_changes(diff, kinds), None, now, extra)
    return True
