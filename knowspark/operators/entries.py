"""Entry-table writes: store routing, upsert, delete, status, snapshots.

The entry table is a versioned Parquet snapshot set partitioned by
(store, type).  A write produces a new snapshot: unchanged rows are the old
snapshot anti-joined with the changed keys, plus the changed rows.  When the
batch of changes is small AQE turns the anti join into a broadcast join, so
the big side is streamed once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import ENTRY_COLUMNS, SYSTEM_TYPES


def route_store(type_col: Column | str = "type", target: Column | str | None = None) -> Column:
    """'auto' (or null) -> system for knowledge/tool, else user; explicit targets kept."""
    t = F.col(type_col) if isinstance(type_col, str) else type_col
    auto = F.when(t.isin(*SYSTEM_TYPES), "system").otherwise("user")
    if target is None:
        return auto
    tg = F.col(target) if isinstance(target, str) else target
    return F.when(tg.isNull() | (tg == "auto"), auto).otherwise(tg)


def entry_id(store: Column | str = "store", name: Column | str = "name") -> Column:
    """Stable per-store identity derived from the business key."""
    return F.xxhash64(F.col(store) if isinstance(store, str) else store,
                      F.col(name) if isinstance(name, str) else name)


def _identified(rows: DataFrame, current: DataFrame) -> DataFrame:
    """Add ``id``: that of the stored entry, else a hash of the key.

    A new name whose hash another entry of its store has, or a smaller new name
    of the same batch, gets a second hash instead, so no two names share an id.
    """
    rows = rows.withColumn("id", F.coalesce("_old_id", entry_id()))
    fresh = rows.filter("_old_id is null")
    wanted = fresh.select("store", "id").distinct()
    taken = current.select("store", "id").join(wanted, ["store", "id"], "left_semi").withColumn("_taken", F.lit(True))
    rows = rows.join(taken, ["store", "id"], "left")
    first = Window.partitionBy("store", "id", F.col("_old_id").isNull()).orderBy("name")
    clash = F.col("_old_id").isNull() & (F.coalesce("_taken", F.lit(False)) | (F.row_number().over(first) > 1))
    return rows.withColumn("_clash", clash).withColumn(
        "id", F.when(F.col("_clash"), F.xxhash64("store", "name", F.lit(1))).otherwise(F.col("id"))).drop("_taken", "_clash")


def changed_rows(current: DataFrame, changes: DataFrame, now: str | Column) -> DataFrame:
    """The rows that ``changes`` leaves, one a (store, name); rows that exist keep id and created.

    ``changes`` has name, type, content, tags, meta, pinned and either store or
    target ('auto'|'user'|'system'); several writes of one key in a batch leave
    one row: the last by the optional ``seq``, else the greatest.
    """
    nowc = (F.lit(now) if isinstance(now, str) else now).cast("timestamp_ntz")
    ch = changes
    if "store" not in ch.columns:
        ch = ch.withColumn("store", route_store("type", "target" if "target" in ch.columns else None))
    # one write a key: the last by seq; writes without an order tie, and the
    # greatest row decides, so the result is the same for the same batch
    rest = [c for c in ("type", "content", "tags", "meta", "pinned") if c in ch.columns]
    w = Window.partitionBy("store", "name").orderBy(
        *([F.col("seq").desc()] if "seq" in ch.columns else []), *[F.col(c).desc_nulls_last() for c in rest])
    ch = ch.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    old = current.select("store", "name", F.col("id").alias("_old_id"), F.col("created").alias("_old_created"))
    return (_identified(ch.join(old, ["store", "name"], "left"), current)
              .select("store", "id",
                      F.coalesce(F.col("type"), F.lit("knowledge")).alias("type"), "name",
                      F.coalesce(F.col("content"), F.lit("")).alias("content"),
                      F.coalesce(F.col("tags"), F.lit("")).alias("tags"),
                      F.coalesce(F.col("meta"), F.lit("{}")).alias("meta"),
                      F.coalesce(F.col("pinned"), F.lit(False)).alias("pinned"),
                      F.coalesce("_old_created", nowc).alias("created"),
                      nowc.alias("updated")).select(*ENTRY_COLUMNS))


def upsert(current: DataFrame, changes: DataFrame, now: str | Column) -> DataFrame:
    """New snapshot after upserting ``changes`` (see :func:`changed_rows`) keyed by (store, name)."""
    changed = changed_rows(current, changes, now)
    kept = current.join(changed.select("store", "name"), ["store", "name"], "left_anti")
    return kept.select(*ENTRY_COLUMNS).unionByName(changed)


def delete_names(current: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, deleted keys): each name is deleted from the user store
    if present there, else from the system store -- one row per name."""
    hit = current.join(names.select("name").distinct(), "name").select("store", "name")
    w = Window.partitionBy("name").orderBy(F.when(F.col("store") == "user", 0).otherwise(1))
    victims = hit.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return current.join(victims, ["store", "name"], "left_anti"), victims


def status_counts(entries: DataFrame) -> DataFrame:
    """Entries per store (type null) and per (store, type), one rollup pass."""
    return (entries.rollup("store", "type").agg(F.count(F.lit(1)).alias("n"))
                   .filter(F.col("store").isNotNull()))


def keep_newest(df: DataFrame, group: str, ts: str, keep: int = 10) -> DataFrame:
    """Retention: the newest ``keep`` rows per group (partial top-k before the shuffle); ties go by the other columns."""
    others = [F.col(c).desc_nulls_last() for c, kind in df.dtypes if c not in (group, ts) and not kind.startswith(("map", "variant"))]
    w = Window.partitionBy(group).orderBy(F.col(ts).desc(), *others)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep).drop("_rn")


# --------------------------------------------------------------------------
# Snapshot store on shared storage
# --------------------------------------------------------------------------

def write_snapshot(df: DataFrame, root: str, version: int) -> str:
    """Write one snapshot ``<root>/v=<version>`` partitioned by store and type."""
    path = f"{root.rstrip('/')}/v={version}"
    df.write.mode("overwrite").partitionBy("store", "type").parquet(path)
    return path


def read_snapshot(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/v={version}").select(*ENTRY_COLUMNS)
