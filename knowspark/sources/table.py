"""Foreign-table source: any Spark-readable table (JDBC, Parquet, ...) as items.

Column mapping: ``id`` (defaults to the row-id column), optional ``name``
(title), ``content`` (one column or several, non-blank values joined by a
blank line) and optional ``tags``.  Unknown columns are refused (empty
result), checked against the schema on the driver -- no data is read for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import safe_key
from ..schema import ITEM_COLUMNS


def _str(c: Column) -> Column:
    """Text form of a value for fingerprints: null -> 'None'."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def table_items(df: DataFrame, source_id: str, table: str, content, id: str | None = None,
                name: str | None = None, tags: str | None = None, rowid: str | None = None,
                db_path: str = "") -> DataFrame:
    cols = [content] if isinstance(content, str) else [c for c in content if c]
    rowid = rowid or id
    spark = df.sparkSession
    if not cols or rowid is None:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in ITEM_COLUMNS))
    for c in [rowid, id, name, tags, *cols]:
        if c and c not in df.columns:
            return spark.createDataFrame([], ", ".join(f"{c} string" for c in ITEM_COLUMNS))
    row_id = F.col(id or rowid)
    parts = [F.when(F.col(c).cast("string").rlike(r"(?U)\S"), F.col(c).cast("string")) for c in cols]
    body = F.concat_ws("\n\n", *parts)
    title = F.when(F.coalesce(F.col(name).cast("string"), F.lit("")) != "", F.col(name).cast("string")) \
             .otherwise(row_id.cast("string")) if name else row_id.cast("string")
    tag_v = F.coalesce(F.col(tags).cast("string"), F.lit("")) if tags else F.lit("")
    fp_cols = [rowid]
    for c in [id, name, *cols, tags]:
        if c and c not in fp_cols[1:]:
            fp_cols.append(c)
    fingerprint = F.substring(F.sha2(F.concat_ws("|", *[_str(F.col(c)) for c in fp_cols]), 256), 1, 16)
    indexed = (F.when(title != row_id.cast("string"), F.concat(title, F.lit("\n\n"), body)).otherwise(body)
               if name else body)
    meta = F.to_json(F.struct(
        F.struct(F.lit("sqlite_table").alias("kind"), F.lit(db_path).alias("db_path"),
                 F.lit(table).alias("table"), row_id.alias("row_id")).alias("source_ref"),
        title.alias("title")))
    return df.select(
        F.lit(source_id).alias("source_id"),
        row_id.cast("string").alias("key"),
        F.concat(F.lit(f"observed/{source_id}/{table}/"), safe_key(row_id)).alias("name"),
        indexed.alias("content"),
        F.when(tag_v != "", F.concat(F.lit(f"sqlite_table,{source_id},"), tag_v))
         .otherwise(F.lit(f"sqlite_table,{source_id}")).alias("tags"),
        meta.alias("meta"), fingerprint.alias("fingerprint"),
        F.lit(db_path).alias("source_path"))


def _other_host(host: str, self_host: str) -> str:
    host, me = (host or "").strip(), (self_host or "").strip()
    if not me:
        raise ValueError("own host name is blank")
    if not host or host.lower() == me.lower():
        raise ValueError(f"{host!r} is the own host, whose replica would double its entries")
    return host


def memory_replica_sources(host: str, self_host: str, path: str, prefix: str) -> list[dict]:
    """Sources for the four tables of another host's memory database, switched off until someone enables them.

    ``path``: where the replica is; ``prefix`` begins the tables' names.
    """
    slug = _other_host(host, self_host).lower()
    # The columns of the four tables.
    tables = {"facts": {"id": "id", "name": "key", "content": "value", "tags": "category"},
              "lessons": {"id": "id", "name": "title", "content": ["problem", "solution"], "tags": "category"},
              "working": {"id": "id", "content": "content", "tags": "tags"},
              "sessions": {"id": "id", "name": "current_task", "content": "handoff_notes"}}
    return [{"source_id": f"replica-{slug}-{prefix}-{t}", "kind": "sqlite_table", "enabled": False,
             "params": {"path": f"{path.rstrip('/')}/{prefix}_{t}", "table": f"{prefix}_{t}", "columns": columns}} for t, columns in tables.items()]


def entries_replica_source(host: str, self_host: str, path: str, name: str = "entries") -> dict:
    """Source for another host's whole entry table, switched off until someone enables it."""
    slug = _other_host(host, self_host).lower()
    return {"source_id": f"replica-{slug}-{name}", "kind": "sqlite_table", "enabled": False,
            "params": {"path": path, "table": name, "columns": {"id": "id", "name": "name", "content": "content", "tags": "tags"}}}


def replica_items(tables: dict[str, DataFrame], self_host: str, source_prefix: str, table: str,
                  **mapping) -> DataFrame:
    """Union of one table replicated on several hosts.

    ``tables`` maps host -> that host's copy.  A blank own host, or the own
    host among the replicas, is refused.
    """
    me = (self_host or "").strip().lower()
    if not me:
        raise ValueError("own host name is blank")
    own = [h for h in tables if h.strip().lower() == me]
    if own:
        raise ValueError(f"the own host {own[0]!r} is among the replicas")
    if not tables:
        raise ValueError("no replica hosts")
    parts = [table_items(df, f"{source_prefix}-{h.strip().lower()}", table, **mapping) for h, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
