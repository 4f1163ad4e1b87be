"""Registered queries: entry store writes, refresh, catalog, foreign tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entries as E
from ..operators import refresh as RF
from ..sources import table as TB
from . import oracle as O
from . import views as V
from .search_queries import _with_overrides

NOW = "2024-06-01 12:00:00"


def _changes(spark, sf):
    """items_new: edited documents, new notes, edited benchmark items, a double write."""
    d = V.table(spark, sf, "documents")
    edit = d.filter(F.col("doc_id") % 10 == 0).select(
        F.concat(F.lit("observed/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("name"),
        F.lit("observed").alias("type"), F.concat("text", F.lit(" rev2")).alias("content"),
        F.concat_ws(",", F.lit("documents"), "source", "lang").alias("tags"), F.lit("{}").alias("meta"),
        F.lit(False).alias("pinned"), F.lit("auto").alias("target"), F.lit(1).alias("seq"))
    again = d.filter(F.col("doc_id") % 100 == 0).select(
        F.concat(F.lit("observed/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("name"),
        F.lit("observed").alias("type"), F.concat("text", F.lit(" rev3")).alias("content"),
        F.lit("documents").alias("tags"), F.lit("{}").alias("meta"),
        F.lit(True).alias("pinned"), F.lit("auto").alias("target"), F.lit(2).alias("seq"))
    new = d.filter(F.col("doc_id") % 50 == 0).select(
        F.concat(F.lit("note/new/"), F.col("doc_id").cast("string")).alias("name"),
        F.lit("memory").alias("type"), F.col("lang").alias("content"), F.lit("working").alias("tags"),
        F.lit("{}").alias("meta"), F.lit(False).alias("pinned"), F.lit("auto").alias("target"), F.lit(1).alias("seq"))
    b = V.table(spark, sf, "benchmark").filter(F.col("item_id") % 4 == 0).select(
        F.concat(F.lit("bench/"), F.col("item_id").cast("string")).alias("name"),
        F.lit("knowledge").alias("type"), F.concat("text", F.lit(" edited")).alias("content"), F.lit("benchmark,edited").alias("tags"),
        F.lit("{}").alias("meta"), F.lit(False).alias("pinned"), F.lit("auto").alias("target"), F.lit(1).alias("seq"))
    return edit.unionByName(again).unionByName(new).unionByName(b)


def q_entries_upsert(spark, sf):
    out = E.upsert(V.entries(spark, sf), _changes(spark, sf), NOW)
    return out.select("store", "name", "type", F.md5("content").alias("content_md5"), "tags", "pinned",
                      "created", "updated")


def _del_names(spark, sf):
    b = V.table(spark, sf, "benchmark").filter(F.col("item_id") % 3 == 0).select(
        F.concat(F.lit("bench/"), F.col("item_id").cast("string")).alias("name"))
    d = V.table(spark, sf, "documents").filter(F.col("doc_id") % 9 == 0).select(
        F.concat(F.lit("observed/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("name"))
    miss = V.table(spark, sf, "documents").filter(F.col("doc_id") % 33 == 0).select(
        F.concat(F.lit("nothing/"), F.col("doc_id").cast("string")).alias("name"))
    return b.unionByName(d).unionByName(miss)


def q_entries_delete(spark, sf):
    _, victims = E.delete_names(_with_overrides(spark, sf), _del_names(spark, sf))
    return victims.select("store", "name")


def q_status_counts(spark, sf):
    allr = (V.entries(spark, sf).unionByName(V.memory_entries(spark, sf))
            .unionByName(V.task_entries(spark, sf)))
    return E.status_counts(allr)


def q_snapshot_retention(spark, sf):
    ev = V.table(spark, sf, "events")
    return E.keep_newest(ev, "user_id", "ts", 10).select("user_id", "event_id")


def _items(spark, sf):
    d = V.table(spark, sf, "documents")
    text = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" rev2"))).otherwise(F.col("text"))
    return d.select(F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("key"),
                    F.concat(F.lit("observed/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("name"),
                    text.alias("content"), F.concat(F.lit("markdown_dir,"), "source").alias("tags"),
                    F.lit("{}").alias("meta"), F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint"),
                    F.lit(None).cast("string").alias("source_path"))


def _stored(spark, sf):
    """Entries as left by the previous refresh (fingerprints of the old text)."""
    d = V.table(spark, sf, "documents").filter(F.col("doc_id") % 97 != 0)
    return V.docs_entries(spark, sf).join(d.select(F.col("doc_id").alias("id"), "text"), "id") \
        .withColumn("meta", F.concat(F.lit('{"source_fingerprint":"'),
                                     F.substring(F.sha2("text", 256), 1, 16), F.lit('"}'))).drop("text")


def q_refresh_diff(spark, sf):
    return RF.refresh_diff(_items(spark, sf), _stored(spark, sf)).select("source_id", "name", "action")


def q_refresh_apply(spark, sf):
    """The table after a refresh; items carry nested meta, and every fifth name twice in the batch."""
    items = _items(spark, sf).withColumn("meta", F.concat(F.lit('{"source_ref":{"doc":'), "key", F.lit('},"size":'),
                                                          F.length("content").cast("string"), F.lit("}")))
    again = items.filter(F.col("key").cast("long") % 5 == 0)
    kinds = items.select("source_id").distinct().withColumn("kind", F.lit("markdown_dir"))
    out = RF.refresh(items.unionByName(again), _stored(spark, sf), kinds, "2024-06-01 12:00:00")
    meta = [F.get_json_object("meta", f"$.{k}").alias(k.replace(".", "_")) for k in ("source_ref.doc", "size", "source_kind", "observed")]
    return out.select("store", "name", "type", "pinned", F.md5("content").alias("content_md5"), *meta,
                      F.get_json_object("meta", "$.source_fingerprint").alias("fp"))


def q_refresh_stats(spark, sf):
    return RF.refresh_stats(RF.refresh_diff(_items(spark, sf), _stored(spark, sf)))


def _files_and_state(spark, sf):
    c = V.table(spark, sf, "conversations")
    files = (c.groupBy("conv_id").agg(F.sum(F.octet_length("text") + 1).cast("long").alias("size"),
                                      F.count(F.lit(1)).alias("turns"))
             .select(F.concat(F.lit("sessions/"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("file_key"),
                     "size", (F.col("conv_id") * 10 + F.col("turns")).alias("mtime"), "conv_id"))
    m = F.col("conv_id") % 4
    state = files.filter(m != 3).select(
        "file_key",
        F.when(m == 0, F.col("size")).when(m == 1, (F.col("size") / 2).cast("long"))
         .otherwise(F.col("size") + 10).alias("offset"),
        F.col("mtime"), (F.col("conv_id") % 7).alias("line_no"))
    return files.drop("conv_id"), state


def q_scan_pending(spark, sf):
    files, state = _files_and_state(spark, sf)
    return RF.scan_pending(files, state)


def q_source_catalog(spark, sf):
    srcs = V.table(spark, sf, "documents").select("source").distinct()
    cat = srcs.select(F.col("source").alias("source_id"), F.lit("markdown_dir").alias("kind"),
                      (~F.col("source").isin("src5", "src7")).alias("enabled"), F.lit("{}").alias("params"))
    add = spark.createDataFrame([("conversations", "agent_transcripts", True, '{"format": "generic"}')],
                                RF.CATALOG_SCHEMA)
    cat = RF.catalog_add(cat, add)
    cat = RF.catalog_remove(cat, spark.createDataFrame([("src19",)], "source_id string"))
    return RF.catalog_enabled(cat).select("source_id", "kind")


def _part_items(spark, sf):
    p = V.table(spark, sf, "part")
    return TB.table_items(p, "catalog", "part", ["p_type", "p_brand"], id="p_partkey", name="p_name")


def q_src_table(spark, sf):
    return _part_items(spark, sf).select("key", "name", "content", "tags", "fingerprint")


HOSTS = ("alpha", "beta", "gamma")
SELF_HOST = "beta"


def _replicas(spark, sf):
    s = V.table(spark, sf, "supplier")
    tables = {h: s.filter(F.col("s_suppkey") % 3 == i) for i, h in enumerate(HOSTS) if h != SELF_HOST}
    return TB.replica_items(tables, SELF_HOST, "replica", "supplier", content="s_name", id="s_suppkey")


def q_replica_union(spark, sf):
    return _replicas(spark, sf).select("source_id", "name", "content", "fingerprint")


def q_federated_scan(spark, sf):
    from ..operators import redact as R  # noqa: F401
    items = RF.federate([_part_items(spark, sf), _replicas(spark, sf), _items(spark, sf)])
    return items.select("source_id", "name", "fingerprint", F.array_join("redacted", ",").alias("families"))


def queries():
    return {"entries_upsert": q_entries_upsert, "entries_delete": q_entries_delete,
            "status_counts": q_status_counts, "snapshot_retention": q_snapshot_retention,
            "refresh_apply": q_refresh_apply, "refresh_diff": q_refresh_diff, "refresh_stats": q_refresh_stats,
            "scan_pending": q_scan_pending, "source_catalog": q_source_catalog,
            "src_table": q_src_table, "replica_union": q_replica_union,
            "federated_scan": q_federated_scan}


# ----------------------------------------------------------------------------- oracle

CHANGES_SQL = """
SELECT name, type, content, tags, pinned,
       CASE WHEN type IN ('knowledge', 'tool') THEN 'system' ELSE 'user' END AS store
FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq DESC) AS rn FROM (
  SELECT 'observed/' || source || '/' || CAST(doc_id AS VARCHAR) AS name, 'observed' AS type, text || ' rev2' AS content,
         'documents,' || source || ',' || lang AS tags, false AS pinned, 1 AS seq FROM documents WHERE doc_id % 10 = 0
  UNION ALL
  SELECT 'observed/' || source || '/' || CAST(doc_id AS VARCHAR), 'observed', text || ' rev3', 'documents', true, 2
  FROM documents WHERE doc_id % 100 = 0
  UNION ALL
  SELECT 'note/new/' || CAST(doc_id AS VARCHAR), 'memory', lang, 'working', false, 1 FROM documents WHERE doc_id % 50 = 0
  UNION ALL
  SELECT 'bench/' || CAST(item_id AS VARCHAR), 'knowledge', text || ' edited', 'benchmark,edited', false, 1
  FROM benchmark WHERE item_id % 4 = 0)) WHERE rn = 1"""
DELETES_SQL = """
SELECT DISTINCT name FROM (SELECT 'bench/' || CAST(item_id AS VARCHAR) AS name FROM benchmark WHERE item_id % 3 = 0
  UNION ALL SELECT 'observed/' || source || '/' || CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 9 = 0
  UNION ALL SELECT 'nothing/' || CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 33 = 0)"""

def oracle():
    upsert = O.with_views("entries", extra=[("ch", CHANGES_SQL)]) + f"""
SELECT e.store, e.name, e.type, md5(e.content) AS content_md5, e.tags, e.pinned, e.created, e.updated
FROM entries e WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.store = e.store AND ch.name = e.name)
UNION ALL
SELECT ch.store, ch.name, ch.type, md5(ch.content), ch.tags, ch.pinned,
       coalesce(e.created, TIMESTAMP '{NOW}'), TIMESTAMP '{NOW}'
FROM ch LEFT JOIN entries e ON e.store = ch.store AND e.name = ch.name"""
    over = [("over", "SELECT 'user' AS store, id + 2000000000 AS id, type, name, content, tags, meta, pinned, "
                     "created, updated FROM bench_e WHERE id % 2 = 0"),
            ("ent2", "SELECT * FROM entries UNION ALL SELECT * FROM over"),
            ("dn", DELETES_SQL)]
    delete = O.with_views("entries", extra=over) + """
SELECT store, name FROM (SELECT e.store, e.name, row_number() OVER (PARTITION BY e.name ORDER BY
  CASE WHEN e.store = 'user' THEN 0 ELSE 1 END) AS rn FROM ent2 e JOIN dn ON dn.name = e.name) WHERE rn = 1"""
    status = O.with_views("entries", "memory_e", "tasks_e") + """
SELECT store, type, count(*) AS n FROM (
  SELECT store, type FROM entries UNION ALL SELECT store, type FROM memory_e UNION ALL SELECT store, type FROM tasks_e)
GROUP BY ROLLUP (store, type) HAVING store IS NOT NULL"""
    items = """
SELECT source AS source_id, 'observed/' || source || '/' || CAST(doc_id AS VARCHAR) AS name,
       substr(sha256(CASE WHEN doc_id % 10 = 0 THEN text || ' rev2' ELSE text END), 1, 16) AS fingerprint
FROM documents"""
    stored = """
SELECT 'observed/' || source || '/' || CAST(doc_id AS VARCHAR) AS name, substr(sha256(text), 1, 16) AS fp
FROM documents WHERE doc_id % 97 <> 0"""
    diff = f"""WITH it AS ({items}), st AS ({stored}), d AS (
SELECT it.source_id, it.name, CASE WHEN st.name IS NULL THEN 'insert' WHEN st.fp = it.fingerprint THEN 'skip'
       ELSE 'update' END AS action FROM it LEFT JOIN st ON st.name = it.name)
"""
    files = """WITH f AS (SELECT 'sessions/' || CAST(conv_id AS VARCHAR) || '.jsonl' AS file_key,
       CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS size, conv_id * 10 + count(*) AS mtime, conv_id
FROM conversations GROUP BY conv_id),
s AS (SELECT file_key, CASE conv_id % 4 WHEN 0 THEN size WHEN 1 THEN CAST(trunc(size / 2) AS BIGINT) ELSE size + 10 END AS off,
             mtime, conv_id % 7 AS line_no FROM f WHERE conv_id % 4 <> 3)
SELECT f.file_key, f.size,
       CAST(CASE WHEN s.off IS NULL OR f.size < s.off THEN 0 ELSE s.off END AS BIGINT) AS start_offset,
       CAST(CASE WHEN s.off IS NULL OR f.size < s.off THEN 0 ELSE s.line_no END AS BIGINT) AS start_line
FROM f LEFT JOIN s ON s.file_key = f.file_key
WHERE NOT coalesce(s.off = f.size AND s.mtime = f.mtime, false)"""
    part = """
SELECT CAST(p_partkey AS VARCHAR) AS key, 'observed/catalog/part/' || CAST(p_partkey AS VARCHAR) AS name,
       CASE WHEN coalesce(p_name, '') <> '' AND p_name <> CAST(p_partkey AS VARCHAR)
            THEN p_name || chr(10) || chr(10) || concat_ws(chr(10) || chr(10), nullif(trim(p_type), ''), nullif(trim(p_brand), '')) -- trimmed test only
            ELSE concat_ws(chr(10) || chr(10), nullif(trim(p_type), ''), nullif(trim(p_brand), '')) END AS content_t,
       CASE WHEN coalesce(p_name, '') <> '' AND p_name <> CAST(p_partkey AS VARCHAR)
            THEN p_name || chr(10) || chr(10) || concat_ws(chr(10) || chr(10),
                 CASE WHEN trim(p_type) <> '' THEN p_type END, CASE WHEN trim(p_brand) <> '' THEN p_brand END)
            ELSE concat_ws(chr(10) || chr(10), CASE WHEN trim(p_type) <> '' THEN p_type END,
                 CASE WHEN trim(p_brand) <> '' THEN p_brand END) END AS content,
       'sqlite_table,catalog' AS tags,
       substr(sha256(concat_ws('|', CAST(p_partkey AS VARCHAR), CAST(p_partkey AS VARCHAR), coalesce(p_name, 'None'),
              coalesce(p_type, 'None'), coalesce(p_brand, 'None'))), 1, 16) AS fingerprint, 'catalog' AS source_id
FROM part"""
    repl = """
SELECT 'replica-' || h AS source_id, 'observed/replica-' || h || '/supplier/' || CAST(s_suppkey AS VARCHAR) AS name,
       s_name AS content,
       substr(sha256(CAST(s_suppkey AS VARCHAR) || '|' || CAST(s_suppkey AS VARCHAR) || '|' || coalesce(s_name, 'None')), 1, 16) AS fingerprint
FROM (SELECT *, CASE s_suppkey % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS h FROM supplier)
WHERE h <> 'beta'"""
    return {
        "entries_upsert": upsert,
        "entries_delete": delete,
        "status_counts": status,
        "snapshot_retention": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER "
                              "(PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn <= 10",
        "refresh_diff": diff + "SELECT source_id, name, action FROM d",
        "refresh_apply": """
SELECT 'user' AS store, 'observed/' || source || '/' || CAST(doc_id AS VARCHAR) AS name, 'observed' AS type, false AS pinned,
  md5(t) AS content_md5, CASE WHEN new THEN CAST(doc_id AS VARCHAR) END AS source_ref_doc,
  CASE WHEN new THEN CAST(length(t) AS VARCHAR) END AS size, CASE WHEN new THEN 'markdown_dir' END AS source_kind,
  CASE WHEN new THEN 'true' END AS observed, substr(sha256(t), 1, 16) AS fp
FROM (SELECT *, CASE WHEN doc_id % 10 = 0 THEN text || ' rev2' ELSE text END AS t, doc_id % 10 = 0 OR doc_id % 97 = 0 AS new FROM documents)""",
        "refresh_stats": diff + "SELECT source_id, count_if(action <> 'skip') AS indexed, "
                                "count_if(action = 'skip') AS skipped FROM d GROUP BY source_id",
        "scan_pending": files,
        "source_catalog": "SELECT source_id, kind FROM (SELECT DISTINCT source AS source_id, 'markdown_dir' AS kind "
                          "FROM documents WHERE source NOT IN ('src5', 'src7', 'src19') UNION ALL "
                          "SELECT 'conversations', 'agent_transcripts')",
        "src_table": "SELECT key, name, content, tags, fingerprint FROM (" + part + ")",
        "replica_union": repl,
        "federated_scan": "SELECT source_id, name, fingerprint, '' AS families FROM (" + part + ") UNION ALL "
                          "SELECT source_id, name, fingerprint, '' FROM (" + repl + ") UNION ALL "
                          "SELECT source_id, name, fingerprint, '' FROM (" + items + ")",
    }
