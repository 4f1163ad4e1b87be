"""Registered queries: a segmented index after changes and deletes against a rebuild."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import observe as OB
from ..operators import search as S
from ..operators import segments as SG
from ..schema import ENTRY_COLUMNS
from ..session import scratch_path
from ..sources.file_sink import write_line_files
from . import oracle as O
from . import store_queries as SQ
from . import transcript_queries as TQ
from . import views as V

QUERIES = {1: "the", 2: "rev2 edited", 3: "rev3 de la"}


def _refreshed(spark, sf):
    """Built, changed, thinned out, and the last two segments merged."""
    root = scratch_path(spark, "segments")
    SG.create(V.entries(spark, sf), root)
    SG.update(spark, root, SQ._changes(spark, sf), None, SQ.NOW)
    SG.update(spark, root, None, SQ._del_names(spark, sf), SQ.NOW)
    SG.compact(spark, root, first=1)
    return SG.read(spark, root)


def q_index_refresh(spark, sf):
    idx = _refreshed(spark, sf)
    df = idx.terms.groupBy("store", "term").agg(F.sum("df").alias("df")).filter("df <> 0")
    cf = idx.postings.groupBy("store", "term").agg(F.sum("tf").alias("cf"))
    return df.join(cf, ["store", "term"], "full")


def q_index_refresh_find(spark, sf):
    idx = _refreshed(spark, sf)
    hits = S.evaluate(idx, {q: S.parse_match(S.or_rewrite(t) or t) for q, t in QUERIES.items()})
    return hits.join(idx.entries.select("store", "id", "name"), ["store", "id"]).select("qid", "store", "name", F.round("rank", 6).alias("rank"))


def q_observe_refresh(spark, sf):
    """Two runs of the refresh job over a table, transcript files and a source that is not there."""
    files, root = scratch_path(spark, "sessions"), scratch_path(spark, "store")
    lines = TQ._render(spark, sf, "codex").withColumn("conv", F.regexp_extract("stem", r"(\d+)", 1).cast("long"))
    write_line_files(lines.select("conv", "line_no", "value"), ["conv"], files, "line_no")
    SG.create(V.bench_entries(spark, sf).select(*ENTRY_COLUMNS), root)
    part = {"table": "part", "columns": {"id": "p_partkey", "name": "p_name", "content": ["p_type", "p_brand"]}}
    sources = [{"source_id": "catalog", "kind": "sqlite_table", "params": {"path": f"{sf}/part.parquet", **part}},
               {"source_id": "gone", "kind": "sqlite_table", "params": {"path": f"{sf}/no_such_table.parquet", **part}},
               {"source_id": "sessions", "kind": "agent_transcripts",
                "params": {"path": files.replace("file:", "", 1), "patterns": ["**/*.txt"], "format": "codex"}}]
    runs = [OB.observe(spark, root, sources, SQ.NOW, cloud_root="/cloud").withColumn("run", F.lit(k)) for k in (1, 2)]
    stats = runs[0].unionByName(runs[1]).select("run", "source_id", "indexed", "skipped", "alerts", "new_alerts", "errors")
    kept = SG.read(spark, root).entries.groupBy(F.lit(3).alias("run"), F.split("name", "/")[0].alias("source_id")).agg(F.count(F.lit(1)).alias("indexed"))
    return stats.unionByName(kept, allowMissingColumns=True)


def queries():
    return {"index_refresh": q_index_refresh, "index_refresh_find": q_index_refresh_find, "observe_refresh": q_observe_refresh}


def oracle():
    from ..functions.text import tokens_py

    final = [("ch", SQ.CHANGES_SQL), ("dn", SQ.DELETES_SQL), ("left_out", """
SELECT store, name FROM (SELECT e.store, e.name, row_number() OVER (PARTITION BY e.name ORDER BY
  CASE WHEN e.store = 'user' THEN 0 ELSE 1 END) AS rn FROM (
    SELECT store, name FROM entries e WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.store = e.store AND ch.name = e.name)
    UNION ALL SELECT store, name FROM ch) e JOIN dn ON dn.name = e.name) WHERE rn = 1"""),
             ("final", """
SELECT f.*, row_number() OVER () AS id FROM (
  SELECT store, name, content, tags FROM entries e WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.store = e.store AND ch.name = e.name)
  UNION ALL SELECT store, name, content, tags FROM ch) f
WHERE NOT EXISTS (SELECT 1 FROM left_out d WHERE d.store = f.store AND d.name = f.name)""")]
    turns = ("SELECT count(*) FROM conversations WHERE role IN ('user', 'assistant') AND NOT (role = 'assistant' AND turn % 4 = 3) "
             f"AND {TQ.STRIP} <> ''")
    qs = [(qid, tokens_py(t), "or") for qid, t in QUERIES.items()]
    return {
        "observe_refresh": f"""
WITH p AS (SELECT count(*) AS n FROM part), t AS ({turns.replace("count(*)", "count(*) AS n")})
SELECT 1 AS run, 'catalog' AS source_id, n AS indexed, 0 AS skipped, 0 AS alerts, 0 AS new_alerts, 0 AS errors FROM p
UNION ALL SELECT 2, 'catalog', 0, n, 0, 0, 0 FROM p
UNION ALL SELECT r, 'gone', 0, 0, 0, 0, 1 FROM (VALUES (1), (2)) v(r)
UNION ALL SELECT 1, 'sessions', n, 0, 0, 0, 0 FROM t UNION ALL SELECT 2, 'sessions', 0, 0, 0, 0, 0
UNION ALL SELECT 3, 'bench', count(*), NULL, NULL, NULL, NULL FROM benchmark
UNION ALL SELECT 3, 'observed', p.n + t.n, NULL, NULL, NULL, NULL FROM p, t
UNION ALL SELECT 3, 'sync-error', 1, NULL, NULL, NULL, NULL""",
        "index_refresh": O.with_views("entries", extra=final + O.index_ctes("final")) +
        "SELECT store, term, count(DISTINCT id) AS df, count(*) AS cf FROM toks GROUP BY ALL",
        "index_refresh_find": O.with_views("entries", extra=final + O.index_ctes("final") + O.bm25_sql(qs)) +
        "SELECT s.qid, s.store, e.name, round(s.rank, 6) AS rank FROM scored s JOIN final e ON e.store = s.store AND e.id = s.id"}
