"""Registered queries: memory build / recall / boost / consolidate, tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokens_py
from ..operators import index as ix
from ..operators import memory as M
from ..operators import search as S
from . import oracle as O
from . import views as V

NOW = "2024-06-01 12:00:00"
# Fixed query parameters of the registered recall.
RECALL_QUERIES = {1: "click", 2: "purchase user4", 3: "signup", 4: "user9 k%"}
RECALL_LIMIT = 5


def _events_memory(spark, sf):
    e = V.table(spark, sf, "events")
    text = F.concat_ws(" ", "event_type", F.concat(F.lit("user"), F.col("user_id").cast("string")))
    sev = (F.when(F.col("value") < 15, "low").when(F.col("value") < 35, "medium")
            .when(F.col("value") < 70, "high").otherwise("critical"))
    e = e.select("event_id", "event_type", "ts", text.alias("text"), F.col("event_type").alias("tg"),
                 F.concat(F.lit("Lesson "), F.col("user_id").cast("string")).alias("title"), sev.alias("sev"),
                 F.lit("").alias("no_tags"))
    memo = M.memos(e.filter(F.col("event_type").isin("click", "view", "error")), "text", "tg", "ts")
    les = M.lessons(e.filter(F.col("event_type") == "purchase"), "title", "text", "sev", "no_tags", "ts")
    ses = M.session_reports(e.filter(F.col("event_type") == "signup"), "text", "ts")
    return memo.unionByName(les).unionByName(ses)


def q_memory_build(spark, sf):
    b = M.last_write_wins(_events_memory(spark, sf).withColumn("seq", F.lit(0)), "name", ("at",))
    return b.select("name", "type", "tags", "weight", "decay_rate")


def _mem_index(spark, sf):
    return ix.held_index(V.memory_entries(spark, sf))


def q_recall(spark, sf):
    hits, _ = M.recall(_mem_index(spark, sf), RECALL_QUERIES, RECALL_LIMIT)
    return hits.select("qid", "pos", "name", "type", F.round("weight", 6).alias("weight"))


def q_recall_boost(spark, sf):
    idx = _mem_index(spark, sf)
    _, boosts = M.recall(idx, RECALL_QUERIES, RECALL_LIMIT)
    b = M.apply_boosts(idx.entries, boosts, NOW)
    return b.select("name", F.round("weight", 6).alias("weight"), "accessed")


def q_consolidate(spark, sf):
    c = M.consolidate(V.memory_entries(spark, sf), NOW)
    return c.select("name", "action", F.round("weight", 6).alias("weight"))


def q_consolidate_stats(spark, sf):
    return M.consolidate_stats(M.consolidate(V.memory_entries(spark, sf), NOW))


def q_retention_curve(spark, sf):
    return M.retention_curve(V.memory_entries(spark, sf), 10)


def _order_tasks(spark, sf):
    o = V.table(spark, sf, "orders")
    prio = (F.when(F.col("o_orderpriority") == "1-URGENT", "critical")
             .when(F.col("o_orderpriority") == "2-HIGH", "high")
             .when(F.col("o_orderpriority") == "5-LOW", "low").otherwise("normal"))
    return o.select(F.concat(F.lit("task/"), F.col("o_orderkey").cast("string")).alias("n"),
                    F.concat(F.lit("order of customer "), F.col("o_custkey").cast("string")).alias("c"),
                    prio.alias("p"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"),
                    F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus")).alias("t"))


def q_tasks_build(spark, sf):
    t = M.tasks_build(_order_tasks(spark, sf), "n", "c", "p", "d", "t")
    return t.select("name", "tags", F.get_json_object("meta", "$.status").alias("status"),
                    F.get_json_object("meta", "$.priority").alias("priority"),
                    F.get_json_object("meta", "$.due").alias("due"))


def _task_updates(spark, sf):
    o = V.table(spark, sf, "orders")
    upd = o.filter(F.col("o_orderkey") % 7 <= 1).select(
        F.concat(F.lit("task/"), F.col("o_orderkey").cast("string")).alias("name"),
        F.when(F.col("o_orderkey") % 7 == 0, "done").otherwise("blocked").alias("status"))
    missing = o.filter(F.col("o_orderkey") % 97 == 0).select(
        F.concat(F.lit("task/none-"), F.col("o_orderkey").cast("string")).alias("name"), F.lit("done").alias("status"))
    return upd.unionByName(missing)


def q_tasks_update(spark, sf):
    ents = V.task_entries(spark, sf).unionByName(V.entries(spark, sf))
    u = M.tasks_update(ents, _task_updates(spark, sf), NOW)
    return u.select("name", "status", "done_at", F.get_json_object("meta", "$.priority").alias("priority"))


def _nested(entries):
    """Entries whose meta also holds an object and a number, which a write must leave alone."""
    inner = F.concat(F.lit(',"ref":{"k":'), F.col("id").cast("string"), F.lit('},"half":0.5}'))
    return entries.withColumn("meta", F.concat(F.expr("substring(meta, 1, length(meta) - 1)"), inner))


def _written(entries):
    return entries.select("name", "type", "pinned", *[F.get_json_object("meta", f"$.{k}").alias(k.replace(".", "_")) for k in (
        "weight", "accessed", "status", "done_at", "last_decay", "ref.k", "half")],
        F.regexp_replace(F.col("updated").cast("string"), r"\.0+$", "").alias("updated"))


def q_consolidate_apply(spark, sf):
    out = _written(M.consolidate_apply(_nested(V.memory_entries(spark, sf)), NOW))
    return out.withColumn("weight", F.round(F.col("weight").cast("double"), 6)).drop("status", "done_at", "updated")


def q_boost_apply(spark, sf):
    idx = _mem_index(spark, sf)
    _, boosts = M.recall(idx, RECALL_QUERIES, RECALL_LIMIT)
    out = M.boost_apply(_nested(idx.entries), boosts, NOW)
    return out.select("name", F.round(F.get_json_object("meta", "$.weight").cast("double"), 6).alias("weight"),
                      F.get_json_object("meta", "$.accessed").cast("long").alias("accessed"),
                      F.get_json_object("meta", "$.ref.k").cast("long").alias("ref_k"))


def q_tasks_apply(spark, sf):
    out = _written(M.tasks_apply(_nested(V.task_entries(spark, sf)), _task_updates(spark, sf), NOW))
    return out.select("name", "type", "pinned", "status", "done_at", F.col("ref_k").cast("long").alias("ref_k"),
                      (F.col("updated") == NOW).alias("touched"))


def q_tasks_by_status(spark, sf):
    return M.tasks(V.task_entries(spark, sf), "open").select("name", "prio_rank", "updated")


def q_tasks_sorted(spark, sf):
    t = M.tasks(V.task_entries(spark, sf))
    return t.select("name", "prio_rank", "updated").orderBy(F.desc("prio_rank"), F.desc("updated"), "name")


def queries():
    return {"consolidate_apply": q_consolidate_apply, "boost_apply": q_boost_apply, "tasks_apply": q_tasks_apply,
            "memory_build": q_memory_build, "recall": q_recall, "recall_boost": q_recall_boost,
            "consolidate": q_consolidate, "consolidate_stats": q_consolidate_stats,
            "retention_curve": q_retention_curve, "tasks_build": q_tasks_build,
            "tasks_update": q_tasks_update, "tasks_by_status": q_tasks_by_status,
            "tasks_sorted": q_tasks_sorted}


# ----------------------------------------------------------------------------- oracle

def _recall_ctes() -> list:
    mem = ("mem", "SELECT store, id, type, name, content, tags, weight, pinned FROM memory_e")
    exprs, bad = {}, {}
    for q, t in RECALL_QUERIES.items():
        try:
            exprs[q] = S.parse_match(t)
        except S.MatchError:
            bad[q] = t
    ctes = [mem] + O.index_ctes("mem") + [O.ptoks_cte("mem")] + O.expr_ctes(exprs, "sc")
    like = " UNION ALL ".join(
        f"SELECT {q} AS qid, m.*, 0.0 AS rank FROM mem m WHERE "
        f"(coalesce({O.ASCII_LOWER.format(x='name')} LIKE {O.ASCII_LOWER.format(x=O._q('%' + t + '%'))}, false) OR "
        f"coalesce({O.ASCII_LOWER.format(x='content')} LIKE {O.ASCII_LOWER.format(x=O._q('%' + t + '%'))}, false))"
        for q, t in bad.items())
    hits = f"SELECT s.qid, m.*, s.rank FROM sc s JOIN mem m ON m.store = s.store AND m.id = s.id"
    if like:
        hits += " UNION ALL " + like
    ctes.append(("h0", hits))
    ctes.append(("h", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, type ORDER BY rank, id) AS rn "
                      f"FROM h0) WHERE rn <= {RECALL_LIMIT}"))
    ctes.append(("r", "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, "
                      "CASE type WHEN 'memory' THEN 0 WHEN 'lesson' THEN 1 ELSE 2 END, rank, id) AS pos FROM h"))
    return ctes


def oracle():
    mem_build = """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY at_ts DESC) AS rn FROM (
    SELECT 'memo/' || replace(strftime(ts, '%Y-%m-%dT%H:%M:%S'), ':', '-') AS name, 'memory' AS type,
           'working,' || event_type AS tags, 0.5::DOUBLE AS weight, NULL::DOUBLE AS decay_rate, ts AS at_ts
    FROM events WHERE event_type IN ('click', 'view', 'error')
    UNION ALL
    SELECT 'lesson/' || substr(replace(lower('Lesson ' || CAST(user_id AS VARCHAR)), ' ', '-'), 1, 50), 'lesson',
           'lesson,' || sev, CAST(CASE sev WHEN 'low' THEN 0.5 WHEN 'medium' THEN 0.7 WHEN 'high' THEN 0.9 ELSE 1.0 END AS DOUBLE),
           0.99::DOUBLE, ts
    FROM (SELECT *, CASE WHEN value < 15 THEN 'low' WHEN value < 35 THEN 'medium' WHEN value < 70 THEN 'high'
                         ELSE 'critical' END AS sev FROM events WHERE event_type = 'purchase')
    UNION ALL
    SELECT 'session/' || strftime(ts, '%Y-%m-%d'), 'session', 'session,episodisch', 0.8::DOUBLE, 0.97::DOUBLE, ts
    FROM events WHERE event_type = 'signup'))
WHERE rn = 1"""
    cons = """
SELECT name,
       CASE WHEN weight * decay_rate < 0.05 THEN 'forgotten' WHEN weight * decay_rate < weight THEN 'decayed'
            ELSE 'kept' END AS action,
       CASE WHEN weight * decay_rate < 0.05 THEN NULL ELSE CAST(round(CAST(CAST(weight * decay_rate AS VARCHAR) AS DECIMAL(38,20)), 4) AS DOUBLE) END AS weight
FROM memory_e WHERE NOT pinned"""
    rec = O.with_views("memory_e", extra=_recall_ctes())
    tasks_meta = O.with_views("tasks_e")
    at = NOW.replace(" ", "T")
    half_up = "CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,20)), 4) AS DOUBLE)"
    return {
        "consolidate_apply": O.with_views("memory_e") + f"""
SELECT name, type, pinned, round(CASE WHEN decayed THEN {half_up.format(x="weight * decay_rate")} ELSE weight END, 6) AS weight,
  '0' AS accessed, CASE WHEN decayed THEN '{at}' END AS last_decay, CAST(id AS VARCHAR) AS ref_k, '0.5' AS half
FROM (SELECT *, NOT pinned AND weight * decay_rate < weight AS decayed FROM memory_e) WHERE pinned OR weight * decay_rate >= 0.05""",
        "boost_apply": rec + f""", b AS (SELECT store, id, count(*) AS n FROM h GROUP BY ALL)
SELECT m.name, round(CASE WHEN n IS NULL THEN m.weight ELSE {half_up.format(x="least(1.0, m.weight + 0.1 * b.n)")} END, 6) AS weight,
  CAST(coalesce(n, 0) AS BIGINT) AS accessed, m.id AS ref_k FROM mem m LEFT JOIN b ON m.store = b.store AND m.id = b.id""",
        "tasks_apply": tasks_meta + f"""
SELECT name, 'task' AS type, false AS pinned, CASE id % 7 WHEN 0 THEN 'done' WHEN 1 THEN 'blocked' ELSE status END AS status,
  CASE WHEN id % 7 = 0 THEN '{at}' END AS done_at, id AS ref_k, id % 7 <= 1 AS touched FROM tasks_e""",
        "memory_build": "SELECT name, type, tags, weight, decay_rate FROM (" + mem_build + ")",
        "recall": rec + f"SELECT qid, pos, name, type, round(weight, 6) AS weight FROM r WHERE pos <= {RECALL_LIMIT}",
        "recall_boost": rec + ", b AS (SELECT store, id, count(*) AS n FROM h GROUP BY ALL) " +
            "SELECT m.name, CAST(round(CAST(CAST(least(1.0, m.weight + 0.1 * b.n) AS VARCHAR) AS DECIMAL(38,20)), 4) AS DOUBLE) AS weight, CAST(b.n AS BIGINT) AS accessed "
            "FROM b JOIN mem m ON m.store = b.store AND m.id = b.id",
        "consolidate": O.with_views("memory_e") + cons,
        "consolidate_stats": O.with_views("memory_e") + "SELECT count_if(action = 'decayed') AS decayed, "
            "count_if(action = 'forgotten') AS forgotten, count_if(action = 'kept') AS kept FROM (" + cons + ")",
        "retention_curve": O.with_views("memory_e") +
            "SELECT name, CAST(greatest(1, floor(ln(0.05 / weight) / ln(decay_rate)) + 1) AS BIGINT) AS forget_cycle, "
            "round(weight * pow(decay_rate, 10), 6) AS weight_10 FROM memory_e WHERE NOT pinned",
        "tasks_build": """
SELECT 'task/' || CAST(o_orderkey AS VARCHAR) AS name,
       CASE WHEN o_orderstatus = 'F' THEN 'task' ELSE 'task,' || o_orderstatus END AS tags,
       'open' AS status,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high'
            WHEN '5-LOW' THEN 'low' ELSE 'normal' END AS priority,
       strftime(o_orderdate, '%Y-%m-%d') AS due
FROM orders""",
        "tasks_update": tasks_meta + f"""
SELECT name, CASE WHEN id % 7 = 0 THEN 'done' ELSE 'blocked' END AS status,
       CASE WHEN id % 7 = 0 THEN '{NOW.replace(' ', 'T')}' END AS done_at, priority
FROM tasks_e WHERE id % 7 <= 1""",
        "tasks_by_status": tasks_meta + """
SELECT name, CASE priority WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'normal' THEN 2 WHEN 'low' THEN 1
                ELSE 2 END AS prio_rank, updated FROM tasks_e WHERE status = 'open'""",
        "tasks_sorted": tasks_meta + """
SELECT name, CASE priority WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'normal' THEN 2 WHEN 'low' THEN 1
                ELSE 2 END AS prio_rank, updated FROM tasks_e""",
    }
