"""Memory upkeep and task views over the entry table.

Weights live in ``meta`` (JSON text).  Every operator is a projection,
filter, join or window over DataFrames; ``now`` is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json import json_patch
from ..schema import MEMORY_TYPES
from . import entries as E
from . import search as S
from .index import Index

# Weight by lesson severity (unknown severity -> 0.7).
SEVERITY_WEIGHT = {"low": 0.5, "medium": 0.7, "high": 0.9, "critical": 1.0}
# Task priority order (unknown -> normal).
PRIORITY_RANK = {"critical": 4, "high": 3, "normal": 2, "low": 1}

DEFAULT_WEIGHT = 0.5
DEFAULT_DECAY = 0.95
FORGET_BELOW = 0.05
BOOST = 0.1


def meta_double(key: str, default: float | None = None) -> Column:
    """A numeric meta key; invalid JSON reads as {} (so the default)."""
    v = F.get_json_object(F.coalesce(F.col("meta"), F.lit("{}")), f"$.{key}").cast("double")
    return F.coalesce(v, F.lit(default)) if default is not None else v


def meta_string(key: str) -> Column:
    return F.get_json_object(F.coalesce(F.col("meta"), F.lit("{}")), f"$.{key}")


def iso_seconds(ts) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


# --------------------------------------------------------------------------
# Building memory entries (memo, lesson, session report)
# --------------------------------------------------------------------------

def memos(df: DataFrame, text: str, tags: str, now: str) -> DataFrame:
    """Working-memory notes: name memo/<now, ':' -> '-'>, weight 0.5."""
    t = F.col(tags)
    return df.select(
        F.concat(F.lit("memo/"), F.regexp_replace(iso_seconds(now), ":", "-")).alias("name"),
        F.lit("memory").alias("type"), F.col(text).alias("content"),
        F.when(F.coalesce(t, F.lit("")) != "", F.concat(F.lit("working,"), t)).otherwise(F.lit("working")).alias("tags"),
        F.lit(DEFAULT_WEIGHT).alias("weight"), F.lit(None).cast("double").alias("decay_rate"),
        F.substring(iso_seconds(now), 1, 10).alias("session"), F.lit(None).cast("string").alias("severity"),
        F.col(now).cast("timestamp_ntz").alias("at"))


def lessons(df: DataFrame, title: str, content: str, severity: str, tags: str, now: str) -> DataFrame:
    """Lessons: name lesson/<slug>, weight by severity, decay 0.99."""
    sev = F.col(severity)
    wmap = F.create_map(*[x for k, v in SEVERITY_WEIGHT.items() for x in (F.lit(k), F.lit(v))])
    t = F.col(tags)
    base = F.concat(F.lit("lesson,"), sev)
    return df.select(
        F.concat(F.lit("lesson/"), F.substring(F.replace(F.lower(F.col(title)), F.lit(" "), F.lit("-")), 1, 50)).alias("name"),
        F.lit("lesson").alias("type"),
        F.when(F.coalesce(F.col(content), F.lit("")) != "", F.col(content)).otherwise(F.col(title)).alias("content"),
        F.when(F.coalesce(t, F.lit("")) != "", F.concat(base, F.lit(","), t)).otherwise(base).alias("tags"),
        F.coalesce(F.element_at(wmap, sev), F.lit(0.7)).alias("weight"), F.lit(0.99).alias("decay_rate"),
        F.lit(None).cast("string").alias("session"), sev.alias("severity"),
        F.col(now).cast("timestamp_ntz").alias("at"))


def session_reports(df: DataFrame, summary: str, now: str) -> DataFrame:
    """Session reports: name session/<date>, weight 0.8, decay 0.97."""
    return df.select(
        F.concat(F.lit("session/"), F.substring(iso_seconds(now), 1, 10)).alias("name"),
        F.lit("session").alias("type"), F.col(summary).alias("content"),
        F.lit("session,episodisch").alias("tags"),
        F.lit(0.8).alias("weight"), F.lit(0.97).alias("decay_rate"),
        F.lit(None).cast("string").alias("session"), F.lit(None).cast("string").alias("severity"),
        F.col(now).cast("timestamp_ntz").alias("at"))


def last_write_wins(df: DataFrame, key: str = "name", order=("at", "seq")) -> DataFrame:
    """Sequential upserts inside one batch: the latest write of a key wins."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order if c in df.columns])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def memory_meta(df: DataFrame) -> Column:
    """meta JSON of a built memory row."""
    return F.to_json(F.struct(
        F.col("weight").alias("weight"), F.lit(0).alias("accessed"),
        F.col("decay_rate").alias("decay_rate"), F.col("session").alias("session"),
        F.col("severity").alias("severity")))


# --------------------------------------------------------------------------
# Recall, boost, consolidate
# --------------------------------------------------------------------------

def recall(index: Index, queries, limit: int = 5) -> tuple[DataFrame, DataFrame]:
    """(hits, boosts) for a query string or {qid: query}.

    Searches the user store in the types memory/lesson/session, top ``limit``
    per type by rank; LIKE on name/content only when the match expression is
    invalid.  Every per-type hit is boosted; ``hits`` keeps the ``limit``
    best by weight (before the boost).
    """
    qs = {0: queries} if isinstance(queries, str) else dict(queries)
    spark = index.entries.sparkSession
    mem = index.entries.filter((F.col("store") == "user") & F.col("type").isin(*MEMORY_TYPES))
    exprs, bad = {}, {}
    for qid, q in qs.items():
        try:
            exprs[qid] = S.parse_match(q)
        except S.MatchError:
            bad[qid] = q
    parts = []
    tprio = F.when(F.col("type") == "memory", 0).when(F.col("type") == "lesson", 1).otherwise(2)
    if exprs:
        h = S.evaluate(index, exprs).join(mem, ["store", "id"])
        w = Window.partitionBy("qid", "type").orderBy(F.col("rank").asc(), F.col("id").asc())
        parts.append(h.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn"))
    if bad:
        cond = F.array(*[F.when(S.like_condition(q, ("name", "content")), F.lit(qid)) for qid, q in bad.items()])
        # rows without an answer end before the explode
        lk = mem.withColumn("_qids", F.filter(cond, lambda x: x.isNotNull())).filter(F.size("_qids") > 0)
        lk = lk.withColumn("qid", F.explode("_qids")).drop("_qids").withColumn("rank", F.lit(0.0))
        w = Window.partitionBy("qid", "type").orderBy(F.col("id").asc())
        parts.append(lk.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn"))
    if not parts:
        empty = mem.limit(0).withColumn("qid", F.lit(0).cast("long")).withColumn("rank", F.lit(0.0))
        parts.append(empty)
    allh = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    allh = allh.withColumn("weight", meta_double("weight", DEFAULT_WEIGHT))
    boosts = allh.groupBy("store", "id").agg(F.count(F.lit(1)).alias("n_boost"))
    w = Window.partitionBy("qid").orderBy(F.col("weight").desc(), tprio.asc(), F.col("rank").asc(), F.col("id").asc())
    hits = allh.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= limit)
    return hits, boosts


def apply_boosts(entries: DataFrame, boosts: DataFrame, now: str | Column) -> DataFrame:
    """Boosted rows: weight = min(1, w + 0.1 n) rounded to 4, accessed += n."""
    nowc = F.lit(now) if isinstance(now, str) else now
    j = entries.join(boosts, ["store", "id"])
    w = F.round(F.least(F.lit(1.0), meta_double("weight", DEFAULT_WEIGHT) + BOOST * F.col("n_boost")), 4)
    acc = F.coalesce(meta_string("accessed").cast("long"), F.lit(0)) + F.col("n_boost")
    return j.select("store", "id", "name", w.alias("weight"), acc.alias("accessed"),
                    iso_seconds(nowc).alias("last_accessed"))


def consolidate(entries: DataFrame, now: str | Column) -> DataFrame:
    """Decay unpinned memory rows of the user store: action forgotten / decayed / kept and new weight.

    new = w * rate (defaults 0.5 / 0.95); below 0.05 (unrounded) forgotten,
    else stored rounded to 4 decimals.  One narrow projection, no shuffle.
    """
    nowc = F.lit(now) if isinstance(now, str) else now
    m = entries.filter((F.col("store") == "user") & F.col("type").isin(*MEMORY_TYPES) & ~F.col("pinned"))
    w = meta_double("weight", DEFAULT_WEIGHT)
    new = w * meta_double("decay_rate", DEFAULT_DECAY)
    action = (F.when(new < FORGET_BELOW, "forgotten").when(new < w, "decayed").otherwise("kept"))
    return m.select("store", "id", "name", action.alias("action"),
                    F.when(new < FORGET_BELOW, F.lit(None)).otherwise(F.round(new, 4)).alias("weight"),
                    iso_seconds(nowc).alias("last_decay"))


def consolidate_apply(entries: DataFrame, now: str | Column) -> DataFrame:
    """The entry table after one consolidation: forgotten rows gone, decayed rows with new weight and last_decay."""
    r = consolidate(entries, now).filter(F.col("action") != "kept").select("store", "id", "action", F.col("weight").alias("_w"), "last_decay")
    j = entries.join(r, ["store", "id"], "left").filter(~F.coalesce(F.col("action") == "forgotten", F.lit(False)))
    meta = F.when(F.col("action") == "decayed", json_patch("meta", {"weight": F.col("_w"), "last_decay": F.col("last_decay")}))
    return j.withColumn("meta", F.coalesce(meta, F.col("meta"))).select(*entries.columns)


def boost_apply(entries: DataFrame, boosts: DataFrame, now: str | Column) -> DataFrame:
    """The entry table after recalls: boosted rows with new weight, accessed and last_accessed."""
    b = apply_boosts(entries, boosts, now).select("store", "id", F.col("weight").alias("_w"), F.col("accessed").alias("_n"), "last_accessed")
    j = entries.join(b, ["store", "id"], "left")
    meta = F.when(F.col("_w").isNotNull(), json_patch("meta", {
        "weight": F.col("_w"), "accessed": F.col("_n"), "last_accessed": F.col("last_accessed")}))
    return j.withColumn("meta", F.coalesce(meta, F.col("meta"))).select(*entries.columns)


def consolidate_stats(result: DataFrame) -> DataFrame:
    return result.agg(F.count_if(F.col("action") == "decayed").alias("decayed"),
                      F.count_if(F.col("action") == "forgotten").alias("forgotten"),
                      F.count_if(F.col("action") == "kept").alias("kept"))


def retention_curve(entries: DataFrame, cycles: int = 10) -> DataFrame:
    """Closed form of repeated consolidation: weight after ``cycles`` and the
    first cycle at which the row would be forgotten (null if never); a row
    without weight goes in the first."""
    m = entries.filter((F.col("store") == "user") & F.col("type").isin(*MEMORY_TYPES) & ~F.col("pinned"))
    w = meta_double("weight", DEFAULT_WEIGHT)
    r = meta_double("decay_rate", DEFAULT_DECAY)
    n = F.when((r >= 1) | (r <= 0), F.lit(None)).otherwise(
        F.when(w <= 0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(F.log(F.try_divide(F.lit(FORGET_BELOW), w)) / F.log(r)) + 1)))
    return m.select("name", n.cast("long").alias("forget_cycle"),
                    F.round(w * F.pow(r, F.lit(cycles)), 6).alias(f"weight_{cycles}"))


# --------------------------------------------------------------------------
# Tasks
# --------------------------------------------------------------------------

def tasks_build(df: DataFrame, name: str, content: str, priority: str, due: str, tags: str) -> DataFrame:
    """Task entries: status open, priority, optional due; tags task[,<tags>]."""
    t = F.col(tags)
    meta = F.to_json(F.struct(F.lit("open").alias("status"), F.col(priority).alias("priority"),
                              F.col(due).alias("due")))
    return df.select(F.col(name).alias("name"), F.lit("task").alias("type"), F.col(content).alias("content"),
                     F.when(F.coalesce(t, F.lit("")) != "", F.concat(F.lit("task,"), t)).otherwise(F.lit("task")).alias("tags"),
                     meta.alias("meta"))


def tasks_update(entries: DataFrame, updates: DataFrame, now: str | Column) -> DataFrame:
    """Apply (name, status) changes to existing tasks; 'done' also sets done_at.

    The name is looked up user store first, then system; only task entries
    change; the write goes to the user store.
    """
    nowc = F.lit(now) if isinstance(now, str) else now
    found = S.get_by_name(entries, updates.select("name"))
    j = found.filter(F.col("type") == "task").join(updates, "name")
    meta = json_patch("meta", {"status": F.col("status"), "done_at": F.when(F.col("status") == "done", iso_seconds(nowc))})
    return j.select(F.lit("user").alias("store"), "name", "type", "content", "tags", meta.alias("meta"), "pinned",
                    F.col("status"), F.get_json_object(meta, "$.done_at").alias("done_at"))


def tasks_apply(entries: DataFrame, updates: DataFrame, now: str | Column) -> DataFrame:
    """The entry table after the status changes of ``updates``."""
    return E.upsert(entries, tasks_update(entries, updates, now).drop("status", "done_at"), now)


def priority_rank(meta_col: str = "meta") -> Column:
    p = F.get_json_object(F.coalesce(F.col(meta_col), F.lit("{}")), "$.priority")
    m = F.create_map(*[x for k, v in PRIORITY_RANK.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, p), F.lit(2))


def tasks(entries: DataFrame, status: str | None = None) -> DataFrame:
    """User-store tasks (optionally by status) with their semantic sort keys;
    sort with ``.orderBy(F.desc('prio_rank'), F.desc('updated'))``."""
    t = entries.filter((F.col("store") == "user") & (F.col("type") == "task"))
    if status:
        t = t.filter(F.get_json_object("meta", "$.status") == status)
    return t.withColumn("prio_rank", priority_rank())
