"""Entry-shaped views over the driver's tables.

The driver ships documents, benchmark items, conversations, events and orders.
These functions turn them into the entry / memory / task shapes the operators
work on.  They are pure projections and unions (no shuffle except the labels
join), so every query built on them grows with the input tables.

``plans/oracle.py`` holds the DuckDB text of the same views; keep both in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ENTRY_COLUMNS

BASE_TS = "2024-01-01 00:00:00"
CONV_ID_BASE = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ts_plus_seconds(seconds) -> F.Column:
    base = F.lit(BASE_TS).cast("timestamp_ntz")
    return base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def docs_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents (+ labels) as observed user entries."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    d = d.join(lab, "doc_id", "left")
    return d.select(
        F.lit("user").alias("store"),
        F.col("doc_id").alias("id"),
        F.lit("observed").alias("type"),
        F.concat(F.lit("observed/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("name"),
        F.col("text").alias("content"),
        F.concat_ws(",", F.lit("documents"), "source", "lang").alias("tags"),
        F.concat(F.lit('{"source_id":"'), "source", F.lit('","lang":"'), "lang", F.lit('"}')).alias("meta"),
        ((F.coalesce("quality", F.lit(0)) == 1) & (F.col("doc_id") % 10 == 0)).alias("pinned"),
        _ts_plus_seconds(F.col("doc_id") * 60).alias("created"),
        _ts_plus_seconds(F.col("doc_id") * 60).alias("updated"),
    )


def bench_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as system-store knowledge entries."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        F.lit("system").alias("store"),
        F.col("item_id").alias("id"),
        F.lit("knowledge").alias("type"),
        F.concat(F.lit("bench/"), F.col("item_id").cast("string")).alias("name"),
        F.col("text").alias("content"),
        F.lit("benchmark").alias("tags"),
        F.lit("{}").alias("meta"),
        F.lit(False).alias("pinned"),
        _ts_plus_seconds(F.col("item_id") * 60).alias("created"),
        _ts_plus_seconds(F.col("item_id") * 60).alias("updated"),
    )


def conv_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversation turns as observed transcript entries."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.lit("user").alias("store"),
        (F.lit(CONV_ID_BASE) + F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        F.lit("observed").alias("type"),
        F.concat(F.lit("observed/conversations/"), F.col("conv_id").cast("string"),
                 F.lit("/"), F.col("turn").cast("string")).alias("name"),
        F.col("text").alias("content"),
        F.concat(F.lit("agent_transcript,conversations,"), "role").alias("tags"),
        F.concat(F.lit('{"role":"'), "role", F.lit('"}')).alias("meta"),
        F.lit(False).alias("pinned"),
        _ts_plus_seconds(F.col("conv_id") * 60 + F.col("turn")).alias("created"),
        _ts_plus_seconds(F.col("conv_id") * 60 + F.col("turn")).alias("updated"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole entry table: documents + conversations (user), benchmark (system)."""
    parts = [docs_entries(spark, sf_dir), conv_entries(spark, sf_dir), bench_entries(spark, sf_dir)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*ENTRY_COLUMNS)


# Mapping of driver event types onto memory types and decay.
EVENT_MEMORY_TYPE = {"click": "memory", "view": "memory", "error": "memory",
                     "purchase": "lesson", "signup": "session"}
MEMORY_DECAY = {"memory": 0.95, "lesson": 0.99, "session": 0.97}


def memory_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as memory-type entries with weight/decay in meta."""
    e = table(spark, sf_dir, "events")
    mtype = F.when(F.col("event_type") == "purchase", "lesson") \
             .when(F.col("event_type") == "signup", "session").otherwise("memory")
    decay = F.when(mtype == "lesson", 0.99).when(mtype == "session", 0.97).otherwise(0.95)
    weight = F.least(F.lit(1.0), F.col("value") / 500.0)
    k = F.get_json_object("props", "$.k")
    meta = F.concat(F.lit('{"weight":'), weight.cast("string"),
                    F.lit(',"decay_rate":'), decay.cast("string"),
                    F.lit(',"accessed":0,"k":'), k, F.lit("}"))
    return e.select(
        F.lit("user").alias("store"),
        F.col("event_id").alias("id"),
        mtype.alias("type"),
        F.concat(F.lit("mem/"), F.col("event_id").cast("string")).alias("name"),
        F.concat_ws(" ", "event_type", F.concat(F.lit("user"), F.col("user_id").cast("string")),
                    F.concat(F.lit("k"), k)).alias("content"),
        F.concat_ws(",", F.lit("working"), "event_type").alias("tags"),
        meta.alias("meta"),
        (F.col("event_id") % 10 == 0).alias("pinned"),
        F.col("ts").cast("timestamp_ntz").alias("created"),
        F.col("ts").cast("timestamp_ntz").alias("updated"),
    )


def task_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as task entries (priority/status in meta)."""
    o = table(spark, sf_dir, "orders")
    prio = (F.when(F.col("o_orderpriority") == "1-URGENT", "critical")
             .when(F.col("o_orderpriority") == "2-HIGH", "high")
             .when(F.col("o_orderpriority") == "5-LOW", "low").otherwise("normal"))
    status = (F.when(F.col("o_orderstatus") == "O", "open")
               .when(F.col("o_orderstatus") == "P", "doing").otherwise("done"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    meta = F.concat(F.lit('{"status":"'), status, F.lit('","priority":"'), prio,
                    F.lit('","due":"'), day, F.lit('"}'))
    return o.select(
        F.lit("user").alias("store"),
        F.col("o_orderkey").alias("id"),
        F.lit("task").alias("type"),
        F.concat(F.lit("task/"), F.col("o_orderkey").cast("string")).alias("name"),
        F.concat(F.lit("order of customer "), F.col("o_custkey").cast("string")).alias("content"),
        F.lit("task").alias("tags"),
        meta.alias("meta"),
        F.lit(False).alias("pinned"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("updated"),
    )
