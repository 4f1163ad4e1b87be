"""Registered queries: transcript formats, identity, file scan, JSON helpers.

The conversations table is rendered as JSON lines in each transcript format
(Spark ``to_json`` over the table), so every query grows with the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.json import dig, json_fields
from ..session import scratch_path
from ..sources import transcripts as TR
from ..sources.file_sink import write_line_files
from . import views as V


def _esc(c):
    """JSON string literal of a column."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("t"))), r'^\{"t":(.*)\}$', 1)


def _render(spark, sf, fmt: str):
    c = V.table(spark, sf, "conversations")
    role, turn, text, conv = F.col("role"), F.col("turn"), F.col("text"), F.col("conv_id")
    if fmt == "claude_code":
        content = F.when(turn % 2 == 0, _esc(text)).otherwise(
            F.concat(F.lit('[{"type":"thinking","text":"hidden"},{"type":"text","text":'), _esc(text), F.lit("}]")))
        uuid = F.when(turn % 3 == 2, F.lit("")).otherwise(
            F.concat(F.lit(',"uuid":"u'), conv.cast("string"), F.lit("-"), turn.cast("string"), F.lit('"')))
        sess = F.when(conv % 2 == 1, F.lit("")).otherwise(F.concat(F.lit(',"sessionId":"s'), conv.cast("string"), F.lit('"')))
        line = F.concat(F.lit('{"type":"'), role, F.lit('"'), uuid, sess,
                        F.lit(',"timestamp":"2024-01-01T00:00:0'), turn.cast("string"), F.lit('"'),
                        F.lit(',"isSidechain":'), F.when(turn == 5, "true").otherwise("false"),
                        F.lit(',"message":{"role":"'), role, F.lit('","content":'), content, F.lit("}}"))
    elif fmt == "generic":
        line = F.when(turn % 3 == 0, F.concat(F.lit('{"body":'), _esc(text), F.lit("}"))).otherwise(
            F.concat(F.lit('{"speaker":"'), role, F.lit('","body":'), _esc(text), F.lit("}")))
    elif fmt == "gemini":
        line = (F.when(role == "user", F.concat(F.lit('{"step_index":'), turn.cast("string"),
                                                 F.lit(',"type":"USER_INPUT","content":'), _esc(text), F.lit("}")))
                 .when(role == "assistant", F.concat(
                     F.lit('{"step_index":'), turn.cast("string"), F.lit(',"type":"PLANNER_RESPONSE","content":'),
                     F.when(turn % 4 == 1, F.lit('""')).otherwise(_esc(text)), F.lit(',"thinking":'), _esc(text), F.lit("}")))
                 .otherwise(F.concat(F.lit('{"type":"VIEW_FILE","source":"MODEL","content":'), _esc(text), F.lit("}"))))
    elif fmt == "codex":
        msg = F.when(turn % 4 == 3, F.concat(F.lit("[external_agent_tool_call: Read] "), text)).otherwise(text)
        line = (F.when(role == "user", F.concat(F.lit('{"session_id":"s'), conv.cast("string"), F.lit('","ts":'),
                                                 turn.cast("string"), F.lit(',"text":'), _esc(text), F.lit("}")))
                 .when(role == "assistant", F.concat(F.lit('{"type":"event_msg","payload":{"type":"agent_message","message":'),
                                                     _esc(msg), F.lit("}}")))
                 .otherwise(F.concat(F.lit('{"type":"response_item","payload":{"type":"message","role":"developer","content":'),
                                     _esc(text), F.lit("}}"))))
    else:  # kimi
        line = (F.when(role == "assistant", F.concat(
                    F.lit('{"type":"context.append_loop_event","event":{"type":"content.part","part":{"type":"text","text":'),
                    _esc(text), F.lit("}}}")))
                 .when(role == "user", F.concat(
                     F.lit('{"type":"context.append_message","message":{"role":"user","content":[{"type":"text","text":'),
                     _esc(text), F.lit('}],"origin":{"kind":"'), F.when(turn % 4 == 0, "user").otherwise("system_reminder"),
                     F.lit('"}}}')))
                 .otherwise(F.lit('{"type":"usage.record"}')))
    return c.select(F.concat(F.lit("conv/"), conv.cast("string"), F.lit(".jsonl")).alias("file_key"),
                    F.concat(F.lit("/data/conv/"), conv.cast("string"), F.lit(".jsonl")).alias("display_path"),
                    conv.cast("string").alias("stem"), (turn + 1).alias("line_no"), line.alias("value"))


def _q(fmt, **opts):
    def run(spark, sf):
        t = TR.turns(_render(spark, sf, fmt), "transcripts", fmt if fmt != "gemini" else "gemini_antigravity", **opts)
        return t.select(F.regexp_extract("key", r"^(.*)#", 1).alias("file_key"), "line_no", "role", F.col("content").alias("text"))
    return run


def q_tr_identity(spark, sf):
    t = TR.turns(_render(spark, sf, "claude_code"), "transcripts", "claude_code")
    return t.select("name", "key", "session", "timestamp", "fingerprint")


def q_src_transcripts(spark, sf):
    """Write the codex rendering as one JSONL file per conversation, scan it back."""
    out = scratch_path(spark, "transcripts")
    lines = _render(spark, sf, "codex").withColumn("conv", F.regexp_extract("stem", r"(\d+)", 1).cast("long"))
    write_line_files(lines.select("conv", "line_no", "value"), ["conv"], out, "line_no")
    read = TR.read_lines(spark, [out], below="*.txt")
    t = TR.turns(read, "codex-sessions", "codex")
    return t.select(F.regexp_extract("source_path", r"conv=(\d+)", 1).cast("long").alias("conv_id"),
                    "line_no", "role", F.col("content").alias("text"))


def q_json_dig(spark, sf):
    d = _render(spark, sf, "codex").withColumn("v", F.try_parse_json("value"))
    return d.select("file_key", "line_no",
                    dig("v", "payload.type").alias("payload_type"), dig("v", "session_id").alias("session_id"),
                    dig("v", "payload.missing.deeper").alias("missing"))


def q_meta_tolerant(spark, sf):
    e = V.docs_entries(spark, sf)
    e = e.withColumn("meta", F.when(F.col("id") % 10 == 3, F.lit("{broken")).otherwise(F.col("meta")))
    m = json_fields("meta")
    return e.select("id", F.element_at(m, "source_id").cast("string").alias("source_id"), F.element_at(m, "lang").cast("string").alias("lang"),
                    F.size(m).cast("long").alias("n_keys"))


def queries():
    return {
        "tr_blocks": _q("claude_code"),
        "tr_generic": _q("generic", role_field="speaker", text_field="body", default_role="user"),
        "tr_steps": _q("gemini"),
        "tr_events": _q("codex"),
        "tr_wire": _q("kimi"),
        "tr_identity": q_tr_identity,
        "src_transcripts": q_src_transcripts,
        "json_dig": q_json_dig,
        "meta_tolerant": q_meta_tolerant,
    }


STRIP = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


def _expected(where: str, role: str = "role", text: str = STRIP) -> str:
    return (f"SELECT * FROM (SELECT 'conv/' || CAST(conv_id AS VARCHAR) || '.jsonl' AS file_key, turn + 1 AS line_no, "
            f"{role} AS role, {text} AS text FROM conversations WHERE {where}) WHERE text <> ''")


def rendered_sql() -> str:
    """The codex rendering of a conversation row."""
    def text(t: str) -> str:
        return f"CAST(to_json({t}) AS VARCHAR)"
    said = f"CASE WHEN turn % 4 = 3 THEN '[external_agent_tool_call: Read] ' || text ELSE text END"
    return f"""CASE role
    WHEN 'user' THEN '{{"session_id":"s' || CAST(conv_id AS VARCHAR) || '","ts":' || CAST(turn AS VARCHAR) || ',"text":' || {text("text")} || '}}'
    WHEN 'assistant' THEN '{{"type":"event_msg","payload":{{"type":"agent_message","message":' || {text(said)} || '}}}}'
    ELSE '{{"type":"response_item","payload":{{"type":"message","role":"developer","content":' || {text("text")} || '}}}}' END"""


def oracle():
    ua = "role IN ('user', 'assistant')"
    return {
        "tr_blocks": _expected(f"{ua} AND turn <> 5"),
        "tr_generic": _expected(f"(CASE WHEN turn % 3 = 0 THEN 'user' ELSE role END) IN ('user', 'assistant')",
                                role="CASE WHEN turn % 3 = 0 THEN 'user' ELSE role END"),
        "tr_steps": _expected(ua),
        "tr_events": _expected(f"{ua} AND NOT (role = 'assistant' AND turn % 4 = 3)"),
        "tr_wire": _expected("role = 'assistant' OR (role = 'user' AND turn % 4 = 0)"),
        "tr_identity": f"""
SELECT 'observed/transcripts/conv_' || CAST(conv_id AS VARCHAR) || '.jsonl/' ||
       CASE WHEN turn % 3 = 2 THEN 'L' || CAST(turn + 1 AS VARCHAR) ELSE 'u' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) END AS name,
       'conv/' || CAST(conv_id AS VARCHAR) || '.jsonl#' ||
       CASE WHEN turn % 3 = 2 THEN 'L' || CAST(turn + 1 AS VARCHAR) ELSE 'u' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) END AS key,
       CASE WHEN conv_id % 2 = 1 THEN CAST(conv_id AS VARCHAR) ELSE 's' || CAST(conv_id AS VARCHAR) END AS session,
       '2024-01-01T00:00:0' || CAST(turn AS VARCHAR) AS timestamp,
       substr(sha256({STRIP}), 1, 16) AS fingerprint
FROM conversations WHERE {ua} AND turn <> 5 AND {STRIP} <> ''""",
        "src_transcripts": f"""
SELECT conv_id, line_no, role, text FROM (
  SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS line_no, role, turn,
         {STRIP} AS text FROM conversations)
WHERE role IN ('user', 'assistant') AND NOT (role = 'assistant' AND turn % 4 = 3) AND text <> ''""",
        "json_dig": """
SELECT 'conv/' || CAST(conv_id AS VARCHAR) || '.jsonl' AS file_key, turn + 1 AS line_no,
       CASE role WHEN 'assistant' THEN 'agent_message' WHEN 'system' THEN 'message' END AS payload_type,
       CASE WHEN role = 'user' THEN 's' || CAST(conv_id AS VARCHAR) END AS session_id,
       NULL::VARCHAR AS missing
FROM conversations""",
        "meta_tolerant": """
SELECT doc_id AS id, CASE WHEN doc_id % 10 = 3 THEN NULL ELSE source END AS source_id,
       CASE WHEN doc_id % 10 = 3 THEN NULL ELSE lang END AS lang,
       CAST(CASE WHEN doc_id % 10 = 3 THEN 0 ELSE 2 END AS BIGINT) AS n_keys
FROM documents""",
    }


def _write_archives(spark, sf, out: str) -> None:
    """Pack the claude_code rendering into zip archives (one per 25 conversations),
    written by the tasks to the shared scratch folder."""
    import io
    import os
    import zipfile

    import pandas as pd

    lines = _render(spark, sf, "claude_code").withColumn(
        "grp", (F.regexp_extract("stem", r"(\d+)", 1).cast("long") / 25).cast("long"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(pdf["grp"].iloc[0])
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
            for stem, part in pdf.sort_values(["stem", "line_no"]).groupby("stem"):
                zf.writestr(f"s/{stem}/logs/transcript.jsonl", "\n".join(part["value"]) + "\n")
            zf.writestr("s/meta.db", b"\x00\x01")
        path = os.path.join(out.replace("file:", ""), f"archive-{g}.zip")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as fh:
            fh.write(buf.getvalue())
        return pd.DataFrame({"grp": [g]})

    lines.groupBy("grp").applyInPandas(pack, "grp long").collect()


def q_src_zip(spark, sf):
    from ..sources import archive as AR
    out = scratch_path(spark, "archives")
    _write_archives(spark, sf, out)
    lines = AR.read_archive_lines(spark, out, inner="*.jsonl")
    t = TR.turns(lines, "archive", "claude_code")
    return t.select("key", "name", "role", "line_no", "fingerprint")


_base_queries = queries


def queries():  # noqa: F811
    q = _base_queries()
    q["src_zip"] = q_src_zip
    return q
