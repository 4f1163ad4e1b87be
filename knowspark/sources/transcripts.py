"""JSONL chat transcripts -> turn items.

Lines are parsed once with ``try_parse_json`` into VARIANT (bad JSON -> null,
dropped).  Each format is a column-expression function returning
``(role, text)``; a line that carries no text turn gets a null role and is
dropped.  Everything runs as Catalyst expressions -- no Python per line.

Line numbers (1-based, blank and bad lines counted) are computed without
funnelling a file through one task or shuffling the lines: lines are read
split-wise by the text source, counted per (file, split), and a small prefix
sum over the splits gives each split's first line number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import is_excluded, safe_key

# Codex tool-traffic prefixes that are not prose.
CODEX_TOOL_PREFIXES = ("[external_agent_tool_call", "[external_agent_tool_result")
CODEX_EVENT_ROLES = {"user_message": "user", "agent_message": "assistant"}

FORMATS = ("claude_code", "generic", "gemini_antigravity", "antigravity", "gemini", "codex", "kimi")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def vstr(v: Column, path: str) -> Column:
    """String at a JSON path if the value there is a string, else null."""
    x = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(v, path, "string"))


def vtruthy(v: Column, path: str) -> Column:
    """Python-style truthiness of the value at a path (null/false/0/''/[]/{} are false)."""
    x = F.try_variant_get(v, path, "variant")
    t = F.schema_of_variant(x)
    s = F.try_variant_get(v, path, "string")
    return F.coalesce(
        F.when(t == "BOOLEAN", F.try_variant_get(v, path, "boolean"))
         .when(t == "STRING", s != "")
         .when(t.startswith("ARRAY"), F.size(F.try_variant_get(v, path, "array<variant>")) > 0)
         .when(t.startswith("OBJECT"), F.lit(True))
         .when(t == "VOID", F.lit(False))
         .otherwise(F.try_variant_get(v, path, "double") != 0), F.lit(False))


def block_text(v: Column, path: str, block_type: str | Column = "text") -> Column:
    """Text of a string value, or newline-joined non-blank text blocks of a list; stripped."""
    x = F.try_variant_get(v, path, "variant")
    t = F.schema_of_variant(x)
    bt = F.lit(block_type) if isinstance(block_type, str) else block_type
    blocks = F.try_variant_get(v, path, "array<variant>")
    texts = F.transform(
        F.filter(blocks, lambda b: (vstr(b, "$.type") == bt) & (F.coalesce(strip(vstr(b, "$.text")), F.lit("")) != "")),
        lambda b: vstr(b, "$.text"))
    return (F.when(t == "STRING", strip(F.try_variant_get(v, path, "string")))
             .when(t.startswith("ARRAY"), strip(F.array_join(texts, "\n")))
             .otherwise(F.lit("")))


def _turn(role: Column, text: Column) -> tuple[Column, Column]:
    ok = F.coalesce(text, F.lit("")) != ""
    return F.when(ok, role), F.when(ok, text)


def claude_code(v: Column, include_sidechain: bool = False) -> tuple[Column, Column]:
    typ = vstr(v, "$.type")
    keep = typ.isin("user", "assistant") & ~vtruthy(v, "$.isMeta")
    if not include_sidechain:
        keep = keep & ~vtruthy(v, "$.isSidechain")
    msg_ok = F.schema_of_variant(F.try_variant_get(v, "$.message", "variant")).startswith("OBJECT")
    role, text = _turn(F.try_variant_get(v, "$.message.role", "string"), block_text(v, "$.message.content"))
    k = keep & F.coalesce(msg_ok, F.lit(False))
    return F.when(k, role), F.when(k, text)


def _dotted(p: str) -> str:
    return "$." + p if not p.startswith("$") else p


def generic(v: Column, role_field: str = "message.role", text_field: str = "message.content",
            text_block_type: str = "text", default_role: str | None = None) -> tuple[Column, Column]:
    r = F.try_variant_get(v, _dotted(role_field), "variant")
    role = F.when(F.schema_of_variant(r).isNull() | (F.schema_of_variant(r) == "VOID"), F.lit(default_role)) \
            .otherwise(F.try_variant_get(v, _dotted(role_field), "string"))
    return _turn(role, block_text(v, _dotted(text_field), text_block_type))


def gemini_antigravity(v: Column) -> tuple[Column, Column]:
    tp, src = vstr(v, "$.type"), vstr(v, "$.source")
    user = (tp == "USER_INPUT") | (src == "USER_EXPLICIT")
    content = F.coalesce(strip(vstr(v, "$.content")), F.lit(""))
    thinking = F.coalesce(strip(vstr(v, "$.thinking")), F.lit(""))
    planner = tp == "PLANNER_RESPONSE"
    role = F.when(F.coalesce(user, F.lit(False)), "user").when(F.coalesce(planner, F.lit(False)), "assistant")
    text = (F.when(F.coalesce(user, F.lit(False)), content)
             .when(F.coalesce(planner, F.lit(False)), F.when(content != "", content).otherwise(thinking)))
    return _turn(role, text)


def codex(v: Column) -> tuple[Column, Column]:
    flat = (F.schema_of_variant(F.try_variant_get(v, "$.text", "variant")) == "STRING") & \
           F.try_variant_get(v, "$.session_id", "variant").isNotNull()
    rmap = F.create_map(*[x for k, r in CODEX_EVENT_ROLES.items() for x in (F.lit(k), F.lit(r))])
    ev_role = F.element_at(rmap, F.coalesce(vstr(v, "$.payload.type"), F.lit("")))
    msg = strip(vstr(v, "$.payload.message"))
    tool = F.lit(False)
    for p in CODEX_TOOL_PREFIXES:
        tool = tool | msg.startswith(p)
    is_ev = (vstr(v, "$.type") == "event_msg") & ev_role.isNotNull() & (F.coalesce(msg, F.lit("")) != "") & ~tool
    role = F.when(F.coalesce(flat, F.lit(False)), "user").when(F.coalesce(is_ev, F.lit(False)), ev_role)
    text = F.when(F.coalesce(flat, F.lit(False)), strip(F.try_variant_get(v, "$.text", "string"))) \
            .when(F.coalesce(is_ev, F.lit(False)), msg)
    return _turn(role, text)


def kimi(v: Column) -> tuple[Column, Column]:
    typ = vstr(v, "$.type")
    agent = ((typ == "context.append_loop_event") & (vstr(v, "$.event.type") == "content.part")
             & (vstr(v, "$.event.part.type") == "text"))
    agent_text = strip(vstr(v, "$.event.part.text"))
    user = ((typ == "context.append_message") & (vstr(v, "$.message.role") == "user")
            & (vstr(v, "$.message.origin.kind") == "user"))
    role = F.when(F.coalesce(agent, F.lit(False)), "assistant").when(F.coalesce(user, F.lit(False)), "user")
    text = F.when(F.coalesce(agent, F.lit(False)), agent_text) \
            .when(F.coalesce(user, F.lit(False)), block_text(v, "$.message.content"))
    return _turn(role, text)


def extract(v: Column, fmt: str = "claude_code", **opts) -> tuple[Column, Column]:
    """Dispatch on the format name; unknown names fall back to ``generic``."""
    if fmt == "claude_code":
        return claude_code(v, bool(opts.get("include_sidechain", False)))
    if fmt in ("gemini_antigravity", "antigravity", "gemini"):
        return gemini_antigravity(v)
    if fmt == "codex":
        return codex(v)
    if fmt == "kimi":
        return kimi(v)
    return generic(v, opts.get("role_field", "message.role"), opts.get("text_field", "message.content"),
                   opts.get("text_block_type", "text"), opts.get("default_role"))


def _first_truthy(*cols: Column) -> Column:
    out = None
    for c in cols:
        c2 = F.when(F.coalesce(c, F.lit("")) != "", c)
        out = c2 if out is None else F.coalesce(out, c2)
    return out


def turns(lines: DataFrame, source_id: str, fmt: str = "claude_code", roles=("user", "assistant"),
          value_col: str = "value", **opts) -> DataFrame:
    """Lines (file_key, display_path, stem, line_no, value) -> turn items.

    Output: source_id, key, name, content, tags, meta, fingerprint, source_path,
    role, session, uuid, timestamp, line_no.
    """
    # a line may repeat a JSON key (the last one counts), whatever the session was made with
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    v = F.try_parse_json(F.col(value_col))
    d = lines.withColumn("_v", v).filter(F.col("_v").isNotNull())
    role, text = extract(F.col("_v"), fmt, **opts)
    d = d.withColumn("role", role).withColumn("text", text)
    d = d.filter(F.col("role").isNotNull() & F.col("role").isin(*roles))
    vv = F.col("_v")
    uuid = _first_truthy(F.try_variant_get(vv, "$.uuid", "string"), F.try_variant_get(vv, "$.turn_id", "string"),
                         F.try_variant_get(vv, "$.payload.id", "string"),
                         F.try_variant_get(vv, "$.payload.turn_id", "string"))
    has_step = F.try_variant_get(vv, "$.step_index", "variant").isNotNull()
    item_key = F.coalesce(uuid, F.when(has_step, F.concat(F.lit("step_"), F.try_variant_get(vv, "$.step_index", "string"))),
                          F.concat(F.lit("L"), F.col("line_no").cast("string")))
    session = F.coalesce(_first_truthy(F.try_variant_get(vv, "$.sessionId", "string"),
                                       F.try_variant_get(vv, "$.session_id", "string"),
                                       F.try_variant_get(vv, "$.payload.id", "string")), F.col("stem"))
    ts = F.coalesce(_first_truthy(F.try_variant_get(vv, "$.timestamp", "string"),
                                  F.try_variant_get(vv, "$.created_at", "string"),
                                  F.try_variant_get(vv, "$.ts", "string"),
                                  F.try_variant_get(vv, "$.payload.timestamp", "string"),
                                  F.try_variant_get(vv, "$.payload.started_at", "string")), F.lit(""))
    meta = F.to_json(F.struct(
        F.struct(F.lit("agent_transcripts").alias("kind"), F.col("display_path").alias("path"),
                 F.col("line_no").alias("line"), F.col("role").alias("role"), session.alias("session"),
                 uuid.alias("uuid")).alias("source_ref"),
        ts.alias("timestamp")))
    return d.select(
        F.lit(source_id).alias("source_id"),
        F.concat(F.col("file_key"), F.lit("#"), item_key).alias("key"),
        F.concat(F.lit(f"observed/{source_id}/"), safe_key(F.col("file_key")), F.lit("/"), safe_key(item_key)).alias("name"),
        F.col("text").alias("content"),
        F.concat(F.lit(f"agent_transcript,{source_id},"), F.col("role")).alias("tags"),
        meta.alias("meta"),
        F.substring(F.sha2(F.col("text"), 256), 1, 16).alias("fingerprint"),
        F.col("display_path").alias("source_path"),
        "role", session.alias("session"), uuid.alias("uuid"), ts.alias("timestamp"), "line_no")


def read_lines(spark: SparkSession, paths: list[str], key_by: str = "path", below: str | None = None) -> DataFrame:
    """JSONL files -> (file_key, display_path, stem, line_no, value), line numbers 1-based.

    Files under the never-index rule are left out (a filter on the path alone,
    which Spark applies to the listing).  Paths are plain, not percent-encoded.
    With ``below`` (a glob of file names) the paths are folders, of which the
    files at any depth are read: Spark then lists them by tasks, while a path
    with globs is expanded on the driver, file by file.

    Split-parallel: no file is read by a single task; only the per-split line
    counts (one row per split) go through a window.
    """
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    reader = spark.read if below is None else spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", below)
    raw = (reader.text(paths).filter(~is_excluded(plain))
                .select(F.col("value"), plain.alias("display_path"),
                        F.col("_metadata.file_block_start").alias("blk"),
                        F.monotonically_increasing_id().alias("mid")))
    # ids are consecutive within a split (one partition reads it sequentially),
    # so line = lines of earlier splits + (id - first id of the split) + 1
    counts = raw.groupBy("display_path", "blk").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("mid0"))
    w = Window.partitionBy("display_path").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    lines = (raw.join(base, ["display_path", "blk"])
                .withColumn("line_no", F.col("base") + F.col("mid") - F.col("mid0") + 1)
                .drop("base", "mid", "mid0", "blk"))
    path = F.regexp_replace(F.col("display_path"), "^file:", "")
    name = F.element_at(F.split(path, "/"), -1)
    file_key = name if key_by == "name" else F.regexp_replace(F.regexp_replace(path, r"^[A-Za-z]:", ""), r"^/+", "")
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return lines.select(file_key.alias("file_key"), path.alias("display_path"), stem.alias("stem"),
                        "line_no", "value")
