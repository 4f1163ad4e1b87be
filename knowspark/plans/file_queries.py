"""Registered queries: file ingest, export, blobs, helpers, text statistics.

The pages table plays a home folder: each page becomes a file (relative path
from a fixed template list, bytes = UTF-8 of the html).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.text import first_code_block, tags_with, text_stats
from ..operators import files as FL
from ..session import held, scratch_path
from ..sources import files as FI
from ..sources.file_sink import write_line_files
from . import oracle as O
from . import views as V
from .transcript_queries import STRIP, _render, rendered_sql

# Test-view rule: relative path of a page by page_id % 12.
REL_TEMPLATES = ["site/{id}.html", "notes/{id}.md", "notes/{id}.txt", "docs/{id}.pdf", "img/{id}.png",
                 "data/{id}.json", ".absorber/{id}.txt", ".absorber/{id}.bin", "node_modules/x/{id}.js",
                 "keys/{id}.pem", "drafts/{id}-draft.md", "misc/{id}.CSV"]
DIRECT, WARN = 2000, 4000   # scaled thresholds for the test tables
NOW = "2024-06-01T12:00:00"


def _rel_spark():
    n = len(REL_TEMPLATES)
    out = None
    for i, t in enumerate(REL_TEMPLATES):
        pre, _, post = t.partition("{id}")
        v = F.concat(F.lit(pre), F.col("page_id").cast("string"), F.lit(post))
        out = F.when(F.col("page_id") % n == i, v) if out is None else out.when(F.col("page_id") % n == i, v)
    return out


def _rel_duck():
    n = len(REL_TEMPLATES)
    parts = []
    for i, t in enumerate(REL_TEMPLATES):
        pre, _, post = t.partition("{id}")
        parts.append(f"WHEN {i} THEN {O._q(pre)} || CAST(page_id AS VARCHAR) || {O._q(post)}")
    return f"CASE page_id % {n} " + " ".join(parts) + " END"


def home_files(spark, sf):
    p = V.table(spark, sf, "pages")
    rel = _rel_spark()
    return p.select("page_id", rel.alias("rel"), F.concat(F.lit("/home/u/"), rel).alias("path"),
                    F.octet_length("html").cast("long").alias("length"), F.encode("html", "UTF-8").alias("content"),
                    (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
                     + F.make_dt_interval(F.lit(0), F.lit(0), F.col("page_id").cast("int"), F.lit(0))).alias("modificationTime"))


FILES_SQL = f"""SELECT page_id, {_rel_duck()} AS rel, '/home/u/' || {_rel_duck()} AS path,
  CAST(octet_length(encode(html)) AS BIGINT) AS length, html,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id) AS mtime FROM pages"""

_SFX = "CASE WHEN regexp_matches(b, '^.+(\\.[^.]*)$') AND NOT ends_with(b, '.') THEN regexp_extract(b, '^.+(\\.[^.]*)$', 1) ELSE '' END"


def _with_sfx(src: str, col: str) -> str:
    return (f"SELECT *, {_SFX} AS sfx FROM (SELECT *, coalesce(list_filter(string_split(replace({col}, '\\', '/'), '/'), "
            f"lambda s: s <> '')[-1], '') AS b FROM ({src}))")


def q_absorb_classify(spark, sf):
    a = FL.absorb_plan(home_files(spark, sf), DIRECT, WARN, NOW)
    return a.select("name", "mimetype", "storage", "blob_hash", "tags", F.length("content").cast("long").alias("content_len"))


def q_observe_files(spark, sf):
    o = FL.observe_plan(home_files(spark, sf))
    return o.select("name", "tags", F.md5("content").alias("content_md5"))


def q_sync_route(spark, sf):
    r = FL.sync_route(home_files(spark, sf), "selective")
    return FL.sync_counts(r, "selective")


def q_export_plan(spark, sf):
    e = V.docs_entries(spark, sf)
    m = (F.when(F.col("id") % 7 == 0, F.lit('{"filename":"../../../evil.txt"}'))
          .when(F.col("id") % 7 == 1, F.lit('{"blob_path":"/b/x","original_name":"C:\\\\tmp\\\\bericht.bin"}'))
          .when(F.col("id") % 7 == 2, F.lit('{"format":"txt"}'))
          .when(F.col("id") % 7 == 3, F.lit('{"filename":".."}'))
          .otherwise(F.col("meta")))
    return FL.export_plan(e.withColumn("meta", m))


def _blobs(spark, sf):
    f = home_files(spark, sf)
    return f.select("path", F.col("length").alias("size"), FL.blob_hash("content").alias("blob_hash"))


def q_blob_dedup(spark, sf):
    return FL.blob_dedup(_blobs(spark, sf))


def q_blob_stats(spark, sf):
    return FL.blob_stats(FL.blob_dedup(_blobs(spark, sf)))


def q_src_pattern_filter(spark, sf):
    return FL.pattern_filter(home_files(spark, sf), ["*.md", "*.txt", "*.[Cc][Ss][Vv]"], ["*draft*"]).select("path")


def q_folder_inventory(spark, sf):
    return FL.folder_inventory(home_files(spark, sf), 50)


def q_name_keys(spark, sf):
    p = V.table(spark, sf, "pages")
    d = p.select("page_id", P.path_key(F.regexp_replace("url", "^https?://", "C:/")).alias("path_key"),
                 P.safe_key(F.concat(F.lit("  "), F.col("url"), F.lit(" "))).alias("safe_key"),
                 F.substring(F.replace(F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lit(" "), F.lit("-")),
                             1, 50).alias("slug"))
    return d


def q_tag_compose(spark, sf):
    d = V.table(spark, sf, "documents")
    extra = F.array(F.lit("  x "), F.lit(""), F.col("lang"))
    return d.select("doc_id",
                    tags_with(F.concat(F.lit("markdown_dir,"), "source"), extra).alias("file_tags"),
                    F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("task,"), "lang")).otherwise(F.lit("task")).alias("task_tags"),
                    F.concat(F.lit("lesson,"), F.when(F.col("n_chars") > 2000, "high").otherwise("low"),
                             F.lit(","), "source").alias("lesson_tags"))


def q_fingerprints(spark, sf):
    f = home_files(spark, sf)
    row_fp = F.substring(F.sha2(F.concat_ws("|", F.col("page_id").cast("string"), F.col("page_id").cast("string"),
                                            F.coalesce("rel", F.lit("None"))), 256), 1, 16)
    file_fp = FI.file_fingerprint(F.unix_micros(F.col("modificationTime").cast("timestamp")) * 1000, "length")
    return f.select("page_id", FL.blob_hash("content").alias("content_hash"), row_fp.alias("row_fp"),
                    file_fp.alias("file_fp"))


def q_extract_code(spark, sf):
    d = V.table(spark, sf, "documents")
    first = F.element_at(F.split("text", "\n"), 1)
    content = F.when(F.col("doc_id") % 5 == 0,
                     F.concat(F.lit("intro\n```python  \n"), first, F.lit("\n```\nrest\n```python\nsecond\n```")))\
               .otherwise(F.col("text"))
    return d.select("doc_id", first_code_block(content).alias("code"))


def q_file_facts(spark, sf):
    return FL.file_facts(home_files(spark, sf))


def q_text_stats(spark, sf):
    d = V.table(spark, sf, "documents")
    s = text_stats("text")
    return d.select("doc_id", s["lines"].alias("lines"), s["words"].alias("words"), s["chars"].alias("chars"),
                    F.md5(s["first_lines"]).alias("first_lines_md5"), F.md5(s["preview"]).alias("preview_md5"),
                    s["too_big"].alias("too_big"))


def q_encoding_detect(spark, sf):
    d = V.table(spark, sf, "documents")
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1"))
    r = d.select("doc_id", FL.detect_encoding(raw).alias("r"))
    return r.select("doc_id", F.col("r.encoding").alias("encoding"), F.md5("r.text").alias("text_md5"))


def q_src_text_files(spark, sf):
    """Documents written as one file each, scanned back over two roots that overlap."""
    out = scratch_path(spark, "notes")
    d = V.table(spark, sf, "documents")
    write_line_files(d.select("lang", "doc_id", "text"), ["lang", "doc_id"], out)
    folder = out.replace("file:", "", 1)
    items = FI.text_items(spark, "notes", {"path": [folder, f"{folder}/lang=*"], "patterns": ["**/*.txt", "**/part-*"],
                                           "exclude_patterns": ["*.crc"], "extra_tags": [" notes ", ""]}, ["*.md"], "markdown_dir")
    number = F.regexp_extract("name", r"doc_id=(\d+)/", 1).cast("long")
    parts = F.split("fingerprint", ":")
    return items.select(number.alias("doc_id"), F.md5("content").alias("content_md5"), "tags", parts[1].cast("long").alias("size"))


def q_src_incremental(spark, sf):
    """Second scan of transcript files: unchanged, grown, shrunk and new ones against a stored state."""
    out = scratch_path(spark, "sessions")
    lines = _render(spark, sf, "codex").withColumn("conv", F.regexp_extract("stem", r"(\d+)", 1).cast("long"))
    write_line_files(lines.select("conv", "line_no", "value"), ["conv"], out, "line_no")
    conv = lambda c: F.regexp_extract(c, r"conv=(\d+)/", 1).cast("long")
    files = held(FI.listing(spark, out.replace("file:", "", 1), ["**/*.txt"]), "listing")
    of = files.withColumn("conv", conv("path"))
    w = Window.partitionBy("conv").orderBy("line_no")
    read = lines.withColumn("i", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv")))
    half = read.groupBy("conv").agg(F.sum(F.when(F.col("i") <= F.floor(F.col("n") / 2), F.octet_length("value") + 1).otherwise(0)).alias("bytes"),
                                    F.floor(F.max("n") / 2).cast("long").alias("lines"), F.max("n").alias("n"))
    m = F.col("conv") % 4
    state = held(of.join(half, "conv").filter(m != 3).select(
        FI.file_key("path").alias("file_key"),
        F.when(m == 0, F.col("length")).when(m == 1, F.col("bytes")).otherwise(F.col("length") + 10).cast("long").alias("offset"),
        F.col("mtime_ns").alias("mtime"), F.when(m == 0, F.col("n")).otherwise(F.col("lines")).cast("long").alias("line_no")), "state")
    items, new = FI.scan_transcripts(files, state, "codex-sessions", "codex", range_bytes=4096)
    rows = items.select(conv("source_path").alias("conv_id"), "line_no", "role", F.md5("content").alias("value"))
    return rows.unionByName(new.select(conv("file_key").alias("conv_id"), "line_no", F.lit("state").alias("role"), F.col("offset").cast("string").alias("value")))


def queries():
    return {"absorb_classify": q_absorb_classify, "observe_files": q_observe_files, "sync_route": q_sync_route,
            "export_plan": q_export_plan, "blob_dedup": q_blob_dedup, "blob_stats": q_blob_stats,
            "src_pattern_filter": q_src_pattern_filter, "folder_inventory": q_folder_inventory,
            "name_keys": q_name_keys, "tag_compose": q_tag_compose, "fingerprints": q_fingerprints,
            "extract_code": q_extract_code, "text_stats": q_text_stats, "encoding_detect": q_encoding_detect,
            "src_text_files": q_src_text_files, "src_incremental": q_src_incremental,
            "file_facts": q_file_facts}


def oracle():
    from ..functions.paths import ABSORB_TEXT_SUFFIXES, EXCLUDED_FILENAMES, EXCLUDED_PATH_SEGMENTS, \
        EXCLUDED_SUFFIXES, MIMETYPES, OBSERVE_TEXT_SUFFIXES
    files = _with_sfx(FILES_SQL, "rel")
    lsfx = "lower(sfx)"
    mime = "CASE " + " ".join(f"WHEN {lsfx} = {O._q(k)} THEN {O._q(v)}" for k, v in MIMETYPES.items()) + \
           " ELSE 'application/octet-stream' END"
    is_text = f"{lsfx} IN (" + ", ".join(O._q(s) for s in ABSORB_TEXT_SUFFIXES) + ")"
    storage = f"CASE WHEN length > {WARN} THEN 'halde' WHEN length > {DIRECT} THEN 'blob' ELSE 'inline' END"
    absorb = f"""SELECT b AS name, CASE WHEN {is_text} THEN 'text/plain' ELSE {mime} END AS mimetype,
  {storage} AS storage,
  CASE WHEN {storage} <> 'inline' OR NOT ({is_text}) OR html = '' THEN substr(sha256(html), 1, 16) END AS blob_hash,
  'datei,' || regexp_replace(sfx, '^\\.', '') AS tags,
  CAST(CASE WHEN {is_text} THEN length(html) ELSE 0 END AS BIGINT) AS content_len FROM ({files})"""
    segs = "list_transform(list_filter(string_split(replace(rel, '\\', '/'), '/'), lambda s: s <> ''), lambda s: lower(s))"
    excluded = (f"(len(list_intersect({segs}, [" + ", ".join(O._q(s) for s in EXCLUDED_PATH_SEGMENTS) + "])) > 0 "
                f"OR lower(b) IN (" + ", ".join(O._q(s) for s in EXCLUDED_FILENAMES) + ") OR "
                + " OR ".join(f"ends_with(lower(b), {O._q(s)})" for s in EXCLUDED_SUFFIXES) + ")")
    internal = f"({excluded} OR rel = 'config.json')"
    obs_text = f"{lsfx} IN (" + ", ".join(O._q(s) for s in OBSERVE_TEXT_SUFFIXES) + ")"
    observe = f"""SELECT 'observed/' || rel AS name, 'datei,' || regexp_replace(sfx, '^\\.', '') AS tags,
  md5(CASE WHEN {obs_text} THEN html ELSE '[Binärdatei: ' || b || ', ' || CAST(length AS VARCHAR) || ' Bytes]' END) AS content_md5
FROM ({files}) WHERE NOT {internal}"""
    route = f"""SELECT count_if(action = 'absorb') AS absorbed, count_if(action = 'observe') AS observed, 'selective' AS mode
FROM (SELECT CASE WHEN string_split(rel, '/')[1] = '.absorber' THEN 'absorb' WHEN {internal} THEN 'skip'
      ELSE 'observe' END AS action FROM ({files}))"""
    export = """SELECT name, filename, source FROM (
  SELECT 'observed/' || source || '/' || CAST(doc_id AS VARCHAR) AS name, doc_id,
    CASE doc_id % 7 WHEN 0 THEN 'evil.txt' WHEN 1 THEN 'bericht.bin' WHEN 2 THEN CAST(doc_id AS VARCHAR) || '.txt'
         WHEN 3 THEN 'export.md' ELSE CAST(doc_id AS VARCHAR) || '.md' END AS filename,
    CASE doc_id % 7 WHEN 1 THEN 'blob' ELSE 'text' END AS source FROM documents)"""
    blobs = f"SELECT substr(sha256(html), 1, 16) AS blob_hash, min(path) AS path, any_value(length) AS size FROM ({FILES_SQL}) GROUP BY 1"
    pattern = (f"SELECT path FROM ({_with_sfx(FILES_SQL, 'path')}) WHERE (regexp_matches(b, '^.*\\.md$') OR "
               f"regexp_matches(b, '^.*\\.txt$') OR regexp_matches(b, '^.*\\.[Cc][Ss][Vv]$')) AND NOT regexp_matches(b, '^.*draft.*$')")
    inventory = f"""SELECT rel, length AS size, n_files, total_mb FROM (SELECT rel, length FROM ({FILES_SQL}) ORDER BY rel LIMIT 50)
  JOIN (SELECT count(*) AS n_files, round(sum(length) / 1000000, 2) AS total_mb FROM ({FILES_SQL})) ON true"""
    title = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
    names = f"""SELECT page_id,
  regexp_replace(regexp_replace(replace(regexp_replace(url, '^https?://', 'C:/'), '\\', '/'), '^[A-Za-z]:', ''), '^/+', '') AS path_key,
  CASE WHEN trim(replace(replace(url, '/', '_'), '\\', '_')) = '' THEN 'unnamed' ELSE trim(replace(replace(url, '/', '_'), '\\', '_')) END AS safe_key,
  substr(replace(lower({title}), ' ', '-'), 1, 50) AS slug FROM pages"""
    tags = """SELECT doc_id, 'markdown_dir,' || source || ',x' || CASE WHEN trim(lang) <> '' THEN ',' || trim(lang) ELSE '' END AS file_tags,
  CASE WHEN doc_id % 2 = 0 THEN 'task,' || lang ELSE 'task' END AS task_tags,
  'lesson,' || CASE WHEN n_chars > 2000 THEN 'high' ELSE 'low' END || ',' || source AS lesson_tags FROM documents"""
    fps = f"""SELECT page_id, substr(sha256(html), 1, 16) AS content_hash,
  substr(sha256(CAST(page_id AS VARCHAR) || '|' || CAST(page_id AS VARCHAR) || '|' || rel), 1, 16) AS row_fp,
  CAST(epoch_us(mtime) * 1000 AS VARCHAR) || ':' || CAST(length AS VARCHAR) AS file_fp FROM ({FILES_SQL})"""
    code = """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN regexp_replace(string_split(text, chr(10))[1], '^\\s+|\\s+$', '', 'g') END AS code FROM documents"""
    stats = """SELECT doc_id, CAST(len(string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10))) AS BIGINT) AS lines,
  CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS BIGINT) AS words,
  CAST(length(text) AS BIGINT) AS chars,
  md5(array_to_string(string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10))[1:5], chr(10))) AS first_lines_md5,
  md5(CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END) AS preview_md5,
  length(text) > 50000 AS too_big FROM documents"""
    enc = """SELECT doc_id, CASE WHEN doc_id % 2 = 0 OR NOT regexp_matches(text, '[^\\x00-\\x7F]') THEN 'utf-8' ELSE 'cp1252' END AS encoding,
  md5(text) AS text_md5 FROM documents"""
    return {"absorb_classify": absorb, "observe_files": observe, "sync_route": route, "export_plan": export,
            "blob_dedup": blobs, "blob_stats": f"SELECT count(*) AS count, round(sum(size) / 1000000, 1) AS size_mb FROM ({blobs})",
            "src_pattern_filter": pattern, "folder_inventory": inventory, "name_keys": names, "tag_compose": tags,
            "fingerprints": fps, "extract_code": code, "text_stats": stats, "encoding_detect": enc,
            "file_facts": f"""SELECT path, b AS name, length AS size, printf('%.1f KB', length / 1024.0) AS size_human, sfx AS extension
FROM ({_with_sfx(FILES_SQL, 'path')})""",
            "src_text_files": """SELECT doc_id, md5(text || chr(10)) AS content_md5, 'markdown_dir,notes,notes' AS tags,
  CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size FROM documents""",
            "src_incremental": f"""
WITH l AS (SELECT conv_id, turn, role, {STRIP} AS text, octet_length(encode({rendered_sql()})) + 1 AS bytes,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, CAST(i AS BIGINT) AS line_no, role, md5(text) AS value FROM l
WHERE role IN ('user', 'assistant') AND NOT (role = 'assistant' AND turn % 4 = 3) AND text <> ''
  AND conv_id % 4 <> 0 AND (conv_id % 4 <> 1 OR i > n // 2)
UNION ALL SELECT conv_id, CAST(max(n) AS BIGINT), 'state', CAST(CAST(sum(bytes) AS BIGINT) AS VARCHAR) FROM l GROUP BY conv_id"""}
