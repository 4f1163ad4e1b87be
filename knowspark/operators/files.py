"""File ingest: drop-folder absorb, home-folder observe, sync routing, export,
content-addressed blobs, encoding repair, folder inventory.

Input is a file listing with content, e.g. ``spark.read.format("binaryFile")``
(path, modificationTime, length, content) plus a ``rel`` column (path relative
to the home folder).  All decisions are column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

# Size thresholds of the drop-folder ingest (bytes, strictly greater than).
BLOB_THRESHOLD_DIRECT = 1_000_000
BLOB_THRESHOLD_WARN = 50_000_000

# Fixed value: placeholder content for files the walk does not read as text.
BINARY_PLACEHOLDER = "[Binärdatei: %s, %d Bytes]"


def decode_utf8(content: Column | str) -> Column:
    """Bytes -> text, invalid sequences replaced (never fails)."""
    c = F.col(content) if isinstance(content, str) else content
    return F.make_valid_utf8(c.cast("string"))


def blob_hash(content: Column | str) -> Column:
    """Short content address: first 16 hex digits of sha256."""
    c = F.col(content) if isinstance(content, str) else content
    return F.substring(F.sha2(c, 256), 1, 16)


def absorb_plan(files: DataFrame, direct: int = BLOB_THRESHOLD_DIRECT, warn: int = BLOB_THRESHOLD_WARN,
                now: str = "1970-01-01T00:00:00") -> DataFrame:
    """Classify dropped files: text extraction, mimetype, storage, blob hash.

    files: (path, length, content).  Text suffixes are read at any size;
    storage is 'halde' above ``warn``, 'blob' above ``direct``, else 'inline'
    (inline binaries also get a blob copy).
    """
    sfx = F.lower(P.suffix("path"))
    is_text = sfx.isin(*P.ABSORB_TEXT_SUFFIXES)
    text = F.when(is_text, decode_utf8("content")).otherwise(F.lit(""))
    storage = (F.when(F.col("length") > warn, "halde").when(F.col("length") > direct, "blob").otherwise("inline"))
    needs_blob = (storage != "inline") | (text == "")
    return files.select(
        P.basename("path").alias("name"),
        F.lit("document").alias("type"),
        text.alias("content"),
        F.concat(F.lit("datei,"), F.regexp_replace(P.suffix("path"), r"^\.", "")).alias("tags"),
        F.when(is_text, F.lit("text/plain")).otherwise(P.mimetype(sfx)).alias("mimetype"),
        storage.alias("storage"),
        F.when(needs_blob, blob_hash("content")).alias("blob_hash"),
        F.col("length").alias("size"), F.col("path").alias("original_path"),
        F.lit(True).alias("pinned"), F.lit(now).alias("absorbed_at"))


def observe_plan(files: DataFrame) -> DataFrame:
    """Home-folder walk: observed/<rel>, text for 9 suffixes, placeholder otherwise.

    files: (rel, path, length, content, modificationTime); internal paths skipped.
    """
    f = files.filter(~P.is_internal("rel"))
    sfx = F.lower(P.suffix("rel"))
    content = F.when(sfx.isin(*P.OBSERVE_TEXT_SUFFIXES), decode_utf8("content")).otherwise(
        F.format_string(BINARY_PLACEHOLDER, P.basename("rel"), F.col("length")))
    meta = F.to_json(F.struct(F.col("path").alias("path"), F.col("length").alias("size"),
                              F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("modified"),
                              F.lit(True).alias("observed")))
    return f.select(F.concat(F.lit("observed/"), F.translate("rel", "\\", "/")).alias("name"),
                    F.lit("observed").alias("type"), content.alias("content"),
                    F.concat(F.lit("datei,"), F.regexp_replace(P.suffix("rel"), r"^\.", "")).alias("tags"),
                    meta.alias("meta"))


def sync_route(files: DataFrame, mode: str = "selective", drop_dir: str = ".absorber") -> DataFrame:
    """Route every home file: 'absorb' (drop folder, or everything when mode is
    always_absorb), 'observe', or 'skip' (internal).  The drop folder is
    drained in every mode."""
    in_drop = F.element_at(F.split(F.translate("rel", "\\", "/"), "/"), 1) == drop_dir
    internal = P.is_internal("rel")
    action = (F.when(in_drop, "absorb").when(internal, "skip")
               .when(F.lit(mode == "always_absorb"), "absorb").otherwise("observe"))
    return files.withColumn("action", action)


def sync_counts(routed: DataFrame, mode: str) -> DataFrame:
    return routed.agg(F.count_if(F.col("action") == "absorb").alias("absorbed"),
                      F.count_if(F.col("action") == "observe").alias("observed")) \
                 .withColumn("mode", F.lit(mode))


def error_entries(failed: DataFrame, error_col: str = "error") -> DataFrame:
    """Dead-letter rows for files whose ingest failed: sync-error/<file>."""
    return failed.select(F.concat(F.lit("sync-error/"), P.basename("rel")).alias("name"),
                         F.lit("memory").alias("type"),
                         F.concat(F.lit("Absorb fehlgeschlagen: "), F.col(error_col)).alias("content"),
                         F.lit("error,sync").alias("tags"))


def export_plan(entries: DataFrame) -> DataFrame:
    """(name, filename, source): blob copy under its original name, else text as
    <name>.<meta.format or md>; every file name reduced to a safe basename."""
    m = F.coalesce(F.col("meta"), F.lit("{}"))
    blob = F.get_json_object(m, "$.blob_path")
    fmt = F.coalesce(F.get_json_object(m, "$.format"), F.lit("md"))
    orig = F.coalesce(F.get_json_object(m, "$.original_name"), F.col("name"))
    fname = F.coalesce(F.get_json_object(m, "$.filename"), F.concat(F.col("name"), F.lit("."), fmt))
    return entries.select(
        "name",
        F.when(blob.isNotNull(), P.safe_filename(orig, "blob.bin"))
         .otherwise(P.safe_filename(fname, F.concat(F.lit("export."), fmt))).alias("filename"),
        F.when(blob.isNotNull(), F.lit("blob")).otherwise(F.lit("text")).alias("source"))


def blob_dedup(blobs: DataFrame) -> DataFrame:
    """One copy per content hash (smallest path wins)."""
    return (blobs.groupBy("blob_hash").agg(F.min("path").alias("path"), F.first("size").alias("size")))


def blob_stats(blobs: DataFrame) -> DataFrame:
    return blobs.agg(F.count(F.lit(1)).alias("count"),
                     F.round(F.sum("size") / 1_000_000, 1).alias("size_mb"))


def folder_inventory(files: DataFrame, first: int = 50) -> DataFrame:
    """First ``first`` files by relative path, with the folder's count and MB."""
    agg = files.agg(F.count(F.lit(1)).alias("n_files"),
                    F.round(F.sum("length") / 1_000_000, 2).alias("total_mb")).withColumn("_k", F.lit(1))
    top = files.orderBy("rel").limit(first).select("rel", F.col("length").alias("size")).withColumn("_k", F.lit(1))
    return top.join(F.broadcast(agg), "_k").drop("_k")


def file_facts(files: DataFrame) -> DataFrame:
    return files.select("path", P.basename("path").alias("name"), F.col("length").alias("size"),
                        F.format_string("%.1f KB", F.bround(F.col("length") / 1024, 1)).alias("size_human"),
                        P.suffix("path").alias("extension"))


def pattern_filter(files: DataFrame, patterns: list[str], excludes: list[str] = (), col: str = "path") -> DataFrame:
    """Files whose basename matches any include glob and no exclude glob."""
    from ..functions.text import glob_to_regex
    name = P.basename(col)
    inc = F.lit(False)
    for p in patterns:
        inc = inc | name.rlike(glob_to_regex(p))
    exc = F.lit(False)
    for p in excludes:
        exc = exc | name.rlike(glob_to_regex(p))
    return files.filter(inc & ~exc)


# Bytes 0x80..0x9F: the characters that cp1252 gives them, by the codec itself, and its undefined bytes.
_C1 = [bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0)]
_DEFINED = [(chr(b), c) for b, c in zip(range(0x80, 0xA0), _C1) if c != "\ufffd"]
_UNDEFINED = "".join(f"\\x{b:02X}" for b, c in zip(range(0x80, 0xA0), _C1) if c == "\ufffd")


def detect_encoding(content) -> Column:
    """STRUCT<encoding, text>: the first of utf-8, cp1252, latin-1 that decodes the bytes; null for null."""
    c = F.col(content) if isinstance(content, str) else content
    latin = F.decode(c, "ISO-8859-1")
    windows = F.translate(latin, "".join(a for a, _ in _DEFINED), "".join(b for _, b in _DEFINED))
    pick = lambda utf8, cp1252, latin1: F.when(F.is_valid_utf8(c.cast("string")), utf8).when(
        ~latin.rlike(f"[{_UNDEFINED}]"), cp1252).otherwise(latin1)
    known = F.struct(pick(F.lit("utf-8"), F.lit("cp1252"), F.lit("latin-1")).alias("encoding"),
                     pick(c.cast("string"), windows, latin).alias("text"))
    return F.when(c.isNotNull(), known).otherwise(F.struct(F.lit(None).cast("string").alias("encoding"), F.lit(None).cast("string").alias("text")))


def repaired(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with ``content`` rewritten as UTF-8 bytes and the ``encoding`` it had."""
    d = files.withColumn("_e", detect_encoding(content))
    return d.withColumn(content, F.encode("_e.text", "UTF-8")).withColumn("encoding", F.col("_e.encoding")).drop("_e")
