"""Path predicates and path-derived columns (never-index rules, names, mimetypes)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PIECE = re.compile(r"\\.|\[[^\]]*\]\*?|.", re.S)
# The home folder's own segment, never indexed; a caller with another home folder passes its name.
HOME_SEGMENT = ".knowspark"
# Path segments that are never indexed (case-insensitive).
EXCLUDED_PATH_SEGMENTS = ("credentials", ".ssh", ".gnupg", ".absorber", ".output",
                          "node_modules", ".git", "__pycache__", ".venv", "venv")
# File names that are never indexed (case-insensitive).
EXCLUDED_FILENAMES = (".npmrc", ".netrc", ".pgpass", ".env", ".htpasswd", "auth.json",
                      "credentials.json", "secrets.json", "token.json", "id_rsa", "id_dsa",
                      "id_ecdsa", "id_ed25519")
# File suffixes that carry key material (case-insensitive).
EXCLUDED_SUFFIXES = (".pem", ".key", ".p12", ".pfx", ".keystore", ".jks", ".ppk", ".asc")
# Internal top-level files of the home folder.
INTERNAL_FILES = ("config.json",)

# Suffixes whose content is read as text by the home-folder walk
# and by the drop-folder ingest.
OBSERVE_TEXT_SUFFIXES = (".txt", ".md", ".py", ".json", ".csv", ".yaml", ".yml", ".xml", ".html")
ABSORB_TEXT_SUFFIXES = (".txt", ".md", ".py", ".json", ".csv", ".yaml", ".yml", ".xml", ".html",
                        ".css", ".js", ".ts", ".sh", ".bat", ".sql", ".log")

# Mimetypes by suffix (anything else is application/octet-stream).
MIMETYPES = {
    ".pdf": "application/pdf",
    ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xls": "application/vnd.ms-excel",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".gif": "image/gif",
    ".mp4": "video/mp4",
    ".mp3": "audio/mpeg",
    ".zip": "application/zip",
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def segments(path) -> Column:
    """Non-empty '/'-segments of a path, '\\' counted as '/'."""
    return F.filter(F.split(F.translate(_c(path), "\\", "/"), "/"), lambda s: s != "")


def basename(path) -> Column:
    """Last segment ('' for an empty path)."""
    return F.coalesce(F.element_at(segments(path), -1), F.lit(""))


def suffix(path) -> Column:
    """'.ext' of the basename ('' when none; a leading dot alone is no suffix)."""
    b = basename(path)
    ext = F.regexp_extract(b, r"^.+(\.[^.]*)$", 1)
    return F.when(b.endswith("."), F.lit("")).otherwise(ext)


def is_excluded(path, home: str = HOME_SEGMENT) -> Column:
    """Never-index rule: a segment (or the home folder's), the filename or the suffix is on the block lists."""
    segs = F.transform(segments(path), lambda s: F.lower(s))
    name = F.lower(basename(path))
    seg_hit = F.arrays_overlap(segs, F.array(*[F.lit(s) for s in (*EXCLUDED_PATH_SEGMENTS, home.lower())]))
    seg_hit = F.coalesce(seg_hit, F.lit(False))
    name_hit = name.isin(*EXCLUDED_FILENAMES)
    suf_hit = F.lit(False)
    for s in EXCLUDED_SUFFIXES:
        suf_hit = suf_hit | name.endswith(s)
    return seg_hit | name_hit | suf_hit


def excluded_py(path: str, home: str = HOME_SEGMENT) -> bool:
    """:func:`is_excluded` for a path at hand (listings of folders)."""
    parts = [p.lower() for p in path.replace("\\", "/").split("/") if p]
    name = parts[-1] if parts else ""
    return not {*EXCLUDED_PATH_SEGMENTS, home.lower()}.isdisjoint(parts) or name in EXCLUDED_FILENAMES or name.endswith(EXCLUDED_SUFFIXES)


def path_glob_to_regex(pattern: str) -> str:
    """A glob over a relative path as an anchored regex: ``*`` and ``?`` stay inside a segment, ``**/`` spans any number of them."""
    from .text import glob_to_regex
    out = ""
    for k, part in enumerate(pattern.split("/")):
        last = k == pattern.count("/")
        if part == "**":
            out += ".*" if last else "(?:[^/]+/)*"
        else:
            body = glob_to_regex(part)[len("(?s)^"):-1].replace(".*", "[^/]*")
            out += "".join("[^/]" if x == "." else x for x in _tokens_of(body)) + ("" if last else "/")
    return f"(?s)^{out}$"


def _tokens_of(regex: str) -> list[str]:
    """Pieces of a regex: escapes, sets and single characters."""
    return _PIECE.findall(regex)


def is_internal(rel_path, home: str = HOME_SEGMENT) -> Column:
    """Home-folder skip rule: never-index rule or a top-level internal file."""
    segs = F.split(F.translate(_c(rel_path), "\\", "/"), "/")
    top = (F.size(segs) == 1) & F.element_at(segs, 1).isin(*INTERNAL_FILES)
    return is_excluded(rel_path, home) | top


def mimetype(sfx) -> Column:
    m = F.create_map(*[x for k, v in MIMETYPES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, F.lower(_c(sfx))), F.lit("application/octet-stream"))


def path_key(path) -> Column:
    """Posix form without drive letter and leading slashes (entry-name identity)."""
    p = F.translate(_c(path), "\\", "/")
    return F.regexp_replace(F.regexp_replace(p, r"^[A-Za-z]:", ""), r"^/+", "")


def safe_key(value) -> Column:
    """One name segment: '/' and '\\' become '_', trimmed, empty -> 'unnamed'."""
    v = F.regexp_replace(F.translate(_c(value).cast("string"), "/\\", "__"), r"^\s+|\s+$", "")
    return F.when(F.coalesce(v, F.lit("")) == "", F.lit("unnamed")).otherwise(v)


def safe_filename(raw, fallback: str | Column) -> Column:
    """Basename after '/', '\\' and ':'; '', '.', '..' -> fallback."""
    fb = F.lit(fallback) if isinstance(fallback, str) else fallback
    s = F.translate(_c(raw).cast("string"), "\\", "/")
    s = F.regexp_extract(s, r"([^/]*)$", 1)
    s = F.regexp_replace(F.regexp_extract(s, r"([^:]*)$", 1), r"^\s+|\s+$", "")
    return F.when(s.isin("", ".", ".."), fb).otherwise(s)
