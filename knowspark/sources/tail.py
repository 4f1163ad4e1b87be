"""Structured Streaming source that tails growing JSONL files by byte offset.

Spark's file stream only sees *new* files; transcripts grow in place.  This
Python data source keeps, per file, the byte position after the last complete
line.  ``latestOffset`` only stats files and looks backwards from their end
for the last newline (a partial last line is never consumed); ``read`` runs on
executors, one partition per changed file, and derives line numbers by
counting newlines before its start offset.  A file that shrank, or whose first
KiB changed, restarts at 0.

Paths must be visible to driver and executors (a shared mount on a cluster).
"""

from __future__ import annotations

import glob
import hashlib
import json
import os

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.paths import excluded_py

SCHEMA = "file_key string, display_path string, stem string, line_no long, value string"
HEAD_BYTES = 1024
CHUNK = 1 << 20


def _head_hash(path: str, n: int) -> str:
    """Hash of both ends of the ``n`` consumed bytes: a file that was rewritten
    differs there (its first bytes, or what stands just before the offset)."""
    with open(path, "rb") as f:
        seen = hashlib.sha256(f.read(min(n, HEAD_BYTES)))
        f.seek(max(0, n - HEAD_BYTES))
        seen.update(f.read(min(n, HEAD_BYTES)))
        return seen.hexdigest()[:16]


def _last_newline_end(path: str, start: int, size: int) -> int:
    """Position just after the last b'\\n' in [start, size), or ``start``."""
    pos = size
    with open(path, "rb") as f:
        while pos > start:
            lo = max(start, pos - 65536)
            f.seek(lo)
            buf = f.read(pos - lo)
            i = buf.rfind(b"\n")
            if i >= 0:
                return lo + i + 1
            pos = lo
    return start


def _file_key(path: str, key_by: str) -> str:
    p = path.replace("\\", "/")
    if key_by == "name":
        return os.path.basename(p)
    import re
    return re.sub(r"^[A-Za-z]:", "", p).lstrip("/")


class _Range(InputPartition):
    def __init__(self, path, key, start, end):
        self.path, self.key, self.start, self.end = path, key, start, end


class JsonlTailReader(DataSourceStreamReader):
    def __init__(self, options):
        pats = options.get("paths") or options.get("path") or ""
        self.patterns = [p for p in json.loads(pats)] if pats.startswith("[") else [pats]
        self.key_by = options.get("key_by", "path")

    def _files(self):
        seen = []
        for pat in self.patterns:
            for f in sorted(glob.glob(os.path.expanduser(pat), recursive=True)):
                if f not in seen and os.path.isfile(f) and not excluded_py(f) and not f.endswith(".zip"):
                    seen.append(f)
        return seen

    def initialOffset(self):
        return {"files": {}}

    def latestOffset(self):
        files = {}
        prev = getattr(self, "_last", {"files": {}})["files"]
        for f in self._files():
            size = os.path.getsize(f)
            p = prev.get(f)
            start = 0
            if p and size >= p["end"] and _head_hash(f, p["end"]) == p["head"]:
                start = p["end"]
            end = _last_newline_end(f, start, size) if size > start else start
            files[f] = {"end": end, "head": _head_hash(f, end)}
        self._last = {"files": files}
        return self._last

    def partitions(self, start, end):
        s, out = start.get("files", {}), []
        for f, e in end.get("files", {}).items():
            b = s.get(f)
            same = b is not None and b["end"] <= e["end"] and _head_hash(f, b["end"]) == b.get("head")
            begin = b["end"] if same else 0
            if e["end"] > begin:
                out.append(_Range(f, _file_key(f, self.key_by), begin, e["end"]))
        return out

    def read(self, partition):
        line_no = 0
        with open(partition.path, "rb") as fh:
            remaining = partition.start
            while remaining > 0:
                buf = fh.read(min(CHUNK, remaining))
                if not buf:
                    break
                line_no += buf.count(b"\n")
                remaining -= len(buf)
            fh.seek(partition.start)
            data = fh.read(partition.end - partition.start)
        stem = os.path.splitext(os.path.basename(partition.path))[0]
        for raw in data.split(b"\n")[:-1]:
            line_no += 1
            yield (partition.key, partition.path, stem, line_no,
                   raw.rstrip(b"\r").decode("utf-8", "replace"))

    def commit(self, end):
        pass


class JsonlTail(DataSource):
    """``spark.readStream.format("jsonl_tail").option("paths", json.dumps([...]))``"""

    @classmethod
    def name(cls):
        return "jsonl_tail"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return JsonlTailReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(JsonlTail)
