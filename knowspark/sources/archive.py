"""Zip-archived JSONL transcripts, read in place (never unpacked to disk).

``binaryFile`` lists the archives; ``mapInPandas`` opens each archive's bytes
with ``zipfile`` inside the task and emits one row per line of every member
matching the inner glob.  An archive is a finished unit, so work is spread
by archive; bad archives yield nothing.  The rows feed the same format
expressions as plain transcript files.
"""

from __future__ import annotations

import fnmatch
import io
import os
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import excluded_py

LINE_SCHEMA = "file_key string, display_path string, stem string, line_no long, value string"


def _explode_archives(inner: str, key_by: str):
    def run(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                p = path[5:] if path.startswith("file:") else path
                zkey = os.path.basename(p) if key_by == "name" else p.lstrip("/")
                try:
                    zf = zipfile.ZipFile(io.BytesIO(bytes(content)))
                    names = sorted(n for n in zf.namelist() if fnmatch.fnmatch(n, inner) and not excluded_py(n))
                    for n in names:
                        data = zf.read(n).decode("utf-8", "replace")
                        # only \n ends a line: other line separators may stand inside JSON strings
                        lines = data.removesuffix("\n").split("\n") if data else []
                        stem = os.path.splitext(os.path.basename(n))[0]
                        for i, line in enumerate(lines, start=1):
                            out.append((f"{zkey}!{n}", f"{p}!{n}", stem, i, line))
                except (zipfile.BadZipFile, OSError, RuntimeError):
                    continue
            yield pd.DataFrame(out, columns=["file_key", "display_path", "stem", "line_no", "value"])
    return run


def read_archive_lines(spark: SparkSession, root: str, pattern: str = "*.zip", inner: str = "*.jsonl",
                       key_by: str = "path") -> DataFrame:
    """Archives under ``root`` -> transcript lines keyed ``<archive>!<member>``."""
    z = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
         .option("recursiveFileLookup", "true").load(root).select("path", "content"))
    return z.mapInPandas(_explode_archives(inner, key_by), LINE_SCHEMA)


def member_counts(lines: DataFrame) -> DataFrame:
    """Members per archive that contributed lines."""
    return (lines.select(F.split("display_path", "!").getItem(0).alias("archive"), "file_key")
                 .groupBy("archive").agg(F.count_distinct("file_key").alias("members")))
