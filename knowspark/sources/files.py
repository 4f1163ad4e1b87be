"""File trees as sources: listing first, bytes only of the files that are wanted.

``file_tree`` is a Python data source that lists folders: the driver expands
the given roots and the first levels below them, tasks walk what lies deeper.
It yields names and sizes only, dotfiles included (Spark's own file sources
never show them).  Patterns, the never-index rule, duplicates of overlapping
roots and the state of an earlier scan are DataFrame operations on the listing;
:func:`with_bytes` and :func:`lines_from` then open what is left.

Roots are folders that driver and executors see under the same path (a shared
mount on a cluster).  A root with a scheme (``s3a://...``) is listed and read by
Spark's ``binaryFile`` source instead, which shows no dotfiles.
"""

from __future__ import annotations

import glob
import json
import os
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import paths as P
from ..operators.files import decode_utf8
from ..session import held, scratch_path

LISTING = "root string, path string, rel string, length long, mtime_ns long"
_LISTING_ARROW = pa.schema([("root", pa.string()), ("path", pa.string()), ("rel", pa.string()), ("length", pa.int64()), ("mtime_ns", pa.int64())])
#: folders that the driver looks for before it hands the rest to tasks, and tasks of a listing
FRONTIER, TASKS = 64, 256
BATCH_BYTES = 16 << 20


class _Folders(InputPartition):
    def __init__(self, folders: list[tuple[str, str, bool]]):
        self.folders = folders  # (root, folder, whether to go below it)


def _entries(folder: str) -> list[os.DirEntry]:
    try:
        with os.scandir(folder) as it:
            return sorted(it, key=lambda e: e.name)
    except OSError:
        return []


class FileTreeReader(DataSourceReader):
    def __init__(self, options):
        self.roots = json.loads(options["roots"])
        self.rules = options.get("rules", "true") == "true"

    def _left_out(self, path: str) -> bool:
        return self.rules and P.excluded_py(path)

    def partitions(self):
        roots: list[str] = []
        for pattern in self.roots:
            for d in sorted(glob.glob(os.path.expanduser(pattern), recursive=True, include_hidden=True)):
                if os.path.isdir(d) and not self._left_out(d):
                    roots.append(os.path.realpath(d))
        level = [(r, r) for r in dict.fromkeys(roots)]
        flat: list[tuple[str, str, bool]] = []
        while level and len(level) < FRONTIER:
            flat += [(r, d, False) for r, d in level]
            level = [(r, e.path) for r, d in level for e in _entries(d) if e.is_dir() and not self._left_out(e.name)]
        work = flat + [(r, d, True) for r, d in level]
        n = max(1, min(TASKS, len(work)))
        return [_Folders(work[i::n]) for i in range(n)]

    def read(self, partition):
        rows: list[tuple] = []
        todo = list(partition.folders)
        while todo:
            root, folder, below = todo.pop()
            for e in _entries(folder):
                try:
                    if e.is_dir():
                        if below and not e.is_symlink() and not self._left_out(e.name):
                            todo.append((root, e.path, True))
                    elif e.is_file():
                        s = e.stat()
                        rows.append((root, e.path, os.path.relpath(e.path, root).replace(os.sep, "/"), s.st_size, s.st_mtime_ns))
                except OSError:
                    continue
            if len(rows) >= 10_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _LISTING_ARROW)], schema=_LISTING_ARROW)


class FileTree(DataSource):
    """``spark.read.format("file_tree").option("roots", json.dumps([...]))``"""

    @classmethod
    def name(cls):
        return "file_tree"

    def schema(self):
        return LISTING

    def reader(self, schema):
        return FileTreeReader(self.options)


def _plain(c: Column) -> Column:
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def listing(spark: SparkSession, roots, patterns=("**/*",), excludes=(), rules: bool = True) -> DataFrame:
    """(path, rel, length, mtime_ns) of the files below the roots (folders or globs of folders).

    ``patterns`` are matched against the path below the root (``*`` stays inside
    a segment, ``**/`` goes below), ``excludes`` against the file name.  Files on
    the never-index lists are left out, unless ``rules`` is off; a file that
    several roots or patterns reach is listed once.
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    stored = [r for r in roots if "://" in r]
    mounted = [r for r in roots if "://" not in r]
    parts = []
    if mounted:
        spark.dataSource.register(FileTree)
        parts.append(spark.read.format("file_tree").option("roots", json.dumps(mounted)).option("rules", str(rules).lower()).load())
    for r in stored:
        f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(r).select(
            F.lit(r).alias("root"), _plain(F.col("path")).alias("path"), F.col("length"),
            (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))
        parts.append(f.select("root", "path", F.expr("substring(path, instr(path, '://') + 3)").alias("rel"), "length", "mtime_ns"))
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], LISTING)
    wanted = reduce(lambda a, b: a | b, [F.col("rel").rlike(P.path_glob_to_regex(p)) for p in patterns], F.lit(False))
    left_out = reduce(lambda a, b: a | b, [P.basename("path").rlike(_name_regex(p)) for p in excludes], F.lit(False))
    allowed = ~P.is_excluded("path") if rules else F.lit(True)
    return found.filter(wanted & ~left_out & allowed).select("path", "rel", "length", "mtime_ns").dropDuplicates(["path"])


def _name_regex(pattern: str) -> str:
    from ..functions.text import glob_to_regex
    return glob_to_regex(pattern)


def with_bytes(files: DataFrame) -> DataFrame:
    """``files`` with ``content`` (bytes) and ``error`` (why a file could not be read, else null)."""
    out = pa.schema([*[pa.field(f.name, _arrow(f.dataType.simpleString())) for f in files.schema], ("content", pa.binary()), ("error", pa.string())])
    at = files.columns.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size, first = [], 0, 0
            for k, path in enumerate(batch.column(at).to_pylist()):
                try:
                    with open(path, "rb") as f:
                        rows.append((f.read(), None))
                except OSError as e:
                    rows.append((None, str(e)))
                size += len(rows[-1][0] or b"")
                if size >= BATCH_BYTES or k + 1 == len(batch):
                    part = batch.slice(first, len(rows))
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(part.columns, out)] + [
                        pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], schema=out)
                    rows, size, first = [], 0, k + 1

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{kinds}, content binary, error string")


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[kind]


def extra_tags(extra) -> str:
    """What a source's own tags add after its fixed ones (a string or a list; blanks go)."""
    listed = [extra] if isinstance(extra, str) else extra or []
    return "".join("," + t for x in listed if (t := str(x).strip()))


def file_fingerprint(mtime_ns: Column | str = "mtime_ns", length: Column | str = "length") -> Column:
    m, n = (F.col(x) if isinstance(x, str) else x for x in (mtime_ns, length))
    return F.concat_ws(":", m.cast("string"), n.cast("string"))


def text_items(spark: SparkSession, source_id: str, config: dict, patterns: list[str], kind: str, seen: DataFrame | None = None) -> DataFrame:
    """One item a text file (ITEM columns and ``error``); bytes that are no UTF-8 are replaced.

    config: ``path`` (folder, glob of folders, or a list), ``patterns`` or
    ``glob``, ``exclude_patterns``, ``extra_tags``.  ``seen`` (name,
    fingerprint): files whose fingerprint is stored are not opened.
    """
    roots = config.get("path") or []
    own = config.get("patterns") or ([config["glob"]] if config.get("glob") else patterns)
    files = listing(spark, roots, own, config.get("exclude_patterns") or ())
    files = files.withColumn("key", P.path_key("path")).withColumn("name", F.concat(F.lit(f"observed/{source_id}/"), F.col("key")))
    files = files.withColumn("fingerprint", file_fingerprint())
    if seen is not None:
        files = files.join(seen.select("name", "fingerprint"), ["name", "fingerprint"], "left_anti")
    ref = F.struct(F.lit(kind).alias("kind"), F.col("path").alias("path"))
    modified = F.date_format((F.col("mtime_ns") / 1e9).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    return with_bytes(files).select(
        F.lit(source_id).alias("source_id"), "key", "name", decode_utf8("content").alias("content"),
        F.lit(f"{kind},{source_id}{extra_tags(config.get('extra_tags'))}").alias("tags"),
        F.to_json(F.struct(ref.alias("source_ref"), F.col("length").alias("size"), modified.alias("modified"))).alias("meta"),
        "fingerprint", F.col("path").alias("source_path"), "error")


def markdown_dir(spark: SparkSession, source_id: str, config: dict, seen: DataFrame | None = None) -> DataFrame:
    """Notes of one or more folders, ``*.md`` unless the config has patterns."""
    return text_items(spark, source_id, config, ["*.md"], "markdown_dir", seen)


def remember_files(spark: SparkSession, source_id: str, config: dict, seen: DataFrame | None = None) -> DataFrame:
    """``.remember`` notes anywhere below the roots."""
    return text_items(spark, source_id, config, ["**/.remember"], "remember_files", seen)


# --------------------------------------------------------------------------
# Lines of growing files by byte ranges
# --------------------------------------------------------------------------

RANGE_BYTES = 32 << 20
READ = 1 << 20
STATE = "file_key string, offset long, mtime long, line_no long"


def _range_lines(path: str, start: int, lo: int, hi: int) -> Iterator[tuple[int, bytes]]:
    """(end position, line) of the complete lines that begin in [lo, hi); a line begins at ``start`` or behind a newline."""
    with open(path, "rb") as f:
        at = lo
        if lo > start:  # the line that runs into the range belongs to the range before
            f.seek(lo - 1)
            skipped = f.readline()
            at = lo - 1 + len(skipped)
            if not skipped.endswith(b"\n"):
                return
        else:
            f.seek(lo)
        while at < hi:
            line = f.readline()
            if not line.endswith(b"\n"):  # a partial last line waits for its end
                return
            at += len(line)
            yield at, line


def lines_from(pending: DataFrame, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lines, state) of the files in pending(file_key, path, size, mtime, start_offset, start_line).

    lines: (file_key, display_path, stem, line_no, value), numbered on from
    ``start_line``; state: (file_key, offset, mtime, line_no) behind the last
    complete line.  Files are read by ranges, so a large one is shared by many
    tasks, and only from their offset on; each byte is read once.  The lines are
    written to the scratch folder, since their numbers need the counts of the
    ranges before.
    """
    spark = pending.sparkSession
    span = F.sequence(F.col("start_offset"), F.greatest("start_offset", F.col("size") - 1), F.lit(range_bytes).cast("long"))
    ranges = pending.filter("size > start_offset").select("file_key", "path", "start_offset", "size", F.explode(span).alias("lo"))
    ranges = ranges.repartition("file_key", "lo")
    schema = pa.schema([("file_key", pa.string()), ("path", pa.string()), ("lo", pa.int64()), ("k", pa.int64()), ("end", pa.int64()), ("value", pa.binary())])

    def run(batches):
        for batch in batches:
            for key, path, start, size, lo in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held, k = [], 0, 0
                for end, line in _range_lines(path, start, lo, min(size, lo + range_bytes)):
                    k += 1
                    rows.append((key, path, lo, k, end, line.rstrip(b"\r\n")))
                    held += len(line)
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    out = scratch_path(spark, "lines")
    ranges.mapInArrow(run, "file_key string, path string, lo long, k long, end long, value binary").write.parquet(out)
    got = spark.read.schema("file_key string, path string, lo long, k long, end long, value binary").parquet(out)
    of = got.groupBy("file_key", "lo").agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("end"))
    before = Window.partitionBy("file_key").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    base = of.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    first = pending.select("file_key", "start_offset", "start_line", "mtime")
    numbered = got.join(base.select("file_key", "lo", "base"), ["file_key", "lo"]).join(first, "file_key")
    name = P.basename("path")
    lines = numbered.select("file_key", F.col("path").alias("display_path"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
                            (F.col("start_line") + F.col("base") + F.col("k")).alias("line_no"), decode_utf8("value").alias("value"))
    ends = of.groupBy("file_key").agg(F.sum("n").alias("n"), F.max("end").alias("end"))
    state = first.join(ends, "file_key", "left").select(
        "file_key", F.coalesce("end", "start_offset").alias("offset"), "mtime", (F.col("start_line") + F.coalesce("n", F.lit(0))).alias("line_no"))
    return lines, state


def file_key(path: Column | str = "path", key_by: str = "path") -> Column:
    return P.basename(path) if key_by == "name" else P.path_key(path)


def scan_transcripts(files: DataFrame, state: DataFrame, source_id: str, fmt: str = "claude_code", key_by: str = "path",
                     range_bytes: int = RANGE_BYTES, **options) -> tuple[DataFrame, DataFrame]:
    """(turn items, new state) of a listing (path, length, mtime_ns) against the state of the scan before.

    Unchanged files are not opened, grown ones are read from their offset, with
    their line numbers carried on; one that is shorter than its offset starts
    again.  The new state keeps the rows of files that were not read.
    """
    from ..operators.refresh import scan_pending
    from .transcripts import turns
    f = files.select(file_key("path", key_by).alias("file_key"), "path", F.col("length").alias("size"), F.col("mtime_ns").alias("mtime"))
    # one file a key: of files of one name the newest
    f = f.groupBy("file_key").agg(F.max(F.struct("mtime", "size", "path")).alias("f")).select("file_key", "f.path", "f.size", "f.mtime")
    # the listing and what is pending are read by several plans; the folders are walked once
    f = held(f, "listed")
    pending = held(scan_pending(f, state).join(f.select("file_key", "path", "mtime"), "file_key"), "pending")
    lines, new = lines_from(pending, range_bytes)
    kept = state.join(new.select("file_key"), "file_key", "left_anti").select("file_key", "offset", "mtime", "line_no")
    return turns(lines, source_id, fmt, **options), kept.unionByName(new)
