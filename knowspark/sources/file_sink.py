"""File sink: rows become files, all of a write or none.

Each task writes its files into a staging folder of its own below the
destination; when all tasks are done the driver renames the staged files into
place, and on a failure it removes the staging folders.  A task that runs twice
stages twice, and only the attempt that Spark accepts is renamed.

Two rows of one file name cannot both stay: the write fails before anything is
renamed.  The destination must be seen by driver and executors under one path.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "filename string, content binary"
#: file names that one commit message may carry; a task with more is told by its staging folder
STAGING = ".staging-"


@dataclass
class _Staged(WriterCommitMessage):
    folder: str
    count: int


class FileWriter(DataSourceWriter):
    def __init__(self, options):
        self.dest = options["path"].replace("file://", "", 1).replace("file:", "", 1)
        self.skip = options.get("existing", "replace") == "keep"
        self.run = uuid.uuid4().hex

    def _root(self) -> str:
        return os.path.join(self.dest, f"{STAGING}{self.run}")

    def write(self, iterator) -> _Staged:
        folder = os.path.join(self._root(), uuid.uuid4().hex)
        os.makedirs(folder, exist_ok=True)
        n = 0
        for row in iterator:
            name = row["filename"]
            if not name or name != os.path.basename(name) or name in (".", ".."):
                raise ValueError(f"not a file name: {name!r}")
            with open(os.path.join(folder, name), "xb") as f:
                f.write(bytes(row["content"] or b""))
            n += 1
        return _Staged(folder, n)

    def commit(self, messages) -> None:
        seen: set[str] = set()
        staged = [(m.folder, e.name) for m in messages if m is not None for e in os.scandir(m.folder)]
        for _, name in staged:
            if name in seen:
                self.abort(messages)
                raise ValueError(f"two rows for the file {name!r}")
            seen.add(name)
        for folder, name in staged:
            place = os.path.join(self.dest, name)
            if not (self.skip and os.path.exists(place)):
                os.replace(os.path.join(folder, name), place)
        shutil.rmtree(self._root(), ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self._root(), ignore_errors=True)


class FileSink(DataSource):
    """``df.write.format("file_sink").option("path", dest).mode("append").save()``"""

    @classmethod
    def name(cls):
        return "file_sink"

    def schema(self):
        return SCHEMA

    def writer(self, schema, overwrite):
        return FileWriter(self.options)


def write_files(df: DataFrame, dest: str, keep: bool = False) -> None:
    """Write rows (filename, content) as files in ``dest``; ``keep``: a file that exists stays as it is (content-addressed blobs)."""
    df.sparkSession.dataSource.register(FileSink)
    rows = df.select(F.col("filename").cast("string").alias("filename"), F.col("content").cast("binary").alias("content"))
    rows.write.format("file_sink").option("path", dest).option("existing", "keep" if keep else "replace").mode("append").save()


#: what Spark escapes in the folder names of a partitioned write, and its name for a key without value
_ESCAPED = {c: f"%{c:02X}" for c in [*range(1, 0x20), 0x7F, *map(ord, "\"#%'*/:=?\\{[]^")]}
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def write_line_files(df: DataFrame, keys: list[str], out: str, order: str | None = None) -> None:
    """One text file a key: ``<out>/<key>=<value>/.../part-0.txt`` with a line a row of the column that is no key.

    Same folders and lines as ``df.write.partitionBy(*keys).text(out)``.  Spark's
    commit lists and renames the files one by one on the driver; here each task
    stages a file beside the tree and renames it into place when it is whole, so
    a task that runs again replaces it.  ``order`` sorts a file's lines.  A folder that only
    Spark can write to (with a scheme other than ``file``) is written by Spark.
    """
    value = next(c for c in df.columns if c not in (*keys, order))
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *([order] if order else []))
    folder = out.replace("file://", "", 1).replace("file:", "", 1)
    if "://" in folder:
        rows.select(*keys, value).write.partitionBy(*keys).text(out)
        return
    staged = f"{folder.rstrip('/')}-staged"

    def place(key: tuple) -> str:
        return os.path.join(folder, *(f"{k}={v.translate(_ESCAPED) if v else _NO_VALUE}" for k, v in zip(keys, key)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(staged, exist_ok=True)
        draft = os.path.join(staged, uuid.uuid4().hex)
        n = 0
        for key, lines in groupby(each(batches), lambda row: row[:-1]):
            with open(draft, "wb") as f:
                f.writelines((row[-1] or b"") + b"\n" for row in lines)
            os.makedirs(place(key), exist_ok=True)
            os.replace(draft, os.path.join(place(key), "part-0.txt"))
            n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    os.makedirs(folder)
    rows = rows.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(value).cast("binary").alias(value))
    rows.mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()
    shutil.rmtree(staged, ignore_errors=True)
