"""Commit log of a table folder: versions named by manifests that appear whole or not at all.

``<root>/_log/<version>.json`` holds what a version consists of.  A manifest is
written beside its place and renamed without overwriting, so of two writers that
start from the same version one gets ``Conflict`` and must read again.  Readers
see the last manifest; files that no manifest names are invisible.

All file access goes through Hadoop's file system API, so the root may be in any
store that Spark reads.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer committed this version first."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, root: str) -> list[int]:
    fs, log = _fs(spark, root), _path(spark, f"{root}/_log")
    if not fs.exists(log):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(log)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _read(spark: SparkSession, path: str) -> str:
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def latest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """(version, manifest) of the last commit; (0, {}) before the first."""
    all_of = _versions(spark, root)
    return (all_of[-1], at(spark, root, all_of[-1])) if all_of else (0, {})


def at(spark: SparkSession, root: str, version: int) -> dict:
    return json.loads(_read(spark, f"{root}/_log/{version:012d}.json"))


def commit(spark: SparkSession, root: str, version: int, manifest: dict) -> int:
    """Make ``manifest`` the version after ``version``; raises :class:`Conflict` if there is one already."""
    place = f"{root}/_log/{version + 1:012d}.json"
    draft = f"{root}/_log/.draft-{uuid.uuid4().hex}"
    fs, jvm = _fs(spark, root), spark._jvm
    out = fs.create(_path(spark, draft), False)
    out.write(json.dumps(manifest, sort_keys=True).encode())
    out.close()
    rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, root).toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(_path(spark, draft), _path(spark, place), options)
    except Exception as e:
        fs.delete(_path(spark, draft), False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {version + 1} of {root} exists") from None
        raise
    return version + 1


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder."""
    _fs(spark, path).delete(_path(spark, path), True)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of the files of a folder."""
    return _fs(spark, path).getContentSummary(_path(spark, path)).getLength()


def prune(spark: SparkSession, root: str, keep: int, named) -> list[str]:
    """Keep the last ``keep`` manifests; delete the others and the folders that only they name.

    ``named(manifest)`` gives the folders of a version, relative to ``root``.
    Returns the folders that were deleted.
    """
    versions = _versions(spark, root)
    old, kept = versions[:-keep], versions[-keep:]
    live = {f for v in kept for f in named(at(spark, root, v))}
    dead = {f for v in old for f in named(at(spark, root, v))} - live
    for v in old:  # manifests first: no version may name a folder that is gone
        remove(spark, f"{root}/_log/{v:012d}.json")
    for f in sorted(dead):
        remove(spark, f"{root}/{f}")
    return sorted(dead)
