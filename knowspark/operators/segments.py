"""A segmented index: changes add a segment, old segments are not rewritten.

A segment holds the entries that one change wrote, their postings, terms and
blocks, and what the change took away: ``gone`` (store, id) of entries of earlier
segments, and ``undo``, the document frequencies of their words.  So statistics
merge by sums over the segments, without reading postings:

* entries that live = all entries of all segments without those that a later
  segment lists in ``gone``;
* df of a term = the sum over segments of its df, less the sum of its ``undo``.

Versions are manifests of a commit log (:mod:`commits`): a change writes its
folder first and then names it, so readers see whole versions, and a writer that
lost a race writes nothing that is seen.  :func:`compact` merges the segments
from a given one on into one.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ENTRY_COLUMNS
from ..session import sent_if_few, shuffles_removed
from . import commits
from . import entries as E
from . import index as ix

SEARCHED = ["store", "id", "name", "content", "tags"]


def _write(spark: SparkSession, root: str, entries: DataFrame, gone: DataFrame | None, undo: DataFrame | None,
           undo_stats: DataFrame | None) -> dict:
    """A segment's folder and its line in the manifest."""
    name = f"seg-{uuid.uuid4().hex}"
    path = f"{root}/{name}"
    if gone is not None:
        with shuffles_removed(spark):
            gone.write.parquet(f"{path}/gone")
            undo.repartitionByRange("store", "term").sortWithinPartitions("store", "term").write.partitionBy("store").parquet(f"{path}/undo")
            undo_stats.write.parquet(f"{path}/undo_stats")
    ix.write_index_from(entries, path)
    stats = {r["store"]: [r["n_docs"], r["n_tokens"]] for r in ix.read_table(spark, path, "stats").collect()}  # a row a store
    line = {"name": name, "stats": stats, "gone": gone is not None}
    if gone is not None:
        line["taken"] = spark.read.schema("store string, id long").parquet(f"{path}/gone").count()
        line["undo"] = {r["store"]: [r["n_docs"], r["n_tokens"]] for r in spark.read.schema(undo_stats.schema).parquet(f"{path}/undo_stats").collect()}
    return line


def create(entries: DataFrame, root: str) -> int:
    """The first version: one segment with all entries."""
    spark = entries.sparkSession
    version, manifest = commits.latest(spark, root)
    if version:
        raise ValueError(f"{root} holds an index")
    return commits.commit(spark, root, 0, {"segments": [_write(spark, root, entries.select(*ENTRY_COLUMNS), None, None, None)]})


def _gone(spark: SparkSession, root: str, segments: list[dict]) -> DataFrame | None:
    parts = [spark.read.schema("store string, id long").parquet(f"{root}/{s['name']}/gone").select("store", "id", F.lit(i).alias("seg"))
             for i, s in enumerate(segments) if s["gone"]]
    return reduce(DataFrame.unionByName, parts) if parts else None


def _table(spark: SparkSession, root: str, segments: list[dict], name: str, gone: DataFrame | None) -> DataFrame:
    """A table of all segments with ``seg``, without what later segments take away."""
    parts = []
    for i, s in enumerate(segments):
        t = ix.read_table(spark, f"{root}/{s['name']}", name).withColumn("seg", F.lit(i))
        later = [x.get("taken") for x in segments[i + 1:] if x["gone"]]
        if gone is not None and later:
            ids = gone.filter(F.col("seg") > i).select("store", "id").distinct()
            t = t.join(sent_if_few(ids, None if None in later else sum(later)), ["store", "id"], "left_anti")
        parts.append(t)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _totals(segments: list[dict]) -> dict[str, list[int]]:
    out: dict = {}
    for s in segments:
        for sign, part in ((1, s["stats"]), (-1, s.get("undo", {}))):
            for store, (n, t) in part.items():
                have = out.setdefault(store, [0, 0])
                have[0] += sign * n
                have[1] += sign * t
    return out


def read(spark: SparkSession, root: str, version: int | None = None) -> ix.Index:
    """The index of a version (the last one if None)."""
    manifest = commits.latest(spark, root)[1] if version is None else commits.at(spark, root, version)
    return _index(spark, root, manifest.get("segments", []))


def _index(spark: SparkSession, root: str, segments: list[dict]) -> ix.Index:
    if not segments:
        raise ValueError(f"{root} holds no index")
    gone = _gone(spark, root, segments)
    stats = [(s, n, t, t / n) for s, (n, t) in sorted(_totals(segments).items()) if n]
    terms = [ix.read_table(spark, f"{root}/{s['name']}", "terms").withColumn("seg", F.lit(i)) for i, s in enumerate(segments)]
    terms += [spark.read.schema("store string, term string, df long").parquet(f"{root}/{s['name']}/undo").withColumn("df", -F.col("df")).withColumn("seg", F.lit(i))
              for i, s in enumerate(segments) if s["gone"]]
    return ix.Index(
        entries=_table(spark, root, segments, "entries", gone).drop("seg"), postings=_table(spark, root, segments, "postings", gone).drop("seg"),
        lengths=_table(spark, root, segments, "lengths", gone).drop("seg"),
        stats=spark.createDataFrame(stats, "store string, n_docs long, n_tokens long, avgdl double"),
        terms=reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), terms),
        blocks=_table(spark, root, segments, "blocks", None), gone=gone,
        averages={(i, store): t / n for i, s in enumerate(segments) for store, (n, t) in s["stats"].items() if n})


def _taken(old: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gone, undo, undo_stats) of entries that leave."""
    toks = ix.tokenized(old.select(*SEARCHED))
    words = F.array_distinct(F.concat("t_name", "t_content", "t_tags"))
    undo = toks.select("store", F.explode(words).alias("term")).groupBy("store", "term").agg(F.count(F.lit(1)).alias("df"))
    return old.select("store", "id"), undo, ix.store_stats(toks).drop("avgdl")


#: how often a change is tried again after another writer's commit
TRIES = 5


def update(spark: SparkSession, root: str, changes: DataFrame | None, deleted: DataFrame | None, now: str | Column,
           extra: dict | None = None) -> int:
    """The next version: ``changes`` upserted by (store, name), the names in ``deleted`` removed.

    ``changes`` as for :func:`entries.changed_rows`; a name is deleted from the
    user store if it is there, else from the system store, before the changes
    apply.  Only entries that change are read as text, tokenised and written.
    ``extra`` goes into the manifest beside the segments.
    """
    for left in reversed(range(TRIES)):
        version, manifest = commits.latest(spark, root)
        line = _change(spark, root, manifest["segments"], changes, deleted, now)
        try:
            return commits.commit(spark, root, version, {**manifest, **(extra or {}), "segments": [*manifest["segments"], line]})
        except commits.Conflict:
            commits.remove(spark, f"{root}/{line['name']}")
            if not left:
                raise
    raise AssertionError


def annotate(spark: SparkSession, root: str, extra: dict) -> int:
    """The next version: the same segments, ``extra`` in the manifest."""
    version, manifest = commits.latest(spark, root)
    return commits.commit(spark, root, version, {**manifest, **extra})


def _held(df: DataFrame, path: str) -> DataFrame:
    """``df`` as written to a draft."""
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _change(spark: SparkSession, root: str, segments: list[dict], changes: DataFrame | None, deleted: DataFrame | None, now: str | Column) -> dict:
    current = _index(spark, root, segments).entries
    draft = f"{root}/draft-{uuid.uuid4().hex}"
    none = current.limit(0).select("store", "name")
    victims = none if deleted is None else E.delete_names(current, deleted)[1]
    rest = current if deleted is None else current.join(victims, ["store", "name"], "left_anti")
    rows = (current.limit(0) if changes is None else E.changed_rows(rest, changes, now)).select(*ENTRY_COLUMNS)
    rows = _held(rows, f"{draft}/rows")
    left = _held(victims.unionByName(rows.select("store", "name")).distinct(), f"{draft}/left")
    old = _held(current.join(sent_if_few(left, left.count()), ["store", "name"], "left_semi").select(*SEARCHED), f"{draft}/old")
    line = _write(spark, root, rows, *_taken(old))
    commits.remove(spark, draft)
    return line


def compact(spark: SparkSession, root: str, first: int = 0) -> int:
    """The next version, with the segments from number ``first`` on merged into one; those before stay as they are."""
    version, manifest = commits.latest(spark, root)
    head, tail = manifest["segments"][:first], manifest["segments"][first:]
    merged = _index(spark, root, tail)
    gone = undo = undo_stats = None
    if head:
        gone = merged.gone.select("store", "id").distinct() if merged.gone is not None else merged.entries.limit(0).select("store", "id")
        # what the merged segments take from those before: all that they took, less what they took from each other
        own = ix.term_stats(merged.postings).select("store", "term", "df")
        net = merged.terms.select("store", "term", (-F.col("df")).alias("df")).unionByName(own)
        undo = net.groupBy("store", "term").agg(F.sum("df").alias("df")).filter("df <> 0")
        held = {r["store"]: (r["n_docs"], r["n_tokens"]) for r in ix.store_stats(merged.lengths).collect()}
        total = _totals(tail)
        undo_stats = spark.createDataFrame(
            [(s, held.get(s, (0, 0))[0] - total.get(s, [0, 0])[0], held.get(s, (0, 0))[1] - total.get(s, [0, 0])[1]) for s in {*held, *total}],
            "store string, n_docs long, n_tokens long")
    line = _write(spark, root, merged.entries.select(*ENTRY_COLUMNS), gone, undo, undo_stats)
    return commits.commit(spark, root, version, {**manifest, "segments": [*head, line]})


def prune(spark: SparkSession, root: str, keep: int = 10) -> list[str]:
    """Delete versions before the last ``keep``, and the segments that only they name."""
    return commits.prune(spark, root, keep, lambda m: [*[s["name"] for s in m["segments"]], *m.get("states", {}).values(), *m.get("alerts", [])])
