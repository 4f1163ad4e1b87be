"""The segmented index against a rebuild, and its commit log."""

import os
import random

import pytest
from entry_rows import make_entries
from pyspark.sql import functions as F

from knowspark import session
from knowspark.operators import commits
from knowspark.operators import entries as E
from knowspark.operators import index as ix
from knowspark.operators import search as S
from knowspark.operators import segments as SG
from knowspark.operators import topk

CHANGE = "name string, type string, content string, tags string, meta string, pinned boolean, target string, seq int"
WORDS = ["apple", "pear", "plum", "often", "often", "often", "fig", "rare"]


def text(r):
    return " ".join(r.choice(WORDS) for _ in range(r.randint(1, 9)))


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(root) for f in fs}


def same(spark, root, entries):
    """The index at root equals one built from ``entries``: rows, statistics, rankings and best rows."""
    idx, new = SG.read(spark, root), ix.build_index(entries)
    key = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    assert key(idx.entries, "store", "id", "name", "content") == key(entries, "store", "id", "name", "content")
    stats = lambda df: {r["store"]: (r["n_docs"], r["n_tokens"], round(r["avgdl"], 9)) for r in df.collect()}
    assert stats(idx.stats) == stats(new.stats)
    assert key(idx.postings, "store", "term", "id", "tf", "dl") == key(new.postings, "store", "term", "id", "tf", "dl")
    df = idx.terms.groupBy("store", "term").agg(F.sum("df").alias("df")).filter("df <> 0")
    assert key(df, "store", "term", "df") == key(ix.term_stats(new.postings), "store", "term", "df")
    exprs = {i: S.parse_match(q) for i, q in enumerate(["often", "rare often", "rare OR often", '"apple pear"', "pl* NOT fig", "fig OR plum OR rare"])}
    rank = lambda d: sorted((r["qid"], r["store"], r["id"], round(r["rank"], 9)) for r in d.collect())
    assert rank(S.evaluate(idx, exprs)) == rank(S.evaluate(new, exprs))
    plain = {q: e for q, e in exprs.items() if topk.plain(e)}
    assert rank(S.fts_stage(idx, plain, limit=3)) == rank(S.fts_stage(new, plain, limit=3))


def test_changes_deletes_and_merges_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "BLOCK", 4)
    root, r = str(tmp_path / "index"), random.Random(4)
    rows = [{"name": f"n{i}", "content": text(r), "id": i, "store": r.choice(["user", "system"])} for i in range(120)]
    entries = make_entries(spark, rows)
    assert SG.create(entries, root) == 1
    same(spark, root, entries)
    for turn in range(3):
        changes = spark.createDataFrame([(f"n{r.randrange(150)}", "memory", text(r), "t", "{}", False, r.choice(["user", "system"]), k)
                                         for k in range(15)], CHANGE) if turn != 1 else None
        names = spark.createDataFrame([(f"n{r.randrange(150)}",) for _ in range(8)], "name string") if turn else None
        before = files(root)
        SG.update(spark, root, changes, names, "2024-07-01 00:00:00")
        after = files(root)
        assert {k: v for k, v in after.items() if k in before} == before  # nothing written before is touched
        if names is not None:
            entries = E.delete_names(entries, names)[0]
        if changes is not None:
            entries = E.upsert(entries, changes, "2024-07-01 00:00:00")
        entries = spark.createDataFrame(entries.collect(), entries.schema)
        if turn == 2:
            same(spark, root, entries)
    SG.compact(spark, root, first=2)
    assert len(commits.latest(spark, root)[1]["segments"]) == 3
    same(spark, root, entries)
    SG.compact(spark, root)
    assert len(commits.latest(spark, root)[1]["segments"]) == 1
    same(spark, root, entries)
    assert commits.latest(spark, root)[0] == 6
    assert len(SG.prune(spark, root, keep=1)) == 5  # four of the changes, one of the partial merge
    same(spark, root, entries)
    with pytest.raises(ValueError):
        SG.create(entries, root)


def test_one_of_two_writers_wins(spark, tmp_path):
    root = str(tmp_path / "t")
    assert commits.latest(spark, root) == (0, {})
    assert commits.commit(spark, root, 0, {"a": 1}) == 1
    with pytest.raises(commits.Conflict):
        commits.commit(spark, root, 0, {"a": 2})
    assert commits.latest(spark, root) == (1, {"a": 1})
    assert commits.commit(spark, root, 1, {"a": "ü"}) == 2
    assert commits.at(spark, root, 2) == {"a": "ü"}
    assert not [f for f in os.listdir(f"{root}/_log") if "draft" in f and not f.endswith(".crc")]


def test_names_with_one_hash_get_ids_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(E, "entry_id", lambda *a: F.lit(7).cast("long"))
    root = str(tmp_path / "index")
    SG.create(make_entries(spark, [{"name": "old", "content": "stone", "id": 7}, {"name": "old", "content": "wood", "id": 7, "store": "system"}]), root)
    changes = spark.createDataFrame([(n, "memory", f"{n} words", "", "{}", False, "user", 0) for n in ("b", "a", "old")], CHANGE)
    SG.update(spark, root, changes, None, "2024-07-01 00:00:00")
    idx = SG.read(spark, root)
    rows = {(r["store"], r["name"]): (r["id"], r["content"]) for r in idx.entries.collect()}
    assert rows["user", "old"] == (7, "old words") and rows["system", "old"] == (7, "wood")
    ids = [i for (s, _), (i, _) in rows.items() if s == "user"]
    assert len(set(ids)) == 3
    hits = S.evaluate(idx, {0: S.parse_match("a"), 1: S.parse_match("b"), 2: S.parse_match("words")})
    assert sorted((r["qid"], r["id"]) for r in hits.collect()) == sorted(
        [(0, rows["user", "a"][0]), (1, rows["user", "b"][0])] + [(2, i) for i in ids])


def test_few_ids_that_are_gone_are_sent_and_postings_stay(spark, tmp_path, monkeypatch):
    root, r = str(tmp_path / "index"), random.Random(9)
    entries = make_entries(spark, [{"name": f"n{i}", "content": text(r), "id": i, "store": r.choice(["user", "system"])} for i in range(40)])
    SG.create(entries, root)
    SG.update(spark, root, None, spark.createDataFrame([("n3",), ("n4",)], "name string"), "2024-07-01 00:00:00")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda: SG.read(spark, root).postings._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan() and "SortMergeJoin" not in plan()
        left = entries.filter(~F.col("name").isin("n3", "n4"))
        same(spark, root, left)
        monkeypatch.setattr(session, "SENT", 1)  # too many to be sent
        assert "SortMergeJoin" in plan()
        same(spark, root, left)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
