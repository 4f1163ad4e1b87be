import json
import os
import tempfile

from knowspark.streaming import jobs as J


def _line(uuid, text, role="user"):
    return json.dumps({"type": role, "uuid": uuid, "message": {"role": role, "content": text}}) + "\n"


def _run(spark, src, out, ck):
    q = J.stream_transcripts(spark, [os.path.join(src, "*.jsonl")], "live", out, checkpoint=ck)
    q.awaitTermination(120)
    try:
        return spark.read.parquet(out).orderBy("line_no").collect()
    except Exception:  # noqa: BLE001 - no batch written yet
        return []


def test_tail_append_partial_line_and_truncation(spark):
    src = tempfile.mkdtemp(prefix="ks-src-")
    out = tempfile.mkdtemp(prefix="ks-out-")
    ck = tempfile.mkdtemp(prefix="ks-ck-")
    path = os.path.join(src, "s.jsonl")
    with open(path, "w") as f:
        f.write(_line("u1", "first turn"))
        f.write('{"type": "user", "uuid": "u2", "mess')      # partial line: not consumed yet
    rows = _run(spark, src, out, ck)
    assert [(r.line_no, r.content) for r in rows] == [(1, "first turn")]

    with open(path, "a") as f:                               # complete the line, add another
        f.write('age": {"role": "user", "content": "second"}}\n')
        f.write(_line("u3", "token ghp_" + "a" * 36))
    rows = _run(spark, src, out, ck)
    assert [(r.line_no, r.content) for r in rows] == [
        (1, "first turn"), (2, "second"), (3, "token ghp_***REDACTED***")]
    assert rows[2].redacted == ["github-token"]

    rows_again = _run(spark, src, out, ck)                   # unchanged: nothing new
    assert len(rows_again) == 3

    with open(path, "w") as f:                               # truncated/rotated: restart at 0
        f.write(_line("v1", "after rotation"))
    rows = _run(spark, src, out, ck)
    assert (1, "after rotation") in [(r.line_no, r.content) for r in rows]


def test_excluded_paths_never_listed():
    from knowspark.functions.paths import excluded_py
    assert excluded_py("/home/u/.ssh/x.jsonl") and excluded_py("C:\\CREDENTIALS\\a.jsonl") and excluded_py("/u/.knowspark/s.jsonl")
    assert not excluded_py("/home/u/sessions/a.jsonl")


def test_stream_upserts_once_and_replays_change_nothing(spark, tmp_path):
    from entry_rows import make_entries

    from knowspark.operators import commits
    from knowspark.operators import observe as OB
    from knowspark.operators import segments as SG

    src, root = tmp_path / "src", str(tmp_path / "store")
    src.mkdir()
    SG.create(make_entries(spark, [{"name": "note/a", "content": "old words"}]), root)
    with open(src / "s.jsonl", "w") as f:
        f.write(_line("u1", "first turn") + _line("u2", "second turn"))

    def run():
        q = J.stream_transcripts(spark, [str(src / "*.jsonl")], "live", root, checkpoint=str(tmp_path / "ck"), upsert=True)
        assert q.awaitTermination(120)
        return {r["name"].rsplit("/", 1)[1]: r["content"] for r in SG.read(spark, root).entries.filter("type = 'observed'").collect()}

    assert run() == {"u1": "first turn", "u2": "second turn"}
    with open(src / "s.jsonl", "a") as f:
        f.write(_line("u3", "third turn"))
    assert run() == {"u1": "first turn", "u2": "second turn", "u3": "third turn"}
    version, manifest = commits.latest(spark, root)
    items = spark.createDataFrame([("live", "k", "observed/live/x", "late", "t", "{}", "f", "p", 1)],
                                  "source_id string, key string, name string, content string, tags string, meta string, fingerprint string, source_path string, seq int")
    kinds = spark.createDataFrame([("live", "agent_transcripts")], "source_id string, kind string")
    assert not OB.upsert_batch(spark, root, items, kinds, "2024-01-01 00:00:00", "live", max(manifest["batches"].values()))
    assert commits.latest(spark, root)[0] == version
