"""File sources, incremental scans and the refresh job over real folders."""

import json
import os

import pytest
from entry_rows import make_entries
from pyspark.sql import functions as F

from knowspark.functions.paths import path_glob_to_regex
from knowspark.operators import observe as OB
from knowspark.operators import segments as SG
from knowspark.sources import files as FI

NOW = "2024-07-01 00:00:00"


def put(root, rel, text):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())
    return path


def rels(df):
    return sorted(r["rel"] for r in df.collect())


def test_listing_patterns_roots_and_rules(spark, tmp_path):
    root = str(tmp_path)
    for rel in ("a.md", "b.txt", "sub/c.md", "sub/deep/d.md", "sub/.remember", ".remember", "x/.git/e.md", "x/id_rsa", "x/k.pem",
                ".knowspark/f.md", "sub/c_en.md", "ü +%20.md"):
        put(root, rel, rel)
    assert rels(FI.listing(spark, root, ["*.md"])) == ["a.md", "ü +%20.md"]
    assert rels(FI.listing(spark, root, ["**/*.md"], ["*_en.md"])) == ["a.md", "sub/c.md", "sub/deep/d.md", "ü +%20.md"]
    assert rels(FI.listing(spark, root, ["**/.remember"])) == [".remember", "sub/.remember"]
    both = FI.listing(spark, [root, f"{root}/s*", f"{root}/nothing"], ["**/*.md", "**/c*"])
    paths = [r["path"] for r in both.collect()]
    assert len(paths) == len(set(paths)) == 5
    assert {r["length"] for r in FI.listing(spark, root, ["*.txt"]).collect()} == {5}
    assert rels(FI.listing(spark, f"{root}/nothing")) == []
    assert rels(FI.listing(spark, f"file://{root}/sub", ["**/*.md"])) and not rels(FI.listing(spark, f"file://{root}/sub", ["**/.remember"]))


@pytest.mark.parametrize("glob,yes,no", [("*.md", ["a.md", ".md"], ["s/a.md", "amd"]), ("**/*.md", ["a.md", "s/t/a.md"], ["a.txt"]),
                                         ("?.t[xy]t", ["a.txt", "b.tyt"], ["aa.txt", "/.txt"]), ("s/**", ["s/a", "s/b/c"], ["t/a"]),
                                         ("s/*/x", ["s/a/x"], ["s/x", "s/a/b/x"]), ("a.b", ["a.b"], ["axb"])])
def test_path_globs(spark, glob, yes, no):
    df = spark.createDataFrame([(x,) for x in yes + no], "p string")
    assert {r[0] for r in df.filter(F.col("p").rlike(path_glob_to_regex(glob))).collect()} == set(yes)


def test_text_items_and_presets(spark, tmp_path):
    root = str(tmp_path)
    put(root, "n/a.md", "hello")
    put(root, "n/b.md", b"bad \xff byte")
    put(root, "n/t.txt", "text")
    put(root, "p/q/.remember", "keep this")
    rows = {r["source_path"].rsplit("/", 1)[1]: r for r in FI.markdown_dir(spark, "notes", {"path": f"{root}/n", "extra_tags": "policy"}).collect()}
    assert set(rows) == {"a.md", "b.md"} and rows["b.md"]["content"] == "bad \ufffd byte" and rows["a.md"]["tags"] == "markdown_dir,notes,policy"
    stat = os.stat(f"{root}/n/a.md")
    assert rows["a.md"]["fingerprint"] == f"{stat.st_mtime_ns}:{stat.st_size}"
    assert rows["a.md"]["name"] == "observed/notes/" + f"{root}/n/a.md".lstrip("/") and json.loads(rows["a.md"]["meta"])["size"] == 5
    assert len(FI.markdown_dir(spark, "notes", {"path": [f"{root}/n"], "glob": "*.txt"}).collect()) == 1
    r = FI.remember_files(spark, "mem", {"path": root}).collect()
    assert [x["content"] for x in r] == ["keep this"] and r[0]["tags"] == "remember_files,mem"
    assert FI.extra_tags(None) == "" and FI.extra_tags([" a ", "", 5]) == ",a,5"


def turn(k, text="words"):
    return json.dumps({"type": "user", "message": {"role": "user", "content": f"{text} {k}"}}) + "\n"


@pytest.mark.parametrize("range_bytes", [64, 1 << 20])
def test_incremental_scan_reads_only_what_is_new(spark, tmp_path, monkeypatch, range_bytes):
    root = str(tmp_path)
    state = spark.createDataFrame([], FI.STATE)

    def scan():
        nonlocal state
        items, new = FI.scan_transcripts(FI.listing(spark, root, ["**/*.jsonl"]), state, "s", range_bytes=range_bytes)
        got = sorted((r["source_path"].rsplit("/", 1)[1], r["line_no"], r["content"]) for r in items.collect())
        state = spark.createDataFrame(new.collect(), FI.STATE)
        return got

    put(root, "a.jsonl", "".join(turn(k) for k in range(20)) + "\n\r\nno json\n" + '{"type": "us')
    put(root, "b.jsonl", turn(0, "x" * 500))
    put(root, "empty.jsonl", "")
    got = scan()
    assert got == [("a.jsonl", k + 1, f"words {k}") for k in range(20)] + [("b.jsonl", 1, "x" * 500 + " 0")]
    held = {r["file_key"].rsplit("/", 1)[1]: (r["offset"], r["line_no"]) for r in state.collect()}
    assert held["a.jsonl"][1] == 23 and held["b.jsonl"] == (os.path.getsize(f"{root}/b.jsonl"), 1)
    with open(f"{root}/a.jsonl", "a") as f:
        f.write('er", "message": {"role": "user", "content": "late"}}\n' + turn(9))
    os.rename(f"{root}/b.jsonl", f"{root}/b.moved")
    put(root, "b.jsonl", "")  # shorter than its offset
    put(root, "c.jsonl", turn(1))
    assert scan() == [("a.jsonl", 24, "late"), ("a.jsonl", 25, "words 9"), ("c.jsonl", 1, "words 1")]
    os.chmod(f"{root}/a.jsonl", 0o000)  # unchanged files are not opened
    assert scan() == []


def test_refresh_job_isolates_a_broken_source(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "store")
    put(src, "n/a.md", "alpha note with npm_" + "a" * 36)
    put(src, "n/b.md", "beta note")
    put(src, "t/s.jsonl", turn(1) + turn(2))
    SG.create(make_entries(spark, [{"name": "own", "content": "mine"}]), root)

    def broken(spark, sid, params, seen, state):
        raise OSError("no such disk")

    adapters = {**OB.ADAPTERS, "broken": broken}
    sources = [{"source_id": "notes", "kind": "markdown_dir", "params": {"path": f"{src}/n"}},
               {"source_id": "bad", "kind": "broken"},
               {"source_id": "off", "kind": "markdown_dir", "params": {"path": src}, "enabled": False},
               {"source_id": "odd", "kind": "no such kind"},
               {"source_id": "chat", "kind": "agent_transcripts", "params": {"path": f"{src}/t"}}]

    def run():
        rows = OB.observe(spark, root, sources, NOW, cloud_root=f"{src}/n", adapters=adapters).collect()
        return {r["source_id"]: (r["indexed"], r["skipped"], r["alerts"], r["new_alerts"], r["errors"]) for r in rows}

    assert run() == {"notes": (2, 0, 1, 1, 0), "bad": (0, 0, 0, 0, 1), "odd": (0, 0, 0, 0, 1), "chat": (2, 0, 0, 0, 0)}
    entries = {r["name"]: r for r in SG.read(spark, root).entries.collect()}
    assert "own" in entries and entries["sync-error/bad"]["content"] == "OSError: no such disk" and entries["sync-error/bad"]["tags"] == "error,sync"
    assert sum(n.startswith("observed/chat/") for n in entries) == 2 and len(entries) == 7
    assert [r["content"] for n, r in entries.items() if n.endswith("a.md")][0].count("***REDACTED***") == 1
    put(src, "n/b.md", "beta note, changed")
    with open(f"{src}/t/s.jsonl", "a") as f:
        f.write(turn(3))
    assert run() == {"notes": (1, 1, 0, 0, 0), "bad": (0, 0, 0, 0, 1), "odd": (0, 0, 0, 0, 1), "chat": (1, 0, 0, 0, 0)}
    assert OB.alerts(spark, root).count() == 1
    OB.forget_source(spark, root, "chat")
    assert run()["chat"] == (0, 3, 0, 0, 0)


def test_replica_presets_refuse_the_own_host(spark, tmp_path):
    from knowspark.sources import table as TB

    four = TB.memory_replica_sources("Alpha", "beta", str(tmp_path), "mem")
    assert [s["source_id"] for s in four] == [f"replica-alpha-mem-{t}" for t in ("facts", "lessons", "working", "sessions")]
    assert not any(s["enabled"] for s in four) and TB.entries_replica_source("alpha", "beta", "/x")["source_id"] == "replica-alpha-entries"
    for host, me in (("beta", "BETA"), ("", "beta"), ("alpha", " ")):
        with pytest.raises(ValueError):
            TB.memory_replica_sources(host, me, "/x", "mem")
    spark.createDataFrame([(1, "c", "title", "what broke", "what helped")], "id int, category string, title string, problem string, solution string") \
        .write.parquet(str(tmp_path / "mem_lessons"))
    root = str(tmp_path / "store")
    SG.create(make_entries(spark, [{"name": "own", "content": "mine"}]), root)
    rows = OB.observe(spark, root, [{**s, "enabled": s["source_id"].endswith("lessons")} for s in four], NOW).collect()
    assert [(r["source_id"], r["indexed"], r["errors"]) for r in rows] == [("replica-alpha-mem-lessons", 1, 0)]
    assert SG.read(spark, root).entries.filter("type = 'observed'").first()["content"] == "title\n\nwhat broke\n\nwhat helped"


def test_files_are_written_all_or_none(spark, tmp_path):
    import hashlib

    from knowspark.sources.file_sink import write_files

    dest = str(tmp_path / "out")
    os.makedirs(dest)
    df = spark.range(40).select(F.concat(F.lit("f"), "id", F.lit(".txt")).alias("filename"), F.repeat(F.col("id").cast("string"), 50).alias("content"))
    write_files(df.repartition(5), dest)
    want = {r["filename"]: r["h"] for r in df.select("filename", F.sha2("content", 256).alias("h")).collect()}
    assert {f: hashlib.sha256(open(f"{dest}/{f}", "rb").read()).hexdigest() for f in os.listdir(dest)} == want
    bad = [df.limit(5).unionByName(spark.createDataFrame([("../x", "y")], "filename string, content string")),
           spark.createDataFrame([("same", "1"), ("same", "2")], "filename string, content string").repartition(2),
           df.select(F.concat(F.lit("n"), "filename").alias("filename"), F.when(F.col("filename") == "f7.txt", F.raise_error(F.lit("no"))).otherwise(F.col("content")).alias("content"))]
    for b in bad:
        with pytest.raises(Exception):
            write_files(b, dest)
        assert set(os.listdir(dest)) == set(want)
    write_files(spark.createDataFrame([("f0.txt", "new")], "filename string, content string"), dest, keep=True)
    assert open(f"{dest}/f0.txt").read() == "0" * 50
    write_files(spark.createDataFrame([("f0.txt", "new")], "filename string, content string"), dest)
    assert open(f"{dest}/f0.txt").read() == "new"


def test_snippet_markup_and_helpers(spark):
    from knowspark.functions.json import dig
    from knowspark.functions.text import first_code_block, snippet_markup, tags_with

    df = spark.createDataFrame([("a & b >>>hit<<< <i> \"q\"", "x\n```python \n  f(1)\n```\n```python\ng()\n```", '{"a":{"b":[1]}}')], "s string, c string, j string")
    r = df.select(snippet_markup("s").alias("s"), first_code_block("c").alias("c"), dig(F.parse_json("j"), "a.b").alias("d"),
                  dig(F.parse_json("j"), "a.x.y").alias("n"), tags_with(F.lit("k"), F.array(F.lit(" x "), F.lit(""))).alias("t")).first()
    assert r["s"] == 'a &amp; b <mark>hit</mark> &lt;i&gt; &quot;q&quot;'
    assert r["c"] == "f(1)" and r["d"] == "[1]" and r["n"] is None and r["t"] == "k,x"


def test_sync_drains_the_drop_folder_and_observes_the_rest(spark, tmp_path):
    import hashlib

    from knowspark.operators import sync as SY

    home, root, blobs = str(tmp_path / "home"), str(tmp_path / "store"), str(tmp_path / "blobs")
    put(home, "notes/a.md", "first note")
    put(home, "pic.png", b"\x89PNG" + b"0" * 50)
    put(home, "config.json", "{}")
    put(home, "x/.git/y.md", "never")
    drop = [put(home, ".absorber/in.txt", "dropped text"), put(home, ".absorber/sub/big.txt", "z" * 300), put(home, ".absorber/bericht.bin", bytes(range(9)))]
    locked = put(home, ".absorber/locked.txt", "secret")
    os.chmod(locked, 0)
    unreadable = not os.access(locked, os.R_OK)  # not so for root
    SG.create(make_entries(spark, [{"name": "own", "content": "mine"}]), root)
    got = SY.sync(spark, home, root, blobs, NOW, direct=100, warn=200)
    assert got == {"absorbed": 4 - unreadable, "observed": 2, "failed": int(unreadable), "mode": "selective"}
    assert not any(map(os.path.exists, drop)) and os.path.exists(f"{home}/notes/a.md") and os.path.exists(locked) == unreadable
    e = {r["name"]: r for r in SG.read(spark, root).entries.collect()}
    assert e["observed/notes/a.md"]["content"] == "first note" and "54 Bytes" in e["observed/pic.png"]["content"]
    assert e["in.txt"]["content"] == "dropped text" and e["in.txt"]["pinned"]
    meta = {n: json.loads(e[n]["meta"]) for n in ("in.txt", "big.txt", "bericht.bin")}
    assert [meta[n]["storage"] for n in ("in.txt", "big.txt", "bericht.bin")] == ["inline", "halde", "inline"]
    assert "blob_path" not in meta["in.txt"] and meta["bericht.bin"]["original_name"] == "bericht.bin"
    with open(meta["bericht.bin"]["blob_path"], "rb") as f:
        assert f.read() == bytes(range(9)) and meta["bericht.bin"]["blob_hash"] == hashlib.sha256(bytes(range(9))).hexdigest()[:16]
    assert len(os.listdir(blobs)) == 2
    before = SG.commits.latest(spark, root)[0]
    again = SY.sync(spark, home, root, blobs, NOW, direct=100, warn=200)
    assert (again["absorbed"], again["observed"]) == (0, 2) and (unreadable or SG.commits.latest(spark, root)[0] == before)
    out = str(tmp_path / "out")
    SY.export(SG.read(spark, root).entries.filter("type = 'document' and name <> 'locked.txt' or name = 'own'"), out)
    assert {f: len(open(f"{out}/{f}", "rb").read()) for f in os.listdir(out)} == {"in.txt.md": 12, "big.txt": 300, "bericht.bin": 9, "own.md": 4}
    SY.sync(spark, home, root, blobs, NOW, mode="always_absorb")
    assert not os.path.exists(f"{home}/notes/a.md") and os.path.exists(f"{home}/config.json")


def test_line_files_are_those_of_a_partitioned_write(spark, tmp_path):
    import glob

    from knowspark.sources import transcripts as TR
    from knowspark.sources.file_sink import write_line_files
    rows = [("a/b:c", 1, 2, "second"), ("a/b:c", 1, 1, "first \u00e9"), ("a/b:c", 2, 1, ""), (None, 3, 1, None), ("", 4, 1, "x"), ("d e+f", None, 1, "y")]
    df = spark.createDataFrame(rows, "lang string, n long, at int, t string")
    write_line_files(df, ["lang", "n"], f"file:{tmp_path}/ours", "at")
    df.repartition("lang", "n").sortWithinPartitions("lang", "n", "at").select("lang", "n", "t").write.partitionBy("lang", "n").text(f"file:{tmp_path}/spark")

    def found(root):
        return {f.rsplit("/", 1)[0][len(f"{tmp_path}/{root}"):]: open(f, "rb").read() for f in glob.glob(f"{tmp_path}/{root}/*/*/*.txt")}

    assert found("ours") == found("spark") and len(found("ours")) == 5
    lines = TR.read_lines(spark, [f"{tmp_path}/ours"], below="*.txt").filter("display_path like '%n=1/%'")
    assert sorted((r.line_no, r.value) for r in lines.collect()) == [(1, "first \u00e9"), (2, "second")]


def test_a_scan_walks_the_folders_once(spark, tmp_path):
    from knowspark.sources import files as FI
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s.jsonl").write_text('{"session_id": "s", "text": "hello"}\n')
    items, new = FI.scan_transcripts(FI.listing(spark, str(tmp_path / "in")), spark.createDataFrame([], FI.STATE), "x", "codex")
    (tmp_path / "in" / "s.jsonl").unlink()  # what comes later is of no matter to this scan
    assert [r.content for r in items.collect()] == ["hello"] and new.count() == 1
    assert "file_tree" not in items._jdf.queryExecution().toString() + new._jdf.queryExecution().toString()
