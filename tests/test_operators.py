import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from knowspark.functions import paths as P
from knowspark.operators import entries as E
from knowspark.operators import memory as M
from knowspark.operators import redact as R
from knowspark.operators import refresh as RF

from entry_rows import make_entries

NOW = "2024-06-01 12:00:00"


def test_consolidate_forgets_unpinned_keeps_pinned(spark):
    meta = json.dumps({"weight": 0.06, "decay_rate": 0.5})
    e = make_entries(spark, [{"name": "a", "type": "memory", "meta": meta, "pinned": False},
                             {"name": "b", "type": "memory", "meta": meta, "pinned": True}])
    r = {x.name: x for x in M.consolidate(e, NOW).collect()}
    assert set(r) == {"a"} and r["a"].action == "forgotten"


def test_consolidate_three_cycles(spark):
    e = make_entries(spark, [{"name": "m", "type": "lesson", "meta": json.dumps({"weight": 0.9, "decay_rate": 0.5})}])
    w = 0.9
    for _ in range(3):
        r = M.consolidate(e, NOW).collect()[0]
        w2 = w * 0.5
        assert r.action == ("forgotten" if w2 < 0.05 else "decayed")
        w = round(w2, 4)
        e = e.withColumn("meta", F.lit(json.dumps({"weight": w, "decay_rate": 0.5})))
    stats = M.consolidate_stats(M.consolidate(e, NOW)).collect()[0]
    assert stats.decayed + stats.forgotten + stats.kept == 1


def test_retention_curve_of_rows_without_weight(spark):
    e = make_entries(spark, [{"name": n, "type": "memory", "meta": json.dumps({"weight": w, "decay_rate": 0.5})}
                             for n, w in (("zero", 0.0), ("less", -0.5), ("some", 0.5))])
    assert {r.name: r.forget_cycle for r in M.retention_curve(e).collect()} == {"zero": 1, "less": 1, "some": 4}


def test_broken_meta_reads_as_empty(spark):
    e = make_entries(spark, [{"name": "x", "type": "memory", "meta": "{broken", "content": "recall me"}])
    r = M.consolidate(e, NOW).collect()[0]
    assert r.weight == round(0.5 * 0.95, 4)


def test_task_priority_order(spark):
    rows = [{"name": f"t/{p}", "type": "task", "meta": json.dumps({"status": "open", "priority": p})}
            for p in ["low", "critical", "normal", "high"]]
    t = M.tasks(make_entries(spark, rows), "open").orderBy(F.desc("prio_rank"), F.desc("updated"))
    assert [x.name for x in t.collect()] == ["t/critical", "t/high", "t/normal", "t/low"]


def test_task_done_only_for_tasks(spark):
    e = make_entries(spark, [{"name": "t", "type": "task", "meta": '{"status":"open","priority":"high"}'},
                             {"name": "k", "type": "knowledge"}])
    u = spark.createDataFrame([("t", "done"), ("k", "done"), ("none", "done")], "name string, status string")
    r = M.tasks_update(e, u, NOW).collect()
    assert [x.name for x in r] == ["t"] and r[0].done_at == "2024-06-01T12:00:00"
    assert json.loads(r[0].meta)["priority"] == "high"


def test_upsert_keeps_id_and_created(spark):
    cur = make_entries(spark, [{"name": "a", "id": 7, "content": "old", "created": datetime(2023, 1, 1)}])
    ch = spark.createDataFrame([("a", "knowledge", "new", "", "{}", False, "user"),
                                ("b", "memory", "x", "", "{}", False, "auto")],
                               "name string, type string, content string, tags string, meta string, "
                               "pinned boolean, target string")
    out = {r.name: r for r in E.upsert(cur, ch, NOW).collect()}
    assert out["a"].id == 7 and out["a"].content == "new" and out["a"].created == datetime(2023, 1, 1)
    assert out["b"].store == "user" and out["b"].created == datetime(2024, 6, 1, 12)


def test_delete_prefers_user_store(spark):
    cur = make_entries(spark, [{"name": "k", "store": "user"}, {"name": "k", "store": "system", "id": 2}])
    after, victims = E.delete_names(cur, spark.createDataFrame([("k",)], "name string"))
    assert [r.store for r in victims.collect()] == ["user"] and after.count() == 1


POSITIVE = [
    "sk-ant-api03-" + "a" * 93 + "AA", "sk-proj-" + "b" * 24 + "T3BlbkFJ" + "c" * 24,
    "sk-" + "d" * 20 + "T3BlbkFJ" + "e" * 20, "ghp_" + "f" * 36, "github_pat_" + "g" * 22 + "_" + "h" * 59,
    "AKIA" + "Q" * 16, "xoxb-" + "1" * 24, "AIza" + "k" * 35, "glpat-" + "m" * 20, "npm_" + "n" * 36,
    "Authorization: Bearer " + "p" * 32,
    "-----BEGIN RSA PRIVATE KEY-----\n" + "q" * 40 + "\n-----END RSA PRIVATE KEY-----",
]
NEGATIVE = ["sketch", "ghp_ or gho_ prefixes", "AKIA is a prefix", "AIzawa", "the bearer of news", "sk-1234",
            "npm_install_twice", "digest 00ff11ee22dd33cc"]


def test_redaction_positives_and_lookalikes(spark):
    rows = [(i, f"before {t} after") for i, t in enumerate(POSITIVE + NEGATIVE)]
    df = R.redact(spark.createDataFrame(rows, "i int, text string"), "text", "fams")
    got = {r.i: r for r in df.collect()}
    for i in range(len(POSITIVE)):
        assert R.REDACTION_MARKER in got[i].text and len(got[i].fams) == 1, POSITIVE[i]
    for i in range(len(POSITIVE), len(rows)):
        assert got[i].text == rows[i][1] and got[i].fams == []


def test_bearer_headers_in_odd_letters_are_masked(spark):
    value = "p" * 32
    heads = ["author\u0131zation: bearer ", "AUTHOR\u0130ZATION:BEARER ", "authori\u017fation: x", "Authorization\u00a0: Bearer\u2003"]
    df = R.redact(spark.createDataFrame([(i, h + value) for i, h in enumerate(heads)], "i int, text string"), "text", "fams")
    got = {r.i: (value not in r.text, r.fams) for r in df.collect()}
    raw = spark.createDataFrame([(i, h + value) for i, h in enumerate(heads)], "i int, text string")
    want = {r.i: r.hit for r in raw.select("i", F.col("text").rlike(R.ANY_SECRET).alias("hit")).collect()}
    assert {i: x[0] for i, x in got.items()} == want and want[0] and not want[2]


def test_prefilter_passes_every_match(spark):
    # of the letters of "bearer" no code point beyond ASCII is a case variant
    odd = spark.createDataFrame([(chr(c),) for c in range(0x80, 0x30000) if not 0xD800 <= c <= 0xDFFF], "c string")
    assert odd.filter(F.col("c").rlike("(?U)(?i)^[bear]$")).count() == 0
    # all families, in random surroundings and case where the pattern ignores it
    import random
    r = random.Random(3)
    texts = []
    for k in range(400):
        p = POSITIVE[k % len(POSITIVE)]
        if p.startswith("Authorization"):
            p = "".join(r.choice([c.lower(), c.upper()]) for c in p)
        texts.append(("".join(r.choice("ab \n:-_\u0131\u0130") for _ in range(r.randint(0, 9))) + " " + p + " x",))
    df = spark.createDataFrame(texts, "t string")
    assert df.filter(F.col("t").rlike(R.ANY_SECRET) & ~R.maybe_secret("t")).count() == 0


def test_each_pattern_runs_once_and_behind_its_anchors(spark):
    texts = [(k, f"x {p} y {POSITIVE[k - 1]} z") for k, p in enumerate(POSITIVE)]
    df = spark.createDataFrame(texts, "i int, t string")
    for family, pattern in R.SECRET_PATTERNS:
        assert df.filter(F.col("t").rlike("(?U)" + pattern) & ~R.may_hold("t", family)).count() == 0
    red = R.redact(df, "t", "fams")
    assert all(len(r.fams) == 2 and r.t.count(R.REDACTION_MARKER) == 2 for r in red.collect())
    found = R.findings(red.withColumn("p", F.col("i").cast("string")), "p", "fams")
    for q in (red, found):
        plan = q._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace(") <= len(R.FAMILIES) and plan.count("RLIKE") <= len(R.FAMILIES)
    assert found.count() == 2 * len(POSITIVE)


def test_redaction_idempotent(spark):
    df = spark.createDataFrame([(0, "x " + POSITIVE[3])], "i int, text string")
    once = R.redact(df, "text", "f").select("i", "text")
    twice = R.redact(once, "text", "f")
    assert twice.collect()[0].f == [] and twice.collect()[0].text == once.collect()[0].text


def test_alerts_only_new_cloud_pairs(spark):
    found = spark.createDataFrame([("/cloud/a.md", "npm-token"), ("/local/b.md", "npm-token"),
                                   ("/cloud2/c.md", "npm-token")], "path string, family string")
    existing = spark.createDataFrame([], "path string, family string")
    new = R.alert_new(found, existing, "/cloud")
    assert [r.path for r in new.collect()] == ["/cloud/a.md"]
    assert R.alert_new(found, existing.unionByName(new), "/cloud").count() == 0


BAD = ["D:\\work\\Credentials\\notes.md", "u/.KnowSpark/index.db", "/home/u/.ssh/config", "a/.git/HEAD", "x/node_modules/y.js",
       "p/.env", "keys/server.PEM", "id_rsa", "a/__pycache__/m.pyc", "v/.venv/lib.py", "s/secrets.json", "k/a.key"]
GOOD = ["docs/credentials-howto.md", "notes/a.md", "x/.envrc", "tokenizer.py"]


def test_cloud_paths_are_resolved(spark):
    found = spark.createDataFrame([("/local/../cloud/x", "f"), ("/cloud/../local/y", "f"), ("/cloud/./a//b", "f"), ("\\cloud\\w", "f"),
                                   ("/../cloud", "f")], "path string, family string")
    none = spark.createDataFrame([], "path string, family string")
    assert sorted(r.path for r in R.alert_new(found, none, "/cloud/").collect()) == ["/../cloud", "/cloud/./a//b", "/local/../cloud/x", "\\cloud\\w"]


def test_never_index_paths(spark):
    df = spark.createDataFrame([(p,) for p in BAD + GOOD], "path string")
    got = {r.path: r.x for r in df.select("path", P.is_excluded("path").alias("x")).collect()}
    assert all(got[p] for p in BAD) and not any(got[p] for p in GOOD)


def test_internal_paths(spark):
    paths = [".absorber/x.txt", "sub/__pycache__/x.pyc", "config.json",
             ".absorber-notes.txt", ".outputs/x.txt", "sub/config.json"]
    df = spark.createDataFrame([(p,) for p in paths], "rel string")
    got = [r.x for r in df.select(P.is_internal("rel").alias("x")).collect()]
    assert got == [True, True, True, False, False, False]


def test_safe_filename(spark):
    df = spark.createDataFrame([("../../../evil.txt",), ("/abs/path/x.md",), ("C:\\a\\b.bin",), ("..",)], "v string")
    got = [r.f for r in df.select(P.safe_filename("v", "fallback").alias("f")).collect()]
    assert got == ["evil.txt", "x.md", "b.bin", "fallback"]


def test_refresh_is_idempotent(spark):
    items = spark.createDataFrame([("s", "k1", "observed/s/1", "text", "t", "{}", "fp1", None)],
                                  "source_id string, key string, name string, content string, tags string, "
                                  "meta string, fingerprint string, source_path string")
    cur = make_entries(spark, [{"name": "other"}])
    d1 = RF.refresh_diff(items, cur)
    assert [r.action for r in d1.collect()] == ["insert"]
    kinds = spark.createDataFrame([("s", "markdown_dir")], "source_id string, kind string")
    cur2 = E.upsert(cur, RF.refresh_changes(d1, kinds), NOW)
    assert [r.action for r in RF.refresh_diff(items, cur2).collect()] == ["skip"]


def test_writes_keep_json_types_and_one_row_a_key(spark):
    schema = "source_id string, key string, name string, content string, tags string, meta string, fingerprint string, source_path string"
    nested = '{"source_ref":{"path":"p","line":3},"n":1.5,"list":[1,"a"],"source_id":"old"}'
    items = spark.createDataFrame([("s", "k", "observed/s/1", t, "", nested, t, None) for t in ("one", "two")], schema)
    kinds = spark.createDataFrame([("s", "markdown_dir")], "source_id string, kind string")
    out = RF.refresh(items, make_entries(spark, [{"name": "other"}]), kinds, NOW).filter("name <> 'other'").collect()
    assert len(out) == 1
    assert json.loads(out[0].meta) == {"source_ref": {"path": "p", "line": 3}, "n": 1.5, "list": [1, "a"], "source_id": "s",
                                       "source_kind": "markdown_dir", "source_fingerprint": out[0].content, "observed": True}


def test_snapshots_after_consolidate_boost_and_task_updates(spark):
    e = make_entries(spark, [
        {"name": "m", "type": "memory", "meta": '{"weight":0.8,"decay_rate":0.5,"x":{"y":1}}'},
        {"name": "gone", "type": "memory", "meta": '{"weight":0.06,"decay_rate":0.5}'},
        {"name": "sys", "store": "system", "type": "memory", "meta": '{"weight":0.06,"decay_rate":0.5}'},
        {"name": "t", "type": "task", "meta": '{"status":"open","due":"x","n":2}', "tags": "task,a", "pinned": True}])
    got = {r.name: r for r in M.consolidate_apply(e, NOW).collect()}
    assert set(got) == {"m", "sys", "t"}
    assert json.loads(got["m"].meta) == {"weight": 0.4, "decay_rate": 0.5, "x": {"y": 1}, "last_decay": "2024-06-01T12:00:00"}
    assert got["sys"].meta == '{"weight":0.06,"decay_rate":0.5}'
    boosts = e.filter("name = 'm'").select("store", "id").withColumn("n_boost", F.lit(3).cast("long"))
    m = {r.name: json.loads(r.meta) for r in M.boost_apply(e, boosts, NOW).collect()}["m"]
    assert m == {"weight": 1.0, "decay_rate": 0.5, "x": {"y": 1}, "accessed": 3, "last_accessed": "2024-06-01T12:00:00"}
    u = spark.createDataFrame([("t", "done")], "name string, status string")
    t = {r.name: r for r in M.tasks_apply(e, u, NOW).collect()}["t"]
    assert json.loads(t.meta) == {"status": "done", "due": "x", "n": 2, "done_at": "2024-06-01T12:00:00"}
    assert (t.type, t.pinned, t.tags, t.id) == ("task", True, "task,a", 4)


def test_blank_values_and_own_replica(spark):
    from knowspark.sources import table as TB

    df = spark.createDataFrame([(1, "\t\n", "text"), (2, "a", " ")], "i long, x string, y string")
    assert {r.key: r.content for r in TB.table_items(df, "s", "t", ["x", "y"], id="i").collect()} == {"1": "text", "2": "a"}
    with pytest.raises(ValueError):
        TB.replica_items({"here": df, "there": df}, "Here ", "r", "t", content="x", id="i")


def test_encoding_detection_with_built_ins(spark):
    from knowspark.operators import files as FL

    raw = ["\u00e9 \u4e2d".encode(), b"caf\xe9 \x93x\x94 \x80", b"\x81 \xe9", b"", bytes(range(0x80, 0x100))]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)] + [(9, None)], "i int, content binary")
    got = {r.i: (r.e.encoding, r.e.text) for r in df.select("i", FL.detect_encoding("content").alias("e")).collect()}
    assert got == {0: ("utf-8", raw[0].decode()), 1: ("cp1252", raw[1].decode("cp1252")), 2: ("latin-1", raw[2].decode("latin-1")),
                   3: ("utf-8", ""), 4: ("latin-1", raw[4].decode("latin-1")), 9: (None, None)}
    fixed = {r.i: r.content for r in FL.repaired(df).collect()}
    assert bytes(fixed[1]).decode() == raw[1].decode("cp1252")


def test_catalog_rejects_unknown_kind(spark):
    cat = spark.createDataFrame([], RF.CATALOG_SCHEMA)
    with pytest.raises(ValueError):
        RF.catalog_add(cat, spark.createDataFrame([("x", "nope", True, "{}")], RF.CATALOG_SCHEMA))


def test_scan_pending_rules(spark):
    files = spark.createDataFrame([("a", 10, 1), ("b", 20, 1), ("c", 5, 1), ("d", 7, 1)],
                                  "file_key string, size long, mtime long")
    state = spark.createDataFrame([("a", 10, 1, 3), ("b", 10, 1, 2), ("c", 9, 1, 4)],
                                  "file_key string, offset long, mtime long, line_no long")
    got = {r.file_key: (r.start_offset, r.start_line) for r in RF.scan_pending(files, state).collect()}
    assert got == {"b": (10, 2), "c": (0, 0), "d": (0, 0)}
