"""Cases that earlier versions of the corpus operators got wrong."""

import random

import brute
import numpy as np
from pyspark.sql import functions as F

from knowspark.llm import decontam, minhash, quality, toxicity, urls

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))


def test_benchmark_items_without_id_and_long_ones_are_found(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PIECE", 3_000)
    monkeypatch.setattr(decontam, "OVERLAP", 500)
    r = random.Random(1)
    nameless, long, other = prose(r, 15), prose(r, 3_000), prose(r, 15)
    bench = spark.createDataFrame([(None, nameless), (5, long), (6, other), (None, None)], "item_id long, text string")
    quotes = [long[a: a + 300] for a in range(0, len(long) - 300, 1_150)]
    docs = [(1, "before " + nameless + " after"), (2, other), (3, prose(r, 200))] + [(10 + k, f"it says {q} there") for k, q in enumerate(quotes)]
    for most in (decontam.MAX_BLOCK, 9_000):
        monkeypatch.setattr(decontam, "MAX_BLOCK", most)
        blocks = list(decontam.blocks(bench, most))
        assert (len(blocks) > 1) == (most < 10_000)
        monkeypatch.setattr(decontam, "blocks", lambda b, blocks=blocks: iter(blocks))
        got = {(x["doc_id"], x["item_id"]) for x in decontam.leaks(spark.createDataFrame(docs, SCHEMA), bench).collect()}
        assert got == {(1, None), (2, 6)} | {(10 + k, 5) for k in range(len(quotes))}
        assert [x["doc_id"] for x in decontam.clean(spark.createDataFrame(docs, SCHEMA), bench).collect()] == [3]
        monkeypatch.undo()
        monkeypatch.setattr(decontam, "PIECE", 3_000)
        monkeypatch.setattr(decontam, "OVERLAP", 500)


def test_every_document_against_every_short_item(spark):
    """All pairs by the plain edit distance, with nothing taken from the index."""
    r = random.Random(2)
    items = [(k, prose(r, 14)[:95]) for k in range(12)]
    docs = []
    for d in range(60):
        text = list(r.choice(items)[1])
        for _ in range(r.randint(0, 14)):
            k = r.randrange(len(text))
            text[k: k + 1] = r.choice(["", "q", text[k] + "q"])
        docs.append((d, prose(r, r.randint(0, 20)) + " " + "".join(text) + " " + r.choice([prose(r, 5), r.choice(items)[1]])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontam.leaks(spark.createDataFrame(docs, SCHEMA), bench).collect()}
    want = {(d, i) for d, t in docs for i, x in items if brute.distance_in(x, t) <= len(x) * decontam.BUDGET // 100}
    assert got == want and 60 < len(want) < 400


def test_quality_leaves_other_columns_alone_and_names_rules_in_a_fixed_order(spark):
    rows = [(1, "SHOUT " * 12 + "#" * 200 + " two words more to say than this " * 2), (2, "plain words " + prose(random.Random(3), 30)), (3, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("_w", "_l", "_h", "_g", "_rep", "_s", "_p")})
    got = {x["doc_id"]: x for x in quality.quality(df).collect()}
    assert all(x[c] == "mine" for x in got.values() for c in ("_w", "_l", "_h", "_g", "_rep", "_s", "_p"))
    assert got[3]["rejected_by"] == "base" and got[2]["kept"] and got[2]["rejected_by"] is None
    sample = quality.features(df)
    orders = {tuple(x[0] for x in quality.order_rules(sample, quality.rules(), quality.work())) for _ in range(3)}
    assert len(orders) == 1
    costs = {name: cost for name, cost, _ in quality.order_rules(sample, quality.rules(), quality.work())}
    assert costs["shouting"] > costs["symbols"] == 1


def test_urls_replace_their_columns_and_keep_others(spark):
    df = spark.createDataFrame([("https://example.com/en/x", "a", "b", "c", "d", "e", "f")],
                               "url string, rule string, verdict string, _lead string, _rest string, _raw string, _b string")
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    got = urls.judge(df, rules)
    assert sorted(got.columns) == sorted(["url", "_lead", "_rest", "_raw", "_b", "host", "path", "rule", "verdict"])
    r = got.first()
    assert (r["rule"], r["verdict"], r["_lead"], r["_rest"], r["_raw"], r["_b"]) == ("example.com/en/", "block", "c", "d", "e", "f")


def test_neighbour_words_are_whole_however_long_or_far(spark):
    from knowspark.llm import pii

    long, far = "w" * 90, " " * 70
    text = f"start {long}{far}a@b.cd{far}{long}z end x@y.zz\n{long} tail"
    _, spans = pii._spans(spark.createDataFrame([(1, text), (2, "a@b.cd"), (3, f"one two {'q' * 39} a@b.cd, {'r' * 39}")], SCHEMA))
    got = {(r["doc_id"], r["value"]): (r["left"], r["right"]) for r in spans.filter("kind = 0").collect()}
    assert got == {(1, "a@b.cd"): (long, long + "z"), (1, "x@y.zz"): ("end", long), (2, "a@b.cd"): ("", ""),
                   (3, "a@b.cd"): ("q" * 39, ",")}


def test_signatures_of_many_sets_are_those_of_each():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 1 << 63, n).astype(np.uint64)) for n in (3, 0, 1, 40, 0, 17, 5, 0)]
    off = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    for chunk in (1, 2, 7, 64, 1 << 16):
        got = minhash.signatures(np.concatenate(sets), off, 12, chunk)
        for x, row in zip(sets, got):
            s = minhash.sigma((x >> np.uint64(32)).astype(np.uint32))
            assert row.tolist() == [int(minhash.pi(s - np.uint32(k)).min()) if len(x) else 0 for k in range(12)]


def test_maxima_in_blocks_are_those_of_whole_texts(monkeypatch):
    m = toxicity.Model()
    m.bias = [np.random.default_rng(k).normal(0, 0.1, toxicity.FILTERS).astype(np.float32) for k in range(len(m.bias))]
    texts = [b"", b"a", b"one two", b"x " * 50, b"", b"the end of it", "dö 1 b".encode(), b""]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    ids, at, _ = toxicity.words(np.frombuffer(b"".join(texts), np.uint8), off)
    want = m._pooled(ids, at, False)[0]
    for block in (1, 2, 5, 4096):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        assert np.allclose(m._maxima(ids, at), want, rtol=1e-5, atol=1e-6)
    assert not m._maxima(ids[:0], np.zeros(3, np.int64)).any()
