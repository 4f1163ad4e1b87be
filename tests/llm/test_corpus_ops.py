"""Each corpus operator against its plain version, and on nulls, empty tables, ties, repeats and clashing columns."""

import hashlib
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from knowspark.llm import bpe, chat, decontam, kernel, lines, minhash, mph, pii, quality, token_counts, toxicity, urls
from knowspark.llm.transducer import Transducer

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def table_rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def random_texts(n, alphabet, seed=1, most=30):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, most))) for _ in range(n)]


# -- 1
@pytest.mark.parametrize("words", [2, 5])
def test_minhash_components_match_all_pairs(spark, words):
    rows = table_rows(spark)
    r = random.Random(words)
    for k in range(40):  # a chain of small edits: ends are far apart, neighbours are linked
        base = rows[3][1].split() if k == 0 else base
        base = base[:]
        base[r.randrange(len(base))] = f"edit{k}"
        rows.append((10_000 + k, " ".join(base)))
    rows += [(20_000, None), (20_001, ""), (20_002, " \t\n"), (20_003, "one"), (20_004, "ONE"), (20_005, "one two"), (20_006, "one  TWO"),
             (20_007, "\u0130 x"), (20_008, "i\u0307 x")]
    want = brute.components(rows, words)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in minhash.near_duplicates(frame(spark, rows), words).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_far_members_of_a_group_are_linked_where_they_should(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 8)
    r = random.Random(32)
    base = [f"w{r.randrange(5000)}" for _ in range(90)]
    passage = [f"p{k}" for k in range(40)]
    rows = []
    for i in range(60):  # copies with more or fewer own words, cut ones, and ones that share a passage or another's changes
        kind = i % 4
        x = base[:]
        for _ in range(r.randrange(2, 14)):
            x[r.randrange(len(x))] = f"own{r.randrange(60)}"
        if kind == 1:
            x = base[:r.randrange(55, 90)]
        elif kind == 2:
            x = x[:50] + passage + x[50:]
        elif kind == 3 and i > 20:
            x = rows[r.randrange(len(rows))][1].split()
            x[r.randrange(len(x))] = f"new{i}"
        rows.append((i, " ".join(x)))
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(frame(spark, rows), 2).collect()}
    assert got == {i: c for i, (_, c) in brute.components(rows, 2).items()}


def test_minhash_edges(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    rows = [(None, "a b c"), (5, "a b c"), (7, "a b c"), (7, "a b c"), (9, "x y z"), (9, "a b c")]
    got = sorted((x["doc_id"] or -1, x["component_id"], x["kept"]) for x in minhash.near_duplicates(frame(spark, rows), 2).collect())
    assert got == [(-1, None, True), (5, 5, True), (7, 5, False), (7, 5, False), (9, 5, False), (9, 5, False)] or \
        got == [(-1, None, True), (5, 5, True), (7, 5, False), (7, 5, False), (9, 5, False), (9, 9, True)]


def test_minhash_is_circulant():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 50).astype(np.uint64))
    s = minhash.sigma((x >> np.uint64(32)).astype(np.uint32))
    want = [int(minhash.pi(s - np.uint32(k)).min()) for k in range(minhash.ROWS * minhash.BANDS)]
    assert minhash.signature(x, chunk=7).tolist() == want
    every = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65537)
    assert len(np.unique(minhash.sigma(every))) == len(every) == len(np.unique(minhash.pi(every.copy())))


def test_large_group_of_near_copies_needs_few_pairs(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(base + [f"own{i}"])) for i in range(400)]
    got = minhash.near_duplicates(frame(spark, rows), 2)
    assert {x["component_id"] for x in got.collect()} == {0}


# -- 2 and 6
ODD = ["'", "'s", "'RE", " ", "  ", "\n", "\t", "\u00c9", "\u65e5\u672c", "1", "\u0663", "\u00bd", "!", "?!", "<|endoftext|>", "<|endo", "text|>", "the",
       "\U0001f600", "e\u0301", "\u00a0", "\x1c", "\x85", "\ua7cbA", "a", "\u0130", "\u03a3", "\ud55c", "\u0149", "\u200b", "\x00"]


def test_token_counts_match_the_library():
    t = bpe.tokenizer(token_counts.VOCABULARY)
    texts = random_texts(1500, ODD) + [None, "", "a" * 5000, " " * 300, "ab c" * 3000]
    want = [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    buf, off = kernel.utf8(pa.array(texts, pa.string()))
    for most in (400, token_counts.SLICE):
        assert token_counts.counts(buf, off, token_counts.VOCABULARY, most).tolist() == want


def test_transducer_with_few_states_counts_the_same():
    small = Transducer(bpe.vocabulary_path(token_counts.VOCABULARY), limit=300)
    t = bpe.tokenizer(token_counts.VOCABULARY)
    words = [w for w in random_texts(400, "abcdethinro", most=25) if w] + ["etaoin" * 400]
    codes = [c for w in words for c in [256 + ord(w[0]), *map(ord, w[1:])]] + [512]
    assert int(small.count(np.array(codes, np.int16)).sum(dtype=np.int64)) == sum(len(t.encode(w).ids) for w in words)


def test_token_counts_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "x"), (2, None)]
    got = sorted((x["doc_id"] or -1, x["n_bytes"], x["n_tokens"], x["over_limit"]) for x in token_counts.token_counts(frame(spark, rows), limit=1).collect())
    assert got == [(-1, 1, 1, False), (1, 3, 2, True), (1, 3, 2, True), (2, 0, 0, False)]
    assert token_counts.token_counts(frame(spark, [])).count() == 0


def test_bpe_matches_the_library_and_round_trips(spark):
    t = bpe.tokenizer(bpe.VOCABULARY)
    texts = random_texts(1200, ODD, 2) + [None, "", "a" * 20000]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    got = bpe.encode(frame(spark, rows), block_bytes=3000).collect()
    assert len(got) == len(rows)
    for x in got:
        text = texts[x["doc_id"]] or ""
        ids = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(bytes(x["ids"]), "<u4").tolist() == ids and x["n_tokens"] == len(ids)
        assert x["decoded"] == t.decode(ids, skip_special_tokens=False) == text
        assert x["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and x["decoded_sha256"] == brute.sha(text)
    assert bpe.encode(frame(spark, [])).count() == 0
    assert bpe.encode(frame(spark, [(None, "x"), (4, "")])).count() == 2


def test_bpe_keeps_blocks_of_equal_ids_apart(spark):
    for texts in (["foo", "bar"], ["one two", "two one"]):  # a partition each
        df = spark.createDataFrame(spark.sparkContext.parallelize([(None, t) for t in texts], 2), SCHEMA)
        assert sorted(x["decoded"] for x in bpe.encode(df).collect()) == sorted(texts)


def test_word_positions_round_trip():
    r = np.random.default_rng(3)
    freq = np.sort(r.zipf(1.3, 50_000) % 70_000)
    _, first, inv = np.unique(freq, return_index=True, return_inverse=True)
    order = np.concatenate([np.arange(bpe.FREQUENT), bpe.FREQUENT + np.argsort(first[bpe.FREQUENT:])])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    assert (bpe._unzip_words(bpe._zip_words(rank[inv].astype(np.uint32))) == rank[inv]).all()
    big = np.append(np.arange(1_000_300), [1_000_299, 5, 999_999]).astype(np.uint32)
    assert (bpe._unzip_words(bpe._zip_words(big)) == big).all()


# -- 3
def test_decontamination_matches_edit_distance(spark):
    r = random.Random(5)
    items = [(r_["item_id"], r_["text"]) for r_ in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = []
    for k, (item, text) in enumerate(items[:30]):
        chars = list(" ".join(text.lower().split()))
        for _ in range(k % 30 * len(chars) // 100):
            chars[r.randrange(len(chars))] = r.choice("qxz")
        docs.append((k, f"Some words before. {''.join(chars)}\nand after"))
    index = decontam.Index(items)
    got = {(x["doc_id"], x["item_id"]) for x in decontam.leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, text in docs:
        t = " ".join(text.lower().split())
        for u, item, k in zip(index.units, index.item, index.edits):
            if item == items[i][0] and len(u) == len(" ".join(items[i][1].split())):
                assert ((i, int(item)) in got) == (brute.distance_in("".join(map(chr, u)), t) <= k), (i, item)


def test_decontamination_spans_and_edges(spark):
    item = "The quick brown fox jumps over the lazy dog and runs to the far end of the field."
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny")], "item_id long, text string")
    text = "\u00c9t\u00e9 x. " + item.upper().replace(" ", "  \n") + " end"
    rows = [(1, text), (1, text), (None, item), (2, None), (3, ""), (4, "nothing of it here")]
    got = sorted(((x["doc_id"] or -1), x["item_id"], x["start"], x["end"], x["edits"]) for x in decontam.leaks(frame(spark, rows), bench).collect())
    assert got == [(-1, 1, 0, len(item), 0)] + 2 * [(1, 1, 7, len(text) - 4, 0)]
    kept = decontam.clean(frame(spark, rows).withColumn("item_id", F.lit("mine")), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4] and kept.columns == ["doc_id", "text", "item_id"]
    assert decontam.leaks(frame(spark, []), bench).count() == 0
    assert decontam.leaks(frame(spark, rows), bench.limit(0)).count() == 0 and decontam.clean(frame(spark, rows), bench.limit(0)).count() == 6


def test_decontamination_finds_every_quote_of_a_stated_length(spark):
    r = random.Random(9)
    least = decontam.SHORT * 3 // 2
    items = [(n, "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))) for n in (101, 149, 150, 201, 290, 310, 390, 1001)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = {}
    for n, text in items:
        for size in (least, 200, 250):
            for a in {0, 25, 50, n - size}:
                if a >= 0 and a + size <= n:
                    docs[len(docs)] = (n, text[a: a + size])
    rows = [(k, f"12345 {q} 67890") for k, (_, q) in docs.items()] + [(-1, "12345 nothing of it 67890"), (-2, items[4][1][:60])]
    got = {(x["doc_id"], x["item_id"]) for x in decontam.leaks(frame(spark, rows), bench).collect()}
    assert got == {(k, n) for k, (n, _) in docs.items()}
    whole = decontam.leaks(frame(spark, [(1, "x " + items[4][1])]), bench).collect()
    assert [(x["item_id"], x["start"], x["end"], x["edits"]) for x in whole] == [(290, 2, 292, 0)]
    # as many edits as the item as a whole allows, wherever they are
    edited = []
    for n, text in items[:5]:
        for k in range(6):
            chars = list(text)
            for i in r.sample(range(n), n // 10) if k else range(n // 10):
                chars[i] = "0"
            edited.append((10 * n + k, "".join(chars)))
    got = {(x["doc_id"], x["item_id"]) for x in decontam.leaks(frame(spark, edited), bench).collect()}
    assert got == {(k, k // 10) for k, _ in edited}


def test_decontamination_in_blocks(spark):
    items = [(i, f"item number {i} " + " ".join(f"word{i * k}" for k in range(20))) for i in range(1, 30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(decontam.blocks(bench, 900))) > 3
    assert sorted(i for b in decontam.blocks(bench, 900) for i in set(b.item.tolist())) == list(range(1, 30))


# -- 4
def test_line_dedup_matches_plain_version(spark):
    rows = [r for r in table_rows(spark)]
    alphabet = ["This line repeats\n", " this LINE repeats \t\n", "short\n", "\n", "a line of its own ", "\u00e9\u00e9\u00e9\u00e9\u00e9\u00e9\u00e9\u00e9\u00e9\n",
                "\u00c9\u00e9\u00e9\u00e9\u00e9\u00e9\u00e9\u00e9\u00e9\u00e9\r\n", "\x1cunit separated line\n"]
    rows += [(5000 + i, t) for i, t in enumerate(random_texts(300, alphabet, 3, 12))] + [(6000, None), (6001, ""), (-5, "this line repeats")]
    want = brute.lines(rows)
    got = lines.line_dedup(frame(spark, rows)).collect()
    assert {x["doc_id"]: (x["n_lines"], x["n_dropped"], x["text"] or "") for x in got} == want
    assert [x["text"] for x in got if x["doc_id"] == 6000] == [None]


def test_line_dedup_edges(spark):
    line = "one and the same line"
    df = frame(spark, [(None, line), (3, line), (3, line), (8, line + "\nrest"), (8, line)]).withColumns(
        {"drops": F.lit(1), "doc": F.lit(2), "n_lines": F.lit("old")})
    got = sorted((x["doc_id"] or -1, x["text"], x["n_lines"], x["n_dropped"], x["drops"], x["doc"]) for x in lines.line_dedup(df).collect())
    assert got == [(-1, line, 1, 0, 1, 2), (3, line, 1, 0, 1, 2), (3, line, 1, 0, 1, 2), (8, "", 1, 1, 1, 2), (8, "rest", 2, 1, 1, 2)]
    assert lines.line_dedup(frame(spark, [])).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 30_000).astype(np.uint64))
    for x in (keys, keys[:1], keys[:0], np.append(keys[:5], keys[:5])):
        h = mph.MinimalPerfectHash.loads(mph.MinimalPerfectHash(x).dumps())
        at = h(np.unique(x))
        assert len(np.unique(at)) == len(np.unique(x)) and (at >= 0).all() and (at < max(len(h), 1)).all()


# -- 5
def test_base_spans_match_plain_version(spark, tmp_path):
    alphabet = ["a@b.c", "_d@e.f", ".", "+", "1", "22", "255", "256", "1.2.3.4", ".5", "4111 1111 1111 1111", "+1 (555) 555-0199", " ", "\u00e9",
                "\U0001f600", "@", "x", "-", "(", "%", "0001.2.3.004", "\n", "9999999999999995"]
    texts = random_texts(800, alphabet, 4, 20) + [None, "", "a." * 20000, "1" * 20000, "a@" + "b.c" * 9000, "+1" + "(" * 20000]
    spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.query(spark, str(tmp_path)).collect()
    assert len(got) == len(texts) + 1
    for x in got:
        base = brute.pii(texts[x["doc_id"]])
        shown = ",".join(f"{n}:{a}:{e}" for a, _, e, n in base)
        assert [x[f"n_{k}"] for k in pii.KINDS] == [sum(b[3] == k for b in base) for k in pii.KINDS]
        assert x["base_sha256"] == brute.sha(shown) and set(shown.split(",")) <= set(x["spans"].split(","))


def test_patterns_discover_unseen_identifiers(spark):
    good = ["4111111111111111", "5500000000000004", "6011000000000004", "4000000000000002", "4012888888881881", "5105105105105100"]
    rows = [(i, f"please pay with card {c} before monday") for i, c in enumerate(good)]
    rows += [(50, "please pay with card 4111111111111112 before monday"), (51, "sum 4111111111111112 again"), (52, "total 1234567890123456 only")]
    got = {x["doc_id"]: [(s["kind"], s["base"]) for s in x["spans"]] for x in pii.personal_data(frame(spark, rows)).collect()}
    assert got[50] == got[51] == [(2, False)] and got[52] == [] and all(got[i] == [(2, True)] for i in range(len(good)))


def test_patterns_discover_forms_that_the_base_misses(spark):
    rows = [(i, f"please call +1 555 123 {4000 + i} before monday") for i in range(20)]
    rows += [(50, "please call (555) 555-0199 before monday"), (51, "please call 5551234567 before monday"), (52, "so (555) 555-0199 again"),
             (53, "sold 5559876543 pieces"), (54, "10.0.0.1 5551234567 2024 x")]
    # a chain of contexts, each made confident by the round before: more rounds than two
    rows += [(100 + i, f"ring +1 555 123 {6000 + i} soon") for i in range(130)]
    words = [("ring", "soon"), ("ask", "today"), ("try", "later"), ("dial", "twice")]
    number = lambda k, i: f"{7000 + k}-{9000 + i}"
    for k, n in enumerate((32, 8, 2)):
        rows += [(1000 * (k + 1) + 10 * i + c, f"{words[c][0]} {number(k, i)} {words[c][1]}") for i in range(n) for c in (k, k + 1)]
    got = {x["doc_id"]: [(s["kind"], s["start"], s["end"], s["base"]) for s in x["spans"]] for x in pii.personal_data(frame(spark, rows)).collect()}
    assert got[50] == [(3, 12, 26, False)] and got[51] == [(3, 12, 22, False)] and got[52] == [(3, 3, 17, False)]
    assert got[53] == [] and got[54] == [(1, 0, 8, True), (3, 9, 19, False)]
    assert all(len(got[1000 * (k + 1) + 10 * i + k]) == 1 for k, n in enumerate((32, 8, 2)) for i in range(n))


# -- 7
def test_url_rules(spark):
    cases = {"http://a.com/x": ("a.com", "/x", "com/", "allow"), "HTTPS://EXAMPLE.com/en/1?q#f": ("example.com", "/en/1", "example.com/en/", "block"),
             "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
             "x://m.www.example.com/en/a": ("m.www.example.com", "/en/a", "www.example.com/en/", "allow"),
             "http://wwwexample.com/en/a": ("wwwexample.com", "/en/a", "com/", "allow"), "http://a.net/es/": ("a.net", "/es/", "net/es/", "block"),
             "http://a.net/es": ("a.net", "/es", None, "allow"), "http://com": ("com", "", None, "allow"), "a.com/x": ("", "", None, "allow"),
             "http://a.net?x=/es/": ("a.net", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
             "http:///p": ("", "/p", None, "allow"), "http://a.com/x://b.net/es/": ("a.com", "/x://b.net/es/", "com/", "allow")}
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)] + [(0, "http://a.com/x"), (None, None)], "page_id long, url string").withColumn("prefix", F.lit(1))
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    got = urls.judge(df, rules).collect()
    assert len(got) == len(cases) + 2
    assert all((x["host"], x["path"], x["rule"], x["verdict"]) == cases[x["url"]] for x in got)
    assert {x["verdict"] for x in urls.judge(df, rules.limit(0), default="block").collect()} == {"block"}
    assert urls.judge(df.limit(0), rules).count() == 0


# -- 8
def test_toxicity_learns_and_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    bad = docs.withColumn("toxic", (F.col("doc_id") % 4 == 0).cast("int"))
    docs = bad.withColumn("text", F.when(F.col("toxic") == 1, F.concat("text", F.lit(" you awful wretch of awful"))).otherwise(F.col("text")))
    model = toxicity.fitted(docs, bad.select("doc_id", "toxic"), 150)
    got = toxicity.toxicity(docs, model).filter(toxicity.held_out(F.col("doc_id"))).agg(
        F.avg((F.col("predicted") == F.col("toxic")).cast("double")), F.min("score"), F.max("score")).first()
    assert got[0] > 0.97 and 0 <= got[1] and got[2] <= 1
    rows = frame(spark, [(1, None), (2, ""), (None, "awful")]).withColumn("score", F.lit("x"))
    out = toxicity.toxicity(rows, model)
    assert out.count() == 3 and dict(out.dtypes)["score"] == "double" and out.filter("score is null").count() == 0
    none = toxicity.fitted(docs, bad.limit(0).select("doc_id", "toxic"))
    assert toxicity.toxicity(docs, none).filter("score <> 0").count() == 0 and toxicity.toxicity(docs.limit(0), model).count() == 0


def test_toxicity_cuts_count_long_texts(spark, monkeypatch):
    def fit(self, texts, toxic):  # log-odds of the worst word: wretch 3, awful 0.2, bad 0, others -3
        self.emb[:], self.out[:], self.prior[:] = 0, 0, -3
        for f in self.filters:
            f[:] = 0
        self.filters[0][0, 0] = self.out[0] = 1
        for word, x in ((b"wretch", 6), (b"awful", 3.2), (b"bad", 3)):
            self.emb[toxicity.words(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0][0, 0], 0] = x

    monkeypatch.setattr(toxicity.Model, "fit", fit)
    kinds = [("the wretch", 1, 100), ("the bad", 1, 40), ("the day", 0, 100), ("the awful " + "day " * 6000, 0, 40)]
    rows = [(i, text, toxic) for i, (text, toxic) in enumerate((t, y) for t, y, n in kinds for _ in range(n))]
    docs = frame(spark, [r[:2] for r in rows])
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fitted(docs, labels)
    counts = toxicity.score_counts(docs, labels, model)
    used = labels.filter(~toxicity.held_out(F.col("doc_id"))).count()
    assert sum(x[-1] for x in counts) == used and {x[2] for x in counts if x[3]} == {0}
    got = {x["text"][:9]: x["predicted"] for x in toxicity.toxicity(docs, model).collect()}
    assert got == {"the wretc": 1, "the bad": 0, "the day": 0, "the awful": 0}


# -- 9
def test_chat_spans_and_round_trip(spark):
    r = random.Random(2)
    texts = random_texts(260, ["\\", "#", "<", "</turn>", "### user: ", ":", "\n", "a ", "\u00e9", "\\### "], 6, 12)
    rows = [(1, k, r.choice(["user", "assistant", "as:sis#t"]), t) for k, t in enumerate(texts[:200])]
    rows += [(2, 0, None, None), (2, None, "assistant", "first"), (None, 0, "user", "x"), (3, 1, "b", "t"), (3, 1, "a", "u"), (3, 1, "a", "u")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat.format_turns(df, window=16)
    got = {}
    for x in turns.collect():
        got.setdefault(x["conv_id"], []).append(x)
    for conv in (1, 2, 3, None):
        mine = sorted([(r_[1] if r_[1] is not None else -1, r_[2] or "", r_[3] or "") for r_ in rows if r_[0] == conv])
        have = sorted(got[conv], key=lambda x: x["turn_no"])
        formatted = "".join(x["added"] for x in have)
        assert formatted == chat.marked([m[1:] for m in mine]) and chat.read_back(formatted) == [m[1:] for m in mine]
        assert [chat.unescape(formatted[x["text_start"]: x["text_end"]]) for x in have] == [m[2] for m in mine]
        assert not any(x["rewritten"] for x in have)
    d = {x["conv_id"]: x for x in chat.digests(turns).collect()}
    assert d[1]["n_turns"] == 200 and d[1]["loss_sha256"] == brute.sha("".join(x[3] for x in rows[:200] if x[2] == "assistant"))
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


def test_chat_detects_rewritten_history():
    def newest_first(turns):
        return "".join(f"[{r}|{t}]" for r, t in reversed(turns))

    def opener(turns):
        return "<s>" + "".join(f"[{r}|{t}]" for r, t in turns)

    def numbered(turns):
        return "".join(f"[{k}|{t}]" for k, (_, t) in enumerate(turns))

    turns = [("u", f"t{k}") for k in range(20)]
    assert [x[3] for x in chat.located(turns, newest_first, 50)] == [False] + [True] * 19
    for template in (opener, numbered):  # the second one looks back to the beginning, the window must not cut it
        found = list(chat.located(turns, template, 4))
        whole = "".join(x[0] for x in found)
        assert whole == template(turns) and not any(x[3] for x in found)
        assert [x[0][x[1]:x[2]] for x in found] == [t for _, t in turns]


def test_chat_keeps_whole_prefixes_of_rewriting_templates():
    def thinks_once(turns):  # reasoning stays until the next user turn
        last = max((k for k, (r, _) in enumerate(turns) if r == "user"), default=-1)
        return "".join(f"[{r}|{t if k > last else t.split('~')[-1]}]" for k, (r, t) in enumerate(turns))

    def last_hundred(turns):
        return "".join(f"[{r}|{t}]" for r, t in turns[-100:])

    turns = [("user", f"q{k}") if k % 2 == 0 else ("assistant", f"why{k}~a{k}") for k in range(200)]
    for template, marks in ((thinks_once, [k > 0 and k % 2 == 0 for k in range(200)]), (last_hundred, [k >= 100 for k in range(200)])):
        whole, found = "", list(chat.located(turns, template))
        for k, (added, a, e, rewritten) in enumerate(found):
            whole = added if rewritten else whole + added
            assert whole == template(turns[: k + 1]) and (a < 0 or added[a:e] == turns[k][1])
        assert [x[3] for x in found] == marks


# -- 10
def test_quality_counts_match_plain_version(spark):
    texts = random_texts(600, ["a ", "b ", "a b c d e ", "x\n", "\n", "#", "<|> ", "\t", "\u00a0", "\u00c9 "], 7, 40) + [None, "", "w " * 3000, "line one here\n" * 50]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, "x y")]
    got = quality.quality(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for x in got:
        want = brute.quality(x["text"])
        assert tuple(x[c] for c in quality.FEATURES) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert x["base_failed"] == failed and not (failed and x["kept"])
    assert quality.quality(frame(spark, [])).count() == 0


def test_rules_are_ordered_by_rejection_per_cost(spark):
    sample = spark.range(100)
    rejects = {"never": F.col("id") < 0, "half": F.col("id") < 50, "odd_null": F.lit(None).cast("boolean")}
    order = quality.order_rules(sample, rejects)
    assert order[0][0] == "half" and order[0][2] == 0.5
    got = sample.select(quality.cascade(rejects, [x[0] for x in order]).alias("r")).groupBy("r").count().collect()
    assert {x["r"]: x["count"] for x in got} == {"half": 50, None: 50}
