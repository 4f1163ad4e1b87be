"""Alignment, sharding and spelling variants against plain versions, and on nulls, empty tables, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from knowspark.llm import align, shards, spelling

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def table_rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# -- 11
def plain_alignment(rows):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    ta = Tokenizer.from_file(P.path(align.A_VOCABULARY))
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=P.path(align.B_VOCABULARY))
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    chars = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}

    def b_bytes(i):
        p = tb.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if tb.is_byte(i) else p.replace("▁", " ").encode()

    out, count, kept = [], Counter(), []
    for doc, text in rows:
        a = ta.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tb.encode(text) if text else []
        xa, xb = [bytes(chars[c] for c in ta.id_to_token(i)) for i in a], [b_bytes(i) for i in b]
        if text and not b"".join(xa) == b"".join(xb) == b" " + text.encode():
            a, b, xa, xb = [], [], [], []
        ea, eb = np.cumsum([len(x) for x in xa]).tolist(), np.cumsum([len(x) for x in xb]).tolist()
        both = sorted(set(ea) & set(eb))
        groups = ";".join(",".join(str(t) for t, e in zip(a, ea) if lo < e <= hi) + "|" + ",".join(str(t) for t, e in zip(b, eb) if lo < e <= hi)
                          for lo, hi in zip([0] + both, both)) if len(a) < 600 else None
        links, j = [], 0
        for i, (t, e) in enumerate(zip(a, ea)):
            s = e - len(xa[i])
            while j and eb[j - 1] > s:
                j -= 1
            while j < len(b) and eb[j] <= s:
                j += 1
            while j < len(b) and eb[j] - len(xb[j]) < e:
                links.append((t, b[j]))
                j += 1
        count.update(links)
        kept.append((doc, len(a), len(b), len(both), links, groups))
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [(d, na, nb, ng, len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
             None if g is None else hashlib.sha256(g.encode()).hexdigest() if g else "") for d, na, nb, ng, links, g in kept], count


def odd_texts():
    r = random.Random(11)
    alphabet = list("ab  \n\t\r.,'0189<>|_-") + ["é", "é", "▁", "　", "\U0001f600", "กำ", "中", "'s", " 're", "<s>", "</s>", "<unk>",
                                                "<0x0A>", "<|endoftext|>", "    ", "the ", "ing", "\x00", "�", "İ", "\xa0", "\x85"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(600)]


def test_alignment_matches_whole_texts(spark):
    rows = table_rows(spark)[:60] + [(10_000 + i, t) for i, t in enumerate(odd_texts())]
    rows += [(None, None), (None, "x y"), (1, ""), (2, " "), (2, " "), (3, "\n"), (4, "ab" * 30_000), (5, "x " * 5_000)]
    want, count = plain_alignment(rows)
    key = lambda x: tuple((v is None, v) for v in x[:7])
    for block_bytes in (1 << 24, 20_000):
        df = frame(spark, rows).withColumn("n_a", F.lit("mine")).withColumn("block", F.lit(1))
        got = [tuple(r) for r in align.aligned(df, block_bytes=block_bytes).collect()]
        assert len(got) == len(want)
        for x, y in zip(sorted(got, key=key), sorted(want, key=key)):
            assert x[:7] == y[:7]
            assert hashlib.sha256(x[8].encode()).hexdigest() == x[7] if x[8] else x[7] == ""
        # digests by id, where the plain version made them
        have = Counter((r[0], r[7]) for r in got)
        assert not Counter((w[0], w[7]) for w in want if w[7] is not None) - have
    pairs = {(r["a_id"], r["b_id"]): r["n_links"] for r in align.pair_counts(frame(spark, rows)).collect()}
    assert pairs == dict(count)


def test_alignment_of_no_rows(spark):
    out = align.aligned(spark.createDataFrame([], SCHEMA), full=False)
    assert out.count() == 0
    assert [r[1:] for r in align.aligned(frame(spark, [(1, None), (2, "▁")]), full=False).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


# -- 12
def check_shards(rows, got, k):
    assert Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows) == Counter(tuple(r)[:3] for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    sizes = [len(slots[s]) for s in range(k)]
    assert set(slots) <= set(range(k)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    groups = defaultdict(set)
    for r in got:
        groups[r["size"], r["text_crc32"]].add(r["shard"])
    return groups


def test_shards_are_even_and_keep_groups(spark):
    r = random.Random(12)
    rows = [(i, f"own text {i}") for i in range(4_000)]
    rows += [(10_000 + i, "hot " * 50) for i in range(3_000)]
    at = 20_000
    for g in range(400):
        for _ in range(r.randint(2, 9)):
            rows.append((at, f"group {g}"))
            at += 1
    rows += [(None, "nobody"), (None, None), (7, ""), (7, ""), (8, None)]
    got = shards.sharded(frame(spark, rows).withColumn("shard", F.lit("mine")).withColumn("group", F.lit(1))).collect()
    groups = check_shards(rows, got, 16)
    cut = sum(len(s) > 1 for s in groups.values())
    hot = groups[len("hot " * 50) + 1, zlib.crc32(("hot " * 50).encode())]
    assert cut <= 20 and len(hot) <= 12, (cut, len(hot))
    again = shards.sharded(frame(spark, rows, 5)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


@pytest.mark.parametrize("rows", [[], [(1, "a")], [(i, "same") for i in range(37)], [(None, None)] * 20, [(i // 2, f"t{i // 2}") for i in range(33)]])
def test_shards_of_few_rows(spark, rows):
    check_shards(rows, shards.sharded(frame(spark, rows)).collect(), 16)


def test_quotas_hold():
    r = random.Random(3)
    for _ in range(50):
        k = r.randint(2, 16)
        size = [r.randint(0, 100) for _ in range(k)]
        most = [r.randint(50, 120) for _ in range(k)]
        wishes = [(r.randint(0, 3), a, b, r.randint(1, 40)) for a in range(k) for b in range(k) if a != b and r.random() < 0.3]
        part = shards.quotas(wishes, size, most)
        for c in range(4):
            for kk, a, b, n in wishes:
                if kk == c:
                    size[a] -= n * part[c, b]
                    size[b] += n * part[c, b]
        assert all(s <= max(m, 101) + 1e-6 for s, m in zip(size, most))


def test_prefix_sums(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), (F.col("id") % 5).alias("w")).repartition(7)
    got = {r["k"]: r["at"] for r in shards.prefix_sums(df, ["k"], "w", "at", "test").collect()}
    w = {r["k"]: r["w"] for r in df.collect()}
    at = 0
    for k in range(1000):
        assert got[k] == at
        at += w[k]


# -- 13
def near_plain(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(rows):
    n = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    out = {}
    for w in n:
        close = [x for x in n if near_plain(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        out[w] = [best if best and n[best] >= 5 * n[w] else None, None, n[w], len(close)]
    for w, row in out.items():
        at = w
        while out[at][0]:
            at = out[at][0]
        row[1] = at
    return {w: (f, root, k, c, n[f] if f else None) for w, (f, root, k, c) in out.items()}


def variants(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(df).collect()}


@pytest.mark.parametrize("tile", [1024, 16])
def test_spelling_matches_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(spelling, "TILE_ROWS", tile)
    r = random.Random(13)
    words = ["letter", "between", "élèves", "straße", "aaaaaa", "abababab", "international", "x" * 300]
    for w in list(words):
        for _ in range(40):
            k, c = r.randrange(len(w)), r.choice("abeté")
            words.append(r.choice([w[:k] + c + w[k + 1:], w[:k] + w[k + 1:], w[:k] + c + w[k:]]))
    rows = table_rows(spark)
    for i in range(300):
        rows.append((50_000 + i, " ".join(r.choice(words[:8] * 20 + words) for _ in range(60))))
    rows += [(None, "Letter LETTER " * 30), (None, None), (1, ""), (2, "ÉLÈVES " * 7), (2, "ÉLÈVES " * 7), (3, "letter×letter÷ " * 8)]
    got = variants(frame(spark, rows).withColumn("word", F.lit("mine")).withColumn("n", F.lit(1)))
    assert got == plain_variants(rows)
    assert any(x[0] for x in got.values())


def test_spelling_ties_chains_and_empty_tables(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert variants(frame(spark, [(1, None), (2, "few words")])) == {}
    many = lambda w, n, i: [(i + k, w) for k in range(n)]
    rows = many("tablea", 5, 0) + many("tableb", 30, 100) + many("tablec", 30, 200) + many("tablex", 5, 300) + many("tablexyz", 5, 400)
    rows += many("chaina", 5, 1000) + many("chainab", 40, 2000) + many("chainabc", 300, 3000) + many("chainabcd", 2000, 4000)
    got = variants(frame(spark, rows))
    assert got == plain_variants(rows)
    assert got["chaina"][:2] == ("chainab", "chainabcd")
    assert got["tablea"][0] == min("tableb", "tablec")


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = ("Word " * 100 + "x" * 500 + "été-") * 20
    whole = re.findall("[A-Za-zÀ-ÿ]+", text.lower())
    for piece in (1, 7, 64, 1000):
        monkeypatch.setattr(spelling, "PIECE", piece)
        assert [w for p in spelling.runs(text) for w in p] == whole
