"""Alignment of two tokenizers' tokens over the same texts (operator 11).

A is a byte-level BPE of the tokenizers library, B a sentencepiece BPE with
byte fallback that puts a space before a text; both encode ``space + text``.

1. Tasks cut texts into *units*: stretches that neither tokenizer's tokens
   cross.  A's tokens stay inside its pre-tokens; B's pieces can only cross a
   boundary of two characters that stand side by side in some piece of its
   vocabulary.  So a unit's tokens do not depend on what is around it, and each
   distinct unit of a block of about ``BLOCK_BYTES`` of text is aligned once.
2. A unit's cumulative token ends go into two dictionaries, end -> index.  The
   intersection of their keys, sorted, slices both id lists into groups; the
   overlapping pairs of each slice are its links.
3. Blocks give their distinct id pairs with the number of links; Spark sums
   them over the corpus and finds the largest count of each B id.
4. Counts return to the blocks by a join on the pair, and documents sum them
   over their units.

A frequent pair has one row a block, not one a use.  Step 1 is written to the
shared checkpoint folder, so blocks are made once.

Defined results: null and empty texts have no tokens, and neither has a text
that B does not give back byte for byte (one with U+2581); their counts are 0
and their groups ''.  Null ids and repeated rows keep their rows; columns other
than ``doc_id`` and ``text`` are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from array import array
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .bpe import _unzip, _unzip_words, _zip, _zip_words, pieces, ragged, tokenizer, vocabulary_path
from .common import documents, saved

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_BYTES = 6 << 20
KEPT = 60_000  # aligned units that a worker keeps, twice at most
ROWS = 1000  # texts of an Arrow batch that are copied at once
MARK = 0x2581  # stands for a space in B's pieces


class Pair:
    """The two tokenizers: encoding of units and where units may be cut."""

    def __init__(self, a: str, b: str):
        import sentencepiece

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(tokenizer(a).to_str())
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.a_size = np.array([len(x) for x in pieces(a)], np.int64).tolist()
        self.b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(b))
        n = self.b.get_piece_size()
        names = [self.b.id_to_piece(i) for i in range(n)]
        byte = [self.b.is_byte(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if y else p.replace(chr(MARK), " ").encode() for p, y in zip(names, byte)]
        whole = [p for p, y in zip(names, byte) if not y]
        probe = " ﬁ  Å \t"
        if b"".join(self.b_bytes[i] for i in self.b.encode(probe)) != b" " + probe.encode() or any("\n" in p for p in whole):
            raise ValueError(f"{b}: texts are normalised, or a piece holds a line end")
        self.b_size = [len(x) for x in self.b_bytes]
        self.old: dict[str, tuple | None] = {}
        self.new: dict[str, tuple | None] = {}
        self.beside = np.unique(np.array([ord(x) << 21 | ord(y) for p in whole for x, y in zip(p, p[1:])], np.int64))

    def starts(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Byte positions at which a unit begins."""
        cp, lead = K.code_points(buf)
        cut = np.zeros(len(buf) + 1, bool)
        cut[off] = True
        cut = cut[np.append(lead, len(buf))]
        new = K.word_starts(cp, cut, spaced=True)
        at = np.flatnonzero(new & ~cut[:-1])
        pair = np.where(cp == 32, MARK, cp).astype(np.int64)
        new[at] = ~np.isin(pair[at - 1] << 21 | pair[at], self.beside)
        return lead[new]

    def known(self, units: list[str]) -> list[tuple | None]:
        """(A tokens, B tokens, groups, links as packed id pairs, shown groups) of each unit; None where B changes the bytes.

        What was aligned lately is kept, so a unit that returns block after block is aligned once a worker.
        """
        miss = []
        for u in units:
            if u not in self.new:
                if u in self.old:
                    self.new[u] = self.old[u]
                else:
                    miss.append(u)
        for i in range(0, len(miss), 20_000):
            some = miss[i: i + 20_000]
            # a line end stands alone in B, so what follows is encoded as inside a text
            b = self.b.encode(["\n" + u for u in some], num_threads=1)
            for u, x, y in zip(some, self.a.encode_batch_fast(some, add_special_tokens=False), b):
                self.new[u] = self.align(u, x.ids, y[2:])
        out = [self.new[u] for u in units]
        if len(self.new) > KEPT:
            self.old, self.new = self.new, {}
        return out

    def align(self, unit: str, a: list[int], b: list[int]) -> tuple | None:
        sa, sb = self.a_size, self.b_size
        size_a, size_b = [sa[x] for x in a], [sb[x] for x in b]
        if (sum(size_a) != sum(size_b) or chr(MARK) in unit) and b"".join([self.b_bytes[x] for x in b]) != unit.encode():
            return None
        if len(a) == 1 or len(b) == 1:  # the only common end is the last, and the lone token overlaps all
            slices, links = [(a, b)], [x << 32 | y for x in a for y in b]
        else:
            end_a = {e: i for i, e in enumerate(accumulate(size_a), 1)}
            end_b = {e: i for i, e in enumerate(accumulate(size_b), 1)}
            slices, links, i, j = [], [], 0, 0
            for e in sorted(end_a.keys() & end_b.keys()):
                k, m = end_a[e], end_b[e]
                slices.append((a[i:k], b[j:m]))
                if k - i == 1 or m - j == 1:
                    links += [x << 32 | y for x in a[i:k] for y in b[j:m]]
                else:
                    left, right, q = 0, size_b[j], j
                    for p in range(i, k):
                        left += size_a[p]
                        links.append(a[p] << 32 | b[q])
                        while right < left:  # ends inside a slice differ, so the next one overlaps too
                            q += 1
                            right += size_b[q]
                            links.append(a[p] << 32 | b[q])
                i, j = k, m
        shown = ";".join([",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in slices])
        return len(a), len(b), len(slices), array("q", links).tobytes(), shown


@lru_cache(maxsize=2)
def tokenizers(a: str, b: str) -> Pair:
    return Pair(a, b)


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values`` that end at ``edges`` (n + 1)."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[edges[1:]] - total[edges[:-1]]


def _block(pair: Pair, ids: list, texts: list[tuple[np.ndarray, np.ndarray]], full: bool) -> dict:
    hashes, counts, spans, base = [], [], [], 0
    for buf, off in texts:
        for _, _, b, o in K.slices(buf, off):
            s = pair.starts(b, o)
            e = np.append(s[1:], len(b))[:len(s)]
            hashes.append(K.span_hashes(b, s, e))
            counts.append(np.diff(np.searchsorted(s, o)))
            spans.append(np.stack([s, e], 1) + base)
            base += len(b)
    raw = b"".join(buf.tobytes() for buf, _ in texts)
    h, span, n_units = np.concatenate(hashes), np.concatenate(spans), np.concatenate(counts)
    u, first, inv, freq = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    order = np.concatenate([(often := np.argsort(-freq, kind="stable"))[:240], (rest := often[240:])[np.argsort(first[rest])]])
    rank = np.empty(len(u), np.int64)
    rank[order] = np.arange(len(u))
    seq, freq = rank[inv], freq[order]
    units = pair.known([raw[a:e].decode() for a, e in span[first[order]].tolist()])
    del raw, span, hashes, h, u, first, inv
    bad = np.array([x is None for x in units], bool)
    units = [x or (0, 0, 0, b"", "") for x in units]
    size = np.array([(x[0], x[1], x[2], len(x[3]) // 8) for x in units], np.int64).reshape(-1, 4).T
    text = [x[4] for x in units]
    links = np.frombuffer(b"".join([x[3] for x in units]), np.int64)
    edges = np.concatenate([[0], np.cumsum(n_units)])
    spoiled = _sums(bad[seq], edges) > 0
    use = np.bincount(seq[~np.repeat(spoiled, n_units)], minlength=len(units))
    distinct, at = np.unique(links, return_inverse=True)
    times = np.zeros(len(distinct), np.int64)
    np.add.at(times, at, np.repeat(use, size[3]))
    out = [np.where(spoiled, 0, _sums(size[k][seq], edges)) for k in range(4)]
    digests, given = [], []
    for i, (a, e) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        groups = ";".join([text[w] for w in seq[a:e].tolist()]) if e > a and not spoiled[i] else ""
        digests.append(hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        if full:
            given.append(groups)
    live = times > 0
    return {"block": uuid.uuid4().bytes, "ids": ids, "n_a": out[0], "n_b": out[1], "n_groups": out[2], "n_links": out[3],
            "sha": digests, "groups": given if full else None, "spoiled": np.packbits(spoiled).tobytes(), "n_units": _zip(n_units),
            "seq": _zip_words(seq) if len(seq) else b"", "size": _zip(size[3]), "at": _zip(at),
            "pairs": distinct, "pair": distinct[live], "times": times[live]}


_LISTS = ("ids", "n_a", "n_b", "n_groups", "n_links", "pairs", "pair", "times")
_PACKED = ("block binary, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, "
           "groups array<string>, spoiled binary, n_units binary, seq binary, size binary, at binary, pairs array<long>, pair array<long>, times array<long>")
_PACKED_ARROW = pa.schema([(c.split()[0], pa.list_(pa.int64()) if "<long>" in c else pa.list_(pa.string()) if "<string>" in c else pa.binary())
                           for c in _PACKED.split(", ")])


def blocks(docs: DataFrame, a: str, b: str, full: bool, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Steps 1 and 2 over docs(doc_id, text): one row a block."""

    def run(batches):
        pair, ids, texts, size = tokenizers(a, b), [], [], 0

        def made():
            row = _block(pair, ids, texts, full)
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in _PACKED_ARROW], schema=_PACKED_ARROW)

        for batch in (x.slice(k, ROWS) for x in batches for k in range(0, len(x), ROWS)):
            text = batch.column(1).fill_null("").cast(pa.large_string())
            text = pc.if_else(pc.equal(text, pa.scalar("", pa.large_string())), text,
                              pc.binary_join_element_wise(pa.scalar("", pa.large_string()), text, pa.scalar(" ", pa.large_string())))
            buf, off = K.utf8(text)
            doc = batch.column(0).to_pylist()
            for i, j, x, o in K.slices(buf, off, block_bytes):
                if size and size + len(x) > block_bytes:
                    yield made()
                    ids, texts, size = [], [], 0
                ids += doc[i:j]
                texts.append((x.copy(), o))
                size += len(x)
        if ids:
            yield made()

    return docs.mapInArrow(run, _PACKED)


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _documents(full: bool):
    """Step 4 for one block."""
    names = [c.split()[0] for c in _RESULT.split(", ")]
    schema = pa.schema([(n, pa.string() if n == "groups_sha256" else pa.int64()) for n in names] + ([("groups", pa.string())] if full else []))

    def run(block: pa.Table, scores: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        pairs, size, at = np.array(row["pairs"], np.int64), _unzip(row["size"]).astype(np.int64), _unzip(row["at"]).astype(np.int64)
        total, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        if len(scores):
            k = np.searchsorted(pairs, scores["pair"].to_numpy())
            total[k], best[k] = scores["total"].to_numpy(), scores["best"].to_numpy()
        n_units = _unzip(row["n_units"]).astype(np.int64)
        seq = _unzip_words(row["seq"]) if row["seq"] else np.zeros(0, np.int64)
        edges, inner = np.concatenate([[0], np.cumsum(n_units)]), np.concatenate([[0], np.cumsum(size)])
        clean = np.unpackbits(np.frombuffer(row["spoiled"], np.uint8))[: len(n_units)] == 0
        n_best = _sums(_sums(best[at], inner)[seq], edges) * clean
        count_sum = _sums(_sums(total[at], inner)[seq], edges) * clean
        columns = [row["ids"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], n_best, count_sum, row["sha"]]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns + ([row["groups"]] if full else []), schema)], schema=schema)

    return run


def aligned(docs: DataFrame, a: str = A_VOCABULARY, b: str = B_VOCABULARY, full: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs(doc_id, text, ...) -> one row a document with its counts and the digest of its groups; ``full`` adds ``groups``."""
    t = saved(blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), a, b, full, block_bytes), "align-blocks")
    pairs = t.select("block", F.explode(F.arrays_zip("pair", "times")).alias("p")).select("block", "p.pair", "p.times")
    totals = pairs.groupBy("pair").agg(F.sum("times").alias("total")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    totals = saved(totals, "align-pairs")
    top = totals.groupBy("b").agg(F.max("total").alias("top"))
    scored = totals.join(top, "b").select("pair", "total", (F.col("total") == F.col("top")).cast("long").alias("best"))
    back = pairs.select(F.col("block").alias("home"), "pair").join(scored, "pair")
    rows = t.drop("pair", "times")
    return rows.groupBy("block").cogroup(back.groupBy("home")).applyInArrow(_documents(full), _RESULT + (", groups string" if full else ""))


def pair_counts(docs: DataFrame, a: str = A_VOCABULARY, b: str = B_VOCABULARY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs(doc_id, text, ...) -> a_id, b_id, n_links: how many links of the corpus hold each pair."""
    t = blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), a, b, False, block_bytes)
    p = t.select(F.explode(F.arrays_zip("pair", "times")).alias("p")).groupBy(F.col("p.pair").alias("pair")).agg(F.sum("p.times").alias("n_links"))
    return p.select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id"), "n_links")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(documents(spark, sf_dir), full=False)
