"""BPE encoding and decoding over a table of distinct words (operator 6).

1. Tasks split texts into pre-tokens and gather about ``BLOCK_BYTES`` of text
   into a block: the block's distinct words, and each document as positions in
   that word list.
2. Words go to parts by hash; equal words of all blocks meet in one part,
   where each distinct word is encoded once by the tokenizers library.
3. Ids return to their block by position, documents become id lists.
4. Decoding joins ids with the id-to-piece table (one row a vocabulary entry,
   so its size is bounded and checked) and concatenates the pieces.

A frequent word has one row a block, not one a use, so no part is hot.  What
steps 1 and 2 exchange is written to the shared checkpoint folder.

Defined results: null and empty texts have no tokens; null ids and repeated
rows keep their rows; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import documents, saved

VOCABULARY = "byte_bpe_50k.json"
BLOCK_BYTES = 24 << 20
PARTS_PER_PARTITION = 4
MAX_PIECES = 2_000_000
FREQUENT = 240
ROWS = 1000  # texts of an Arrow batch that are converted at once


def vocabulary_path(name: str = VOCABULARY) -> str:
    """A path as it is; a bare file name is looked up where the public vocabularies are installed."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path(path))
    t.no_truncation()
    t.no_padding()
    return t


def pieces(path: str) -> list[bytes]:
    """Bytes of each id: the id-to-piece table.  Added tokens stand as their text."""
    t = tokenizer(path)
    n = t.get_vocab_size(with_added_tokens=True)
    if n > MAX_PIECES:
        raise ValueError(f"vocabulary of {n} pieces; the broadcast table is bounded to {MAX_PIECES}")
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(shown))}
    back = {c: b for b, c in chars.items()}
    added = t.get_added_tokens_decoder()
    return [added[i].content.encode() if i in added else bytes(back[c] for c in t.id_to_token(i)) for i in range(n)]


@lru_cache(maxsize=2)
def specials(path: str) -> tuple[bytes, ...]:
    return tuple(x.content.encode() for x in tokenizer(path).get_added_tokens_decoder().values())


def split(buf: np.ndarray, off: np.ndarray, special: tuple[bytes, ...]) -> np.ndarray:
    """Byte positions at which a pre-token begins; special strings are one word each."""
    cp, lead = K.code_points(buf)
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = True
    raw = buf.tobytes()
    inner = []
    for s in special:
        at = raw.find(s)
        while at >= 0:
            if not cut[at + 1: at + len(s)].any():
                cut[at] = cut[at + len(s)] = True
                inner.append((at, at + len(s)))
            at = raw.find(s, at + len(s))
    cut = cut[np.append(lead, len(buf))]
    new = K.word_starts(cp, cut, spaced=True)
    for a, b in inner:
        i, j = np.searchsorted(lead, [a, b])
        new[i:j] = False
        new[i] = True
    return lead[new]


def ragged(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenation of ``flat[begin[i]: begin[i] + size[i]]``."""
    ends = np.cumsum(size)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(begin - (ends - size), size) + np.arange(ends[-1])]


def _zip(x: np.ndarray) -> bytes:
    """Integers below 2**32 as byte planes, each compressed by itself."""
    c = zstandard.ZstdCompressor(level=3)
    x = np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4)
    planes = [c.compress(np.ascontiguousarray(x[:, k]).tobytes()) for k in range(4)]
    return np.array([len(p) for p in planes], "<u4").tobytes() + b"".join(planes)


def _unzip(b: bytes) -> np.ndarray:
    d, at, out = zstandard.ZstdDecompressor(), 16, []
    for n in np.frombuffer(b, "<u4", 4):
        out.append(np.frombuffer(d.decompress(b[at: at + int(n)]), np.uint8))
        at += int(n)
    return np.ascontiguousarray(np.stack(out, 1)).view("<u4").ravel()


def _zip_words(x: np.ndarray) -> bytes:
    """Word positions of a block: one byte for a frequent word, one for the first use of any other (these are
    numbered by first use), and otherwise its number in three parts."""
    rare = x >= FREQUENT
    r = x[rare].astype(np.int64) - FREQUENT
    first = r == np.maximum.accumulate(np.append(-1, r))[:-1] + 1
    high = r >> 16
    head = x.astype(np.uint8)
    head[rare] = np.where(first, 255, FREQUENT + np.minimum(high, 254 - FREQUENT))
    again = r[~first]
    planes = [head, (again & 255).astype(np.uint8), (again >> 8 & 255).astype(np.uint8),
              (again[again >> 16 >= 254 - FREQUENT] >> 16).astype("<u4")]
    c = zstandard.ZstdCompressor(level=3)
    packed = [c.compress(p.tobytes()) for p in planes]
    return np.array([len(p) for p in packed], "<u4").tobytes() + b"".join(packed)


def _unzip_words(b: bytes) -> np.ndarray:
    d, at, planes = zstandard.ZstdDecompressor(), 16, []
    for n, kind in zip(np.frombuffer(b, "<u4", 4), (np.uint8, np.uint8, np.uint8, "<u4")):
        planes.append(np.frombuffer(d.decompress(b[at: at + int(n)]), kind))
        at += int(n)
    out = planes[0].astype(np.int64)
    new = out == 255
    out[new] = FREQUENT + np.arange(int(new.sum()))
    again = (planes[0] >= FREQUENT) & ~new
    high = planes[0][again].astype(np.int64) - FREQUENT
    high[high == 254 - FREQUENT] = planes[3]
    out[again] = FREQUENT + (high << 16 | planes[2].astype(np.int64) << 8 | planes[1])
    return out


def _block(ids: list, texts: list[tuple[np.ndarray, np.ndarray]], special, parts: int) -> Iterator[dict]:
    """Rows of one block: a row of words for each part, and one row with the documents."""
    hashes, counts, starts, base = [], [], [], 0
    for buf, off in texts:
        for _, _, b, o in K.slices(buf, off):
            s = split(b, o, special)
            e = np.append(s[1:], len(b))[:len(s)]
            hashes.append(K.span_hashes(b, s, e))
            counts.append(np.diff(np.searchsorted(s, o)))
            starts.append((s + base).astype(np.uint32 if base + len(b) < 1 << 32 else np.int64))
            base += len(b)
    flat = np.concatenate([buf for buf, _ in texts])
    texts.clear()
    h = np.concatenate(hashes)
    hashes.clear()
    start = np.concatenate([*starts, [base]])  # every byte is a word's: a word ends where the next begins
    starts.clear()
    u, first, inv, freq = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    del h
    often = np.argsort(-freq, kind="stable")[:FREQUENT]
    other = np.ones(len(u), bool)
    other[often] = False
    other = np.flatnonzero(other)
    order = np.concatenate([often, other[np.argsort(first[other])]])
    rank = np.empty(len(u), np.uint32)
    rank[order] = np.arange(len(u), dtype=np.uint32)
    seq, n_words = rank[inv], np.concatenate(counts)
    del inv
    body = _zip_words(seq) if len(seq) else b""
    # equal keys only for equal blocks: ids, word order, the words themselves and where texts end
    made = repr(ids).encode() + body + u[order].tobytes() + n_words.tobytes()
    key = int.from_bytes(hashlib.blake2b(made, digest_size=8).digest(), "little") >> 1
    at = np.stack([start[first[order]], start[first[order] + 1]], 1).astype(np.int64)
    del start
    part = (u[order] >> np.uint64(20)) % np.uint64(parts)
    by = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[by], np.arange(parts + 1))
    c = zstandard.ZstdCompressor(level=3)
    for p in range(parts):
        mine = by[edges[p]: edges[p + 1]]
        if len(mine):
            size = at[mine, 1] - at[mine, 0]
            yield {"block": key, "part": p, "ranks": _zip(np.diff(mine, prepend=0)), "sizes": _zip(size),
                   "words": c.compress(ragged(flat, at[mine, 0], size).tobytes())}
    yield {"block": key, "part": -1, "n_words": _zip(n_words), "seq": body, "ids": ids}


_PACKED = "block long, part int, ranks binary, sizes binary, words binary, n_words binary, seq binary, ids array<long>"
_PACKED_ARROW = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("ranks", pa.binary()), ("sizes", pa.binary()),
                           ("words", pa.binary()), ("n_words", pa.binary()), ("seq", pa.binary()), ("ids", pa.list_(pa.int64()))])


def word_blocks(docs: DataFrame, path: str, parts: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Step 1 over docs(doc_id, text)."""

    def run(batches):
        special, ids, texts, size = specials(path), [], [], 0
        for batch in (x.slice(k, ROWS) for x in batches for k in range(0, len(x), ROWS)):
            buf, off = K.utf8(batch.column(1))
            doc = batch.column(0).to_pylist()
            for i, j, b, o in K.slices(buf, off, block_bytes):
                if size and size + len(b) > block_bytes:
                    yield pa.RecordBatch.from_pylist(list(_block(ids, texts, special, parts)), _PACKED_ARROW)
                    ids, texts, size = [], [], 0
                ids += doc[i:j]
                texts.append((b.copy(), o))
                size += len(b)
        if ids:
            yield pa.RecordBatch.from_pylist(list(_block(ids, texts, special, parts)), _PACKED_ARROW)

    return docs.mapInArrow(run, _PACKED)


def _encode_part(path: str):
    schema = pa.schema([("block", pa.int64()), ("ranks", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        """All words of one part: each distinct one is encoded once."""
        tok, d = tokenizer(path), zstandard.ZstdDecompressor()
        known: dict[bytes, int] = {}
        packets = []
        for w, s in zip(table["words"].to_pylist(), table["sizes"].to_pylist()):
            raw, ends, a, row = d.decompress(w), np.cumsum(_unzip(s)).tolist(), 0, []
            for e in ends:
                row.append(known.setdefault(raw[a:e], len(known)))
                a = e
            packets.append(np.array(row))
        words, got = [w.decode() for w in known], []
        known = None
        for i in range(0, len(words), 20_000):
            got += [np.array(x.ids, np.uint32) for x in tok.encode_batch_fast(words[i: i + 20_000], add_special_tokens=False)]
        size = np.array([len(x) for x in got], np.int64)
        flat, begin = np.concatenate(got), np.cumsum(size) - size
        return pa.table([table["block"], table["ranks"], [_zip(size[p]) for p in packets],
                         [_zip(ragged(flat, begin[p], size[p])) for p in packets]], schema=schema)

    return run


def _documents(given):
    """Step 3 and 4 for one block."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
                       + ([("ids", pa.binary()), ("decoded", pa.string())] if given["full"] else []))

    def run(words: pa.Table, docs: pa.Table) -> pa.Table:
        piece, start = given["pieces"].value
        piece_size = np.diff(start)
        ranks = [np.cumsum(_unzip(x)) for x in words["ranks"].to_pylist()]
        sizes = [_unzip(x).astype(np.int64) for x in words["sizes"].to_pylist()]
        n = sum(map(len, ranks))
        size, begin = np.zeros(n, np.int64), np.zeros(n, np.int64)
        flat, base = [np.zeros(0, "<u4")], 0
        for r, s, ids in zip(ranks, sizes, words["ids"].to_pylist()):
            flat.append(_unzip(ids))
            size[r], begin[r] = s, base + np.cumsum(s) - s
            base += len(flat[-1])
        flat = np.concatenate(flat)
        out = []
        for doc, n_words, seq in zip(docs["ids"].to_pylist(), docs["n_words"].to_pylist(), docs["seq"].to_pylist()):
            seq, ends = _unzip_words(seq) if seq else np.zeros(0, np.int64), np.cumsum(_unzip(n_words).astype(np.int64))
            at = 0
            for i, e in zip(doc, ends.tolist()):
                w = seq[at:e]
                at = e
                ids = ragged(flat, begin[w], size[w])
                raw = ids.astype("<u4").tobytes()
                text = ragged(piece, start[ids], piece_size[ids]).tobytes()
                row = [i, len(ids), hashlib.sha256(raw).hexdigest(), None]
                shown = text.decode("utf-8", "replace")
                row[3] = hashlib.sha256(shown.encode()).hexdigest()
                out.append(row + ([raw, shown] if given["full"] else []))
        return pa.table([list(c) for c in zip(*out)] if out else [[] for _ in schema], schema=schema)

    return run


def encode(docs: DataFrame, path: str = VOCABULARY, full: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_tokens, digests of ids and of the decoded text.

    ``full`` adds ``ids`` (little-endian unsigned 32-bit) and ``decoded``.
    The number of parts follows ``spark.sql.shuffle.partitions``.
    """
    spark = docs.sparkSession
    parts = PARTS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = saved(word_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path, parts, block_bytes), "bpe-blocks")
    words = t.filter("part >= 0").select("block", "part", "ranks", "sizes", "words")
    coded = words.groupBy("part").applyInArrow(_encode_part(path), "block long, ranks binary, sizes binary, ids binary")
    table = pieces(path)
    flat = np.frombuffer(b"".join(table), np.uint8)
    start = np.concatenate([[0], np.cumsum([len(x) for x in table])])
    given = {"pieces": spark.sparkContext.broadcast((flat, start)), "full": full}
    rows = t.filter("part < 0").select("block", "ids", "n_words", "seq")
    return coded.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(
        _documents(given), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
        + (", ids binary, decoded string" if full else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), full=False)
