"""Token counts by a compiled finite-state tokenizer (operator 2).

Texts are normalised and cut into words by array operations; the transducer of
``transducer.py`` then reads all chunks of a slice side by side and yields the
change of the token count at each byte.  One pass over the documents, no
shuffle, memory bounded by the slice and the transducer's state limit.

Normalisation is the tokenizer's own: its values are tabled for code points
that no neighbour can change; texts with any other code point go through the
library's normaliser.  Special strings in a text count as one token each.

Defined results: null and empty texts have 0 bytes and 0 tokens; null ids and
repeated rows keep their rows; empty tables give empty results.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .bpe import tokenizer, vocabulary_path
from .common import documents
from .transducer import GAP, Transducer

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
SLICE = 2 << 20


@lru_cache(maxsize=1)
def _transducer(path: str) -> Transducer:
    return Transducer(vocabulary_path(path))


@lru_cache(maxsize=1)
def _lower(path: str) -> np.ndarray:
    """Normalised code point of each code point that is normalised by itself, else -1."""
    norm = tokenizer(path).normalizer
    out = np.full(0x110000, -1, np.int32)
    for c in range(0x2E80):
        x = chr(c)
        if unicodedata.category(x)[0] == "M" or unicodedata.category(x) == "Cn" or 0x1100 <= c <= 0x11FF:
            continue
        y = x if x.isspace() or K.SPACE[c & 255] and c < 128 else norm.normalize_str(x)
        if len(y) == 1 and len(y.encode()) == len(x.encode()) and unicodedata.is_normalized("NFC", x):
            out[c] = ord(y)
    out[0x3001:0x302A] = np.arange(0x3001, 0x302A)
    out[0x3041:0x3097] = np.arange(0x3041, 0x3097)
    out[0x30A1:0x30FB] = np.arange(0x30A1, 0x30FB)
    out[0x4E00:0x9FEB] = np.arange(0x4E00, 0x9FEB)
    return out


def _write(buf: np.ndarray, cp: np.ndarray, lead: np.ndarray, to: np.ndarray) -> np.ndarray:
    """``buf`` with its code points replaced by ``to``, which have as many bytes."""
    new = np.flatnonzero(cp != to)
    if not len(new):
        return buf
    buf = buf.copy()
    at, c = lead[new], to[new].astype(np.uint32)
    one, two = c < 0x80, (c >= 0x80) & (c < 0x800)
    three = c >= 0x800
    buf[at[one]] = c[one]
    buf[at[two]], buf[at[two] + 1] = 0xC0 | c[two] >> 6, 0x80 | c[two] & 63
    a, x = at[three], c[three]
    buf[a], buf[a + 1], buf[a + 2] = 0xE0 | x >> 12, 0x80 | x >> 6 & 63, 0x80 | x & 63
    return buf


def _codes(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Codes for the transducer of normalised texts, each followed by a gap."""
    cp, lead = K.code_points(buf)
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = True
    first = K.word_starts(cp, cut[np.append(lead, len(buf))], spaced=False)
    out = buf.astype(np.int16)
    out[lead[first]] += 256
    blank = K.classes()[cp] == K.SPACE_CP
    if len(lead) == len(buf):
        out[blank] = GAP
    else:
        out[np.repeat(blank, np.diff(np.append(lead, len(buf))))] = GAP
    return out


def _normal(buf: np.ndarray, off: np.ndarray, path: str, special: re.Pattern | None):
    """Normalised sections: bytes, offsets, the text of each, and each text's number of special strings."""
    n = len(off) - 1
    extra = np.zeros(n, np.int64)
    cp, lead = K.code_points(buf)
    to = _lower(path)[cp]
    odd = np.zeros(n, bool)
    bad = np.flatnonzero(to < 0)
    if len(bad):
        odd[np.searchsorted(off, lead[bad], "right") - 1] = True
    if special is not None:
        raw = buf.tobytes()
        for m in special.finditer(raw):
            odd[np.searchsorted(off, m.start(), "right") - 1] = True
    low = _write(buf, cp, lead, np.where(to < 0, cp, to))
    if not odd.any():
        return low, off, np.arange(n), extra
    norm, parts, owner = tokenizer(path).normalizer, [], []
    for i in range(n):
        if not odd[i]:
            parts.append(low[off[i]: off[i + 1]].tobytes())
            owner.append(i)
            continue
        pieces = [buf[off[i]: off[i + 1]].tobytes()]
        if special is not None:
            pieces = special.split(pieces[0])
        extra[i] = len(pieces) - 1
        parts += [norm.normalize_str(p.decode()).encode() for p in pieces]
        owner += [i] * len(pieces)
    return (np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]),
            np.array(owner), extra)


def _refine(buf: np.ndarray, off: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets with long texts cut after ASCII white space (no token or composition spans it), and each piece's text."""
    size = np.diff(off)
    if not len(size) or size.max() <= 2 * most:
        return off, np.arange(len(size))
    cuts, owner = [0], []
    for i in range(len(size)):
        a, e = int(off[i]), int(off[i + 1])
        while e - a > 2 * most:
            p = a + most
            while p < e:
                hit = np.flatnonzero(K.SPACE[buf[p: min(p + 65536, e)]])
                if len(hit):
                    break
                p += 65536
            if p >= e:
                break
            a = p + int(hit[0]) + 1
            cuts.append(a)
            owner.append(i)
        cuts.append(e)
        owner.append(i)
    return np.array(cuts), np.array(owner)


def counts(buf: np.ndarray, off: np.ndarray, path: str, most: int = SLICE) -> np.ndarray:
    """Tokens of each text."""
    added = [x.content.encode() for x in tokenizer(path).get_added_tokens_decoder().values()]
    special = re.compile(b"|".join(re.escape(x) for x in sorted(added, key=len, reverse=True))) if added else None
    out = np.zeros(len(off) - 1, np.int64)
    off, owner = _refine(buf, off, most)
    machine = _transducer(path)
    for i, j, b, o in K.slices(buf, off, most):
        low, at, text, extra = _normal(b, o, path, special)
        codes = _codes(low, at)
        n = len(at) - 1
        spread = np.full(len(codes) + n, GAP, np.int16)  # a gap after each section
        spread[np.arange(len(codes)) + np.repeat(np.arange(n), np.diff(at))] = codes
        each = np.add.reduceat(machine.count(spread).astype(np.int64), at[:-1] + np.arange(n))
        got = extra
        np.add.at(got, text, each)
        np.add.at(out, owner[i:j], got)
    return out


def token_counts(docs: DataFrame, path: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        for batch in batches:
            buf, off = K.utf8(batch.column(1))
            n = counts(buf, off, path)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
