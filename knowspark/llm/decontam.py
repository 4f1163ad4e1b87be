"""Benchmark decontamination by the q-gram lemma (operator 3).

A document leaks a benchmark item if a region of it is within an edit distance
of ``BUDGET`` percent of the length of one of the item's units.  An item up to
``SHORT`` code points is one unit.  Any longer one is cut into equal units of at
most SHORT, and once more with the cuts moved by half a unit; items over
``LONG`` have windows of ``UNIT`` that overlap by half besides.  So a verbatim
quote of 3 / 2 SHORT code points always holds a whole unit, and an item that is
within the budget as a whole has a unit that is.  The region found is the whole
item's if that is within the budget (up to LONG), else that of the longest unit.
Texts are compared with letters lower-cased and white space runs as one space.

1. Every q-gram of a document is looked up among the benchmark's q-grams.
2. A shared q-gram lies on the diagonal (document position - unit position).
   Diagonals are counted in bands of twice the edit budget that overlap by
   half; within k edits a unit of length m keeps m - q + 1 - k q q-grams in one
   band, so bands with fewer are dropped and no match is lost.
3. What remains is verified by an alignment that is banded to the diagonals.

The benchmark is the query set.  It is sent to the tasks in blocks of at most
``MAX_BLOCK`` code points; beyond one block, the documents are read once a block.
Items over ``PIECE`` code points are cut by Spark into pieces that overlap by
``OVERLAP`` and are searched like items of that id, so they may have a row a piece.

Defined results: null and empty texts and items match nothing, as do items
shorter than the lemma can serve (they are matched exactly); documents and items
with a null id are searched too (the items count as one, null in the finding);
rows of one document id each have their findings; empty tables give empty results.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .common import documents, table

Q, BUDGET, UNIT, LONG, SHORT = 8, 10, 200, 300, 100
MAX_BLOCK = 4_000_000
PIECE, OVERLAP = 1_000_000, 10_000
FILTER_BITS = 23
SLICE = 2 << 20


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    out = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(0x2000):
        low = chr(c).lower()
        if chr(c).isspace():
            out[c] = 32
        elif len(low) == 1:
            out[c] = ord(low)
    for c in (0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B)):
        out[c] = 32
    return out


def normal(buf: np.ndarray, off: np.ndarray):
    """Code points of the texts, folded and with white space runs as one space; their place in the text; offsets."""
    cp, lead = K.code_points(buf)
    cp = _fold()[cp]
    at = np.searchsorted(lead, off)
    keep = np.ones(len(cp), bool)
    keep[1:] = (cp[1:] != 32) | (cp[:-1] != 32)
    keep[at[:-1][np.diff(at) > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    place = np.arange(len(cp)) - np.repeat(at[:-1], np.diff(at))
    return cp[keep], place[keep], kept[at]


def grams(cp: np.ndarray) -> np.ndarray:
    """Hash of the q-gram at each position (those that run over the end wrap into nothing: n - q + 1 hashes)."""
    n = len(cp)
    if n < Q:
        return np.zeros(0, np.uint64)
    x = cp.astype(np.uint64) + np.uint64(1)
    h = x[: n - Q + 1].copy()
    for k in range(1, Q):
        h *= np.uint64(K.BASE)
        h += x[k: n - Q + 1 + k]
    return h * np.uint64(0xBF58476D1CE4E5B9)


class Index:
    """Units of benchmark items: folded code points, postings of their q-grams, budgets and least counts."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, budget: int = BUDGET):
        self.number, self.units, self.offset, self.whole, self.wholes, self.budget = [], [], [], [], [], budget
        #: ids by item number; items without an id have None
        self.ids = list(dict.fromkeys(i for i, _ in items))
        number = {i: k for k, i in enumerate(self.ids)}
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            cp, _, _ = normal(raw, np.array([0, len(raw)]))
            cp = cp[int(len(cp) > 0 and cp[0] == 32): len(cp) - int(len(cp) > 1 and cp[-1] == 32)]
            if not len(cp):
                continue
            n, k = len(cp), -(-len(cp) // SHORT)
            cuts = [i * n // (2 * k) for i in range(2 * k + 1)]
            spans = [(0, n)] if k == 1 else list(zip(cuts, cuts[2:]))
            if n > LONG:
                spans += [(a, a + UNIT) for a in (*range(0, n - UNIT, UNIT // 2), n - UNIT)]
            if 1 < k and n <= LONG:
                self.wholes.append(cp)
            for a, e in spans:
                self.number.append(number[item])
                self.units.append(cp[a:e])
                self.offset.append(a)
                self.whole.append(len(self.wholes) - 1 if 1 < k and n <= LONG else -1)
        self.number = np.array(self.number, np.int64)
        self.item = np.array(self.ids + [0], object)[:-1][self.number]
        self.size = np.array([len(u) for u in self.units], np.int64)
        self.edits = self.size * budget // 100
        least = self.size - q + 1 - self.edits * q
        # too short for the lemma at this budget: as many edits as leave one q-gram, none at the least
        short = least < 1
        self.edits[short] = np.maximum((self.size[short] - q) // q, 0)
        self.least = np.maximum(self.size - q + 1 - self.edits * q, 1)
        hashes = [grams(u) for u in self.units]
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        unit = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
        pos = np.concatenate([np.arange(len(x)) for x in hashes]) if hashes else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.gram, begin = np.unique(h[order], return_index=True)
        self.begin = np.append(begin, len(h))
        self.unit, self.pos = unit[order].astype(np.int32), pos[order].astype(np.int32)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.gram >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        #: units below q code points are found as they stand
        self.tiny = [i for i in range(len(self.units)) if self.size[i] < q]

    def hits(self, cp: np.ndarray):
        """(document position, unit, unit position) of all shared q-grams."""
        h = grams(cp)
        at = np.flatnonzero(self.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(at) or not len(self.gram):
            return at[:0], at[:0], at[:0]
        k = np.searchsorted(self.gram, h[at]).clip(max=len(self.gram) - 1)
        ok = self.gram[k] == h[at]
        at, k = at[ok], k[ok]
        size = self.begin[k + 1] - self.begin[k]
        flat = np.repeat(self.begin[k] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.repeat(at, size), self.unit[flat], self.pos[flat]


def bands(at: np.ndarray, unit: np.ndarray, pos: np.ndarray, text: np.ndarray, index: Index):
    """(text, unit, first diagonal, last diagonal) of the bands with enough shared q-grams; neighbours are merged."""
    pair = text * len(index.size) + unit  # a pair with too few hits in all has no band with enough
    room = (int(text.max()) + 1) * len(index.size)
    if room <= 1 << 22:
        often = np.bincount(pair, minlength=room)[pair]
    else:
        _, back, count = np.unique(pair, return_inverse=True, return_counts=True)
        often = count[back]
    some = often >= index.least[unit]
    at, unit, pos, text = at[some], unit[some], pos[some], text[some]
    width = np.maximum(index.edits[unit], 4)
    low = (at - pos + (1 << 40)) // width
    # band b holds the diagonals [b * width, (b + 2) * width); a diagonal lies in bands low - 1 and low
    key = np.concatenate([low - 1, low])
    text, unit, pos = np.concatenate([text, text]), np.concatenate([unit, unit]), np.concatenate([pos, pos])
    pair = text * len(index.size) + unit
    order = np.lexsort((key, pair))
    pair, key, pos = pair[order], key[order], pos[order]
    new = np.append(True, (pair[1:] != pair[:-1]) | (key[1:] != key[:-1]))[: len(key)]
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(key)))
    unit = pair[begin] % len(index.size)
    some = count >= index.least[unit]
    # of these, count the unit's q-grams that the band holds, each once
    left = np.repeat(some, count)
    band, pos = np.cumsum(new)[left], pos[left]
    each = np.unique(band * (int(index.size.max(initial=0)) + 1) + pos) // (int(index.size.max(initial=0)) + 1)
    held = np.bincount(each, minlength=len(begin) + 1)[1:]
    begin = begin[held >= index.least[unit]]
    pair, key = pair[begin], key[begin]
    joined = np.append(False, (pair[1:] == pair[:-1]) & (key[1:] - key[:-1] <= 2))[: len(key)]
    a = np.flatnonzero(~joined)
    e = np.append(a[1:], len(key))[: len(a)] - 1
    text, unit = pair[a] // len(index.size), pair[a] % len(index.size)
    width = np.maximum(index.edits[unit], 4)
    return text, unit, key[a] * width - (1 << 40), (key[e] + 2) * width - 1 - (1 << 40)


def align(units: list[np.ndarray], texts: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each unit against any region of its text on the diagonals first..last, and that region's end.

    All pairs advance together, a row of every band at a time.
    """
    n, big = len(units), 1 << 20
    size = np.array([len(u) for u in units])
    length = np.array([len(t) for t in texts])[:, None]
    pattern = np.full((n, int(size.max())), -1, np.int64)
    window = np.full((n, int(length.max()) + 1), -2, np.int64)
    for i, (u, t) in enumerate(zip(units, texts)):
        pattern[i, : len(u)] = u
        window[i, : len(t)] = t
    span = int((last - first).max()) + 1
    d = first[:, None] + np.arange(span)
    on = d <= last[:, None]
    cost = np.where(on & (d >= 0) & (d <= length), 0, big)
    steps, rows = np.arange(span), np.arange(n)[:, None]
    edits, ends = np.full(n, big), np.zeros(n, np.int64)
    for i in range(pattern.shape[1]):
        j = d + i
        inside = on & (j >= 0) & (j < length)
        same = window[rows, np.where(inside, j, length)] == pattern[:, i: i + 1]
        new = np.where(inside, cost + ~same, big)
        np.minimum(new[:, :-1], cost[:, 1:] + 1, out=new[:, :-1])
        new[~(on & (j >= -1) & (j < length))] = big
        cost = np.minimum.accumulate(new - steps, axis=1) + steps
        cost[~on] = big
        done = np.flatnonzero(size == i + 1)
        if len(done):
            k = cost[done].argmin(1)
            edits[done], ends[done] = cost[done, k], d[done, k] + i + 1
    return edits, ends


def search(buf: np.ndarray, off: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(text, item id, start, end, edits) of the best region of each leaked item; places are code points of the text."""
    cp, place, at = normal(buf, off)
    text_of = np.repeat(np.arange(len(off) - 1), np.diff(at))
    pos, unit, upos = index.hits(cp)
    inside = at[text_of[pos] + 1] - pos >= Q if len(pos) else np.zeros(0, bool)
    pos, unit, upos = pos[inside], unit[inside], upos[inside]
    found: dict[tuple[int, int], tuple[int, int, int, int]] = {}

    def note(t: int, u: int, a: int, e: int, edits: int, size: int) -> None:
        key = (t, int(index.number[u]))
        if key not in found or (-size, edits, a) < (-found[key][3], found[key][2], found[key][0]):
            found[key] = (a, e, edits, size)

    def verified(work):
        """(text, unit, start, end, edits) of those of (text, unit, sequence, budget, first diagonal, last diagonal) within the budget."""
        ready = []
        for t, u, seq, k, first, last in work:
            mine = cp[at[t]: at[t + 1]]
            a, e = max(first - k, 0), min(last + len(seq) + 2 * k, len(mine))
            ready.append((t, u, a, mine[a:e], first - k - a, last + k - a, seq, k))
        ready.sort(key=lambda w: (w[5] - w[4], len(w[3])))
        for c in range(0, len(ready), 64):
            some = ready[c: c + 64]
            units = [w[6] for w in some]
            edits, ends = align(units, [w[3] for w in some], np.array([w[4] for w in some]), np.array([w[5] for w in some]))
            good = [i for i in range(len(some)) if edits[i] <= some[i][7]]
            if good:  # the same region from its end gives its start
                k = np.array([some[i][7] for i in good])
                _, sizes = align([units[i][::-1] for i in good], [some[i][3][: ends[i]][::-1] for i in good], -k, k)
                for i, n in zip(good, sizes.tolist()):
                    t, u, a = some[i][:3]
                    yield t, u, a + int(ends[i]) - min(n, int(ends[i])), a + int(ends[i]), int(edits[i])

    if len(pos):
        text = text_of[pos]
        found_bands = bands(pos - at[text], unit, upos, text, index)
        work = [(t, u, index.units[u], int(index.edits[u]), first, last) for t, u, first, last in zip(*(x.tolist() for x in found_bands))]
        around = {}
        for t, u, a, e, edits in verified(work):
            note(t, u, a, e, edits, int(index.size[u]))
            if (w := index.whole[u]) >= 0:
                k, d = len(index.wholes[w]) * index.budget // 100, a - index.offset[u]
                around.setdefault((t, w, d // max(k, 1)), (t, u, index.wholes[w], k, d - k, d + k))
        for t, u, a, e, edits in verified(around.values()):
            note(t, u, a, e, edits, len(index.wholes[index.whole[u]]))
    if index.tiny:
        raw = cp.astype("<u4").tobytes()
        for u in index.tiny:
            seq, p = index.units[u].astype("<u4").tobytes(), -1
            while (p := raw.find(seq, p + 1)) >= 0:
                i = p // 4
                if p % 4 == 0 and i + len(seq) // 4 <= at[text_of[i] + 1]:
                    note(int(text_of[i]), u, i - int(at[text_of[i]]), i - int(at[text_of[i]]) + len(seq) // 4, 0, len(seq) // 4)
    out = []
    for (t, item), (a, e, edits, _) in sorted(found.items()):
        mine = place[at[t]: at[t + 1]]
        out.append((t, index.ids[item], int(mine[a]), int(mine[e - 1]) + 1, edits))
    return out


def blocks(benchmark: DataFrame, most: int = MAX_BLOCK) -> Iterator[Index]:
    """Indexes of the benchmark's blocks, each of at most about ``most`` code points; one at a time is on the driver."""
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    at = F.sequence(F.lit(0), F.greatest(F.length("text") - OVERLAP - 1, F.lit(0)), F.lit(PIECE - OVERLAP))
    b = b.select("item_id", "text", F.explode(at).alias("at")).select("item_id", F.substring(F.col("text"), F.col("at") + 1, F.lit(PIECE)).alias("text"))
    total = b.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = -(-2 * total // most) if total > most else 1
    for k in range(n):
        rows = b.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        if rows:
            yield Index(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1])))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, item_id, start, end, edits: a row a leaked item and document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())])
    kind = "doc_id long, item_id long, start long, end long, edits long"

    def finder(sent):
        def run(batches):
            for batch in batches:
                buf, off = K.utf8(batch.column(1))
                rows = [(i + r[0], *r[1:]) for i, _, b, o in K.slices(buf, off, SLICE) for r in search(b, o, sent.value)]
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids] + [pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 5)], schema=schema)

        return run

    out = None
    for index in blocks(benchmark):
        part = docs.mapInArrow(finder(spark.sparkContext.broadcast(index)), kind)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], kind) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item, with all columns; one pass, no shuffle."""
    at_text = docs.columns.index(text)

    def keeper(sent):
        def run(batches):
            for batch in batches:
                buf, off = K.utf8(batch.column(at_text))
                keep = np.ones(len(off) - 1, bool)
                for i, _, b, o in K.slices(buf, off, SLICE):
                    keep[[i + r[0] for r in search(b, o, sent.value)]] = False
                yield batch.filter(pa.array(keep))

        return run

    for index in blocks(benchmark):
        docs = docs.mapInArrow(keeper(docs.sparkSession.sparkContext.broadcast(index)), T.StructType(docs.schema.fields))
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
