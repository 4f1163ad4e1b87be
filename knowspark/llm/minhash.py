"""Near-duplicate documents by circulant MinHash (operator 1).

Signatures: one permutation ``sigma`` spreads a shingle over the universe
[0, 2**32), a second one ``pi``, shifted circularly by k, gives coordinate k:
``min over x of pi(sigma(x) - k mod 2**32)``.  Both are bijections of 32-bit
numbers, so two permutations make all coordinates.

Links: documents whose shingle sets have a Jaccard similarity of at least
``percent``/100 by the full sets.  Steps:

1. Documents with equal sets form a class; the smallest id represents it.
2. Signatures are cut into ``BANDS`` bands of ``ROWS``; representatives that
   agree in a band share a bucket.  At a similarity of 0.8 a pair shares none
   with a chance of 6e-6, above it less.
3. Every bucket has a head h, the member that shares most buckets with others
   (in a group of near copies, the one that all are near to).  All members are
   compared with the heads of their buckets; confirmed links form components.
4. Two members x, y of one head that are in different components still can be
   linked.  Without a common element outside h, they share at most
   min(|x & h|, |y & h|) elements.  So they need a common element that h lacks
   (an equi-join on head and element; by the prefix filter the rarest fifth of
   a set's elements will do), or sizes that this bound allows (a join on the
   head with the bound as its condition); all such pairs are compared.
   Pairs whose parity sketches differ in more places than sets of that similarity
   can differ in (every place stands for at least one element that only one of
   the two has) are excluded by the join's condition.
   Where more than ``SMALL`` members outside the head's component share one
   such element, all that share it become a bucket of their own and go through
   step 3 again; otherwise each of these few is compared with the others.

   So every pair that shares a bucket is linked, compared, excluded by the
   bound, or in one component already, while a group of near copies costs pairs
   in proportion to its size and not to the square.

Defined results: a text without words, or a null one, has an empty set and is
linked with nothing; a row without id is linked with nothing, its component is
null and it is kept; rows of one id are one document; empty tables give empty
results.  Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text with
fewer words than a shingle is one shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernel as K
from .common import documents, saved
from .graph import components

WORDS, PERCENT = 5, 80
ROWS, BANDS = 6, 40
SMALL = 256
BYTES = 6  # of a shingle's hash that the confirmation compares
PAIRS = 1000  # pairs whose sets a task holds at once


def sigma(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers."""
    x = x ^ x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


_FIRST, _BY, _LAST = np.uint32(0x7FEB352D), np.uint32(15), np.uint32(0x846CA68B)


def pi(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers, in place.

    ``sigma`` has spread its argument, and the minimum is told by the high bits, so it needs
    no more steps; as the first one multiplies, a shift of the argument is a subtraction after it.
    """
    x *= _FIRST
    x ^= x >> _BY
    x *= _LAST
    return x


CHUNK = 1 << 16  # shingles of a slice that stay in the processor's cache while all coordinates are made


def signatures(shingles: np.ndarray, off: np.ndarray, size: int = ROWS * BANDS, chunk: int = CHUNK) -> np.ndarray:
    """Coordinates (sets x size) of sets of 64-bit shingle hashes that lie one after another; empty sets have zeros."""
    full = np.flatnonzero(np.diff(off))
    begin = off[full]
    at = sigma((shingles >> np.uint64(32)).astype(np.uint32)) * _FIRST
    out = np.full((size, len(full)), 0xFFFFFFFF, np.uint32)
    y, z = np.empty((2, min(chunk, len(at))), np.uint32)
    for i in range(0, len(at), chunk):
        x = at[i: i + chunk]
        a, b = y[: len(x)], z[: len(x)]
        first, last = np.searchsorted(begin, i, "right") - 1, np.searchsorted(begin, i + len(x))
        starts, some = np.maximum(begin[first:last] - i, 0), out[:, first:last]
        for k in range(size):  # pi(at - k)
            np.subtract(x, np.uint32(k * int(_FIRST) & 0xFFFFFFFF), out=a)
            np.right_shift(a, _BY, out=b)
            np.bitwise_xor(a, b, out=a)
            np.multiply(a, _LAST, out=a)
            np.minimum(some[k], np.minimum.reduceat(a, starts), out=some[k])
    every = np.zeros((len(off) - 1, size), np.uint32)
    every[full] = out.T
    return every


def signature(shingles: np.ndarray, size: int = ROWS * BANDS, chunk: int = CHUNK) -> np.ndarray:
    """Coordinates of one non-empty set of 64-bit shingle hashes."""
    return signatures(shingles, np.array([0, len(shingles)]), size, chunk)[0]


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted without repeats; a plain sort is several times as fast as ``np.unique`` here."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def shingle_sets(buf: np.ndarray, off: np.ndarray, words: int):
    """The sorted distinct shingle hashes of each text of a slice."""
    a, e, at = K.ascii_words(buf, off)
    w = K.Hasher(K.LOWER[buf])(a, e)
    many = len(w) - words + 1
    h = K.mix(w[: max(many, 0)].copy())
    for k in range(1, words):
        h = K.mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k: k + len(h)])
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        if j - i >= words:
            yield _distinct(h[i: j - words + 1])
        elif j > i:
            x = K.mix(w[i: i + 1].copy())
            for k in range(i + 1, j):
                x = K.mix(x * np.uint64(0x9E3779B97F4A7C15) + w[k: k + 1])
            yield x
        else:
            yield w[:0]


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands (texts x bands)."""
    s = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03), s.shape[:2]).copy()
    for k in range(ROWS):
        h = K.mix(h * np.uint64(0x9E3779B97F4A7C15) + s[:, :, k])
    return h.astype(np.int64)


def signed(docs: DataFrame, words: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n, set key (two sums over the set), band keys."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            buf, off = K.utf8(batch.column(1))
            for i, j, b, o in K.slices(buf, off):
                each = list(shingle_sets(b, o, words))
                n = np.array([len(x) for x in each], np.int64)
                at, x = np.concatenate([[0], np.cumsum(n)]), np.concatenate(each)
                s, full = np.zeros((2, j - i), np.uint64), np.flatnonzero(n)
                if len(full):
                    s[0, full] = np.add.reduceat(x, at[full])
                    s[1, full] = np.add.reduceat(K.mix(x ^ np.uint64(0xA0761D6478BD642F)), at[full])
                keys = band_keys(signatures(x, at))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n), pa.array(s[0].view(np.int64)), pa.array(s[1].view(np.int64)),
                     pa.ListArray.from_arrays(np.arange(j - i + 1, dtype=np.int32) * BANDS, keys.ravel())], schema=schema)

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, keys array<long>")


def sets(docs: DataFrame, words: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, set: sorted hashes of ``BYTES`` bytes."""
    schema = pa.schema([("node", pa.int64()), ("set", pa.binary())])

    def run(batches):
        for batch in batches:
            buf, off = K.utf8(batch.column(1))
            for i, j, b, o in K.slices(buf, off):
                got = []
                for x in shingle_sets(b, o, words):
                    x = _distinct(x >> np.uint64(64 - 8 * BYTES))
                    got.append(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(got, pa.binary())], schema=schema)

    return docs.mapInArrow(run, "node long, set binary")


def _set(raw: bytes) -> np.ndarray:
    x = np.zeros((len(raw) // BYTES, 8), np.uint8)
    x[:, :BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, BYTES)
    return x.view("<u8").ravel()


_COMPARED = "a long, b long, linked boolean, common long, size long, added array<long>, parity array<long>"
SKETCH = 8  # 64-bit words of a parity sketch


def parity(x: np.ndarray) -> np.ndarray:
    """For each of ``64 * SKETCH`` places, whether an odd number of the set's elements fall on it, as packed words."""
    odd = np.bincount((x & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _may_link(percent: int):
    """Condition on x and y: by sizes and sketches they can be as similar as that."""
    differ = sum((F.bit_count(F.col("px")[i].bitwiseXOR(F.col("py")[i])) for i in range(SKETCH)), F.lit(0))
    return (100 + percent) * differ <= (100 - percent) * (F.col("size_x") + F.col("size_y"))


def _in_prefix(percent: int):
    """Condition on a shared element of ranks rx and ry (rarest first): as many elements follow as the pair must share."""
    least = F.ceil(percent * (F.col("size_x") + F.col("size_y")) / (100 + percent))
    return (F.col("rx") <= F.col("size_x") - least + 1) & (F.col("ry") <= F.col("size_y") - least + 1)


def compared(pairs: DataFrame, known: DataFrame, percent: int, details: bool) -> DataFrame:
    """pairs(a, b) -> a, b, linked by the full sets; with ``details`` also what b shares with a, its size and what a lacks of it."""
    x = pairs.join(known.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    x = x.join(known.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").select("a", "b", "sa", "sb")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_()), ("common", pa.int64()), ("size", pa.int64()),
                        ("added", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64()))])

    def run(batches):
        for batch in (x.slice(k, PAIRS) for x in batches for k in range(0, len(x), PAIRS)):
            out = []
            for sa, sb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p, q = _set(sa), _set(sb)
                held = p[np.searchsorted(p, q).clip(max=len(p) - 1)] == q
                same = int(held.sum())
                out.append((100 * same >= percent * (len(p) + len(q) - same), same, len(q),
                            q[~held].astype(np.int64) if details else None, parity(q) if details else None))
            linked, same, size, added, odd = zip(*out) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(linked, pa.bool_()), pa.array(same, pa.int64()),
                                              pa.array(size, pa.int64()), pa.array(added, pa.list_(pa.int64())),
                                              pa.array(odd, pa.list_(pa.int64()))], schema=schema)

    return x.mapInArrow(run, _COMPARED)


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_shingles, component_id, kept; one row a row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    s = saved(signed(docs, words), "minhash-signed")
    key = ["s1", "s2", "n"]
    # of most sets there is one document, which needs no row here
    classes = saved(s.filter("n > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("rows"))
                    .filter("rows > 1").drop("rows"), "minhash-classes")
    # one row a document with its class; the representative's row keeps the band keys
    node = F.coalesce("node", "doc_id")
    rows = saved(s.join(classes, key, "left").select(
        "doc_id", "n", F.when(F.col("doc_id").isNotNull(), node).alias("node"),
        F.when((F.col("doc_id") == node) & (F.col("n") > 0), F.col("keys")).alias("keys")), "minhash-rows")
    band = rows.filter("keys is not null").select("node", F.explode("keys").alias("key"))
    buckets = saved(band.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n"))
                    .filter("first <> last").select("key", "n"), "minhash-buckets")
    members = saved(band.join(buckets, "key").distinct(), "minhash-members")
    degree = saved(members.groupBy("node").agg(F.sum("n").alias("degree")), "minhash-degrees")
    known = saved(sets(docs.join(degree.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"), words), "minhash-sets")

    active, links, label = members.join(degree, "node").select("key", "node", "degree"), None, None
    while True:
        heads = saved(active.groupBy("key").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("a")), "minhash-heads")
        pairs = active.join(heads, "key").filter("node <> a").select("a", F.col("node").alias("b")).distinct()
        family = saved(compared(pairs, known, percent, True), "minhash-families")
        new = family.filter("linked").select("a", "b")
        links = new if links is None else links.unionByName(new)
        label = components(links)
        of = label.select(F.col("node").alias("a"), F.col("label").alias("of"))
        own = label.select(F.col("node").alias("b"), "label")
        family = family.join(of, "a", "left").join(own, "b", "left").withColumns(
            {"of": F.coalesce("of", "a"), "label": F.coalesce("label", "b")}).withColumn("far", F.col("label") != F.col("of"))
        # cap: the largest partner with which b's share of the head alone would do
        family = family.withColumn("cap", F.floor((100 + percent) * F.col("common") / percent).cast("long") - F.col("size"))
        limits = family.groupBy("a").agg(F.max(F.when(F.col("far"), F.col("cap"))).alias("most"), F.min("size").alias("least"))
        family = saved(family.join(limits.filter("most is not null"), "a"), "minhash-mixed")
        if family.isEmpty():
            break
        x = family.filter("far and cap >= least").select("a", F.col("b").alias("x"), F.col("label").alias("lx"), F.col("size").alias("size_x"),
                                                         F.col("cap").alias("cap_x"), F.col("parity").alias("px"))
        y = family.filter("size <= most").select("a", F.col("b").alias("y"), F.col("label").alias("ly"), F.col("size").alias("size_y"),
                                                 F.col("cap").alias("cap_y"), F.col("parity").alias("py"))
        pair = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
        close = x.join(y, "a").filter("x <> y and lx <> ly and size_y <= cap_x and size_x <= cap_y").filter(_may_link(percent)).select(*pair)
        # x needs percent of its size in common with y, so all but so many of its added elements: the rarest of these must hold one
        e = family.select("a", "b", "label", "far", "size", "parity", F.explode("added").alias("e"))
        often = e.groupBy("a", "e").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("any_far"))
        rarest = F.row_number().over(Window.partitionBy("a", "b").orderBy("n", "e"))
        e = e.join(often, ["a", "e"]).withColumn("r", rarest).filter(
            F.col("r") <= F.col("size") - F.ceil(F.col("size") * percent / 100) + 1).filter("n > 1 and any_far")
        e = saved(e.select("a", "e", "b", "label", "far", "size", "parity", "r"), "minhash-rarest")
        groups = e.groupBy("a", "e").agg(
            F.count_if("far").alias("n_far"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"),
            *[F.bit_xor(F.xxhash64("b", F.lit(k))).alias(f"m{k}") for k in (0, 1)]).filter("n_far > 0 and lo <> hi")
        # elements with the same members (the shingles around one changed word) give the same pairs: the rarest of them will do
        groups = saved(groups.groupBy("a", "n", "n_far", "m0", "m1").agg(F.min("e").alias("e")).select("a", "e", "n_far"), "minhash-groups")
        e = saved(e.join(groups, ["a", "e"]), "minhash-shared")
        few = e.filter(F.col("n_far") <= SMALL)
        x = few.filter("far").select("a", "e", F.col("b").alias("x"), F.col("label").alias("lx"), F.col("size").alias("size_x"),
                                     F.col("parity").alias("px"), F.col("r").alias("rx"))
        y = few.select("a", "e", F.col("b").alias("y"), F.col("label").alias("ly"), F.col("size").alias("size_y"),
                       F.col("parity").alias("py"), F.col("r").alias("ry"))
        shared = x.join(y, ["a", "e"]).filter("x <> y and lx <> ly").filter(_in_prefix(percent)).filter(_may_link(percent)).select(*pair)
        more = saved(compared(close.unionByName(shared).distinct(), known, percent, False), "minhash-pairs")
        links = links.unionByName(more.filter("linked").select("a", "b"))
        many = e.filter(F.col("n_far") > SMALL).select(F.xxhash64("a", "e").alias("key"), F.col("b").alias("node"))
        active = saved(many.join(degree, "node").select("key", "node", "degree"), "minhash-members")
        if active.isEmpty():
            label = components(links)
            break
    out = rows.join(label, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "node").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=2)
