"""Spelling variants by dense prefix-suffix tiling (operator 13).

Words are counted in tasks and summed by Spark.  Two words are *near* if they
differ by one inserted, deleted or replaced code point, that is, if their common
prefix and common suffix together reach the longer length minus one.

Near pairs: an edit leaves the first half or the rest of the shorter word as it
is (halves of m // 2 and m - m // 2 code points, m the shorter length).  So
every word is filed under four keys: first and second half as the shorter word
(m its length) and as the longer one (m its length - 1).  Rows are dealt and
sorted by key, and tasks read them as tiles: padded code-point matrices, left-
aligned for prefixes and right-aligned for suffixes, whose rows are compared
with the rows 1, 2, 3 ... places on while these have the same key.  A key with
many words is cut into blocks, and each pair of its blocks is a tile of its own,
so no task takes a whole key.  A pair found by the first halves is not counted
again by the second ones.

A word's form is its near word of largest n (ties: smallest in code-point
order), if that is at least ``RATIO`` times its own n.  Along forms n grows by
that factor, so chains are short; roots come from joins that double the step.

Defined results: null and empty texts have no words; in the run's key a null id
is an empty string; repeated rows count again; other columns are ignored; empty
tables give empty results.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, saved

RUN = re.compile("[A-Za-z\u00C0-\u00FF]+")
NO_RUN = re.compile("[^A-Za-z\u00C0-\u00FF]")
EVERY, LEAST_LENGTH, LEAST_COUNT, RATIO = 199, 6, 5, 5
PIECE = 1 << 20  # code points of a text that are searched at once
HELD = 200_000  # distinct words that a task holds before it passes them on
TILE_ROWS, TILE_CELLS = 1024, 1 << 22

_UPPER = {c: c + 32 for c in range(65, 91)}


def runs(text: str) -> Iterator[list[str]]:
    """The runs of a text with A-Z lower-cased, in pieces of about ``PIECE`` code points."""
    at = 0
    while at < len(text):
        m = NO_RUN.search(text, at + PIECE) if len(text) - at > PIECE else None
        to = m.start() if m else len(text)
        yield RUN.findall(text[at:to].translate(_UPPER))
        at = to


def mangled(key: bytes, word: str) -> str:
    """The word, without one code point where 199 divides the crc32 of ``key`` + word."""
    h = zlib.crc32(word.encode(), zlib.crc32(key))
    if h % EVERY:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1:]


def counts(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """docs(doc_id, text) -> word, n over all documents; words of at least ``least_length`` code points."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def batch_of(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=schema)

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                prefix = b":" if doc is None else b"%d:" % doc
                start = zlib.crc32(prefix)
                for words in runs(text):
                    for w, n in Counter(words).items():
                        if len(w) < least_length:
                            continue
                        if zlib.crc32(w.encode(), start) % EVERY == 0:
                            w = mangled(prefix, w)
                            if len(w) < least_length:
                                continue
                        held[w] += n
                    if len(held) > HELD:
                        yield batch_of(held)
                        held.clear()
        if held:
            yield batch_of(held)

    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def keyed(words: DataFrame) -> DataFrame:
    """words(word, n) -> key, m, second (by the second half), longer (filed as the longer word), word, n."""
    size = F.length("word")
    rows = []
    for longer in (False, True):
        m = size - int(longer)
        half = F.floor(m / 2).cast("int")
        for second in (False, True):
            part = F.substring(F.col("word"), size - (m - half) + 1, m - half) if second else F.substring(F.col("word"), F.lit(1), half)
            rows.append(F.struct(F.xxhash64(m, F.lit(second), part).alias("key"), m.alias("m"), F.lit(second).alias("second"),
                                 F.lit(longer).alias("longer")))
    return words.select("word", "n", F.explode(F.array(*rows)).alias("r")).select("r.*", "word", "n")


def tiled(rows: DataFrame) -> DataFrame:
    """Rows of keys that hold a possible pair, cut into tiles: adds ``i``, ``j``, ``side`` (0 of block i, 1 of block j)."""
    per = F.greatest(F.lit(16), F.least(F.lit(TILE_ROWS), F.floor(F.lit(TILE_CELLS) / (F.col("m") + 1))))
    many = rows.groupBy("key", "m").agg(F.count(F.lit(1)).alias("of"), F.count_if("longer").alias("longer"))
    many = many.filter("of > 1 and of > longer").select("key", "m", F.ceil(F.col("of") / per).cast("int").alias("blocks"))
    r = rows.join(many, ["key", "m"]).withColumn("b", F.pmod(F.xxhash64("word", F.lit(1)), F.col("blocks")).cast("int"))
    one = F.struct(F.col("b").alias("i"), F.col("b").alias("j"), F.lit(0).alias("side"))
    places = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(
        F.least("b", x).alias("i"), F.greatest("b", x).alias("j"), (F.col("b") > x).cast("int").alias("side")))
    return r.withColumn("t", F.explode(F.when(F.col("blocks") > 1, places).otherwise(F.array(one)))).select(
        "key", "m", "second", "longer", "word", "n", "t.*")


def matrices(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left-aligned, right-aligned and reversed, lengths); code points of the words are below 256, padding is 0."""
    size = np.array([len(w) for w in words], np.int64)
    wide = int(size.max(initial=0))
    left = np.array(words, f"S{max(wide, 1)}").view(np.uint8).reshape(len(words), -1)
    right = np.array([w[::-1] for w in words], f"S{max(wide, 1)}").view(np.uint8).reshape(len(words), -1)
    return left, right, size


def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each row pair (the width where all is equal)."""
    differs = x != y
    return np.where(differs.any(1), differs.argmax(1), x.shape[1])


def near_rows(key: np.ndarray, m: np.ndarray, second: np.ndarray, longer: np.ndarray, cross: np.ndarray, side: np.ndarray,
              words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Positions (x, y) of near pairs among rows sorted by ``key``; rows of a tile of two blocks meet the other block's only."""
    left, right, size = matrices(words)
    xs, ys, d = [], [], 1
    at = np.arange(len(words))
    while True:
        at = at[at + d < len(words)]
        at = at[key[at] == key[at + d]]
        if not len(at):
            break
        x, y = at, at + d
        fit = ~(longer[x] & longer[y]) & (~cross[x] | (side[x] != side[y]))
        x, y = x[fit], y[fit]
        p, q = common(left[x], left[y]), common(right[x], right[y])
        hit = (p + q >= np.maximum(size[x], size[y]) - 1) & ~(second[x] & (p >= m[x] // 2))
        xs.append(x[hit])
        ys.append(y[hit])
        d += 1
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (at[:0], at[:0])


def near(words: DataFrame) -> DataFrame:
    """words(word, n) of distinct words -> word, other, n_other: every near pair in both directions."""
    tiles = tiled(saved(keyed(words), "spelling-keys"))
    tiles = tiles.repartition("key", "m", "i", "j").sortWithinPartitions("key", "m", "i", "j", "word")
    schema = pa.schema([("word", pa.string()), ("other", pa.string()), ("n_other", pa.int64())])

    def compared(t: pa.Table) -> pa.RecordBatch:
        col = {c: t[c].to_numpy() for c in ("key", "m", "second", "longer", "i", "j", "side", "n")}
        words = [w.encode("latin-1") for w in t["word"].to_pylist()]
        change = np.zeros(len(words), np.int64)
        for c in ("key", "m", "i", "j"):
            change[1:] |= col[c][1:] != col[c][:-1]
        x, y = near_rows(np.cumsum(change), col["m"], col["second"], col["longer"], col["i"] != col["j"], col["side"], words)
        a, b = np.concatenate([x, y]), np.concatenate([y, x])
        word = t["word"].combine_chunks()
        return pa.RecordBatch.from_arrays([word.take(pa.array(a)), word.take(pa.array(b)), pa.array(col["n"][b])], schema=schema)

    def run(batches):
        held, rows, most = [], 0, 64 * TILE_ROWS
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows < most:
                continue
            t = pa.Table.from_batches(held)
            # the last tile may go on in the next batch
            cols = [t[c].to_numpy() for c in ("key", "m", "i", "j")]
            same = np.flatnonzero(np.any([c != c[-1] for c in cols], 0))
            done = int(same[-1]) + 1 if len(same) else 0
            for part in cut(t.slice(0, done)):
                yield compared(part)
            held, rows = t.slice(done).to_batches(), len(t) - done
            most = rows + 64 * TILE_ROWS
        if rows:
            for part in cut(pa.Table.from_batches(held)):
                yield compared(part)

    def cut(t: pa.Table) -> Iterator[pa.Table]:
        """Runs of whole tiles of at most about ``TILE_CELLS`` cells."""
        if not len(t):
            return
        cols = [t[c].to_numpy() for c in ("key", "m", "i", "j")]
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], 0)) + 1
        start, wide = 0, 0
        m = cols[1]
        edge = np.append(edge, len(t)).tolist()
        last = 0
        for e in edge:
            w = max(wide, int(m[last]) + 1)
            if last > start and (e - start) * w > TILE_CELLS:
                yield t.slice(start, last - start)
                start, w = last, int(m[last]) + 1
            wide, last = w, e
        yield t.slice(start)

    return tiles.mapInArrow(run, "word string, other string, n_other long")


def rooted(forms: DataFrame) -> DataFrame:
    """forms(word, form) -> word, root: the last word along forms, for words that have one."""
    reach = saved(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = saved(reach.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")),
                    "spelling-roots")
        reach = new.select("word", "root")
        if new.filter("went").isEmpty():
            return reach


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """docs(doc_id, text, ...) -> word, form, root, n, n_near, form_n: one row a word."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = saved(counts(docs, least_length).filter(F.col("n") >= least_count), "spelling-words")
    best = near(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best"))
    out = words.join(best, "word", "left")
    has = -F.col("best.less") >= ratio * F.col("n")
    out = saved(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.other")).alias("form"),
                           F.when(has, -F.col("best.less")).alias("form_n")), "spelling-forms")
    roots = rooted(out.filter("form is not null"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))
