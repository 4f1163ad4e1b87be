"""Toxicity by a convolutional text classifier in numpy (operator 8).

A word's vector is the sum of hashed embeddings of the word and of its first
bytes; filters of several widths run over the words, the maximum of each filter
over the whole text feeds a logistic output.  It is trained on the driver on a
bounded sample of labelled rows (``MAX_PER_CLASS`` rows a class, rows of at most
``MAX_TRAIN_BYTES`` bytes), then every whole text is scored in the tasks.

Thresholds are calibrated by language over all labelled rows that are not held
out, of any length: the tasks score them, and rows are counted by language (told
from the text's own function words), score bin and label.  For each language the
cut with the best F-measure of these counts is taken (precision counts more,
since clean documents must stay), and scores are shifted so that this cut
becomes ``CUT``.  Scores of rows that the model was trained on say nothing about
other rows, so these rows count with the scores of the others of their language,
label and length (under or over ``MAX_TRAIN_BYTES``), if there are any; a quarter
of the sample is kept out of training for that.  Only the text enters a score.

Defined results: null and empty texts score as a text without words; a null id
is not held out; repeated rows score equally; without labels of both classes
all scores are 0; empty tables give empty results.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .common import documents, table

MAX_PER_CLASS = 1500
MAX_TRAIN_BYTES = 20_000
CUT = 0.3
BUCKETS, DIM, WIDTHS, FILTERS, PREFIXES = 1 << 16, 16, (1, 2, 3), 16, (4, 5, 6)
EPOCHS, STEPS, BATCH, RATE, SEED = 8, 500, 32, 0.08, 7
MIN_LANGUAGE, MIN_TEXTS, BETA = 15, 3, 0.5
#: Words of a slice whose activations are made at once, at least.
BLOCK = 4096
#: Score bins of the calibration: log-odds in steps of 1 / STEP, from -EDGE to EDGE.
STEP, EDGE = 32, 21

#: Function words that tell the language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with as on be by",
    "fr": "le la les des et un une est que qui dans pour du pas sur",
    "de": "der die das und ist den von mit zu ein eine nicht im auf sich",
    "es": "el los las una por con para es del se lo como su al y",
}

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


@lru_cache(maxsize=1)
def _function_hashes() -> list[np.ndarray]:
    out = []
    for words in FUNCTION_WORDS.values():
        w = [x.encode() for x in words.split()]
        ends = np.cumsum([len(x) for x in w])
        out.append(np.sort(K.span_hashes(np.frombuffer(b"".join(w), np.uint8), ends - [len(x) for x in w], ends)))
    return out


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets of each word (words x features), word offsets by text, and each text's language (-1: none)."""
    low = K.LOWER[buf]
    solid = _LETTER[buf]
    n = len(buf)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:n]
    last[:-1] &= ~solid[1:] | cut[1:n]
    a, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashed = K.Hasher(low).begun(a)
    whole = hashed(e)
    each = [whole] + [hashed(np.minimum(a + p, e)) + np.uint64(p * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) for p in PREFIXES]
    at = np.searchsorted(a, off)
    votes = np.zeros((len(off) - 1, len(FUNCTION_WORDS)), np.int64)
    for k, known in enumerate(_function_hashes()):
        hit = np.concatenate([[0], np.cumsum(known[np.searchsorted(known, whole).clip(max=len(known) - 1)] == whole)])
        votes[:, k] = hit[at[1:]] - hit[at[:-1]]
    lang = np.where(votes.max(1) > 0, votes.argmax(1), -1)
    return np.stack([(x >> np.uint64(40)).astype(np.int64) % BUCKETS for x in each], 1), at, lang


class Model:
    def __init__(self):
        r = np.random.default_rng(SEED)
        self.emb = r.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.filters = [r.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = r.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.prior = np.zeros(1, np.float32)
        self.cuts = np.full(len(FUNCTION_WORDS) + 1, CUT)
        self.constant: float | None = None
        self.fitted_on = np.zeros(0, np.int64)  # ids

    def _vectors(self, ids: np.ndarray) -> np.ndarray:
        x = self.emb[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            x += self.emb[ids[:, k]]
        return x

    def _pooled(self, ids, at, where: bool):
        """Maxima of the filters by text and, if asked, the word at which each lies (-1: no activation)."""
        n = len(at) - 1
        pooled = np.zeros((n, len(self.out)), np.float32)
        arg = np.full(pooled.shape, -1, np.int64)
        full = np.flatnonzero(np.diff(at))
        if not len(full):
            return pooled, arg, None
        x = self._vectors(ids)
        final = np.zeros(len(x), np.int64)  # words left in the text after this one
        final = np.repeat(at[1:], np.diff(at)) - np.arange(len(x)) - 1
        for k, w in enumerate(WIDTHS):
            y = x @ self.filters[k][:DIM]
            for s in range(1, w):
                z = x[s:] @ self.filters[k][s * DIM: (s + 1) * DIM]
                z[final[:-s] < s] = 0
                y[:-s] += z
            y += self.bias[k]
            top = np.maximum.reduceat(y, at[:-1][full], axis=0)
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            pooled[full, cols] = np.maximum(top, 0)
            if where:
                for i in full:
                    seg = y[at[i]: at[i + 1]]
                    best = seg.argmax(0)
                    arg[i, cols] = np.where(seg[best, np.arange(FILTERS)] > 0, at[i] + best, -1)
        return pooled, arg, x

    def _maxima(self, ids, at) -> np.ndarray:
        """The maxima of :meth:`_pooled`, made a block of words at a time: one product gives all filters, a row each."""
        full, n = np.flatnonzero(np.diff(at)), len(ids)
        begin, most = at[:-1][full], max(WIDTHS)
        filters = np.concatenate([f[s * DIM: (s + 1) * DIM] for f, w in zip(self.filters, WIDTHS) for s in range(w)], 1).T.copy()
        final = np.repeat(at[1:], np.diff(at)) - np.arange(n) - 1  # words left in the text after this one
        ids = np.ascontiguousarray(ids.T)
        top = np.zeros((len(self.out), len(full)), np.float32)
        cuts = np.linspace(0, n, max(1, n // BLOCK) + 1).astype(np.int64)
        for i, j in zip(cuts[:-1], cuts[1:]) if n else ():
            e = min(j + most - 1, n)
            z = filters @ self._vectors(ids[:, i:e].T).T
            first, last = np.searchsorted(begin, i, "right") - 1, np.searchsorted(begin, j)
            starts, row = np.maximum(begin[first:last] - i, 0), 0
            short = [np.flatnonzero(final[i: e - s] < s) for s in range(most)]
            for k, w in enumerate(WIDTHS):
                y = z[row: row + FILTERS]
                row += FILTERS
                for s in range(1, w):
                    tail = z[row: row + FILTERS, s:]
                    row += FILTERS
                    tail[:, short[s]] = 0
                    y[:, : e - i - s] += tail
                y = y[:, : j - i]
                y += self.bias[k][:, None]
                some = top[k * FILTERS: (k + 1) * FILTERS, first:last]
                np.maximum(some, np.maximum.reduceat(y, starts, axis=1), out=some)
        pooled = np.zeros((len(at) - 1, len(self.out)), np.float32)
        pooled[full] = top.T
        return pooled

    def raw(self, ids, at) -> np.ndarray:
        pooled = self._maxima(ids, at)
        return 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.prior[0], -30, 30, dtype=np.float64)))

    def score(self, ids, at, lang) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(at) - 1, self.constant)
        p = np.clip(self.raw(ids, at), 1e-9, 1 - 1e-9)
        cut = self.cuts[lang]
        z = np.log(p / (1 - p)) - np.log(cut / (1 - cut)) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-z))

    def fit(self, texts: list[bytes], toxic: np.ndarray) -> None:
        r = np.random.default_rng(SEED)
        data = []
        for t in texts:
            buf = np.frombuffer(t, np.uint8)
            data.append(words(buf, np.array([0, len(buf)])))
        # features of too few training texts tell nothing about other texts: their vectors stay zero
        seen = np.bincount(np.concatenate([np.unique(d[0]) for d in data]), minlength=BUCKETS)
        frozen = seen < max(MIN_TEXTS, len(data) // 400)
        self.emb[frozen] = 0
        sums = {}

        def step(name, p, g, rows=None):
            h = sums.setdefault(name, np.zeros_like(p))
            if rows is None:
                h += g * g
                p -= RATE * g / np.sqrt(h + 1e-6)
            else:
                np.add.at(h, rows, g * g)
                np.add.at(p, rows, -RATE * g / np.sqrt(h[rows] + 1e-6))

        sides = [np.flatnonzero(toxic == y) for y in (0, 1)]
        for _ in range(max(STEPS, EPOCHS * len(data) // BATCH)):  # as many rows of either class
            some = np.concatenate([r.choice(side, BATCH // 2) for side in sides])
            ids = np.concatenate([data[i][0] for i in some])
            at = np.concatenate([[0], np.cumsum([len(data[i][0]) for i in some])])
            pooled, arg, x = self._pooled(ids, at, True)
            p = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.prior[0], -30, 30)))
            err = ((p - toxic[some]) / len(some)).astype(np.float32)
            back = err[:, None] * self.out * (arg >= 0)
            g_out = pooled.T @ err
            if x is not None:
                end = np.repeat(at[1:], np.diff(at))
                rows, grads = [], []
                for k, w in enumerate(WIDTHS):
                    cols = np.arange(k * FILTERS, (k + 1) * FILTERS)
                    d, f = np.nonzero(back[:, cols])
                    g, pos = back[d, cols[f]], arg[d, cols[f]]
                    gf = np.zeros_like(self.filters[k])
                    for s in range(w):
                        ok = pos + s < end[pos]
                        np.add.at(gf[s * DIM: (s + 1) * DIM].T, f[ok], g[ok, None] * x[pos[ok] + s])
                        rows.append(pos[ok] + s)
                        grads.append(g[ok, None] * self.filters[k][s * DIM: (s + 1) * DIM].T[f[ok]])
                    gb = np.bincount(f, g, FILTERS).astype(np.float32)
                    step(("f", k), self.filters[k], gf)
                    step(("b", k), self.bias[k], gb)
                rows, grads = np.concatenate(rows), np.concatenate(grads)
                for k in range(ids.shape[1]):
                    live = ~frozen[ids[rows, k]]
                    step("emb", self.emb, grads[live], ids[rows[live], k])
            step("out", self.out, g_out)
            step("prior", self.prior, np.array([err.sum()], np.float32))

    def bins(self, ids, at) -> np.ndarray:
        p = np.clip(self.raw(ids, at), 1e-9, 1 - 1e-9)
        return np.floor(np.log(p / (1 - p)) * STEP).astype(np.int64) + EDGE * STEP

    def calibrate(self, counts: list[tuple[int, int, int, bool, bool, int]]) -> None:
        """Cut of each language with the best F-measure from (language, bin, toxic, over MAX_TRAIN_BYTES, trained on, rows)."""
        n = np.zeros((len(FUNCTION_WORDS) + 1, 2, 2, 2, 2 * EDGE * STEP))  # the last language: none
        for lang, at, toxic, large, trained, rows in counts:
            n[lang, toxic, int(large), int(trained), at] += rows
        every, others = n.sum(axis=3), n[:, :, :, 0]
        size, rest = every.sum(-1, keepdims=True), others.sum(-1, keepdims=True)
        by_label = np.where(rest > 0, others * size / np.maximum(rest, 1), every).sum(axis=2)
        edge = 1 / (1 + np.exp(-(np.arange(2 * EDGE * STEP + 1) / STEP - EDGE)))

        def best(mine: np.ndarray, least: int = MIN_LANGUAGE) -> float | None:
            if mine.sum(1).min() < least:
                return None
            used = np.flatnonzero(mine.sum(0))[::-1]
            tp, fp = np.cumsum(mine[1, used]), np.cumsum(mine[0, used])
            k = int(((1 + BETA ** 2) * tp / (tp + fp + BETA ** 2 * tp[-1])).argmax())
            low = edge[used[k + 1] + 1] if k + 1 < len(used) else 0.0
            return float(np.clip((edge[used[k]] + low) / 2, 0.1, 0.98))

        overall = best(by_label.sum(0), 1) or CUT
        for k in range(-1, len(FUNCTION_WORDS)):
            self.cuts[k] = best(by_label[k]) or overall


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic), a row an id, of the labels that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS) -> list:
    """(doc_id, text, toxic) of at most ``per_class`` rows a class, the same for the same rows."""
    known = labelled(labels)
    parts = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(per_class) for y in (0, 1)]
    ids = parts[0].unionByName(parts[1])
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = d.filter(F.octet_length("text") <= MAX_TRAIN_BYTES).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(
        F.max("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])[: 2 * per_class]
    return [(r["doc_id"], r["text"].encode(), r["toxic"]) for r in rows]


def train(rows: list) -> Model:
    """Model of rows of ``sample``, not calibrated."""
    m = Model()
    y = np.array([r[2] for r in rows])
    if not len(y) or y.min() == y.max():
        m.constant = 0.0
        return m
    keep = np.arange(len(rows)) % 4 != 3
    if min((y[~keep] == 1).sum(), (y[~keep] == 0).sum(), (y[keep] == 1).sum(), (y[keep] == 0).sum()) == 0:
        keep[:] = True
    m.fit([r[1] for r, k in zip(rows, keep) if k], y[keep])
    m.fitted_on = np.array([r[0] for r, k in zip(rows, keep) if k], np.int64)
    return m


def score_counts(docs: DataFrame, labels: DataFrame, model: Model) -> list[tuple[int, int, int, bool, bool, int]]:
    """What ``calibrate`` takes, over all labelled rows; texts are scored where they are read, only ids and bins are joined."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    names = ["doc_id", "lang", "bin", "large", "trained"]

    def run(batches):
        m = sent.value
        for batch in batches:
            buf, off = K.utf8(batch.column(1))
            lang, at_bin = np.zeros((2, len(off) - 1), np.int64)
            for i, j, b, o in K.slices(buf, off):
                ids, at, lang[i:j] = words(b, o)
                at_bin[i:j] = m.bins(ids, at)
            trained = np.isin(batch.column(0).to_numpy(), m.fitted_on)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (lang, at_bin, np.diff(off) > MAX_TRAIN_BYTES, trained))], names=names)

    scored = d.mapInArrow(run, "doc_id long, lang long, bin long, large boolean, trained boolean")
    n = scored.join(labelled(labels), "doc_id").groupBy("lang", "bin", "toxic", "large", "trained").agg(F.count(F.lit(1)).alias("n"))
    return [tuple(r) for r in n.collect()]  # languages x bins x 8 rows at most


def toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (double) and ``predicted`` (int), which replace columns of these names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted")
    at_text = docs.columns.index(text)

    def run(batches):
        m = sent.value
        for batch in batches:
            buf, off = K.utf8(batch.column(at_text))
            got = np.zeros(len(off) - 1)
            for i, j, b, o in K.slices(buf, off):
                got[i:j] = m.score(*words(b, o))
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(got), pa.array((got >= CUT).astype(np.int32))],
                                             names=batch.schema.names + ["score", "predicted"])

    out = T.StructType([*docs.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(run, out)


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS) -> Model:
    model = train(sample(docs, labels, per_class))
    if model.constant is None:
        model.calibrate(score_counts(docs, labels, model))
    return model


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fitted(docs, table(spark, sf_dir, "labels"))
    return toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
