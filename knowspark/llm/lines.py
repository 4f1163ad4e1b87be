"""Line dedup by sharded minimal perfect hashes (operator 4).

1. Tasks hash the distinct lines of each document and pack the entries
   (hash, fingerprint, document) by shard of the hash.
2. Entries are pre-aggregated a packet and gathered by shard.  A shard's
   distinct hashes get a minimal perfect hash that indexes three arrays:
   fingerprint, number of documents and smallest document.
3. Lines in more than one in ``HEAVY`` of all entries are fewer than ``HEAVY``;
   they go to all tasks as one small table.  The entries of all other lines
   probe their shard's arrays, so a line in a third of all documents is never
   gathered anywhere.
4. Documents drop the lines that their probes found elsewhere first.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z
lower-cased.  Keys of at least ``MIN_POINTS`` code points found in at least two
documents lose all their lines except in the smallest id holding the key.

Defined results: a null text counts as one empty line and stays null; rows with
a null id neither drop lines nor make others drop theirs; rows of one id are
one document; empty tables give empty results; all columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .common import documents, fresh, saved
from .mph import MinimalPerfectHash

MIN_POINTS = 10
HEAVY = 1000
SHARDS_PER_PARTITION = 2


def line_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines (without \\n), and line offsets by text."""
    n = len(buf)
    size = np.diff(off)
    ends = np.flatnonzero(buf == 10)
    text = np.searchsorted(off, ends, "right") - 1  # the text that each \n is in
    starts = np.concatenate([off[:-1], ends + 1])
    stops = np.concatenate([ends, off[1:]])
    owner_a, owner_b = np.concatenate([np.arange(len(size)), text]), np.concatenate([text, np.arange(len(size))])
    a = starts[np.lexsort((starts, owner_a))]
    b = stops[np.lexsort((stops, owner_b))]
    count = np.bincount(text, minlength=len(size)) + 1
    assert n == off[-1]
    return a, b, np.concatenate([[0], np.cumsum(count)])


def keys(buf: np.ndarray, off: np.ndarray, second: bool):
    """Line spans, line offsets, whether a line can be dropped, and the hashes of the lines' keys."""
    a, b, at = line_spans(buf, off)
    n = len(buf)
    solid = ~K.SPACE[buf]
    pos = np.arange(n)
    nxt = np.full(n + 1, n, np.int64)
    nxt[:n] = np.minimum.accumulate(np.where(solid, pos, n)[::-1])[::-1]
    prv = np.zeros(n + 1, np.int64)
    prv[1:] = np.maximum.accumulate(np.where(solid, pos + 1, 0))
    ka = np.minimum(nxt[a], b)
    kb = np.maximum(prv[b], ka)
    points = np.zeros(n + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
    fits = points[kb] - points[ka] >= MIN_POINTS
    low = K.LOWER[buf]
    h1 = K.Hasher(low)(ka, kb)
    h2 = (K.Hasher(low, K.SECOND_BASE)(ka, kb) >> np.uint64(32)).astype(np.uint32) if second else None
    return a, b, at, fits, h1, h2


_ENTRY = np.dtype([("h", "<u8"), ("f", "<u4"), ("doc", "<i8")])
_LINE = np.dtype([("h", "<u8"), ("f", "<u4"), ("first", "<i8"), ("last", "<i8"), ("n", "<i8")])


def _pack(x: np.ndarray) -> bytes:
    """Field after field, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(x[f]).tobytes() for f in x.dtype.names))


def _unpack(raw: bytes, kind: np.dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = len(raw) // kind.itemsize
    out, at = np.zeros(n, kind), 0
    for f in kind.names:
        out[f] = np.frombuffer(raw, kind[f], n, at)
        at += n * kind[f].itemsize
    return out


def entries(docs: DataFrame, shards: int) -> DataFrame:
    """Step 1: docs(doc_id, text) -> shard, packed entries; one row a shard and batch."""
    schema = pa.schema([("shard", pa.int32()), ("entries", pa.binary())])

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            buf, off = K.utf8(batch.column(1))
            found = [np.zeros(0, _ENTRY)]
            for i, j, b, o in K.slices(buf, off):
                _, _, at, fits, h1, h2 = keys(b, o, True)
                x = np.zeros(int(fits.sum()), _ENTRY)
                x["doc"] = np.repeat(ids[i:j], np.diff(at))[fits]
                x["h"], x["f"] = h1[fits], h2[fits]
                x = x[np.lexsort((x["f"], x["h"], x["doc"]))]
                if len(x):
                    x = x[np.append(True, x[1:] != x[:-1])]
                found.append(x)
            x = np.concatenate(found)
            shard = (x["h"] >> np.uint64(40)).astype(np.int64) % shards
            by = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[by], np.arange(shards + 1))
            rows = [(s, _pack(x[by[edges[s]: edges[s + 1]]])) for s in range(shards) if edges[s] < edges[s + 1]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                                  pa.array([r[1] for r in rows], pa.binary())], schema=schema)

    return docs.filter(F.col("doc_id").isNotNull()).mapInArrow(run, "shard int, entries binary")


def _grouped(x: np.ndarray) -> np.ndarray:
    """Entries or lines -> one line a distinct (hash, fingerprint)."""
    out = np.zeros(len(x), _LINE)
    if x.dtype == _ENTRY:
        out["h"], out["f"], out["first"], out["last"], out["n"] = x["h"], x["f"], x["doc"], x["doc"], 1
    else:
        out = x
    if not len(out):
        return out
    out = out[np.lexsort((out["f"], out["h"]))]
    new = np.flatnonzero(np.append(True, (out["h"][1:] != out["h"][:-1]) | (out["f"][1:] != out["f"][:-1])))
    got = out[new].copy()
    got["first"] = np.minimum.reduceat(out["first"], new)
    got["last"] = np.maximum.reduceat(out["last"], new)
    got["n"] = np.add.reduceat(out["n"], new)
    return got


def _ahead(batches) -> Iterator[pa.RecordBatch]:
    """Pre-aggregate packets before they are shuffled."""
    for batch in batches:
        got = [_pack(_grouped(_unpack(e, _ENTRY))) for e in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], names=["shard", "lines"])


def line_key(h: np.ndarray, f: np.ndarray) -> np.ndarray:
    return h ^ K.mix(f.astype(np.uint64) + np.uint64(1))


_ARRAYS = "shard int, index binary, fingerprints binary, counts binary, firsts binary, entries long, heaviest binary"


def _build(table: pa.Table) -> pa.Table:
    """Step 2 for one shard."""
    x = _grouped(np.concatenate([_unpack(e, _LINE) for e in table["lines"].to_pylist()]))
    index = MinimalPerfectHash(line_key(x["h"], x["f"]))
    at = index(line_key(x["h"], x["f"]))
    fp, count, first = np.zeros(len(x), "<u4"), np.zeros(len(x), "<u4"), np.zeros(len(x), "<i8")
    fp[at], first[at] = x["f"], x["first"]
    count[at] = np.where(x["first"] == x["last"], 1, np.clip(x["n"], 2, 0xFFFFFFFF))
    top = x[np.argsort(-x["n"], kind="stable")[:HEAVY]]
    c = zstandard.ZstdCompressor(level=1)
    return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "index": pa.array([c.compress(index.dumps())], pa.binary()),
                     "fingerprints": pa.array([fp.tobytes()], pa.binary()), "counts": pa.array([c.compress(count.tobytes())], pa.binary()),
                     "firsts": pa.array([c.compress(first.tobytes())], pa.binary()), "entries": pa.array([int(x["n"].sum())], pa.int64()),
                     "heaviest": pa.array([top.tobytes()], pa.binary())})


def _heavy(least: int):
    def run(batches):
        for batch in batches:
            x = np.concatenate([np.frombuffer(b, _LINE) for b in batch.column(0).to_pylist()] or [np.zeros(0, _LINE)])
            x = x[x["n"] >= least]
            yield pa.RecordBatch.from_arrays([pa.array(x["h"].astype(np.int64)), pa.array(x["f"].astype(np.int64)), pa.array(x["first"]),
                                              pa.array(x["last"])], names=["h", "f", "first", "last"])

    return run


def _without(heavy):
    """Packets without the entries of heavy lines."""
    def run(batches):
        h, f = heavy.value[:2]
        known = np.sort(line_key(h, f))
        for batch in batches:
            got, shard = [], []
            for s, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(known):
                    x = _unpack(e, _ENTRY)
                    x = x[~np.isin(line_key(x["h"], x["f"]), known)]
                    e = _pack(x) if len(x) else None
                if e is not None:
                    shard.append(s)
                    got.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(got, pa.binary())], names=["shard", "entries"])

    return run


def _probe(packets: pa.Table, arrays: pa.Table) -> pa.Table:
    """Step 3 for one shard: entries whose line has an earlier document."""
    out = [np.zeros(0, _ENTRY)]
    if len(packets) and len(arrays):
        d = zstandard.ZstdDecompressor()
        index = MinimalPerfectHash.loads(d.decompress(arrays["index"][0].as_py()))
        fp = np.frombuffer(arrays["fingerprints"][0].as_py(), "<u4")
        count = np.frombuffer(d.decompress(arrays["counts"][0].as_py()), "<u4")
        first = np.frombuffer(d.decompress(arrays["firsts"][0].as_py()), "<i8")
        for e in packets["entries"].to_pylist():
            x = _unpack(e, _ENTRY)
            at = index(line_key(x["h"], x["f"]))
            out.append(x[(at >= 0) & (fp[at] == x["f"]) & (count[at] >= 2) & (first[at] != x["doc"])])
    x = np.concatenate(out)
    return pa.table({"doc": pa.array(x["doc"]), "line": pa.array(x["h"].astype(np.int64))})


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` with its dropped lines taken out of ``text``, and the two counts (which replace columns of these names)."""
    spark = docs.sparkSession
    shards = SHARDS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.drop(n_lines, n_dropped)
    packed = saved(entries(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), shards), "line-entries")
    arrays = saved(packed.mapInArrow(_ahead, "shard int, lines binary").groupBy("shard").applyInArrow(_build, _ARRAYS), "line-arrays")
    total = arrays.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]
    least = total // HEAVY + 1  # fewer than HEAVY lines can have so many entries
    rows = arrays.select("heaviest").mapInArrow(_heavy(least), "h long, f long, first long, last long").collect()
    assert len(rows) <= HEAVY
    heavy = spark.sparkContext.broadcast((
        np.array([r["h"] for r in rows], np.int64).astype(np.uint64), np.array([r["f"] for r in rows], np.uint32),
        np.array([r["first"] for r in rows], np.int64), np.array([r["last"] for r in rows], np.int64)))
    probes = packed.mapInArrow(_without(heavy), "shard int, entries binary")
    found = probes.groupBy("shard").cogroup(arrays.groupBy("shard")).applyInArrow(_probe, "doc long, line long")
    mine, key = fresh(docs.columns, "drops"), fresh(docs.columns, "doc")
    drops = found.groupBy(F.col("doc").alias(key)).agg(F.collect_list("line").alias(mine))
    joined = docs.join(drops, F.col(doc_id).cast("long") == F.col(key), "left").select(*docs.columns, mine)
    at_text, at_id = docs.columns.index(text), docs.columns.index(doc_id)

    def run(batches):
        h, f, first, last = heavy.value
        order = np.argsort(h, kind="stable")
        h, f, first, last = h[order], f[order], first[order], last[order]
        several = first != last
        for batch in batches:
            ids = batch.column(at_id).cast(pa.int64())
            real = ids.is_valid().to_numpy(zero_copy_only=False)
            doc = ids.fill_null(0).to_numpy(zero_copy_only=False)
            drop = batch.column(batch.num_columns - 1)
            size = drop.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = drop.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            edge = np.concatenate([[0], np.cumsum(size)])
            buf, off = K.utf8(batch.column(at_text))
            texts, lines, dropped = [], [], []
            for i, j, b, o in K.slices(buf, off):
                a, e, at, fits, h1, _ = keys(b, o, False)
                owner = np.repeat(np.arange(i, j), np.diff(at))
                gone = np.zeros(len(a), bool)
                if edge[j] > edge[i]:  # (document, hash) pairs of the slice's drops, looked up at once
                    who = np.repeat(np.arange(i, j), size[i:j]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    want = np.sort(K.mix(flat[edge[i]: edge[j]] ^ who))
                    have = K.mix(h1 ^ owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    k = np.searchsorted(want, have).clip(max=len(want) - 1)
                    gone |= want[k] == have
                if len(h):
                    k = np.searchsorted(h, h1).clip(max=len(h) - 1)
                    gone |= (h[k] == h1) & several[k] & (first[k] != doc[owner])
                gone &= fits & real[owner]
                n = np.diff(at)
                lost = np.add.reduceat(gone.astype(np.int64), at[:-1]) if len(n) else n
                lines.append(n)
                dropped.append(lost)
                raw = b.tobytes()
                for t in range(j - i):
                    if lost[t]:
                        keep = np.flatnonzero(~gone[at[t]: at[t + 1]]) + at[t]
                        texts.append(b"\n".join([raw[p:q] for p, q in zip(a[keep].tolist(), e[keep].tolist())]))
                    else:
                        texts.append(raw[o[t]: o[t + 1]])
            new = pa.array(texts, pa.binary()).cast(pa.string())
            valid = batch.column(at_text).is_valid()
            columns = batch.columns[:-1]
            columns[at_text] = pc.if_else(valid, new, pa.scalar(None, pa.string()))
            counts = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (lines, dropped)]
            yield pa.RecordBatch.from_arrays(columns + counts, names=batch.schema.names[:-1] + [n_lines, n_dropped])

    out = T.StructType([*docs.schema, T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])
    return joined.mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
m AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT l.*, m.first IS NOT NULL AND m.first <> l.doc_id AS gone FROM l LEFT JOIN m USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""
