"""Inverted index over the entry table.

``postings``    (store, term, id, tf, dl, pos_name, pos_content, pos_tags) -- one row per term of an entry
``lengths``     (store, id, dl)           -- tokens of name+content+tags
``store_stats`` (store, n_docs, n_tokens, avgdl)
``terms``       (store, term, df, bits, peak)  -- one row per term: entries that hold it, and how it is cut into blocks
``blocks``      (store, term, block, n, peak, docs) -- about ``BLOCK`` postings each, with the largest share of a score

Statistics are per store and always computed over the *whole* store, never
over a filtered subset (ranking of a filtered search still uses whole-store
document frequencies).

At scale the index is built once per snapshot and written with
``write_index``: postings partitioned by store and sorted by term, so a
search, which filters ``term`` by literals, reads only the row groups whose
term bounds cover its terms.  On disk a row holds the uses of a term in some
entries (``uses``), and :func:`read_table` gives a row a posting again: what is
shuffled, sorted and written is a row a term of many entries.  The range key
ends with the hash of a row's first id: the postings of one frequent term can
spread over several files.  Entries are range-partitioned and sorted by id, so
the rows of a result are fetched by narrow id bounds.

A term's blocks are cut by the leading bits of a hash of the entry id.  So the
block of an entry in any term's list is known without a search, and blocks of
one term are of even size whatever the ids are.  Entries are cut into words in
order of that hash, so the uses of a row are of few blocks, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..schema import ENTRY_SCHEMA, SEARCH_COLUMNS
from ..session import held, scratch_path, shuffles_removed
from . import commits

K1 = 1.2
B = 0.75
#: postings of a term in a block, on average
BLOCK = 128


def tokenized(entries: DataFrame) -> DataFrame:
    """(store, id, dl, t_name, t_content, t_tags): an entry's tokens by column, and their number."""
    t = entries.select("store", "id", *[tokens(F.coalesce(F.col(c), F.lit(""))).alias(f"t_{c}") for c in SEARCH_COLUMNS])
    dl = sum((F.size(f"t_{c}") for c in SEARCH_COLUMNS), F.lit(0))
    return t.withColumn("dl", dl.cast("long"))


def _postings(toks: DataFrame) -> DataFrame:
    """Postings by built-ins alone: a search's filter on ``term`` reaches the words before they are grouped."""
    columns = F.array(*[F.struct(F.lit(k).alias("col"), F.col(f"t_{c}").alias("t")) for k, c in enumerate(SEARCH_COLUMNS)])
    one = toks.select("store", "id", "dl", F.inline(columns)).select("store", "id", "dl", "col", F.posexplode("t").alias("pos", "term"))
    return one.groupBy("store", "term", "id").agg(
        F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"),
        *[F.sort_array(F.collect_list(F.when(F.col("col") == k, F.col("pos")))).alias(f"pos_{c}") for k, c in enumerate(SEARCH_COLUMNS)])


#: words of entries that are counted at once; an entry with more is counted alone
WORDS = 1 << 20


def _new_key(batch: pa.RecordBatch) -> np.ndarray:
    """Whether a row's (store, id) differs from the one's before it; the first row's does."""
    new = np.ones(batch.num_rows, bool)
    store, id = batch.column(0).dictionary_encode().indices.to_numpy(False), batch.column(1)
    none, id = id.is_null().to_numpy(False), id.fill_null(0).to_numpy(False)
    new[1:] = (store[1:] != store[:-1]) | (id[1:] != id[:-1]) | (none[1:] != none[:-1])
    return new


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (store, id), cut so that the rows of a key stay together, at about ``WORDS`` words and where the store changes."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(_new_key(batch))
        if not len(starts):
            continue
        words = np.concatenate([[0], np.cumsum(batch.column(2).to_numpy(False))])
        store = batch.column(0).dictionary_encode().indices.to_numpy(False)
        cuts, done = [0], 0
        for at in starts[1:]:
            if words[at] - done >= WORDS or store[at] != store[at - 1] or at == starts[-1]:
                cuts.append(int(at))
                done = words[at]
        if kept and any(kept[0].column(k)[0].as_py() != batch.column(k)[0].as_py() for k in (0, 1)):
            yield pa.concat_batches(kept)
            kept = []
        for at, to in zip(cuts, [*cuts[1:], batch.num_rows]):
            kept.append(batch.slice(at, to - at))
            if to < batch.num_rows:
                yield pa.concat_batches(kept)
                kept = []
    if kept:
        yield pa.concat_batches(kept)


def _uses(positions: bool, lengths: bool):
    """What :func:`_cut` runs in a task."""
    fields = ["id", "tf", "dl", *([f"pos_{c}" for c in SEARCH_COLUMNS] if positions else [])]

    def packed(store: pa.Array, term: pa.Array, starts: np.ndarray, uses: list[pa.Array]) -> pa.RecordBatch:
        """A row a term with its uses, which begin at ``starts``; all are of one store."""
        ends = pa.array(np.append(starts, len(uses[0])).astype(np.int32))
        lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(uses, fields))
        return pa.RecordBatch.from_arrays([store.take(pa.array(np.zeros(len(starts), np.int64))), term, lists], ["store", "term", "uses"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_keys(batches):
            store, id, dl = batch.columns[:3]
            if lengths:
                n = batch.num_rows
                none = [pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.int32()))] * (len(fields) - 3)
                yield packed(store, pa.nulls(1, pa.string()), np.zeros(1, int), [id, pa.array(np.zeros(n, np.int64)), dl, *none])
            new = _new_key(batch)
            entry, first = np.cumsum(new) - 1, np.flatnonzero(new)
            words, of, col, pos = [], [], [], []
            for k, t in enumerate(batch.columns[3:]):
                ends = np.asarray(t.offsets)
                n = np.diff(ends)
                words.append(t.flatten())
                of.append(np.repeat(entry, n))
                col.append(np.full(len(words[-1]), k, np.int8))
                pos.append(np.arange(len(words[-1]), dtype=np.int32) - np.repeat((ends[:-1] - ends[0]).astype(np.int32), n))
            coded = pa.concat_arrays(words).dictionary_encode()
            if not len(coded):
                continue
            order = pc.sort_indices(coded.dictionary)  # rows in order of their terms, so a slice of terms is a part of a file
            rank = np.empty(len(order), np.int32)
            rank[order.to_numpy(False)] = np.arange(len(order), dtype=np.int32)
            coded = pa.DictionaryArray.from_arrays(rank[coded.indices.to_numpy(False)], coded.dictionary.take(order))
            code, of, col, pos = coded.indices.to_numpy(False).astype(np.int64), np.concatenate(of), np.concatenate(col), np.concatenate(pos)
            if not new.all():  # words come by column and position, but not those of several rows of a key
                at = np.lexsort((pos, col))
                code, of, col, pos = code[at], of[at], col[at], pos[at]
            # by term, so that what follows meets a term's uses together, then by entry, column and position
            bits, more = len(first).bit_length(), len(code).bit_length()
            key, use = code << bits | of, np.arange(len(code))
            if len(coded.dictionary).bit_length() + bits + more < 64:
                use = np.sort(key << more | use)
                use, key = use & ((1 << more) - 1), use >> more
            else:
                use = np.argsort(key, kind="stable")
                key = key[use]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            tf, key, col, pos = np.diff(np.append(starts, len(key))), key[starts], col[use], pos[use]
            row = pa.array(first[key & ((1 << bits) - 1)])
            out = [id.take(row), pa.array(tf), dl.take(row)]
            for k in range(len(fields) - 3):
                here = col == k
                ends = np.append(0, np.cumsum(np.add.reduceat(here, starts, dtype=np.int32), dtype=np.int32))
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(pos[here])))
            term = key >> bits
            heads = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
            yield packed(store, coded.dictionary.take(pa.array(term[heads])), heads, out)
    return run


def _cut(rows: DataFrame, positions: bool = True, lengths: bool = False) -> DataFrame:
    """(store, term, uses): postings of rows whose keys come together and in order, made entry by entry in arrays.

    A row holds a term's uses in entries that were counted at once; with ``lengths`` rows
    without a term hold the entries.  Rows of one key are one entry, and nothing is grouped.
    """
    toks = tokenized(rows).select("store", "id", "dl", *[f"t_{c}" for c in SEARCH_COLUMNS])
    use = "id: bigint, tf: bigint, dl: bigint" + "".join(f", pos_{c}: array<int>" for c in SEARCH_COLUMNS if positions)
    return toks.mapInArrow(_uses(positions, lengths), f"store string, term string, uses array<struct<{use}>>")


def _each(packed: DataFrame) -> DataFrame:
    """A row a posting."""
    return packed.select("store", "term", F.inline("uses"))


def postings(entries: DataFrame, positions: bool = True) -> DataFrame:
    """(store, term, id, tf, dl, pos_*): uses of a term in an entry; statistics need no ``positions``.

    The entries are spread by their key: the text is shuffled and not its words.
    """
    rows = entries.select("store", "id", *SEARCH_COLUMNS).repartition("store", "id").sortWithinPartitions("store", "id")
    return _each(_cut(rows, positions))


def by_column(post: DataFrame) -> DataFrame:
    """Postings as one row per entry column: (store, id, col, term, tf, positions)."""
    each = F.array(*[F.struct(F.lit(c).alias("col"), F.size(f"pos_{c}").alias("tf"), F.col(f"pos_{c}").alias("positions"))
                     for c in SEARCH_COLUMNS])
    return post.select("store", "id", "term", F.inline(each)).filter("tf > 0").select("store", "id", "col", "term", "tf", "positions")


def doc_lengths(entries: DataFrame) -> DataFrame:
    """(store, id, dl) with dl = tokens over all three columns."""
    return tokenized(entries).select("store", "id", "dl")


def store_stats(lengths: DataFrame) -> DataFrame:
    """(store, n_docs, n_tokens, avgdl): one row per store."""
    return (lengths.groupBy("store")
                   .agg(F.count(F.lit(1)).alias("n_docs"),
                        F.sum("dl").cast("long").alias("n_tokens"))
                   .withColumn("avgdl", F.col("n_tokens") / F.col("n_docs")))


def term_stats(post: DataFrame) -> DataFrame:
    """(store, term, df, cf): document and collection frequency per term."""
    return post.groupBy("store", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("cf"))


# --------------------------------------------------------------------------
# Blocks with the largest share of a score
# --------------------------------------------------------------------------

def share(tf: Column | str, dl: Column | str, avgdl: Column | str) -> Column:
    """A posting's factor of the term's weight in BM25 (below K1 + 1)."""
    tf, dl, avgdl = (F.col(x) if isinstance(x, str) else x for x in (tf, dl, avgdl))
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


HASH_BITS = 40


def _hash(id: Column | str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(id), 64 - HASH_BITS)


def block_of(id: Column | str, bits: Column | str) -> Column:
    """Block of an entry in the list of a term that is cut by ``bits`` leading bits."""
    bits = F.col(bits) if isinstance(bits, str) else bits
    return F.call_function("shiftright", _hash(id), (HASH_BITS - bits).cast("int"))


def _peak(uses: str) -> Column:
    """The largest share of a score in an array of uses."""
    return F.array_max(F.zip_with(f"{uses}.tf", f"{uses}.dl", lambda tf, dl: share(tf, dl, F.col("avgdl"))))


def term_table(packed: DataFrame, stats: DataFrame) -> DataFrame:
    """(store, term, df, bits, peak) of postings in rows (store, term, uses)."""
    s = packed.join(F.broadcast(stats.select("store", "avgdl")), "store")  # a row a store
    t = s.groupBy("store", "term").agg(F.sum(F.size("uses.id")).alias("df"), F.max(_peak("uses")).alias("peak"))
    bits = F.greatest(F.lit(0), F.least(F.lit(HASH_BITS), F.ceil(F.log2(F.col("df") / BLOCK)))).cast("int")
    return t.select("store", "term", "df", bits.alias("bits"), "peak")


#: a term in more than this part of a store's entries is frequent
FREQUENT = 1000


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (store, term, blocks, docs) cut into rows (store, term, block, docs)."""
    for batch in batches:
        store, term, blocks, docs = batch.columns
        row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(blocks.offsets)))
        if not len(row):
            continue
        block = blocks.flatten().to_numpy(False)
        at = np.lexsort((block, row))
        row, block = row[at], block[at]
        heads = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(row)).astype(np.int32)), docs.flatten().take(pa.array(at)))
        of = pa.array(row[heads])
        yield pa.RecordBatch.from_arrays([store.take(of), term.take(of), pa.array(block[heads]), lists], ["store", "term", "block", "docs"])


def block_table(packed: DataFrame, terms: DataFrame, stats: DataFrame) -> DataFrame:
    """(store, term, block, n, peak, docs): the postings without positions, in blocks.

    Frequent terms are sent to all tasks: there are at most ``FREQUENT`` times the
    average entry length of them, whatever the number of entries.  So no task
    gets the whole list of a frequent term.  A term without a row has one block.
    """
    docs = F.arrays_zip(*[F.col(f"uses.{c}").cast(f"array<{kind}>").alias(c) for c, kind in (("id", "bigint"), ("tf", "int"), ("dl", "int"))])
    s = packed.select("store", "term", docs.alias("docs"))
    t = terms.filter("bits > 0").join(F.broadcast(stats.select("store", "n_docs")), "store")
    often = F.broadcast(t.filter(F.col("df") * FREQUENT > F.col("n_docs")).select("store", "term", "bits"))
    rare = t.filter(F.col("df") * FREQUENT <= F.col("n_docs")).select("store", "term", "bits")
    s = s.join(often, ["store", "term"]).unionByName(s.join(often, ["store", "term"], "left_anti").join(rare, ["store", "term"], "left"))
    blocks = F.transform("docs.id", lambda id: block_of(id, F.coalesce("bits", F.lit(0))))
    cut = s.select("store", "term", blocks.alias("blocks"), "docs").mapInArrow(
        _by_block, "store string, term string, block long, docs array<struct<id: bigint, tf: int, dl: int>>")
    cut = cut.groupBy("store", "term", "block").agg(F.sort_array(F.flatten(F.collect_list("docs"))).alias("docs"))
    return cut.join(F.broadcast(stats.select("store", "avgdl")), "store").select(
        "store", "term", "block", F.size("docs").cast("long").alias("n"), _peak("docs").alias("peak"), "docs")


# --------------------------------------------------------------------------
# The index of one snapshot
# --------------------------------------------------------------------------

@dataclass
class Index:
    """The index tables of one entry snapshot; ``terms`` and ``blocks`` exist for written ones.

    Rows of ``terms`` and ``blocks`` carry the segment ``seg`` that they are of
    (0 without segments); ``gone`` (store, id, seg) lists entries that a segment
    replaces or deletes in those before it, ``averages`` a segment's own average
    lengths by (seg, store), for which its peaks hold.
    """
    entries: DataFrame
    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    terms: DataFrame | None = None
    blocks: DataFrame | None = None
    gone: DataFrame | None = None
    averages: dict[tuple[int, str], float] | None = None
    _now: dict[str, tuple[int, float]] | None = None

    def averages_now(self) -> dict[str, tuple[int, float]]:
        """(entries, average length) by store, read once."""
        if self._now is None:
            self._now = {r["store"]: (r["n_docs"], r["avgdl"]) for r in self.stats.select("store", "n_docs", "avgdl").collect()}  # a row a store
        return self._now


def build_index(entries: DataFrame, tokens_df: DataFrame | None = None) -> Index:
    """Index tables of an entry frame; pass ``tokens_df`` (a persisted
    :func:`tokenized` frame) to tokenise once for postings and lengths."""
    toks = tokenized(entries) if tokens_df is None else tokens_df
    lengths = toks.select("store", "id", "dl")
    return Index(entries=entries, postings=_postings(toks), lengths=lengths, stats=store_stats(lengths))


def held_index(entries: DataFrame) -> Index:
    """:func:`build_index` for several searches: the tokens are written to the scratch folder once."""
    return build_index(entries, held(tokenized(entries), "tokens"))


#: slices of the terms in which postings and blocks are written at most, and bytes of packed rows that need one
SLICES, SLICE = 8, 1 << 25


def _write(df: DataFrame, path: str, mode: str, *by: str) -> None:
    """A table as Parquet; the shuffle files behind it go when it is written."""
    with shuffles_removed(df.sparkSession):
        df.write.mode(mode).option("compression", "zstd").partitionBy(*by).parquet(path)


def _slices(packed: DataFrame, size: int) -> list[Column]:
    """Conditions on ``term`` that cut rows of ``size`` bytes into ranges of about as many rows.

    What is shuffled at once is one range, so it takes a part of the disk that the table itself takes.
    """
    n = min(SLICES, -(-size // SLICE))
    if n < 2:
        return [F.lit(True)]
    head = F.rpad(F.hex(F.substring(F.encode("term", "UTF-8"), 1, 7)), 14, "0")
    at = packed.agg(F.percentile_approx(F.conv(head, 16, 10).cast("long"), [k / n for k in range(1, n)], 10_000).alias("at")).first()["at"]
    cuts = sorted({k.to_bytes(7).rstrip(b"\0").decode(errors="ignore") for k in at or []} - {""})
    term = F.col("term")
    if not cuts:
        return [F.lit(True)]
    between = [(term >= lo) & (term < hi) for lo, hi in zip(cuts[:-1], cuts[1:])]
    return [term.isNull() | (term < cuts[0]), *between, term >= cuts[-1]]


def write_entries(entries: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Entries partitioned by (store, type), and sorted by id in narrow ranges."""
    _write(entries.repartitionByRange("store", "type", "id").sortWithinPartitions("store", "type", "id"), path, mode, "store", "type")


def write_index_from(entries: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the entries, then cut what was written into words, once for postings and lengths."""
    spark = entries.sparkSession
    write_entries(entries, f"{path}/entries", mode)
    rows = read_table(spark, path, "entries").select("store", "id", *SEARCH_COLUMNS)
    uses = _cut(rows.repartitionByRange(_hash("id")).sortWithinPartitions("store", _hash("id"), "id"), lengths=True)
    draft = scratch_path(spark, "uses")
    _write(uses, draft, "overwrite")
    uses = spark.read.schema(uses.schema).parquet(draft)
    lengths = uses.filter("term IS NULL").select("store", F.inline(F.arrays_zip("uses.id", "uses.dl"))).toDF("store", "id", "dl")
    stats = _write_lengths(lengths, path, mode)
    write_postings(uses.filter("term IS NOT NULL"), stats, path, mode, draft)


def write_index(index: Index, path: str, mode: str = "overwrite") -> None:
    """Write all tables of an index."""
    write_entries(index.entries, f"{path}/entries", mode)
    use = F.struct("id", "tf", "dl", *[f"pos_{c}" for c in SEARCH_COLUMNS])
    stats = _write_lengths(index.lengths, path, mode)
    write_postings(index.postings.select("store", "term", F.array(use).alias("uses")), stats, path, mode)


def _write_lengths(lengths: DataFrame, path: str, mode: str) -> DataFrame:
    """Lengths and statistics; the statistics as written."""
    spark = lengths.sparkSession
    _write(lengths, f"{path}/lengths", mode, "store")
    _write(store_stats(read_table(spark, path, "lengths")).coalesce(1), f"{path}/stats", mode)
    return read_table(spark, path, "stats")


def write_postings(packed: DataFrame, stats: DataFrame, path: str, mode: str = "overwrite", draft: str | None = None) -> None:
    """Postings range-partitioned and sorted by (store, term, hash of the first id); terms and blocks from what was written.

    ``draft`` is the folder that ``packed`` reads, if it reads a written one; it goes before the blocks need room.
    """
    spark = packed.sparkSession
    first = _hash(F.col("uses")[0]["id"])
    slices = [F.lit(True)] if draft is None else _slices(packed, commits.size(spark, draft))
    for k, some in enumerate(slices):
        part = packed.filter(some).repartitionByRange("store", "term", first).sortWithinPartitions("store", "term", first)
        _write(part, f"{path}/postings", "append" if k else mode, "store")
    if draft is not None:
        commits.remove(spark, draft)
    packed = _read(spark, path, "postings")
    _write(term_table(packed, stats).repartitionByRange("store", "term").sortWithinPartitions("store", "term"), f"{path}/terms", mode, "store")
    terms = read_table(spark, path, "terms")
    for k, some in enumerate(slices if draft is not None else _slices(packed, commits.size(spark, f"{path}/postings"))):
        part = block_table(packed.filter(some), terms.filter(some), stats).repartitionByRange("store", "term", "block")
        part = part.sortWithinPartitions("store", "term", "block")
        _write(part, f"{path}/blocks", "append" if k else mode, "store")


#: columns of the written tables; a part without rows has no file that tells them
SCHEMAS = {
    "entries": ENTRY_SCHEMA,
    "postings": "store string, term string, uses array<struct<id: bigint, tf: bigint, dl: bigint, " + ", ".join(f"pos_{c}: array<int>" for c in SEARCH_COLUMNS) + ">>",
    "lengths": "store string, id long, dl long",
    "stats": "store string, n_docs long, n_tokens long, avgdl double",
    "terms": "store string, term string, df long, bits int, peak double",
    "blocks": "store string, term string, block long, n long, peak double, docs array<struct<id: bigint, tf: int, dl: int>>",
}


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A written table; postings as a row a posting."""
    return _each(_read(spark, path, name)) if name == "postings" else _read(spark, path, name)


def read_index(spark: SparkSession, path: str) -> Index:
    read = lambda name: read_table(spark, path, name)
    return Index(entries=read("entries"), postings=read("postings"), lengths=read("lengths"), stats=read("stats"),
                 terms=read("terms").withColumn("seg", F.lit(0)), blocks=read("blocks").withColumn("seg", F.lit(0)))
