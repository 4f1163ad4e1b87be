"""The best entries of plain word queries from the blocks that can reach them.

A *plain* expression is an OR of clauses of single words.  Its score is the sum
of its words' parts, each at most the word's weight times the block's peak.

1. Each query's rarest words (as many as are needed for ``limit`` entries, or
   the one that a sole clause requires) give candidates: all entries that hold
   one of them.
2. The other words are looked up for these candidates only: the block of an
   entry in any word's list follows from its id, so that is an equi-join.
3. The ``limit``-th best candidate of a store is its threshold.  An entry without
   a rare word can reach it only through a block whose peak, with the most that
   the other frequent words may add, is not below it; such blocks give more
   candidates, which are scored in the same way.

The result holds every entry of the top ``limit`` of each query and store among
the entries that pass the filter, with the same scores as the exhaustive way.
What goes through the driver is bounded by the batch: a row a word and store,
a threshold a query and store, and at most ``NAMED`` block numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .index import Index, block_of, share

#: blocks that a lookup names as literals in the filter of the scan; more are found by the join alone
NAMED = 2000
SLACK = 1 + 1e-9  # bounds and scores are sums of doubles in different orders


def plain(expr) -> bool:
    """Whether all matchers are single words without prefix, column or position, and nothing is excluded."""
    from .search import Phrase
    return all(not c.must_not and c.must and all(isinstance(m, Phrase) and m.simple and not m.prefix and m.column is None for m in c.must)
               for c in expr.clauses)


@dataclass(frozen=True)
class Word:
    """A word of a query in a store."""
    qid: int
    pid: int
    store: str
    term: str
    df: int
    idf: float
    cuts: tuple[tuple[int, int, float, float], ...]  # (segment, bits, peak, what the peak can have grown by)

    @property
    def most(self) -> float:
        return self.idf * max(peak * grown for _, _, peak, grown in self.cuts)


def _words(index: Index, comp) -> dict[tuple[int, str], list[Word]]:
    """Words by (qid, store), rarest first."""
    from .search import IDF_FLOOR
    terms = sorted({t[4] for t in comp.terms})
    stats = index.averages_now()
    rows = index.terms.filter(F.col("term").isin(terms)).select("store", "term", "seg", "df", "bits", "peak").collect()  # a row a word, store and segment
    df, cuts = {}, {}
    for r in rows:
        k = r["term"], r["store"]
        df[k] = df.get(k, 0) + r["df"]
        if r["bits"] is not None:
            then, now = (index.averages or {}).get((r["seg"], r["store"])), stats[r["store"]][1]
            cuts.setdefault(k, []).append((r["seg"], r["bits"], r["peak"], max(1.0, now / then) if then else 1.0))
    out: dict = {}
    for qid, pid, _, _, term, _, _, _ in comp.terms:
        for (t, store), n_hit in df.items():
            if t == term and n_hit > 0:
                raw = math.log((stats[store][0] - n_hit + 0.5) / (n_hit + 0.5))
                out.setdefault((qid, store), []).append(
                    Word(qid, pid, store, term, n_hit, raw if raw > 0 else IDF_FLOOR, tuple(sorted(cuts[term, store]))))
    return {k: sorted(ws, key=lambda w: (w.df, w.pid)) for k, ws in out.items()}


def _seeds(words: list[Word], clauses: list[list[str]], limit: int) -> list[Word]:
    """The rarest words with ``limit`` entries together; of a sole clause its rarest word."""
    if len(clauses) == 1:
        need = [w for w in words if f"p{w.pid}" in clauses[0]]
        return need[:1] if len(need) == len(clauses[0]) else []  # a word that the store lacks: no entry holds all
    out, n = [], 0
    for w in words:
        if n >= limit:
            break
        out.append(w)
        n += w.df
    return out


def _frame(index: Index, words: list[Word]) -> DataFrame:
    return F.broadcast(index.entries.sparkSession.createDataFrame(  # a row a word of the batch, store and segment
        [(w.qid, w.pid, w.store, w.term, seg, bits, w.idf) for w in words for seg, bits, _, _ in w.cuts],
        "qid long, pid int, store string, term string, seg int, bits int, idf double"))


def _blocks(index: Index, words: list[Word]) -> DataFrame:
    return index.blocks.filter(F.col("term").isin(sorted({w.term for w in words})) & F.col("store").isin(sorted({w.store for w in words})))


def _live(index: Index, rows: DataFrame) -> DataFrame:
    """Rows (seg, store, id, ...) without those that a later segment replaces or deletes."""
    if index.gone is None:
        return rows
    gone = index.gone.select(F.col("store").alias("_s"), F.col("id").alias("_i"), F.col("seg").alias("_by"))
    return rows.join(gone, (F.col("store") == F.col("_s")) & (F.col("id") == F.col("_i")) & (F.col("seg") < F.col("_by")), "left_anti")


def _candidates(index: Index, blocks: DataFrame, words: DataFrame, ents: DataFrame) -> DataFrame:
    """(qid, store, id) of the entries in the blocks that pass the filter."""
    ids = blocks.join(words, ["seg", "store", "term"]).select("qid", "seg", "store", F.explode("docs.id").alias("id"))
    ids = _live(index, ids).select("qid", "store", "id").distinct()
    return ids.join(ents.select("store", "id"), ["store", "id"], "left_semi")


def _scores(index: Index, candidates: DataFrame, words: list[Word], comp, report: list | None) -> DataFrame:
    """(qid, store, id, rank) of the candidates that hold a clause; all their words are looked up."""
    from .search import _scored
    need = candidates.join(_frame(index, words), ["qid", "store"]).withColumn("block", block_of("id", "bits"))
    path = scratch_path(need.sparkSession, "topk")
    need.write.parquet(path)
    need = need.sparkSession.read.schema(need.schema).parquet(path)
    blocks = _blocks(index, words)
    named = [tuple(r) for r in need.select("term", "block").distinct().limit(NAMED + 1).collect()]
    if not named:
        return need.select("qid", "store", "id", F.lit(0.0).alias("rank")).limit(0)
    if len(named) <= NAMED:
        at: dict = {}
        for term, block in named:
            at.setdefault(term, []).append(block)
        blocks = blocks.filter(reduce(lambda a, b: a | b, [(F.col("term") == t) & F.col("block").isin(sorted(bs)) for t, bs in at.items()]))
    key = ["seg", "store", "term", "block"]
    touched = blocks.join(need.select(*key).distinct(), key, "left_semi")
    if report is not None:
        report.append(touched.select("n"))
    docs = _live(index, touched.select(*key, F.explode("docs").alias("d")).select(*key, "d.*"))
    hits = need.join(docs, [*key, "id"]).join(F.broadcast(index.stats.select("store", "avgdl")), "store")
    part = F.col("idf") * share("tf", "dl", "avgdl")
    return _scored(hits.select("qid", "pid", F.lit(None).cast("int").alias("gid"), "store", "id", part.alias("part")), comp)


def top(index: Index, exprs: dict, ents: DataFrame, limit: int, report: list | None = None) -> DataFrame:
    """(qid, store, id, rank): holds the top ``limit`` of each query and store among ``ents``, and some rows below.

    ``report`` collects frames whose ``n`` sums to the postings read.
    """
    from .search import _compile
    comp = _compile(exprs)
    words = _words(index, comp)
    clauses = {qid: [must for must, _ in cl] for qid, cl in comp.clauses.items()}
    seeds = {k: _seeds(ws, clauses[k[0]], limit) for k, ws in words.items()}
    words = {k: ws for k, ws in words.items() if seeds[k]}
    listed = [w for ws in words.values() for w in ws]
    if not listed:
        return index.entries.sparkSession.createDataFrame([], "qid long, store string, id long, rank double")
    first = [w for k in words for w in seeds[k]]
    blocks = _blocks(index, first)
    if report is not None:
        report.append(blocks.join(_frame(index, first).select("seg", "store", "term").distinct(), ["seg", "store", "term"]).select("n"))
    one = _scores(index, _candidates(index, blocks, _frame(index, first), ents), listed, comp, report)
    # queries with a clause that holds none of the rare words
    more = {k: [w for w in ws if w not in seeds[k]] for k, ws in words.items()
            if any(not {f"p{w.pid}" for w in seeds[k]} & set(c) for c in clauses[k[0]])}
    more = {k: ws for k, ws in more.items() if ws}
    if not more:
        return one
    path = scratch_path(one.sparkSession, "topk")
    one.write.parquet(path)
    one = one.sparkSession.read.schema(one.schema).parquet(path)
    w = Window.partitionBy("qid", "store").orderBy("rank", "id")
    kth = one.withColumn("r", F.row_number().over(w)).filter(F.col("r") == limit).select("qid", "store", "rank")
    least = {(r["qid"], r["store"]): -r["rank"] for r in kth.collect()}  # a row a query and store
    conditions, second = [], []
    for k, ws in more.items():
        for x in ws:
            lowest = (least.get(k, 0.0) / SLACK - sum(y.most for y in ws if y is not x)) / x.idf
            reach = [(seg, lowest / grown) for seg, _, peak, grown in x.cuts if peak * grown >= lowest]
            if reach:
                second.append(x)
            conditions += [(F.col("store") == x.store) & (F.col("term") == x.term) & (F.col("seg") == seg) & (F.col("peak") >= F.lit(least_peak))
                           for seg, least_peak in reach]
    if not second:
        return one
    blocks = index.blocks.filter(reduce(lambda a, b: a | b, conditions))
    if report is not None:
        report.append(blocks.select("n"))
    two = _scores(index, _candidates(index, blocks, _frame(index, second), ents), listed, comp, report)
    return one.unionByName(two).dropDuplicates(["qid", "store", "id"])


def reads(index: Index, exprs: dict, limit: int = 20) -> tuple[int, int]:
    """(postings read for the top ``limit``, postings of all words of the batch)."""
    from .search import _compile
    report: list = []
    top(index, exprs, index.entries.select("store", "id"), limit, report).count()
    read = reduce(DataFrame.unionByName, report).agg(F.sum("n")).first()[0] if report else 0
    return read or 0, sum(w.df for ws in _words(index, _compile(exprs)).values() for w in ws)
