"""Shards of even size by balanced label propagation (operator 12, built-in functions only).

Documents with an equal link key (here: equal texts) are linked with each
other.  Law ``rows``: shards' counts are at most one apart.

1. Linked documents start in shards dealt by hash.  Those of one group in one
   shard are alike, so they are held as a *cell* (group, shard, n): a group has
   at most as many cells as there are shards, however many documents it has.
2. Each round joins a group's cells with the group's largest cell in an open
   shard; members of smaller cells want to move there.  The wishes are summed
   by (group size class, from, to), a table bounded by the number of shards, and
   quotas are dealt from it: no shard may get more linked documents than its
   share of all rows, and small groups come first.  A cell moves by its share of
   the quota.  A shard whose quota was used up is closed until it has room again.
   Rounds end when nothing wants to move.
3. Unlinked documents, which no shard pulls, fill the shards up; what a shard
   holds beyond its share (hash starts may be uneven) is dealt with them.

Places come from prefix sums: rows are range-partitioned by (group, id), every
partition's count shifts the next ones, and a place decides shard and slot by
the cell whose interval it lies in.  Intervals meet places in buckets of equal
length, so a group with a third of all rows is spread like any other.

Defined results: a null text counts as an empty one (size 1, crc32 0); null ids
and repeated rows keep their rows; other columns are ignored; an empty table
gives an empty result.  ``grown_shard`` is null, as the law is not ``key``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, saved

SHARDS, ROUNDS = 16, 12
BUCKET = 1 << 16
FREE = 50  # a closed shard opens when more than this part of its share is free


def prefix_sums(df: DataFrame, keys: list[str], weight: str | None, name: str, total: str) -> DataFrame:
    """Add ``name``: the sum of ``weight`` (1 if None) over all rows before a row in the order of ``keys``; ``total`` names scratch folders.

    Rows with equal keys follow each other in some order.  One row a partition
    (not a row of ``df``) goes through one task.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    part = saved(df.repartitionByRange(*keys).withColumn("_pid", F.spark_partition_id()).withColumn("_w", w.cast("long")), total)
    first = part.groupBy("_pid").agg(F.sum("_w").alias("_in")).withColumn(
        "_before", F.coalesce(F.sum("_in").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_pid", "_before")
    inner = F.sum("_w").over(Window.partitionBy("_pid").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w")
    return part.withColumn("_inner", inner).join(F.broadcast(first), "_pid").withColumn(name, F.col("_before") + F.col("_inner")).drop(
        "_pid", "_w", "_inner", "_before")


def shares(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def quotas(wishes: list[tuple[int, int, int, int]], size: list[int], most: list[int]) -> dict[tuple[int, int], float]:
    """wishes(class, from, to, n) -> part of each (class, to) that may move, so that no shard grows beyond ``most``; classes in order."""
    size, out = list(size), {}
    for c in sorted({w[0] for w in wishes}):
        flows = [(a, b, n) for k, a, b, n in wishes if k == c]
        part = {b: 1.0 for _, b, _ in flows}
        for _ in range(64):
            get = {b: sum(n for _, t, n in flows if t == b) for b in part}
            lose = [sum(n * part[b] for a, b, n in flows if a == s) for s in range(len(size))]
            worse = False
            for b in part:
                room = max(most[b], size[b]) - size[b] + lose[b]
                fit = max(0.0, min(part[b], room / get[b]))
                worse |= fit < part[b] - 1e-9
                part[b] = fit
            if not worse:
                break
        for a, b, n in flows:
            size[a] -= n * part[b]
            size[b] += n * part[b]
        out.update({(c, b): p for b, p in part.items()})
    return out


def _pick(values: list, index: Column, kind: str) -> Column:
    """``values[index]`` of a small list."""
    return F.element_at(F.lit(values).cast(f"array<{kind}>"), (index + 1).cast("int"))


def propagated(cells: DataFrame, share: list[int], rounds: int) -> DataFrame:
    """cells(group, shard, n) of linked documents -> the same columns after moving members towards their neighbours' shards."""
    k = len(share)
    groups = cells.groupBy("group").agg(F.sum("n").alias("_all"))
    cells = saved(cells.join(groups, "group").select("group", "shard", "n", F.floor(F.log2("_all")).cast("int").alias("class")), "shards-cells")
    closed: set[int] = set()
    for turn in range(rounds):
        size = [0] * k
        for s, n in cells.groupBy("shard").agg(F.sum("n")).collect():  # one row a shard
            size[s] = n
        closed = {s for s in closed if size[s] > share[s] - share[s] // FREE - 1}
        is_open = ~F.col("shard").isin(*closed) if closed else F.lit(True)
        rank = F.struct("n", F.xxhash64("group", "shard").alias("tie"), "shard")
        lead = cells.filter(is_open).groupBy("group").agg(F.max(rank).alias("lead"))
        wish = cells.join(lead, "group").filter((F.col("shard") != F.col("lead.shard")) & (rank < F.col("lead"))).select(
            "group", "class", F.col("shard").alias("from"), F.col("lead.shard").alias("to"), "n")
        wish = saved(wish, "shards-wishes")
        # at most classes x shards x shards rows
        table = [tuple(r) for r in wish.groupBy("class", "from", "to").agg(F.sum("n")).collect()]
        if not table:
            break
        part = quotas(table, size, share)
        spread = [part.get((c, t), 0.0) for c in range(64) for t in range(k)]
        q = _pick(spread, F.col("class") * k + F.col("to"), "double")
        u = F.pmod(F.xxhash64("group", "from", F.lit(turn)), F.lit(1 << 20)) / F.lit(1 << 20)
        moves = wish.select("group", "class", "from", "to", F.least(F.col("n"), F.floor(F.col("n") * q + u)).alias("n")).filter("n > 0")
        change = moves.select("group", F.col("from").alias("shard"), (-F.col("n")).alias("n"), "class").unionByName(
            moves.select("group", F.col("to").alias("shard"), "n", "class"))
        cells = saved(cells.unionByName(change).groupBy("group", "shard").agg(F.sum("n").alias("n"), F.max("class").alias("class")).filter("n > 0"),
                      "shards-cells")
        closed |= {t for (_, t), p in part.items() if p < 1.0}
    return cells.select("group", "shard", "n")


def sharded(docs: DataFrame, shards: int = SHARDS, link: Column | None = None, rounds: int = ROUNDS) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, size, text_crc32, law, shard, slot, grown_shard; one row a row of ``docs``.

    ``link``: rows with equal values are linked (default: the text's digest);
    null links with nothing.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = saved(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), (F.unhex(F.md5(text)) if link is None else F.unhex(F.md5(link.cast("string")))).alias("group")), "shards-rows")
    start = F.pmod(F.xxhash64("doc_id", "group"), F.lit(shards)).cast("int")
    cells = rows.filter("group is not null").groupBy("group", start.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    cells = saved(cells, "shards-start")
    linked = cells.groupBy("group").agg(F.sum("n").alias("_all")).filter("_all > 1").select("group")
    n = rows.count()
    share = shares(n, shards)
    cells = propagated(cells.join(linked, "group"), share, rounds)

    # where each cell begins among the linked documents, and among those of its shard
    cells = saved(prefix_sums(cells, ["group", "shard"], "n", "place", "shards-places"), "shards-placed")
    cells = saved(prefix_sums(cells, ["shard", "group"], "n", "rank", "shards-ranks"), "shards-ranked")
    has = [0] * shards
    for s, m in cells.groupBy("shard").agg(F.sum("n")).collect():  # one row a shard
        has[s] = m
    n_linked = sum(has)
    before = [sum(has[:s]) for s in range(shards)]
    over = [max(0, h - q) for h, q in zip(has, share)]
    over_before = [sum(over[:s]) for s in range(shards)]
    spare = [q - min(h, q) for h, q in zip(has, share)]
    spare_before = [sum(spare[:s]) for s in range(shards)]

    # linked documents in front, in the order of the cells; then the others
    order = rows.join(linked.withColumn("alone", F.lit(0)), "group", "left").withColumn("alone", F.coalesce("alone", F.lit(1)))
    order = order.withColumn("by", F.when(F.col("alone") == 0, F.col("group")))
    placed = prefix_sums(order, ["alone", "by", "doc_id", "group", "text_crc32", "size"], None, "place", "shards-order")
    bucket = F.floor(F.col("place") / BUCKET)
    last = F.floor((F.col("place") + F.col("n") - 1) / BUCKET)
    starts = cells.select("place", F.struct("place", "shard", "rank").alias("cell"), F.explode(F.sequence(bucket, last)).alias("bucket"))
    starts = starts.select("bucket", F.greatest("place", F.col("bucket") * BUCKET).alias("at"), F.lit(0).alias("kind"), "cell")
    docs_at = placed.select(bucket.alias("bucket"), F.col("place").alias("at"), F.lit(1).alias("kind"),
                            F.struct("doc_id", "size", "text_crc32").alias("row"))
    both = starts.withColumn("row", F.lit(None).cast(docs_at.schema["row"].dataType)).unionByName(
        docs_at.withColumn("cell", F.lit(None).cast(starts.schema["cell"].dataType)))
    seen = Window.partitionBy("bucket").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("cell", F.last("cell", True).over(seen)).filter("kind = 1")
    mine = F.col("at") < n_linked
    shard = F.when(mine, F.col("cell.shard"))
    rank = F.col("cell.rank") - _pick(before, shard, "long") + F.col("at") - F.col("cell.place")
    out = out.select("row.*", "at", shard.alias("own"), F.when(mine, rank).alias("rank"))
    kept = F.col("own").isNotNull() & (F.col("rank") < _pick(share, F.col("own"), "long"))
    pool = F.when(F.col("own").isNotNull(), _pick(over_before, F.col("own"), "long") + F.col("rank") - _pick(share, F.col("own"), "long")).otherwise(
        F.col("at") - n_linked + sum(over))
    out = out.withColumn("kept", kept).withColumn("pool", F.when(~F.col("kept"), pool))
    ends = F.lit([b + s for b, s in zip(spare_before, spare)]).cast("array<long>")
    taker = F.size(F.filter(ends, lambda e: e <= F.col("pool")))
    out = out.withColumn("shard", F.when(F.col("kept"), F.col("own")).otherwise(taker).cast("int"))
    filled = [min(h, q) for h, q in zip(has, share)]
    slot = F.when(F.col("kept"), F.col("rank")).otherwise(
        F.col("pool") - _pick(spare_before, F.col("shard"), "long") + _pick(filled, F.col("shard"), "long"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(documents(spark, sf_dir))
