"""Personal data by bootstrapped contextual extraction (operator 5, built-in functions only).

Seeds are what the base patterns find (email, ip, card, phone, each checked).
Runs of words with digits that no seed covers, and words with an @, are
candidates, and so is each word of a run for itself.  Every seed and candidate
has lexical patterns of four families: the word to its left, the word to its
right, and both, each alone and with the exact shape, and the coarse shape (runs
of digits and letters as one) alone.  Rounds over the pattern-instance graph
score a pattern by the share of its distinct instances that are known, and a
candidate by the best pattern of each family; candidates that confident patterns
of several families support become known and vote in the next round, until a
round finds nothing new.  A word of a longer run votes for no pattern's share
unless it is known.  All uses of a value that became known this way are added to
the spans (a word of a run that is known as a whole is not); the base spans
always stay.

The base patterns are written with possessive parts and look-behinds that
change no match but keep the search linear in the text; matches and the gaps
between them give the places, so each text is scanned by a pattern once to
test and twice to cut.

Defined results: a null text is empty; null ids and repeated rows keep their
rows; empty tables give empty results.  Places are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WS, documents, saved

KINDS = ("email", "ip", "card", "phone")
CANDIDATE = len(KINDS)
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    rf"(?<![^{WS}])[^{WS}0-9@]*+[0-9@][^{WS}]*+",
)
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
MIN_DIGITS, MIN_SUPPORT, MIN_CONFIDENCE, MIN_PATTERNS, ACCEPT = 4, 3, 0.8, 2, 0.98
CONTEXT = 40  # code points of a gap that mostly hold the word beside a match


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (F.when(kind == 0, F.lit(True))
            .when(kind == 1, value.rlike(rf"\A(?:{_PART}\.){{3}}{_PART}\z"))
            .when(kind == 2, F.length(digits).between(14, 19) & F.call_function("luhn_check", digits))
            .when(kind == 3, F.length(digits).between(10, 15))
            .otherwise(F.lit(False)))


def _found(text: Column, kind: int) -> Column:
    """Matches of one pattern with the length of the gap before each and the words beside it."""
    pattern = F.lit(PATTERNS[kind])
    hint = {0: F.contains(text, F.lit("@")), 3: F.contains(text, F.lit("+")), CANDIDATE: text.rlike("[0-9@]")}.get(kind, text.rlike("[0-9]"))
    matches = F.when(hint, F.regexp_extract_all(text, pattern, F.lit(0)))
    gaps = F.when(F.size(matches) > 0, F.split(text, PATTERNS[kind], -1))
    def left(gap: Column) -> Column:
        """The last word of a gap; all of the gap is searched only where its last code points do not hold that word whole."""
        some = F.substring(gap, -CONTEXT, CONTEXT)
        enough = (F.length(gap) <= CONTEXT) | some.rlike(rf"[{WS}][^{WS}]+[{WS}]*\z")
        return F.lower(F.regexp_extract(F.when(enough, some).otherwise(gap), rf"(?<![^{WS}])([^{WS}]++)[{WS}]*+\z", 1))

    def right(gap: Column) -> Column:
        some = F.substring(gap, 1, CONTEXT)
        enough = (F.length(gap) <= CONTEXT) | some.rlike(rf"\A[{WS}]*[^{WS}]+[{WS}]")
        return F.lower(F.regexp_extract(F.when(enough, some).otherwise(gap), rf"\A[{WS}]*+([^{WS}]++)", 1))

    return F.transform(matches, lambda m, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), m.alias("value"), F.length(F.get(gaps, i)).alias("gap"),
        left(F.get(gaps, i)).alias("left"), right(F.get(gaps, i + 1)).alias("right"),
        F.get(gaps, i).rlike(r"\A[\x20\x09]+\z").alias("near")))


def _spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row a document: doc_id, th), (a row a match: doc_id, th, kind, i, start, end, value, left, right, near, valid)."""
    text = F.coalesce("text", F.lit(""))
    t = docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))
    t = t.select("doc_id", "th", F.flatten(F.filter(
        F.array(*[_found(F.col("text"), k) for k in range(len(PATTERNS))]), lambda a: a.isNotNull())).alias("m"))
    t = saved(t, "pii-matches")
    m = t.filter(F.size("m") > 0).dropDuplicates(["doc_id", "th"]).select("doc_id", "th", F.explode("m").alias("m")).select("doc_id", "th", "m.*")
    w = Window.partitionBy("doc_id", "th", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.length("value")).over(w)
    m = m.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    m = m.withColumn("valid", _valid(F.col("kind"), F.col("value")))
    return t.select("doc_id", "th"), saved(m.drop("gap"), "pii-spans")


def _candidates(spans: DataFrame) -> DataFrame:
    """Runs of candidate words that no valid base span of their document overlaps, and the words of longer runs (not ``main``)."""
    doc = Window.partitionBy("doc_id", "th").orderBy("start", "kind")
    base = F.col("valid")
    s = spans.filter(base | (F.col("kind") == CANDIDATE)).withColumn(
        "before", F.max(F.when(base, F.col("end"))).over(doc.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "after", F.min(F.when(base, F.col("start"))).over(doc.rowsBetween(1, Window.unboundedFollowing)))
    free = (F.col("kind") == CANDIDATE) & (F.coalesce("before", F.lit(0)) <= F.col("start")) & \
        (F.coalesce("after", F.col("end")) >= F.col("end"))
    digit = F.col("value").rlike("[0-9]")
    joined = F.col("near") & digit & F.lag(digit).over(doc) & (F.lag("i").over(doc) == F.col("i") - 1)
    s = s.filter(free).withColumn("joined", F.coalesce(joined, F.lit(False)))
    s = s.withColumn("run", F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    runs = s.groupBy("doc_id", "th", "run").agg(F.array_sort(F.collect_list(F.struct("start", "end", "value", "left", "right"))).alias("w"))
    whole = F.struct(F.get("w", F.lit(0))["start"].alias("start"), F.element_at("w", -1)["end"].alias("end"),
                     F.array_join(F.col("w.value"), " ").alias("value"), F.get("w", F.lit(0))["left"].alias("left"),
                     F.element_at("w", -1)["right"].alias("right"), F.lit(True).alias("main"))
    each = F.when(F.size("w") > 1, F.transform("w", lambda x: x.withField("main", F.lit(False)))).otherwise(
        F.array().cast("array<struct<start:bigint,end:bigint,value:string,left:string,right:string,main:boolean>>"))
    c = runs.select("doc_id", "th", "run", F.explode(F.concat(F.array(whole), each)).alias("c")).select("doc_id", "th", "run", "c.*")
    return c.filter(F.contains("value", F.lit("@")) | (F.length(F.regexp_replace("value", "[^0-9]", "")) >= MIN_DIGITS))


def _edges(instances: DataFrame) -> DataFrame:
    """Distinct (value, family, pattern) of instances(value, left, right, main) with ``main`` if one of them is."""
    shape = F.regexp_replace(F.regexp_replace("value", "[0-9]", "9"), r"\p{L}+", "a")
    coarse = F.regexp_replace(F.regexp_replace("value", "[0-9]+", "9"), r"\p{L}+", "a")
    bare = lambda c: F.regexp_replace(c, r"[\p{P}\p{S}]+\z", "")
    e = instances.select("value", "main", shape.alias("shape"), coarse.alias("coarse"), bare("left").alias("l"), bare("right").alias("r"))
    has_l, has_r = F.col("l") != "", F.col("r") != ""
    sides = {"L": (has_l, F.col("l")), "R": (has_r, F.col("r")), "B": (has_l & has_r, F.concat("l", F.lit(" "), "r"))}
    item = lambda family, *parts: F.struct(F.lit(family).alias("family"), F.concat(F.lit(f"{family}:"), *parts).alias("pattern"))
    patterns = [F.array(item("S", "coarse"))] + [F.when(ok, F.array(item(k, words), item(k, words, F.lit(" "), "shape"))) for k, (ok, words) in sides.items()]
    every = F.flatten(F.filter(F.array(*patterns), lambda x: x.isNotNull()))
    return e.select("value", "main", F.explode(every).alias("p")).groupBy("value", "p.family", "p.pattern").agg(F.max("main").alias("main"))


def discovered(spans: DataFrame) -> DataFrame:
    """(doc_id, th, kind, start, end) of identifiers that the patterns found beyond the base."""
    seeds = spans.filter("valid")
    free = saved(_candidates(spans), "pii-candidates")
    known = seeds.select("value", "kind").distinct().groupBy("value").agg(F.min("kind").alias("kind"))
    unknown = free.select("value").distinct().join(known, "value", "left_anti")
    seen = seeds.select("value", "left", "right", F.lit(True).alias("main")).unionByName(free.select("value", "left", "right", "main"))
    edges = saved(_edges(seen), "pii-edges")
    known, unknown = saved(known, "pii-known"), saved(unknown, "pii-open")
    new = None
    while True:
        e = edges.join(known, "value", "left").filter(F.col("main") | F.col("kind").isNotNull())
        sums = [F.count_if(F.col("kind") == k).alias(f"k{k}") for k in range(len(KINDS))]
        p = e.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *sums)
        best = F.greatest(*[F.struct(F.col(f"k{k}").alias("support"), F.lit(k).alias("kind")) for k in range(len(KINDS))])
        p = p.select("pattern", "n", best.alias("b")).select("pattern", "b.kind", "b.support", (F.col("b.support") / F.col("n")).alias("confidence"))
        p = saved(p.filter((F.col("support") >= MIN_SUPPORT) & (F.col("confidence") >= MIN_CONFIDENCE)), "pii-patterns")
        open_ = unknown if new is None else unknown.join(new, "value", "left_anti")
        votes = edges.join(open_, "value", "left_semi").join(p, "pattern").groupBy("value", "kind", "family").agg(F.max("confidence").alias("confidence"))
        votes = votes.groupBy("value", "kind").agg(
            F.count(F.lit(1)).alias("n"), (1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("score"))
        got = votes.filter((F.col("n") >= MIN_PATTERNS) & (F.col("score") >= ACCEPT)).groupBy("value").agg(
            F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
        got = saved(got, "pii-found")
        if got.isEmpty():
            break
        new = got if new is None else new.unionByName(got)
        known = known.unionByName(got)
    if new is None:
        return spans.limit(0).select("doc_id", "th", "kind", "start", "end")
    run = Window.partitionBy("doc_id", "th", "run")
    found = free.join(new, "value").withColumn("whole", F.max("main").over(run))
    return found.filter(F.col("main") | ~F.col("whole")).select("doc_id", "th", "kind", "start", "end")


def personal_data(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id and ``spans``: array of (start, kind, end, base) by start, then kind."""
    rows, spans = _spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    base = spans.filter("valid").select("doc_id", "th", "kind", "start", "end", F.lit(True).alias("base"))
    every = base.unionByName(discovered(spans).withColumn("base", F.lit(False)))
    item = F.struct(F.col("start").cast("long").alias("start"), "kind", F.col("end").cast("long").alias("end"), "base")
    each = every.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(item)).alias("spans"))
    each = each.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "spans")
    out = rows.join(each, rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["th"] == F.col("_th")), "left")
    return out.select("doc_id", F.coalesce("spans", F.array().cast(each.schema["spans"].dataType)).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = personal_data(documents(spark, sf_dir))
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(len(KINDS))]
    return p.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
