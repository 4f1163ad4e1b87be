"""Quality rules as a short-circuit cascade (operator 10, built-in functions only).

A rule is a boolean column that rejects a row.  ``order_rules`` estimates every
rule on a small sample (code points that it looks at, and the share it rejects)
and sorts the rules by rejection per cost; ``cascade`` turns the ordered rules
into one ``CASE`` expression, so a row stops at the first rule that rejects it.
Costs are counts of work and not times, so the same sample gives the same order.
The order never changes a verdict, only the time it takes; ``rejected_by`` names
the first rule in the fixed order of ``rules``.

Defined results: a null or empty text has no words and fails the base rule;
empty tables give empty results; repeated rows get equal results; columns that
the operator does not know are left alone, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, documents, fresh, saved

MIN_WORDS = 10
MAX_REPEAT_PCT = 20
WINDOW = 5
MAX_SYMBOL_PCT = 25
MAX_DUP_LINE_PCT = 60
MAX_MEAN_WORD = 60
MAX_UPPER_PCT = 90
SAMPLE_ROWS = 512
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of ``FEATURES`` (and ``n_word_lines``) of whole texts.

    Windows are compared by a 64-bit hash within one text.  Sorting the
    (hash, position) pairs of a text finds the repeated windows in n log n;
    texts without a repeated window skip that step.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{WS}]"))
    c_w, c_l, c_h, c_g, c_rep, c_s, c_p = (fresh(df.columns, n) for n in ("_w", "_l", "_h", "_g", "_rep", "_s", "_p"))
    d = df.withColumns({
        c_w: F.filter(F.split(t, f"[{WS}]+", -1), lambda x: x != ""),
        c_l: lines,
        "n_symbols": (F.size(F.split(t, "[#*$%&|<>]", -1)) - 1).cast("long"),
    })
    d = d.withColumns({
        "n_words": F.size(c_w).cast("long"),
        "word_chars": F.length(F.array_join(c_w, "")).cast("long"),
        "n_word_lines": F.size(c_l).cast("long"),
        "n_dup_lines": (F.size(c_l) - F.size(F.array_distinct(c_l))).cast("long"),
        c_h: F.transform(c_w, lambda w: F.xxhash64(w)),
    }).drop(c_w, c_l)
    at = [lambda i, k=k: F.get(c_h, i + k) for k in range(WINDOW)]
    d = d.withColumn(c_g, F.when(
        F.size(c_h) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(c_h) - WINDOW), lambda i: F.xxhash64(*[f(i) for f in at]))))
    d = d.withColumn(c_rep, F.size(F.array_distinct(c_g)) < F.size(c_g)).drop(c_h)
    d = d.withColumn(c_s, F.when(
        F.col(c_rep), F.sort_array(F.transform(c_g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop(c_g)
    d = d.withColumn(c_p, F.when(F.col(c_rep), F.sort_array(F.filter(F.transform(c_s, lambda s, j: F.when(
        s["h"].eqNullSafe(F.get(c_s, j - 1)["h"]) | s["h"].eqNullSafe(F.get(c_s, j + 1)["h"]), s["i"])),
        lambda x: x.isNotNull())))).drop(c_s)
    gaps = F.transform(c_p, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(c_p, k + 1), p + WINDOW) - p))
    return d.withColumn("n_repeat_words", F.when(
        F.col(c_rep), F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))
    ).drop(c_p, c_rep)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def rules(text: str = "text") -> dict[str, Column]:
    """The method's rules beyond the base; each rejects plain junk only."""
    t = F.coalesce(F.col(text), F.lit(""))
    upper = F.size(F.split(t, "\\p{Lu}", -1)) - 1
    lower = F.size(F.split(t, "\\p{Ll}", -1)) - 1
    return {
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PCT * F.col("word_chars"),
        "dup_lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PCT * F.col("n_word_lines"),
        "long_words": F.col("word_chars") > MAX_MEAN_WORD * F.col("n_words"),
        "shouting": 100 * upper > MAX_UPPER_PCT * (upper + lower),
    }


def work(text: str = "text") -> dict[str, Column]:
    """Code points that a rule looks at beyond the counts that every row has; a comparison of counts is 1."""
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    return {"symbols": F.lit(1), "dup_lines": F.lit(1), "long_words": F.lit(1), "shouting": 1 + 2 * size}


def order_rules(sample: DataFrame, rejects: dict[str, Column], costs: dict[str, Column] | None = None) -> list[tuple[str, float, float]]:
    """(name, cost, rejected share) by rejection per cost, best first; ties keep the given order.

    One aggregate over ``sample``, whose rows the caller bounds.  ``costs``: work
    a row (1 for rules that it does not name).  An empty sample keeps the order.
    """
    costs = costs or {}
    shares = [F.avg(F.coalesce(col, F.lit(False)).cast("double")) for col in rejects.values()]
    each = [F.avg(costs.get(name, F.lit(1)).cast("double")) for name in rejects]
    got = sample.agg(*[c.alias(f"m{i}") for i, c in enumerate(shares + each)]).first()
    n = len(rejects)
    found = [(name, max(got[n + i] or 1.0, 1e-9), got[i] or 0.0) for i, name in enumerate(rejects)]
    return sorted(found, key=lambda x: -x[2] / x[1])


def cascade(rejects: dict[str, Column], order: Sequence[str]) -> Column:
    """Name of the first rule in ``order`` that rejects the row, else null."""
    out = None
    for name in order:
        out = (F.when if out is None else out.when)(F.coalesce(rejects[name], F.lit(False)), F.lit(name))
    return F.lit(None).cast("string") if out is None else out


def quality(df: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Add features, ``base_failed``, ``rejected_by`` and ``kept`` to ``df``.

    ``sample_rows`` bounds the rows on which rules are estimated; all rows are judged.
    """
    extra = rules(text)
    sample = saved(features(df.select(F.col(text)).limit(sample_rows), text), "quality-sample")
    order = [x[0] for x in order_rules(sample, extra, work(text))]
    d = features(df, text).withColumn("base_failed", base_failed())
    d = d.withColumn("kept", ~F.col("base_failed") & cascade(extra, order).isNull())
    # rows that are kept are done; of the few others the first rule in the fixed order is named
    return d.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).when(~F.col("kept"), cascade(extra, list(extra))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir)).select("doc_id", *FEATURES, "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
 FROM documents),
words AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM d),
win AS (SELECT doc_id, i, x || ' ' || lead(x, 1) OVER s || ' ' || lead(x, 2) OVER s || ' ' || lead(x, 3) OVER s
   || ' ' || lead(x, 4) OVER s AS g FROM words WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win WHERE g IS NOT NULL) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(5) r(k) GROUP BY doc_id),
f AS (SELECT d.doc_id, t, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l) AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS up, length(regexp_replace(t, '[^\p{Ll}]', '', 'g')) AS low
  FROM d LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 25 * word_chars OR 100 * n_dup_lines > 60 * n_lines
    OR word_chars > 60 * n_words OR 100 * up > 90 * (up + low)) AS kept FROM b
"""
