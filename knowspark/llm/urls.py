"""URL filters by hashed host-suffix and path-prefix expressions (operator 7, built-in functions only).

Every distinct URL is expanded into ``host suffix + path prefix`` expressions;
an expression is the string of a rule that would fit.  Expressions and rules
meet in an equi-join on the first bytes of their SHA-256, the whole digest
confirms a hit, and the most specific rule wins.

Host suffixes end at label boundaries (the host and its parents).  Path
prefixes are taken at the lengths that occur among the rules' paths: a rule's
path fits only as a prefix of its own length, so no other prefix can hit.

Defined results: a null URL, or one without ``://``, has an empty host and path
and no rule; rows keep their number, repeated rows get equal verdicts; an empty
rule table leaves all rows to the default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, saved, table

PREFIX_HEX = 8
MAX_PATH_LENGTHS = 4096
#: The rules that the query applies (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


def parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    r, raw = fresh(df.columns, "_rest"), fresh(df.columns, "_raw")
    d = df.withColumn(r, rest)
    d = d.withColumn(raw, F.regexp_extract(r, r"\A([^/?#]*)", 1))
    low = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return d.withColumns({
        "host": low,
        "path": F.regexp_extract(F.substring(F.col(r), F.length(raw) + 1, F.length(r)), r"\A([^?#]*)", 1),
    }).drop(r, raw)


def hashed_rules(rules: DataFrame) -> DataFrame:
    """rules(host, path, verdict) -> one row a rule string with digest and prefix; the larger verdict of equal rules."""
    r = rules.select(F.concat("host", "path").alias("rule"), F.length("host").alias("host_len"),
                     F.length("path").alias("path_len"), "verdict")
    r = r.groupBy("rule").agg(F.max("host_len").alias("host_len"), F.max("path_len").alias("path_len"),
                              F.max("verdict").alias("verdict"))
    r = r.withColumn("digest", F.sha2("rule", 256))
    return r.withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))


def judge(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to ``df``, in place of columns of these names.

    The distinct paths' lengths of the rules go to the driver (integers, at
    most ``MAX_PATH_LENGTHS``; more raise).  Verdicts are found once a distinct
    (host, leading path), so a host with a third of all rows is expanded once
    a path and not once a row; the join back is an outer join that Spark can
    split by skew.
    """
    r = hashed_rules(rules)
    lengths = [x[0] for x in r.select("path_len").distinct().limit(MAX_PATH_LENGTHS + 1).collect()]
    if len(lengths) > MAX_PATH_LENGTHS:
        raise ValueError(f"more than {MAX_PATH_LENGTHS} different path lengths among the rules")
    lead, best_of = fresh(df.columns, "_lead"), fresh(df.columns, "_b")
    d = parts(df, url).drop("rule", "verdict").withColumn(lead, F.substring("path", 1, max(lengths, default=0)))
    heads = d.select("host", F.col(lead).alias("_lead")).filter(F.col("host") != "").distinct()
    labels = F.split("host", "\\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("_lead") >= n, F.substring("_lead", 1, n)) for n in lengths])
                        if lengths else F.array().cast("array<string>"), lambda x: x.isNotNull())
    e = heads.withColumn("_s", F.explode(suffixes)).withColumn("_p", F.explode(prefixes))
    e = e.withColumn("_d", F.sha2(F.concat("_s", "_p"), 256)).withColumn("prefix", F.substring("_d", 1, PREFIX_HEX))
    hit = e.join(r, "prefix").filter((F.col("_d") == F.col("digest")) & (F.length("_s") == F.col("host_len")))
    best = hit.groupBy("host", "_lead").agg(F.max(F.struct(
        F.length("rule").alias("n"), "host_len", "rule", "verdict")).alias("_b"))
    # written first: the join then has plain shuffles on both sides, which Spark can split by skew
    best = saved(best, "url-verdicts").select("host", F.col("_lead").alias(lead), F.col("_b").alias(best_of))
    out = d.join(best, ["host", lead], "left")
    keep = [c for c in d.columns if c != lead]
    return out.select(*keep, F.col(best_of)["rule"].alias("rule"),
                      F.coalesce(F.col(best_of)["verdict"], F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string")).drop("url")


ORACLE = r"""
WITH r(host, path, verdict) AS (VALUES ('com','/','allow'), ('example.com','/en/','block'), ('www.example.com','/en/','allow'),
  ('net','/es/','block'), ('net','/fr/','block')),
p AS (SELECT row_number() OVER () AS k, page_id, coalesce(CASE WHEN position('://' IN url) > 0
   THEN substr(url, position('://' IN url) + 3) ELSE '' END, '') AS rest FROM pages),
q AS (SELECT k, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path FROM p),
j AS (SELECT q.*, r.host || r.path AS rule, r.verdict,
  row_number() OVER (PARTITION BY k ORDER BY length(r.host || r.path) DESC NULLS LAST) AS n
  FROM q LEFT JOIN r ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM j WHERE n = 1
"""
