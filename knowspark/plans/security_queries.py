"""Registered queries: redaction, findings, alerts, never-index paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import redact as R
from . import oracle as O
from . import views as V

CLOUD_ROOT = "/cloud"

# Test-view rule: documents get one fake credential appended, chosen by doc_id % 14
# (13 = clean).  Each token is built from the doc id, so both engines agree.
_TOKENS_SQL = {
    0: "'sk-ant-api03-' || lpad(CAST(doc_id AS VARCHAR), 93, 'a') || 'AA'",
    1: "'sk-proj-' || lpad(CAST(doc_id AS VARCHAR), 24, 'b') || 'T3BlbkFJ' || lpad(CAST(doc_id AS VARCHAR), 24, 'c')",
    2: "'sk-' || lpad(CAST(doc_id AS VARCHAR), 20, 'd') || 'T3BlbkFJ' || lpad(CAST(doc_id AS VARCHAR), 20, 'e')",
    3: "'ghp_' || lpad(CAST(doc_id AS VARCHAR), 36, 'f')",
    4: "'github_pat_' || lpad(CAST(doc_id AS VARCHAR), 22, 'g') || '_' || lpad(CAST(doc_id AS VARCHAR), 59, 'h')",
    5: "'AKIA' || lpad(CAST(doc_id AS VARCHAR), 16, 'Q')",
    6: "'xoxb-' || lpad(CAST(doc_id AS VARCHAR), 24, '1')",
    7: "'xapp-' || lpad(CAST(doc_id AS VARCHAR), 24, '2')",
    8: "'AIza' || lpad(CAST(doc_id AS VARCHAR), 35, 'k')",
    9: "'glpat-' || lpad(CAST(doc_id AS VARCHAR), 20, 'm')",
    10: "'npm_' || lpad(CAST(doc_id AS VARCHAR), 36, 'n')",
    11: "'Authorization: Bearer ' || lpad(CAST(doc_id AS VARCHAR), 32, 'p')",
    12: "'-----BEGIN RSA PRIVATE KEY-----' || chr(10) || lpad(CAST(doc_id AS VARCHAR), 40, 'q') || chr(10) || '-----END RSA PRIVATE KEY-----'",
}


def _token_sql_duck() -> str:
    return "CASE doc_id % 14 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _TOKENS_SQL.items()) + " ELSE '' END"


def leaky(spark, sf):
    """documents with a fake credential appended (spark side of the view)."""
    d = V.table(spark, sf, "documents")
    tok = F.expr(_token_sql_duck().replace("chr(10)", "char(10)").replace("CAST(doc_id AS VARCHAR)", "CAST(doc_id AS STRING)"))
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(CLOUD_ROOT + "/"), "source", F.lit("/"),
                                                   F.col("doc_id").cast("string"), F.lit(".md"))) \
            .otherwise(F.concat(F.lit("/local/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")))
    return d.select("doc_id", F.concat("text", F.lit(" "), tok, F.lit(" ")).alias("text"),
                    path.alias("source_path"))


LEAKY_SQL = f"""
SELECT doc_id, text || ' ' || {_token_sql_duck()} || ' ' AS text,
       CASE WHEN doc_id % 3 = 0 THEN '{CLOUD_ROOT}/' || source || '/' || CAST(doc_id AS VARCHAR) || '.md'
            ELSE '/local/' || source || '/' || CAST(doc_id AS VARCHAR) || '.md' END AS source_path
FROM documents"""

_PATTERNS_RE2 = [(f, p) for f, p in R.SECRET_PATTERNS]


def _duck_chain() -> tuple[str, str]:
    """(redacted expr, families expr) over column ``text`` in DuckDB SQL."""
    cur = "text"
    fams = []
    for fam, pat in _PATTERNS_RE2:
        fams.append(f"CASE WHEN regexp_matches({cur}, {O._q(pat)}) THEN '{fam}' END")
        cur = f"regexp_replace({cur}, {O._q(pat)}, '\\1{R.REDACTION_MARKER}', 'g')"
    return cur, fams


def q_redact_text(spark, sf):
    d = R.redact(leaky(spark, sf), "text", "fams")
    return d.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def q_redact_bearer_unicode(spark, sf):
    """Headers whose letters match only by Unicode case rules; the last word shows whether the value survived."""
    head = F.when(F.col("doc_id") % 3 == 0, "author\u0131zation: bearer ").when(F.col("doc_id") % 3 == 1, "AUTHORIZATION :  BeaRer ") \
            .otherwise("authorization - bearer ")
    d = V.table(spark, sf, "documents").select("doc_id", F.concat(
        "text", F.lit(" "), head, F.lpad(F.col("doc_id").cast("string"), 32, "p")).alias("text"))
    return R.redact(d, "text", "fams").select("doc_id", F.substring_index("text", " ", -1).alias("last"))


def q_redact_families(spark, sf):
    d = R.redact(leaky(spark, sf), "text", "fams")
    return d.select("doc_id", F.array_join("fams", ",").alias("families"))


def q_redact_sweep(spark, sf):
    d = R.redact(leaky(spark, sf), "text", "fams")
    return R.fired(d, families_col="fams").groupBy("family").agg(F.count(F.lit(1)).alias("n_entries"))


def _existing_alerts(spark, sf):
    """Alerts already listed: the findings of every fifth document."""
    d = R.redact(leaky(spark, sf).filter(F.col("doc_id") % 5 == 0), "text", "fams")
    return R.findings(d, "source_path", "fams")


def q_alert_new(spark, sf):
    d = R.redact(leaky(spark, sf), "text", "fams")
    return R.alert_new(R.findings(d, "source_path", "fams"), _existing_alerts(spark, sf), CLOUD_ROOT)


# Test-view rule: synthetic paths per document (fixed templates, doc id inside).
PATH_TEMPLATES = [
    "notes/{id}.md", "C:\\Users\\x\\.ssh\\id_{id}", "home/CREDENTIALS/{id}.txt",
    "proj/credentials-howto-{id}.md", "keys/{id}.pem", "a/b/.env", "node_modules/x/{id}.js",
    "docs/Secrets.json", "x/{id}.KEY", ".absorber/{id}.txt", "sub/__pycache__/{id}.pyc",
    "config.json", "sub/config.json", ".absorber-notes-{id}.txt", "D:\\work\\venv\\{id}.py",
    "Id_RSA", "deep/.git/objects/{id}", "archive/{id}.asc.txt",
]


def _path_expr_spark():
    n = len(PATH_TEMPLATES)
    out = None
    for i, t in enumerate(PATH_TEMPLATES):
        pre, _, post = t.partition("{id}")
        v = F.concat(F.lit(pre), F.col("doc_id").cast("string"), F.lit(post)) if "{id}" in t else F.lit(t)
        out = F.when(F.col("doc_id") % n == i, v) if out is None else out.when(F.col("doc_id") % n == i, v)
    return out


def _path_expr_duck():
    n = len(PATH_TEMPLATES)
    parts = []
    for i, t in enumerate(PATH_TEMPLATES):
        pre, _, post = t.partition("{id}")
        v = f"{O._q(pre)} || CAST(doc_id AS VARCHAR) || {O._q(post)}" if "{id}" in t else O._q(t)
        parts.append(f"WHEN {i} THEN {v}")
    return f"CASE doc_id % {n} " + " ".join(parts) + " END"


def q_path_excluded(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", _path_expr_spark().alias("path"))
    return d.select("doc_id", "path", P.is_excluded("path").alias("excluded"),
                    P.is_internal("path").alias("internal"))


def _duck_path_rules() -> tuple[str, str]:
    segs = "list_transform(list_filter(string_split(replace(path, '\\', '/'), '/'), lambda s: s <> ''), lambda s: lower(s))"
    name = f"lower(coalesce({segs}[-1], ''))"
    seg_hit = "len(list_intersect(" + segs + ", [" + ", ".join(O._q(s) for s in (*P.EXCLUDED_PATH_SEGMENTS, P.HOME_SEGMENT)) + "])) > 0"
    name_hit = f"{name} IN (" + ", ".join(O._q(s) for s in P.EXCLUDED_FILENAMES) + ")"
    suf_hit = " OR ".join(f"ends_with({name}, {O._q(s)})" for s in P.EXCLUDED_SUFFIXES)
    excluded = f"({seg_hit} OR {name_hit} OR {suf_hit})"
    top = "(len(string_split(replace(path, '\\', '/'), '/')) = 1 AND replace(path, '\\', '/') IN ('config.json'))"
    return excluded, f"({excluded} OR {top})"


def queries():
    return {"redact_bearer_unicode": q_redact_bearer_unicode, "redact_text": q_redact_text, "redact_families": q_redact_families,
            "redact_sweep": q_redact_sweep, "alert_new": q_alert_new,
            "path_excluded": q_path_excluded}


def oracle():
    red, fams = _duck_chain()
    fam_list = "list_sort(list_filter([" + ", ".join(fams) + "], lambda x: x IS NOT NULL))"
    base = "WITH leaky AS (" + LEAKY_SQL + "), red AS (SELECT doc_id, source_path, " + red + \
        " AS rtext, " + fam_list + " AS fams FROM leaky)\n"
    excluded, internal = _duck_path_rules()
    found = "SELECT DISTINCT source_path AS path, unnest(fams) AS family FROM red"
    return {
        "redact_text": base + "SELECT doc_id, CAST(length(rtext) AS BIGINT) AS n_chars, md5(rtext) AS text_md5 FROM red",
        "redact_bearer_unicode": f"SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN '{R.REDACTION_MARKER}' "
                                 "ELSE lpad(CAST(doc_id AS VARCHAR), 32, 'p') END AS last FROM documents",
        "redact_families": base + "SELECT doc_id, array_to_string(fams, ',') AS families FROM red",
        "redact_sweep": base + "SELECT family, count(*) AS n_entries FROM (SELECT unnest(fams) AS family FROM red) GROUP BY family",
        "alert_new": base + f", f AS ({found}), ex AS (SELECT DISTINCT source_path AS path, unnest(fams) AS family "
                            f"FROM red WHERE doc_id % 5 = 0) "
                            f"SELECT path, family FROM f WHERE (path = '{CLOUD_ROOT}' OR starts_with(path, '{CLOUD_ROOT}/')) "
                            f"AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.path = f.path AND ex.family = f.family)",
        "path_excluded": f"WITH p AS (SELECT doc_id, {_path_expr_duck()} AS path FROM documents) "
                         f"SELECT doc_id, path, {excluded} AS excluded, {internal} AS internal FROM p",
    }
