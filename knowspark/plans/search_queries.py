"""Registered search queries (Spark side + DuckDB oracle text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import index as ix
from ..operators import search as S
from . import oracle as O
from . import views as V

# Fixed query parameters of the registered searches.
RANK_QUERIES = {1: "the", 2: "thedea", 3: "aique moron", 4: "que de la", 5: "schsch"}
ANY_QUERIES = {1: "thedea moron", 2: "schsch cionie aique"}
ALL_QUERIES = {1: "the of and", 2: "que la"}
TYPE_QUERY, TYPE_FILTER = "the", "knowledge"
SOURCE_QUERY, SOURCE_FILTER = "the", "src1,src12"


def _index(spark: SparkSession, sf: str) -> ix.Index:
    return ix.build_index(V.entries(spark, sf))


def _held(spark: SparkSession, sf: str) -> ix.Index:
    return ix.held_index(V.entries(spark, sf))


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("qid", "store", "id", "name", F.round("rank", 6).alias("rank"))


def q_tokenize(spark, sf):
    e = V.entries(spark, sf)
    all_toks = F.concat(*[tokens(F.coalesce(F.col(c), F.lit(""))) for c in ("name", "content", "tags")])
    return e.select("store", "id", F.size(all_toks).cast("long").alias("n_tokens"),
                    F.size(F.array_distinct(all_toks)).cast("long").alias("n_distinct"))


def q_postings(spark, sf):
    return ix.by_column(ix.postings(V.entries(spark, sf))).select("store", "id", "col", "term", F.col("tf").cast("long"))


def q_term_stats(spark, sf):
    return ix.term_stats(ix.postings(V.entries(spark, sf), positions=False))


def _eval(spark, sf, queries: dict[int, str], mode: str):
    idx = _held(spark, sf)
    if mode == "or":
        exprs = {q: S.parse_match(S.or_rewrite(t) or t) for q, t in queries.items()}
    else:
        exprs = {q: S.parse_match(t) for q, t in queries.items()}
    hits = S.evaluate(idx, exprs)
    return _ranked(hits.join(idx.entries.select("store", "id", "name"), ["store", "id"]))


def q_find_rank(spark, sf):
    return _eval(spark, sf, RANK_QUERIES, "and")


def q_find_any_term(spark, sf):
    return _eval(spark, sf, ANY_QUERIES, "or")


def q_find_all_terms(spark, sf):
    return _eval(spark, sf, ALL_QUERIES, "and")


def _bm25_oracle(queries: dict[int, str], mode: str) -> str:
    from ..functions.text import tokens_py
    qs = [(qid, tokens_py(t), mode) for qid, t in queries.items()]
    pre = O.with_views("entries", extra=O.index_ctes() + O.bm25_sql(qs))
    return pre + ("SELECT s.qid, s.store, s.id, e.name, round(s.rank, 6) AS rank "
                  "FROM scored s JOIN entries e ON e.store = s.store AND e.id = s.id")


def oracle() -> dict[str, str]:
    toks3 = " || ".join(O.tok(c) for c in ("name", "content", "tags"))
    idx_pre = O.with_views("entries", extra=O.index_ctes())
    return {
        "tokenize": O.with_views("entries") +
            f"SELECT store, id, CAST(len({toks3}) AS BIGINT) AS n_tokens, "
            f"CAST(len(list_distinct({toks3})) AS BIGINT) AS n_distinct FROM entries",
        "postings": idx_pre + "SELECT store, id, col, term, count(*) AS tf FROM toks GROUP BY ALL",
        "term_stats": idx_pre + "SELECT store, term, count(DISTINCT id) AS df, count(*) AS cf "
                                "FROM toks GROUP BY ALL",
        "find_rank": _bm25_oracle(RANK_QUERIES, "and"),
        "find_any_term": _bm25_oracle(ANY_QUERIES, "or"),
        "find_all_terms": _bm25_oracle(ALL_QUERIES, "and"),
    }


def queries() -> dict:
    return {
        **EXTRA,
        "tokenize": q_tokenize,
        "postings": q_postings,
        "term_stats": q_term_stats,
        "find_rank": q_find_rank,
        "find_any_term": q_find_any_term,
        "find_all_terms": q_find_all_terms,
    }


# --------------------------------------------------------------------------
# Expressions: phrase, NEAR, boolean, prefix, column / first-token
# --------------------------------------------------------------------------

# Fixed query parameters.
PHRASE_QUERIES = {1: '"de la"', 2: '"of the"', 3: '"que de"'}
NEAR_QUERIES = {1: "NEAR(thedea moron, 5)", 2: "NEAR(the was)", 3: "NEAR(que la, 0)"}
BOOL_QUERIES = {1: "thedea OR moron", 2: "moron NOT the", 3: "the AND aique", 4: "schsch OR thedea NOT of",
                5: "thedea NOT the moron", 6: "moron – the", 7: "the AND that NOT of is", 8: "moron NOT the NOT of"}


def _w(word: str) -> S.Phrase:
    return S.Phrase((word,))


def _c(*must: str, no=()) -> S.Clause:
    return S.Clause(tuple(map(_w, must)), tuple(tuple(map(_w, g)) for g in no))


# What BOOL_QUERIES mean, written out for the oracle.
BOOL_MEANING = {q: S.SearchExpr(c) for q, c in {
    1: (_c("thedea"), _c("moron")), 2: (_c("moron", no=[["the"]]),), 3: (_c("the", "aique"),),
    4: (_c("schsch"), _c("thedea", no=[["of"]])), 5: (_c("thedea", no=[["the", "moron"]]),), 6: (_c("moron", "the"),),
    7: (_c("the", "that", no=[["of", "is"]]),), 8: (_c("moron", no=[["the"], ["of"]]),)}.items()}
PREFIX_QUERIES = {1: "thed*", 2: "schs*", 3: '"de la"*'}
COLUMN_QUERIES = {1: "tags:documents src1", 2: "name:bench", 3: "^the", 4: "content:observed", 5: "tags:^agent"}


def _expr_query(qs):
    def run(spark, sf):
        idx = _held(spark, sf)
        hits = S.evaluate(idx, {q: S.parse_match(t) for q, t in qs.items()})
        return _ranked(hits.join(idx.entries.select("store", "id", "name"), ["store", "id"]))
    return run


def _expr_oracle(qs, meaning=None) -> str:
    exprs = meaning or {q: S.parse_match(t) for q, t in qs.items()}
    pre = O.with_views("entries", extra=O.index_ctes() + [O.ptoks_cte()] + O.expr_ctes(exprs))
    return pre + ("SELECT s.qid, s.store, s.id, e.name, round(s.rank, 6) AS rank "
                  "FROM scored s JOIN entries e ON e.store = s.store AND e.id = s.id")


# --------------------------------------------------------------------------
# Staged find, filters, listings, lookups
# --------------------------------------------------------------------------

FIND_QUERIES = {1: "the", 2: "thedea moron", 3: "aux.", 4: "zzqx aux,", 5: "qqqzz wwwyy",
                6: "Eau", 7: "", 8: "e, l"}
FIND_LIMIT = 10
LIKE_QUERIES = {1: "aux.", 2: "e, l", 3: "ment_e", 4: "SRC1", 5: "É", 6: "Ü"}
LIKE_ANY_QUERIES = {1: "qqzz aux.", 2: "zzyq thedea"}
LISTING_SOURCE = "observed/src3/"


def _find_out(df):
    return df.select("qid", "pos", "stage", "store", "id", "name")


def q_find(spark, sf):
    return _find_out(S.find(_held(spark, sf), FIND_QUERIES, limit=FIND_LIMIT))


def q_find_type(spark, sf):
    return _find_out(S.find(_held(spark, sf), {1: TYPE_QUERY}, type=TYPE_FILTER, limit=FIND_LIMIT))


def q_find_source(spark, sf):
    return _find_out(S.find(_held(spark, sf), {1: SOURCE_QUERY}, source=SOURCE_FILTER, limit=FIND_LIMIT))


def q_browse(spark, sf):
    return _find_out(S.find(_index(spark, sf), {1: ""}, type="observed", limit=20))


def q_source_listing(spark, sf):
    return _find_out(S.find(_index(spark, sf), {1: "  "}, source=LISTING_SOURCE, limit=20))


def q_find_like(spark, sf):
    r = S.like_stage(V.entries(spark, sf), LIKE_QUERIES, limit=20)
    return r.select("qid", "store", "id", "name")


def q_find_like_any(spark, sf):
    r = S.like_stage(V.entries(spark, sf), LIKE_ANY_QUERIES, limit=20)
    return r.select("qid", "store", "id", "name")


def q_snippet(spark, sf):
    r = S.find(_held(spark, sf), {1: "the moron", 2: "aux."}, limit=FIND_LIMIT, with_snippets=True)
    return r.select("qid", "pos", "store", "id", "snippet")


#: A bad limit, one beyond the bound, blank queries and white space around words, as a user may type them.
BOUNDED = {1: " the moron ", 2: "aux.", 3: "  ", 4: ""}


def q_find_bounded(spark, sf):
    idx = _held(spark, sf)
    cols = ["qid", "pos", "store", "id", "snippet"]
    a = S.find_bounded(idx, BOUNDED, limit="many").select(*cols, F.lit("bad").alias("asked"))
    return a.unionByName(S.find_bounded(idx, {1: BOUNDED[1]}, limit=1000).select(*cols, F.lit("large").alias("asked")))


def _snippet_sql(queries: dict, k: int, asked: str | None = None) -> str:
    """Snippets of the words' hits in the rows that ``find`` returns for plain words; rows found as substrings have none."""
    from ..functions.text import TOKEN_PATTERN, tokens_py
    words = " ".join(f"WHEN {qid} THEN [" + ", ".join(O._q(t) for t in tokens_py(q)) + "]" for qid, q in queries.items())
    token = O._q(TOKEN_PATTERN)
    find = _find_sql(queries, k)
    return f"""
WITH f AS ({find}), t AS (
  SELECT f.qid, f.pos, f.stage, f.store, f.id, regexp_extract_all(coalesce(d.text, c.text, b.text, ''), {token}) AS r
  FROM f LEFT JOIN documents d ON f.store = 'user' AND d.doc_id = f.id
  LEFT JOIN conversations c ON f.store = 'user' AND 1000000000 + c.conv_id * 100 + c.turn = f.id
  LEFT JOIN benchmark b ON f.store = 'system' AND b.item_id = f.id),
m AS (SELECT *, list_transform(r, lambda x: CASE WHEN list_contains(CASE qid {words} END, strip_accents(lower(x))) THEN 1 ELSE 0 END) AS h FROM t),
w AS (SELECT *, len(r) AS n, list_transform(range(0, greatest(len(r) - 16, 0) + 1), lambda s: coalesce(list_sum(list_slice(h, s + 1, s + 16)), 0)) AS sc FROM m),
p AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE list_position(sc, list_max(sc)) - 1 END AS s FROM w)
SELECT qid, pos, store, id, CASE WHEN stage < 3 THEN CASE WHEN s > 0 THEN '… ' ELSE '' END || array_to_string(
    list_transform(range(s, least(s + 16, n)), lambda i: CASE WHEN h[i + 1] = 1 THEN '>>>' || r[i + 1] || '<<<' ELSE r[i + 1] END), ' ')
    || CASE WHEN s + 16 < n THEN ' …' ELSE '' END END AS snippet{f", '{asked}' AS asked" if asked else ""} FROM p"""


def q_list_entries(spark, sf):
    return S.list_entries(V.entries(spark, sf), None, 50).select("pos", "store", "id", "name")


def _with_overrides(spark, sf):
    """Entries plus user-store copies of even benchmark items (shadowing)."""
    e = V.entries(spark, sf)
    over = (V.bench_entries(spark, sf).filter(F.col("id") % 2 == 0)
            .withColumn("store", F.lit("user")).withColumn("id", F.col("id") + 2_000_000_000))
    return e.unionByName(over)


def q_get_by_name(spark, sf):
    e = _with_overrides(spark, sf)
    names = V.bench_entries(spark, sf).select("name").unionByName(
        V.docs_entries(spark, sf).filter(F.col("id") % 7 == 0).select("name"))
    return S.get_by_name(e, names).select("name", "store", "id")


def _topk_sql(src: str, part: str, order: str, k: int) -> str:
    return (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS rn "
            f"FROM {src}) WHERE rn <= {k}")


def _like_sql(queries: dict, k: int, filt: str = "true", name: str = "lk") -> list[tuple[str, str]]:
    """CTE ``name``(qid, store, id, ...entry cols) for the LIKE stage."""
    a = " UNION ALL ".join(f"SELECT {qid} AS qid, e.* FROM entries e WHERE ({O.like_any_cols(q)}) AND {filt}"
                           for qid, q in queries.items()) or "SELECT NULL::BIGINT AS qid, e.* FROM entries e WHERE false"
    ctes = [(f"{name}_a", _topk_sql(f"({a})", "qid, store", "id", k))]
    multi = {qid: [t for t in q.split() if t.strip()] for qid, q in queries.items()}
    multi = {qid: ts for qid, ts in multi.items() if len(ts) > 1}
    if multi:
        b = " UNION ALL ".join(
            f"SELECT {qid} AS qid, e.* FROM entries e WHERE ({' OR '.join('(' + O.like_any_cols(t) + ')' for t in ts)}) "
            f"AND {filt} AND {qid} NOT IN (SELECT qid FROM {name}_a)" for qid, ts in multi.items())
        ctes.append((f"{name}_b", _topk_sql(f"({b})", "qid, store", "id", k)))
        ctes.append((name, f"SELECT * FROM {name}_a UNION ALL SELECT * FROM {name}_b"))
    else:
        ctes.append((name, f"SELECT * FROM {name}_a"))
    return ctes


def _find_sql(queries: dict, k: int, type_=None, source=None, extra_out="") -> str:
    filt = "true"
    if type_:
        filt += f" AND type = '{type_}'"
    srcs = S.normalize_sources(source)
    if srcs:
        filt += " AND " + O.source_cond(srcs)
    listing = {q: t for q, t in queries.items() if not t.strip() and srcs}
    pending = {q: t for q, t in queries.items() if q not in listing}
    ctes = O.index_ctes() + [O.ptoks_cte()]
    parts = []
    if listing:
        l_rows = " UNION ALL ".join(f"SELECT {q} AS qid, e.* FROM entries e WHERE {filt}" for q in listing)
        ctes.append(("st0", _topk_sql(f"({l_rows})", "qid, store", "updated DESC, id", k)))
        parts.append("SELECT qid, 0 AS stage, 0.0 AS rank, store, id, name, pinned, updated FROM st0")

    def fts(texts, tag, stage, exclude):
        exprs = {}
        for q, t in texts.items():
            try:
                exprs[q] = S.parse_match(t)
            except S.MatchError:
                pass
        if not exprs:
            return
        ctes.extend(O.expr_ctes(exprs, name=f"{tag}x"))
        excl = "".join(f" AND s.qid NOT IN (SELECT qid FROM {x})" for x in exclude)
        ctes.append((tag, _topk_sql(
            f"(SELECT s.qid, s.rank, e.* FROM {tag}x s JOIN entries e ON e.store = s.store AND e.id = s.id "
            f"WHERE {filt}{excl})", "qid, store", "rank, id", k)))
        parts.append(f"SELECT qid, {stage} AS stage, rank, store, id, name, pinned, updated FROM {tag}")
        done.append(tag)

    done = []
    fts(pending, "st1", 1, [])
    rew = {q: S.or_rewrite(t) for q, t in pending.items()}
    fts({q: r for q, r in rew.items() if r}, "st2", 2, list(done))
    like_q = pending
    ctes += _like_sql(like_q, k, filt, "lk")
    excl = "".join(f" AND qid NOT IN (SELECT qid FROM {x})" for x in done)
    parts.append(f"SELECT qid, 3 AS stage, 0.0 AS rank, store, id, name, pinned, updated FROM lk WHERE true{excl}")
    ctes.append(("allr", " UNION ALL ".join(parts)))
    ctes.append(("ordered", "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pinned DESC, rank, "
                            "updated DESC, CASE WHEN store = 'user' THEN 0 ELSE 1 END, id) AS pos FROM allr"))
    return O.with_views("entries", extra=ctes) + \
        f"SELECT qid, pos, stage, store, id, name FROM ordered WHERE pos <= {k}"


def _list_sql(k: int) -> str:
    ctes = [("per", _topk_sql("entries", "store", "updated DESC, id", k)),
            ("o", "SELECT *, row_number() OVER (ORDER BY CASE WHEN store = 'user' THEN 0 ELSE 1 END, "
                  "updated DESC, id) AS pos FROM per")]
    return O.with_views("entries", extra=ctes) + f"SELECT pos, store, id, name FROM o WHERE pos <= {k}"


def _get_sql() -> str:
    ctes = [("over", "SELECT 'user' AS store, id + 2000000000 AS id, type, name, content, tags, meta, pinned, "
                     "created, updated FROM bench_e WHERE id % 2 = 0"),
            ("ent2", "SELECT * FROM entries UNION ALL SELECT * FROM over"),
            ("names", "SELECT DISTINCT name FROM (SELECT name FROM bench_e UNION ALL "
                      "SELECT name FROM docs_e WHERE id % 7 = 0)"),
            ("r", "SELECT e.name, e.store, e.id, row_number() OVER (PARTITION BY e.name ORDER BY "
                  "CASE WHEN e.store = 'user' THEN 0 ELSE 1 END) AS rn FROM ent2 e JOIN names n ON n.name = e.name")]
    return O.with_views("entries", extra=ctes) + "SELECT name, store, id FROM r WHERE rn = 1"


def _like_only_sql(qs) -> str:
    return O.with_views("entries", extra=_like_sql(qs, 20)) + "SELECT qid, store, id, name FROM lk"


EXTRA = {
    "find_phrase": _expr_query(PHRASE_QUERIES),
    "find_near": _expr_query(NEAR_QUERIES),
    "find_boolean": _expr_query(BOOL_QUERIES),
    "find_prefix": _expr_query(PREFIX_QUERIES),
    "find_column": _expr_query(COLUMN_QUERIES),
    "find": q_find,
    "find_type": q_find_type,
    "find_source": q_find_source,
    "browse": q_browse,
    "source_listing": q_source_listing,
    "find_like": q_find_like,
    "find_like_any": q_find_like_any,
    "snippet": q_snippet,
    "find_bounded": q_find_bounded,
    "list_entries": q_list_entries,
    "get_by_name": q_get_by_name,
}

_base_oracle = oracle


def oracle() -> dict[str, str]:  # noqa: F811
    o = _base_oracle()
    o.update({
        "find_phrase": _expr_oracle(PHRASE_QUERIES),
        "find_near": _expr_oracle(NEAR_QUERIES),
        "find_boolean": _expr_oracle(BOOL_QUERIES, BOOL_MEANING),
        "find_prefix": _expr_oracle(PREFIX_QUERIES),
        "find_column": _expr_oracle(COLUMN_QUERIES),
        "find": _find_sql(FIND_QUERIES, FIND_LIMIT),
        "find_type": _find_sql({1: TYPE_QUERY}, FIND_LIMIT, type_=TYPE_FILTER),
        "find_source": _find_sql({1: SOURCE_QUERY}, FIND_LIMIT, source=SOURCE_FILTER),
        "browse": _find_sql({1: ""}, 20, type_="observed"),
        "source_listing": _find_sql({1: "  "}, 20, source=LISTING_SOURCE),
        "find_like": _like_only_sql(LIKE_QUERIES),
        "find_like_any": _like_only_sql(LIKE_ANY_QUERIES),
        "list_entries": _list_sql(50),
        "snippet": _snippet_sql({1: "the moron", 2: "aux."}, FIND_LIMIT),
        "find_bounded": "SELECT * FROM (" + _snippet_sql({1: "the moron", 2: "aux."}, 20, "bad") + ") UNION ALL SELECT * FROM ("
                        + _snippet_sql({1: "the moron"}, 100, "large") + ")",
        "get_by_name": _get_sql(),
    })
    return o
