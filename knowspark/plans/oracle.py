"""DuckDB SQL of the test views and of the oracle queries.

Each oracle string is self-contained: a WITH prefix defining the views over
the driver tables (pre-registered in DuckDB under their table names) followed
by the query.  The operator code in ``knowspark`` is written independently
with the DataFrame API; only the view definitions are shared knowledge.
"""

from __future__ import annotations

TOK = r"regexp_extract_all(strip_accents(lower(coalesce({x}, ''))), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{M}}]*')"


def tok(x: str) -> str:
    return TOK.format(x=x)


VIEWS = {
    "docs_e": """
SELECT 'user' AS store, d.doc_id AS id, 'observed' AS type,
       'observed/' || d.source || '/' || CAST(d.doc_id AS VARCHAR) AS name,
       d.text AS content, 'documents,' || d.source || ',' || d.lang AS tags,
       '{"source_id":"' || d.source || '","lang":"' || d.lang || '"}' AS meta,
       (coalesce(l.quality, 0) = 1 AND d.doc_id % 10 = 0) AS pinned,
       TIMESTAMP '2024-01-01 00:00:00' + to_seconds(d.doc_id * 60) AS created,
       TIMESTAMP '2024-01-01 00:00:00' + to_seconds(d.doc_id * 60) AS updated
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "conv_e": """
SELECT 'user' AS store, 1000000000 + conv_id * 100 + turn AS id, 'observed' AS type,
       'observed/conversations/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS name,
       text AS content, 'agent_transcript,conversations,' || role AS tags,
       '{"role":"' || role || '"}' AS meta, false AS pinned,
       TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 60 + turn) AS created,
       TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 60 + turn) AS updated
FROM conversations""",
    "bench_e": """
SELECT 'system' AS store, item_id AS id, 'knowledge' AS type,
       'bench/' || CAST(item_id AS VARCHAR) AS name, text AS content, 'benchmark' AS tags,
       '{}' AS meta, false AS pinned,
       TIMESTAMP '2024-01-01 00:00:00' + to_seconds(item_id * 60) AS created,
       TIMESTAMP '2024-01-01 00:00:00' + to_seconds(item_id * 60) AS updated
FROM benchmark""",
    "entries": """
SELECT * FROM docs_e UNION ALL SELECT * FROM conv_e UNION ALL SELECT * FROM bench_e""",
    "memory_e": """
SELECT 'user' AS store, event_id AS id,
       CASE event_type WHEN 'purchase' THEN 'lesson' WHEN 'signup' THEN 'session' ELSE 'memory' END AS type,
       'mem/' || CAST(event_id AS VARCHAR) AS name,
       event_type || ' user' || CAST(user_id AS VARCHAR) || ' k' || CAST(json_extract_string(props, '$.k') AS VARCHAR) AS content,
       'working,' || event_type AS tags,
       least(1.0, value / 500.0) AS weight,
       CAST(CASE event_type WHEN 'purchase' THEN 0.99 WHEN 'signup' THEN 0.97 ELSE 0.95 END AS DOUBLE) AS decay_rate,
       0 AS accessed,
       (event_id % 10 = 0) AS pinned,
       CAST(ts AS TIMESTAMP) AS created, CAST(ts AS TIMESTAMP) AS updated
FROM events""",
    "tasks_e": """
SELECT 'user' AS store, o_orderkey AS id, 'task' AS type,
       'task/' || CAST(o_orderkey AS VARCHAR) AS name,
       'order of customer ' || CAST(o_custkey AS VARCHAR) AS content, 'task' AS tags,
       CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'doing' ELSE 'done' END AS status,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high'
            WHEN '5-LOW' THEN 'low' ELSE 'normal' END AS priority,
       strftime(o_orderdate, '%Y-%m-%d') AS due,
       false AS pinned, CAST(o_orderdate AS TIMESTAMP) AS created, CAST(o_orderdate AS TIMESTAMP) AS updated
FROM orders""",
}

# dependency order for the WITH prefix
_ORDER = ["docs_e", "conv_e", "bench_e", "entries", "memory_e", "tasks_e"]


def with_views(*names: str, extra: list[tuple[str, str]] = ()) -> str:
    """WITH prefix holding the named views (and their dependencies) + extra CTEs."""
    need = set(names)
    if "entries" in need:
        need |= {"docs_e", "conv_e", "bench_e"}
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in _ORDER if n in need]
    parts += [f"{n} AS ({sql.strip()})" for n, sql in extra]
    return "WITH " + ",\n".join(parts) + "\n"


def index_ctes(src: str = "entries") -> list[tuple[str, str]]:
    """Positional tokens, lengths and store stats over an entry view."""
    cols = ["name", "content", "tags"]
    toks = " UNION ALL ".join(
        f"SELECT store, id, '{c}' AS col, unnest({tok(c)}) AS term FROM {src}" for c in cols)
    dl = " + ".join(f"len({tok(c)})" for c in cols)
    return [
        ("toks", toks),
        ("dl", f"SELECT store, id, {dl} AS dl FROM {src}"),
        ("stats", "SELECT store, count(*) AS n_docs, sum(dl) / count(*) AS avgdl FROM dl GROUP BY store"),
    ]


def bm25_sql(queries: list[tuple[int, list[str], str]]) -> list[tuple[str, str]]:
    """CTEs 'qterms', 'tf', 'nhit', 'scored' for bag-of-word queries.

    queries: (qid, terms, 'and' | 'or').  scored = (qid, store, id, rank).
    """
    vals = ", ".join(f"({qid}, {pid}, '{t}', {len(ts)}, '{mode}')"
                     for qid, ts, mode in queries for pid, t in enumerate(ts))
    return [
        ("qterms", f"SELECT * FROM (VALUES {vals}) AS v(qid, pid, term, nq, mode)"),
        ("tf", "SELECT q.qid, q.pid, t.store, t.id, count(*) AS freq FROM toks t "
               "JOIN qterms q ON t.term = q.term GROUP BY ALL"),
        ("nhit", "SELECT qid, pid, store, count(*) AS n_hit FROM tf GROUP BY ALL"),
        ("scored", """
SELECT tf.qid, tf.store, tf.id,
       -sum(greatest_idf * tf.freq * 2.2 / (tf.freq + 1.2 * (0.25 + 0.75 * dl.dl / s.avgdl))) AS rank,
       count(*) AS n_matched, any_value(q.nq) AS nq, any_value(q.mode) AS mode
FROM tf
JOIN (SELECT nhit.*, CASE WHEN ln((s.n_docs - n_hit + 0.5) / (n_hit + 0.5)) <= 0 THEN 1e-6
             ELSE ln((s.n_docs - n_hit + 0.5) / (n_hit + 0.5)) END AS greatest_idf
      FROM nhit JOIN stats s USING (store)) h USING (qid, pid, store)
JOIN stats s ON s.store = tf.store
JOIN dl ON dl.store = tf.store AND dl.id = tf.id
JOIN (SELECT DISTINCT qid, nq, mode FROM qterms) q ON q.qid = tf.qid
GROUP BY tf.qid, tf.store, tf.id
HAVING (any_value(q.mode) = 'or' OR count(*) = any_value(q.nq))"""),
    ]


def ptoks_cte(src: str = "entries") -> tuple[str, str]:
    """(store, id, col, pos, term) with 1-based positions."""
    parts = []
    for c in ("name", "content", "tags"):
        parts.append(f"SELECT store, id, '{c}' AS col, unnest(l) AS term, generate_subscripts(l, 1) AS pos "
                     f"FROM (SELECT store, id, {tok(c)} AS l FROM {src})")
    return ("ptoks", " UNION ALL ".join(parts))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _phrase_occ(ph, tag: str) -> str:
    """SQL of (store, id, col, pos) start positions of a phrase."""
    n = len(ph.tokens)
    if n == 0:
        return "SELECT store, id, col, pos FROM ptoks WHERE false"
    frm = ["ptoks a0"]
    where = []
    for i in range(1, n):
        frm.append(f"JOIN ptoks a{i} ON a{i}.store = a0.store AND a{i}.id = a0.id "
                   f"AND a{i}.col = a0.col AND a{i}.pos = a0.pos + {i}")
    for i, t in enumerate(ph.tokens):
        if ph.prefix and i == n - 1:
            where.append(f"starts_with(a{i}.term, {_q(t)})")
        else:
            where.append(f"a{i}.term = {_q(t)}")
    if ph.column:
        where.append(f"a0.col = {_q(ph.column)}")
    if ph.first:
        where.append("a0.pos = 1")
    return (f"SELECT a0.store, a0.id, a0.col, a0.pos FROM {' '.join(frm)} WHERE {' AND '.join(where)}")


def expr_ctes(exprs: dict, name: str = "scored") -> list[tuple[str, str]]:
    """CTEs ending in ``name``(qid, store, id, rank) for parsed SearchExprs.

    NEAR groups are supported for single-token members.
    """
    from ..operators.search import Near
    ctes, freq_rows, nhit_rows, match_rows, clause_sql = [], [], [], [], {}
    for qid, expr in exprs.items():
        ids = {}
        for ci, clause in enumerate(expr.clauses):
            for m in [*clause.must, *(m for g in clause.must_not for m in g)]:
                if m in ids:
                    continue
                mid = f"{name}_{qid}_{len(ids)}"
                ids[m] = mid
                if isinstance(m, Near):
                    occ = []
                    for j, ph in enumerate(m.phrases):
                        ctes.append((f"{mid}_o{j}", _phrase_occ(ph, mid)))
                        occ.append(f"{mid}_o{j}")
                    k1 = m.k + 1
                    for j, ph in enumerate(m.phrases):
                        others = [o for jj, o in enumerate(occ) if jj != j]
                        conds = " AND ".join(
                            f"EXISTS (SELECT 1 FROM {o} b WHERE b.store = a.store AND b.id = a.id "
                            f"AND b.col = a.col AND abs(b.pos - a.pos) <= {k1})" for o in others)
                        ctes.append((f"{mid}_c{j}", f"SELECT store, id, count(*) AS freq FROM {occ[j]} a "
                                                    f"WHERE {conds} GROUP BY store, id"))
                        freq_rows.append(f"SELECT {qid} AS qid, '{mid}_{j}' AS pid, store, id, freq FROM {mid}_c{j}")
                        nhit_rows.append(f"SELECT {qid} AS qid, '{mid}_{j}' AS pid, store, count(DISTINCT id) AS n_hit "
                                         f"FROM {occ[j]} GROUP BY store")
                        match_rows.append(f"SELECT {qid} AS qid, '{mid}' AS mid, store, id FROM {mid}_c{j}")
                else:
                    ctes.append((f"{mid}_o", _phrase_occ(m, mid)))
                    ctes.append((f"{mid}_f", f"SELECT store, id, count(*) AS freq FROM {mid}_o GROUP BY store, id"))
                    freq_rows.append(f"SELECT {qid} AS qid, '{mid}' AS pid, store, id, freq FROM {mid}_f")
                    nhit_rows.append(f"SELECT {qid} AS qid, '{mid}' AS pid, store, count(*) AS n_hit "
                                     f"FROM {mid}_f GROUP BY store")
                    match_rows.append(f"SELECT {qid} AS qid, '{mid}' AS mid, store, id FROM {mid}_f")
            conds = [f"list_contains(matched, '{ids[m]}')" for m in clause.must]
            conds += ["NOT (" + " AND ".join(f"list_contains(matched, '{ids[m]}')" for m in g) + ")" for g in clause.must_not]
            clause_sql.setdefault(qid, []).append("(" + " AND ".join(conds or ["false"]) + ")")
    ctes.append((f"{name}_freq", " UNION ALL ".join(freq_rows)))
    ctes.append((f"{name}_nhit", " UNION ALL ".join(nhit_rows)))
    ctes.append((f"{name}_match", f"SELECT qid, store, id, list(DISTINCT mid) AS matched FROM "
                                  f"({' UNION ALL '.join(match_rows)}) GROUP BY ALL"))
    ctes.append((f"{name}_score", f"""
SELECT f.qid, f.store, f.id,
       -sum(CASE WHEN ln((s.n_docs - h.n_hit + 0.5) / (h.n_hit + 0.5)) <= 0 THEN 1e-6
                 ELSE ln((s.n_docs - h.n_hit + 0.5) / (h.n_hit + 0.5)) END
            * f.freq * 2.2 / (f.freq + 1.2 * (0.25 + 0.75 * dl.dl / s.avgdl))) AS rank
FROM {name}_freq f JOIN {name}_nhit h USING (qid, pid, store)
JOIN stats s ON s.store = f.store JOIN dl ON dl.store = f.store AND dl.id = f.id
GROUP BY f.qid, f.store, f.id"""))
    ok = " OR ".join(f"(m.qid = {qid} AND ({' OR '.join(cs)}))" for qid, cs in clause_sql.items())
    ctes.append((name, f"SELECT sc.qid, sc.store, sc.id, sc.rank FROM {name}_score sc "
                       f"JOIN {name}_match m ON m.qid = sc.qid AND m.store = sc.store AND m.id = sc.id "
                       f"WHERE {ok}"))
    return ctes


ASCII_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def like_any_cols(q: str) -> str:
    pat = _q("%" + q + "%")
    return " OR ".join(f"coalesce({ASCII_LOWER.format(x=c)} LIKE {ASCII_LOWER.format(x=pat)}, false)"
                       for c in ("name", "content", "tags"))


def source_cond(sources: list[str]) -> str:
    return "(" + " OR ".join(
        f"(starts_with({ASCII_LOWER.format(x='name')}, {ASCII_LOWER.format(x=_q('observed/' + s + '/'))}) "
        f"OR name = {_q('observed/' + s)})" for s in sources) + ")"
