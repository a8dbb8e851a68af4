"""The SQL that the registered queries are held against, composed of common table expressions."""

DOCS = "docs AS (SELECT doc_id AS doc_idx, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'), lambda w: lower(w)) AS tokens FROM documents)"
ITEMS = "items AS (SELECT item_id AS query_idx, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'), lambda w: lower(w)) AS tokens FROM benchmark)"
USERS = "docs AS (SELECT user_id AS doc_idx, list(event_type ORDER BY ts, event_id) AS tokens FROM events GROUP BY user_id)"
SLICES = "items AS (SELECT doc_idx AS query_idx, tokens[11:15] AS tokens FROM docs WHERE doc_idx % 15 = 0)"
BASKETS = "docs AS (SELECT l_orderkey AS doc_idx, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS tokens FROM lineitem GROUP BY l_orderkey)"
CODED = """types AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events)),
docs AS (SELECT user_id AS doc_idx, list(code ORDER BY ts, event_id) AS tokens FROM events JOIN types USING (event_type) GROUP BY user_id)"""


def tok(source: str = "docs", id_col: str = "doc_idx", name: str = "tok") -> str:
    """One row per token: id, t, pos, len."""
    return f"{name} AS MATERIALIZED (SELECT {id_col}, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS pos, len(tokens) AS len FROM {source})"


def gram(n: int, source: str = "tok", id_col: str = "doc_idx", name: str = "gram") -> str:
    """One row per n-gram: id, gram (joined by blanks), len."""
    parts = " || ' ' || ".join(f"lead(CAST(t AS VARCHAR), {i}) OVER w" if i else "CAST(t AS VARCHAR)" for i in range(n))
    return f"{name} AS (SELECT * FROM (SELECT {id_col}, {parts} AS gram, len FROM {source} WINDOW w AS (PARTITION BY {id_col} ORDER BY pos)) WHERE gram IS NOT NULL)"


def idf(grams: str = "gram", name: str = "idf", form: str = "(1 + df)", where: str = "") -> str:
    return f"{name} AS (SELECT gram, df, ln((SELECT count(*) FROM docs) / CAST({form} AS DOUBLE)) AS idf FROM (SELECT gram, count(DISTINCT doc_idx) AS df FROM {grams} {where} GROUP BY gram))"


def weights(grams: str, idfs: str, n: int, id_col: str, name: str, scale: str = "1.0") -> str:
    return f"{name} AS (SELECT {id_col}, gram, cnt / CAST(len - {n - 1} AS DOUBLE) * idf * {scale} AS w FROM (SELECT {id_col}, gram, max(len) AS len, count(*) AS cnt FROM {grams} GROUP BY {id_col}, gram) JOIN {idfs} USING (gram))"


def normal(raw: str, id_col: str, name: str) -> str:
    return f"{name} AS (SELECT {id_col}, gram, w / CASE WHEN norm = 0 THEN 1 ELSE norm END AS w FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY {id_col})) AS norm FROM {raw}))"


PMI = """bi AS MATERIALIZED (SELECT doc_idx, t AS a, lead(t) OVER (PARTITION BY doc_idx ORDER BY pos) AS b FROM tok),
pairs AS MATERIALIZED (SELECT a, b, count(*) AS cnt FROM bi WHERE b IS NOT NULL GROUP BY a, b),
single AS MATERIALIZED (SELECT t, count(*) AS c FROM tok GROUP BY t),
totals AS MATERIALIZED (SELECT (SELECT CAST(sum(cnt) AS DOUBLE) FROM pairs) AS n_bi, (SELECT CAST(sum(c) AS DOUBLE) FROM single) AS n_tok),
pmi AS (
  SELECT a, b, cnt, ln((cnt / n_bi) / ((x.c / n_tok) * (y.c / n_tok))) AS pmi
  FROM pairs JOIN single x ON x.t = a JOIN single y ON y.t = b CROSS JOIN totals WHERE cnt >= 2
)"""

#: Similarities of queries and documents from normalised weights ``dw`` and ``qw``.
SIMS = "sims AS (SELECT query_idx, doc_idx, round(sum(q.w * d.w), 9) AS sim FROM qw q JOIN dw d USING (gram) WHERE q.w <> 0 AND d.w <> 0 GROUP BY query_idx, doc_idx)"
EVERY = "pairs_all AS (SELECT query_idx, doc_idx, coalesce(sim, 0) AS sim FROM (SELECT query_idx, doc_idx FROM items CROSS JOIN docs) LEFT JOIN sims USING (query_idx, doc_idx))"
BY_SIM = "by_sim AS (SELECT *, row_number() OVER (PARTITION BY query_idx ORDER BY sim DESC, doc_idx) AS rank FROM pairs_all)"


def unigram(docs: str = DOCS, items: str = ITEMS) -> str:
    """CTEs up to ``sims`` with single tokens."""
    return ",\n".join([
        docs, items, tok(), tok("items", "query_idx", "qtok"), gram(1), gram(1, "qtok", "query_idx", "qgram"), idf(),
        weights("gram", "idf", 1, "doc_idx", "draw"), weights("qgram", "idf", 1, "query_idx", "qraw"), normal("draw", "doc_idx", "dw"), normal("qraw", "query_idx", "qw"), SIMS,
    ])


def paired(docs: str = DOCS, items: str = ITEMS, tau: float = 0.5, alpha: float = 1.0) -> str:
    """CTEs up to ``sims`` with single tokens and selected pairs."""
    return ",\n".join([
        docs, items, tok(), tok("items", "query_idx", "qtok"), PMI,
        gram(1), gram(2, name="gram2"), gram(1, "qtok", "query_idx", "qgram"), gram(2, "qtok", "query_idx", "qgram2"),
        f"chosen AS (SELECT CAST(a AS VARCHAR) || ' ' || CAST(b AS VARCHAR) AS gram FROM pmi WHERE pmi > {tau})",
        idf(), idf("gram2", "idf2", where="WHERE gram IN (SELECT gram FROM chosen)"),
        weights("gram", "idf", 1, "doc_idx", "d1"), weights("gram2", "idf2", 2, "doc_idx", "d2", str(float(alpha))),
        weights("qgram", "idf", 1, "query_idx", "q1"), weights("qgram2", "idf2", 2, "query_idx", "q2", str(float(alpha))),
        "draw AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2)", "qraw AS (SELECT * FROM q1 UNION ALL SELECT * FROM q2)",
        normal("draw", "doc_idx", "dw"), normal("qraw", "query_idx", "qw"), SIMS,
    ])


def local_alignment(cand: str = "cand") -> str:
    """Recursive CTE over query positions: the best cell ``best`` of each pair of ``cand``; needs tok and qtok."""
    return f"""h(query_idx, doc_idx, i, j, v) AS (
  SELECT c.query_idx, c.doc_idx, 0, d.pos, CAST(0 AS DOUBLE) FROM {cand} c JOIN tok d USING (doc_idx)
  UNION ALL
  SELECT query_idx, doc_idx, i, j, max(s + 2 * j) OVER (PARTITION BY query_idx, doc_idx ORDER BY j ROWS UNBOUNDED PRECEDING) - 2 * j
  FROM (
    SELECT h.query_idx, h.doc_idx, h.i + 1 AS i, h.j,
      greatest(0, h.v - 2, coalesce(lag(h.v) OVER (PARTITION BY h.query_idx, h.doc_idx ORDER BY h.j), 0) + CASE WHEN q.t = d.t THEN 2 ELSE -1 END) AS s
    FROM h JOIN qtok q ON q.query_idx = h.query_idx AND q.pos = h.i + 1 JOIN tok d ON d.doc_idx = h.doc_idx AND d.pos = h.j
  )
),
best AS (SELECT query_idx, doc_idx, max(v) AS best FROM h GROUP BY query_idx, doc_idx)"""


def warping(cand: str = "cand") -> str:
    """Recursive CTE over query positions: the warping cost ``cost`` of each pair of ``cand``; needs tok and qtok."""
    return f"""g(query_idx, doc_idx, i, j, v) AS (
  SELECT c.query_idx, c.doc_idx, 1, d.pos, CAST(sum(CASE WHEN q.t = d.t THEN 0 ELSE 1 END) OVER (PARTITION BY c.query_idx, c.doc_idx ORDER BY d.pos ROWS UNBOUNDED PRECEDING) AS DOUBLE)
  FROM {cand} c JOIN tok d USING (doc_idx) JOIN qtok q ON q.query_idx = c.query_idx AND q.pos = 1
  UNION ALL
  SELECT query_idx, doc_idx, i, j, s + min(o - (s - c)) OVER (PARTITION BY query_idx, doc_idx ORDER BY j ROWS UNBOUNDED PRECEDING)
  FROM (
    SELECT query_idx, doc_idx, i, j, c, CAST(sum(c) OVER (PARTITION BY query_idx, doc_idx ORDER BY j ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS s, o
    FROM (
      SELECT g.query_idx, g.doc_idx, g.i + 1 AS i, g.j, CASE WHEN q.t = d.t THEN 0 ELSE 1 END AS c,
        least(g.v, coalesce(lag(g.v) OVER (PARTITION BY g.query_idx, g.doc_idx ORDER BY g.j), g.v)) AS o
      FROM g JOIN qtok q ON q.query_idx = g.query_idx AND q.pos = g.i + 1 JOIN tok d ON d.doc_idx = g.doc_idx AND d.pos = g.j
    )
  )
),
costs AS (
  SELECT query_idx, doc_idx, v AS cost FROM g
  JOIN (SELECT query_idx, len(tokens) AS m FROM items) USING (query_idx) JOIN (SELECT doc_idx, len(tokens) AS n FROM docs) USING (doc_idx)
  WHERE i = m AND j = n
)"""


TRUTH = "truth AS (SELECT item_id AS query_idx, doc_id AS doc_idx FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def metrics(ranking: str, truth: str = "truth", queries: str = "SELECT query_idx FROM items", named: str = "") -> str:
    """Final SELECT of the metrics of a ranking. ``named``: SQL of (query_idx, n_rel), else counted from the truth."""
    n_rel = named or f"SELECT query_idx, count(DISTINCT doc_idx) AS n_rel FROM {truth} GROUP BY query_idx"
    return f"""hits AS (SELECT r.query_idx, rank, row_number() OVER (PARTITION BY r.query_idx ORDER BY rank) AS hit FROM {ranking} r JOIN (SELECT DISTINCT query_idx, doc_idx FROM {truth}) USING (query_idx, doc_idx)),
sums AS (SELECT query_idx, sum(hit / CAST(rank AS DOUBLE)) AS s, min(rank) AS f, count(*) FILTER (rank <= 1) AS c1, count(*) FILTER (rank <= 5) AS c5, count(*) FILTER (rank <= 10) AS c10 FROM hits GROUP BY query_idx),
each AS (SELECT coalesce(s / n_rel, 0) AS ap, coalesce(1 / CAST(f AS DOUBLE), 0) AS rr, coalesce(c1 / 1.0, 0) AS p1, coalesce(c5 / 5.0, 0) AS p5, coalesce(c10 / 10.0, 0) AS p10
  FROM ({queries}) LEFT JOIN ({n_rel}) USING (query_idx) LEFT JOIN sums USING (query_idx)),
scores AS (SELECT round(coalesce(avg(ap), 0), 6) AS map, round(coalesce(avg(rr), 0), 6) AS mrr, round(coalesce(avg(CAST(p1 AS DOUBLE)), 0), 6) AS p_at_1, round(coalesce(avg(CAST(p5 AS DOUBLE)), 0), 6) AS p_at_5, round(coalesce(avg(CAST(p10 AS DOUBLE)), 0), 6) AS p_at_10 FROM each)"""
