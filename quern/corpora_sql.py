"""SQL (DuckDB) for the views of :mod:`quern.corpora` and for the shared expressions."""

from __future__ import annotations


def norm(x: str) -> str:
    return rf"trim(regexp_replace(strip_accents(lower({x})), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g'))"


def toks(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda t: t <> '')"


def grams(tokens: str) -> str:
    return (
        f"list_sort(list_distinct(flatten(list_transform({tokens}, lambda t: list_transform(range(1, greatest(1, length(t) - 2) + 1), "
        "lambda i: substring(t, i, least(3, length(t))))))))"
    )


def one_line(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\t\n\f\r ]+', ' ', 'g'))"


def shorten(x: str, most: int) -> str:
    return f"CASE WHEN length({x}) > {most} THEN substring({x}, 1, {most - 1}) || '…' ELSE {x} END"


def title(x: str) -> str:
    line = one_line(rf"split_part(regexp_replace({x}, '^[\t\n\f\r ]+', ''), chr(10), 1)")
    return f"CASE WHEN coalesce({line}, '') = '' THEN 'Untitled session' ELSE {shorten(line, 100)} END"


def windows(x: str) -> str:
    """List of the word windows of a text."""
    trimmed = rf"regexp_replace({x}, '^[\t\n\f\r ]+|[\t\n\f\r ]+$', '', 'g')"
    w = rf"regexp_extract_all({trimmed}, '[^\t\n\f\r ]+[\t\n\f\r ]*')"
    piece = rf"regexp_replace(array_to_string(list_slice({w}, p * 210 + 1, p * 210 + 250), ''), '[\t\n\f\r ]+$', '')"
    return (
        f"CASE WHEN coalesce({trimmed}, '') = '' THEN [] WHEN len({w}) <= 250 THEN [{trimmed}] "
        f"ELSE list_transform(range(0, ceil((len({w}) - 250) / 210.0)::BIGINT + 1), lambda p: {piece}) END"
    )


ENTRIES = """
entries AS (
  SELECT 'e' || conv_id || '-' || turn AS entry_key, 's' || conv_id AS session_key, conv_id, turn, role, coalesce(text, '') AS text
  FROM conversations WHERE role IN ('user', 'assistant'))"""

SESSIONS = f"""{ENTRIES},
sessions AS (
  SELECT session_key, 'conv-' || conv_id AS native_id, ['pi', 'codex', 'opencode', 'claude'][conv_id % 4 + 1] AS harness,
    '/work/p' || (conv_id % 5) AS cwd, {title("first_user")} AS name, 'topic' || (conv_id % 3) AS git_branch,
    conv_id * 1000 + first_turn AS started_at, conv_id * 1000 + last_turn AS updated_at
  FROM (SELECT conv_id, session_key, arg_min(text, turn) FILTER (WHERE role = 'user') AS first_user, min(turn) AS first_turn, max(turn) AS last_turn
        FROM entries GROUP BY conv_id, session_key))"""

SESSION_ROWS = f"""{SESSIONS},
parts AS (
  SELECT entry_key, session_key, conv_id, turn, role, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS part
  FROM (SELECT *, {windows("text")} AS ws FROM entries)),
rows_ AS (
  SELECT p.entry_key || '-' || p.part AS row_id, p.session_key AS group_key, p.session_key, p.entry_key, p.part, p.role, p.text,
    {toks("p.text")} AS t_content, e.embedding, s.native_id, s.harness, s.cwd, s.updated_at,
    {toks("s.name")} AS t_name, {toks("s.cwd")} AS t_cwd, {toks("s.native_id")} AS t_native, {toks("s.git_branch")} AS t_branch
  FROM parts p JOIN sessions s USING (session_key)
  LEFT JOIN embeddings e ON p.part = 0 AND e.vec_id = p.conv_id * 8 + p.turn),
search_rows AS (SELECT *, {grams("t_content")} AS grams FROM rows_)"""

MEMORIES = """
memories AS (
  SELECT doc_id, 'm_' || lpad(doc_id::VARCHAR, 8, '0') AS id, coalesce(text, '') AS text,
    CASE WHEN doc_id % 5 = 0 THEN 'global' ELSE 'project' END AS scope,
    CASE WHEN doc_id % 5 = 0 THEN '' ELSE coalesce(source, '') END AS project_key, coalesce(source, '') AS source,
    CASE WHEN doc_id % 7 = 0 THEN doc_id END AS archived_at, doc_id AS updated_at, e.embedding
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""

MEMORY_ROWS = f"""{MEMORIES},
rows_ AS (
  SELECT id AS row_id, id AS group_key, *, {toks("text")} AS t_content, {toks("source")} AS t_source, {toks("project_key")} AS t_project, {toks("id")} AS t_id FROM memories),
search_rows AS (SELECT *, {grams("t_content")} AS grams FROM rows_)"""

SESSION_WEIGHTS = {"t_content": 1.0, "t_name": 3.0, "t_cwd": 0.5, "t_native": 4.0, "t_branch": 1.0}
MEMORY_WEIGHTS = {"t_content": 1.0, "t_source": 0.5, "t_project": 0.5, "t_id": 3.0}


def words_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def bm25(query: list[str], weights: dict[str, float], out: str = "scores", rows: str = "search_rows") -> str:
    """CTEs ending in ``out`` (row_id, raw, plain): weighted and unweighted scores."""
    times = {t: query.count(t) for t in dict.fromkeys(query)}
    values = ", ".join(f"('{t}', {n})" for t, n in times.items())
    f = " + ".join(f"{w} * len(list_filter({c}, lambda x: x = term))" for c, w in weights.items())
    f1 = " + ".join(f"len(list_filter({c}, lambda x: x = term))" for c in weights)
    dl = " + ".join(f"len({c})" for c in weights)
    return f"""
q(term, times) AS (VALUES {values}),
sizes AS (SELECT count(*)::DOUBLE AS n_docs, avg({dl}) AS avg_len FROM {rows}),
tf AS (SELECT row_id, term, times, ({dl})::DOUBLE AS dl, ({f})::DOUBLE AS f, ({f1})::DOUBLE AS f1 FROM {rows}, q),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf WHERE f1 > 0 GROUP BY term),
idf AS (SELECT term, df, CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END AS idf FROM df, sizes),
{out} AS (
  SELECT row_id, -sum(times * idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avg_len))) AS raw,
    -sum(times * idf * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / avg_len))) AS plain
  FROM tf JOIN idf USING (term), sizes WHERE f1 > 0 GROUP BY row_id)"""


def coverage(query: list[str], columns: tuple[str, ...]) -> str:
    return f"len(list_intersect({words_list(list(dict.fromkeys(query)))}, flatten([{', '.join(columns)}])))"


def lexical(query: list[str], weights: dict[str, float], cover: tuple[str, ...], where: str, order: str, gate: bool) -> str:
    """CTEs ending in ``lexical`` (row_id, group_key, text, raw, updated_at, pos)."""
    n = len(set(query))
    least = 1 if n < 3 else -(-n // 3)
    gated = f"WHERE best * 2 >= {n}" if gate and n >= 3 else ""
    return f"""{bm25(query, weights)},
lex_top AS (
  SELECT r.*, round({order}, 9) AS by_, s.raw AS raw, {coverage(query, cover)} AS coverage
  FROM search_rows r JOIN scores s USING (row_id) WHERE {where} ORDER BY by_, r.updated_at DESC, row_id LIMIT 100),
lex_cov AS (SELECT *, max(coverage) OVER () AS best FROM lex_top WHERE coverage >= {least}),
lexical AS (SELECT row_id, group_key, text, raw, updated_at, row_number() OVER (ORDER BY by_, updated_at DESC, row_id) AS pos FROM lex_cov {gated})"""


def fuzzy(query_grams: list[str], where: str) -> str:
    n = len(query_grams)
    return f"""
g_sizes AS (SELECT count(*)::DOUBLE AS n_docs, avg(len(grams)) AS avg_len FROM search_rows),
g_hits AS (SELECT row_id, len(grams)::DOUBLE AS dl, unnest(list_intersect(grams, {words_list(query_grams)})) AS gram FROM search_rows),
g_df AS (SELECT gram, count(*)::DOUBLE AS df FROM g_hits GROUP BY gram),
g_idf AS (SELECT gram, CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END AS idf FROM g_df, g_sizes),
g_scores AS (
  SELECT row_id, -sum(idf) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * any_value(dl) / any_value(avg_len))) AS g_score, count(*) AS n_shared
  FROM g_hits JOIN g_idf USING (gram), g_sizes GROUP BY row_id),
fuz_pre AS (
  SELECT r.*, round(g_score, 9) AS by_, n_shared, n_shared / {float(n)} AS raw FROM search_rows r JOIN g_scores USING (row_id)
  WHERE {where} ORDER BY by_, updated_at DESC, row_id LIMIT 200),
fuzzy AS (
  SELECT row_id, group_key, text, raw, updated_at, row_number() OVER (ORDER BY raw DESC, updated_at DESC, by_, row_id) AS pos
  FROM (SELECT * FROM fuz_pre WHERE raw >= 0.25 ORDER BY raw DESC, updated_at DESC, by_, row_id LIMIT 100))"""


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] * z[2])::DOUBLE))"


def semantic(where: str, threshold: float) -> str:
    return f"""
sem_all AS (
  SELECT r.*, round({dot("r.embedding", "v.embedding")}, 9) AS raw FROM search_rows r, (SELECT embedding FROM embeddings WHERE vec_id = 0) v
  WHERE r.embedding IS NOT NULL AND {where}),
semantic AS (
  SELECT row_id, group_key, text, raw, updated_at, row_number() OVER (ORDER BY raw DESC, row_id) AS pos
  FROM (SELECT * FROM sem_all WHERE raw >= {threshold} ORDER BY raw DESC, row_id LIMIT 100))"""


def exact(table: str, key: str, id_col: str, query: str, where: str, text: str) -> str:
    return f"""
exact AS (
  SELECT {key} AS row_id, {key} AS group_key, {text} AS text, 1.0 AS raw, updated_at, row_number() OVER (ORDER BY updated_at DESC, {key}) AS pos
  FROM (SELECT * FROM {table} WHERE {id_col} = '{query}' AND {where} ORDER BY updated_at DESC, {key} LIMIT 100))"""


def fused(dedupe: bool, limit: int) -> str:
    first = "QUALIFY row_number() OVER (PARTITION BY channel, group_key ORDER BY pos) = 1" if dedupe else ""
    return f"""
bag AS (
  SELECT 'exact' AS channel, 0 AS ord, 4.0 AS weight, * FROM exact UNION ALL SELECT 'lexical', 1, 1.0, * FROM lexical
  UNION ALL SELECT 'fuzzy', 2, 1.0, * FROM fuzzy UNION ALL SELECT 'semantic', 3, 1.0, * FROM semantic),
firsts AS (SELECT * FROM bag {first}),
ranks AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY pos) AS rank_ FROM firsts),
contrib AS (SELECT *, weight / (60 + rank_) AS c FROM ranks),
best AS (SELECT group_key, row_id, text FROM contrib QUALIFY row_number() OVER (PARTITION BY group_key ORDER BY (text = ''), c DESC, ord) = 1),
sums AS (
  SELECT group_key, round(sum(c), 12) AS score, max(updated_at) AS updated_at, min(rank_) FILTER (WHERE channel = 'exact') AS exact_rank,
    min(rank_) FILTER (WHERE channel = 'lexical') AS lexical_rank, min(rank_) FILTER (WHERE channel = 'fuzzy') AS fuzzy_rank,
    min(rank_) FILTER (WHERE channel = 'semantic') AS semantic_rank, arg_min(raw, rank_) FILTER (WHERE channel = 'semantic') AS similarity
  FROM contrib GROUP BY group_key),
fused AS (
  SELECT row_number() OVER (ORDER BY score DESC, updated_at DESC, group_key) AS rank, s.*, b.row_id, b.text
  FROM sums s JOIN best b USING (group_key) ORDER BY score DESC, updated_at DESC, group_key LIMIT {limit})"""


def many(queries: str, weights: dict[str, float], cover: tuple[str, ...], groups: str, group_key: str, id_col: str, bare: bool, where: str, group_where: str, order: str, gate: bool, dedupe: bool, threshold: float, limit: int) -> str:
    """CTEs ending in ``fused`` for a table of queries (query, text, vector), over ``search_rows``."""
    occurrences = " UNION ALL ".join(f"SELECT row_id, unnest({c}) AS term, {w}::DOUBLE AS w FROM search_rows" for c, w in weights.items())
    dl = " + ".join(f"len({c})" for c in weights)
    gated = "WHERE n < 3 OR best * 2 >= n" if gate else ""
    first = "QUALIFY row_number() OVER (PARTITION BY query, channel, group_key ORDER BY pos) = 1" if dedupe else ""
    bm = "sum(times * idf * {f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * dl / avg_len)))"
    idf = "CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END"
    return f"""
asked AS (SELECT query, trim(text) AS text, {toks("trim(text)")} AS tokens, {grams(toks("trim(text)"))} AS grams, vector FROM ({queries}) WHERE trim(text) <> ''),
keyed AS (SELECT row_id, updated_at FROM search_rows WHERE {where}),
q_words AS (SELECT query, term, count(*) AS times FROM (SELECT query, unnest(tokens) AS term FROM asked) GROUP BY query, term),
sizes AS (SELECT count(*)::DOUBLE AS n_docs, avg({dl}) AS avg_len, avg(len(grams)) AS avg_grams FROM search_rows),
lens AS (SELECT row_id, ({dl})::DOUBLE AS dl, len(grams)::DOUBLE AS gl FROM search_rows),
tf AS (SELECT row_id, term, sum(w) AS f, count(*)::DOUBLE AS f1 FROM ({occurrences}) WHERE term IN (SELECT term FROM q_words) GROUP BY row_id, term),
word_idf AS (SELECT term, {idf} AS idf FROM (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term), sizes),
bm AS (
  SELECT query, row_id, -{bm.format(f="f")} AS raw, -{bm.format(f="f1")} AS plain
  FROM tf JOIN word_idf USING (term) JOIN q_words USING (term) JOIN lens USING (row_id), sizes GROUP BY query, row_id),
lex_top AS (
  SELECT b.query, b.row_id, b.raw, round(b.{order}, 9) AS by_, k.updated_at FROM bm b JOIN keyed k USING (row_id)
  QUALIFY row_number() OVER (PARTITION BY b.query ORDER BY round(b.{order}, 9), k.updated_at DESC, b.row_id) <= 100),
lex_cov AS (
  SELECT t.*, len(list_distinct(a.tokens)) AS n, len(list_intersect(list_distinct(a.tokens), flatten([{", ".join(f"r.{c}" for c in cover)}]))) AS coverage
  FROM lex_top t JOIN asked a USING (query) JOIN search_rows r USING (row_id)),
lex_best AS (SELECT *, max(coverage) OVER (PARTITION BY query) AS best FROM lex_cov WHERE coverage >= CASE WHEN n < 3 THEN 1 ELSE ceil(n / 3.0) END),
lexical AS (SELECT query, row_id, raw, row_number() OVER (PARTITION BY query ORDER BY by_, updated_at DESC, row_id) AS pos FROM lex_best {gated}),
q_grams AS (SELECT query, unnest(grams) AS gram, len(grams)::DOUBLE AS n FROM asked),
g_hits AS (SELECT row_id, gram FROM (SELECT row_id, unnest(grams) AS gram FROM search_rows) WHERE gram IN (SELECT gram FROM q_grams)),
gram_idf AS (SELECT gram, {idf} AS idf FROM (SELECT gram, count(*)::DOUBLE AS df FROM g_hits GROUP BY gram), sizes),
g_scores AS (
  SELECT query, row_id, -sum(idf) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * any_value(gl) / any_value(avg_grams))) AS g_score, count(*) / any_value(n) AS raw
  FROM g_hits JOIN q_grams USING (gram) JOIN gram_idf USING (gram) JOIN lens USING (row_id), sizes GROUP BY query, row_id),
fuz_pre AS (
  SELECT g.query, g.row_id, g.raw, round(g_score, 9) AS by_, k.updated_at FROM g_scores g JOIN keyed k USING (row_id)
  QUALIFY row_number() OVER (PARTITION BY g.query ORDER BY round(g_score, 9), k.updated_at DESC, g.row_id) <= 200),
fuzzy AS (
  SELECT query, row_id, raw, row_number() OVER (PARTITION BY query ORDER BY raw DESC, updated_at DESC, by_, row_id) AS pos
  FROM fuz_pre WHERE raw >= 0.25 QUALIFY pos <= 100),
sem_all AS (
  SELECT a.query, r.row_id, round({dot("r.embedding", "a.vector")}, 9) AS raw FROM search_rows r, asked a
  WHERE r.embedding IS NOT NULL AND a.vector IS NOT NULL AND {where}),
semantic AS (SELECT query, row_id, raw, row_number() OVER (PARTITION BY query ORDER BY raw DESC, row_id) AS pos FROM sem_all WHERE raw >= {threshold} QUALIFY pos <= 100),
exact AS (
  SELECT a.query, g.{group_key} AS row_id, 1.0 AS raw, row_number() OVER (PARTITION BY a.query ORDER BY g.updated_at DESC, g.{group_key}) AS pos,
    g.{group_key} AS group_key, {"''" if bare else "g.text"} AS text, g.updated_at
  FROM {groups} g JOIN asked a ON g.{id_col} = a.text WHERE {group_where} QUALIFY pos <= 100),
bag AS (
  SELECT query, 'exact' AS channel, 0 AS ord, 4.0 AS weight, row_id, raw, pos, group_key, text, updated_at FROM exact
  UNION ALL SELECT c.query, c.channel, c.ord, 1.0, c.row_id, c.raw, c.pos, r.group_key, r.text, r.updated_at
  FROM (SELECT 'lexical' AS channel, 1 AS ord, * FROM lexical UNION ALL SELECT 'fuzzy', 2, * FROM fuzzy UNION ALL SELECT 'semantic', 3, * FROM semantic) c
  JOIN search_rows r USING (row_id)),
firsts AS (SELECT * FROM bag {first}),
ranks AS (SELECT *, row_number() OVER (PARTITION BY query, channel ORDER BY pos) AS rank_ FROM firsts),
contrib AS (SELECT *, weight / (60 + rank_) AS c FROM ranks),
best AS (SELECT query, group_key, row_id, text FROM contrib QUALIFY row_number() OVER (PARTITION BY query, group_key ORDER BY (text = ''), c DESC, ord) = 1),
sums AS (
  SELECT query, group_key, round(sum(c), 12) AS score, max(updated_at) AS updated_at, min(rank_) FILTER (WHERE channel = 'exact') AS exact_rank,
    min(rank_) FILTER (WHERE channel = 'lexical') AS lexical_rank, min(rank_) FILTER (WHERE channel = 'fuzzy') AS fuzzy_rank,
    min(rank_) FILTER (WHERE channel = 'semantic') AS semantic_rank, arg_min(raw, rank_) FILTER (WHERE channel = 'semantic') AS similarity
  FROM contrib GROUP BY query, group_key),
fused AS (
  SELECT row_number() OVER (PARTITION BY s.query ORDER BY score DESC, updated_at DESC, s.group_key) AS rank, s.*, b.row_id, b.text
  FROM sums s JOIN best b ON b.query = s.query AND b.group_key = s.group_key QUALIFY rank <= {limit})"""
