"""The registered queries of the search engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import corpora
from . import corpora_sql as S
from .functions import identity, vectors
from .functions import text as T
from .operators import blocks, bm25, cells, channels, chunking, filters, maintenance, segments
from .operators.lineage import cut, spread
from .plans import batch, search

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LEXICAL = "Ofblethti THWHST the onhaha the"
TYPOS = "ofbleti thwhsst onhahha"
MEMORY_QUERY = "erleaux the thtion the mentoi"
THRESHOLD = 0.1
BIG = "cast({} as bigint)"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rows_of(name: str):
    return lambda spark, d: corpora.read(spark, d, name)


def long(c: Column) -> Column:
    return c.cast("bigint")


def query_vector(spark: SparkSession, d: str) -> search.QueryVector:
    """The vector with the number 0 as query vector."""
    v = corpora.read(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return search.QueryVector(list(v[0]) if v else [], corpora.FINGERPRINT, THRESHOLD)


# --- scalar functions ---------------------------------------------------------------


@query(f"SELECT conv_id, turn, {S.norm('text')} AS normalized FROM conversations")
def normalize_text(spark, d):
    return corpora.read(spark, d, "conversations").select("conv_id", "turn", T.normalize(F.col("text")).alias("normalized"))


@query(f"SELECT item_id, array_to_string({S.toks('text')}, '|') AS tokens, len({S.toks('text')})::BIGINT AS n FROM benchmark")
def token_set(spark, d):
    t = T.tokens(T.normalize(F.col("text")))
    return corpora.read(spark, d, "benchmark").select("item_id", F.array_join(t, "|").alias("tokens"), long(F.size(t)).alias("n"))


@query(f"SELECT item_id, array_to_string({S.grams(S.toks('text'))}, ' ') AS grams FROM benchmark")
def gram_set(spark, d):
    return corpora.read(spark, d, "benchmark").select("item_id", T.grams_text(T.gram_set(F.col("text"))).alias("grams"))


@query(
    f"""WITH q AS (SELECT {S.words_list(T.query_grams(TYPOS))} AS q)
SELECT conv_id, turn, round(len(list_intersect(q, g)) / len(q)::DOUBLE, 9) AS similarity
FROM (SELECT conv_id, turn, {S.grams(S.toks('text'))} AS g FROM conversations), q"""
)
def gram_similarity(spark, d):
    q = F.array(*[F.lit(g) for g in T.query_grams(TYPOS)])
    return corpora.read(spark, d, "conversations").select("conv_id", "turn", F.round(T.similarity(q, T.gram_set(F.col("text"))), 9).alias("similarity"))


@query(f"SELECT conv_id, turn, {S.shorten(S.one_line('text'), 320)} AS excerpt FROM conversations")
def excerpt(spark, d):
    return corpora.read(spark, d, "conversations").select("conv_id", "turn", T.excerpt(F.col("text")).alias("excerpt"))


@query(f"SELECT doc_id, {S.title('text')} AS title FROM documents")
def first_line_title(spark, d):
    return corpora.read(spark, d, "documents").select("doc_id", T.first_line_title(F.col("text")).alias("title"))


@query(f"SELECT doc_id, {S.one_line('text')} AS line FROM documents")
def one_line(spark, d):
    return corpora.read(spark, d, "documents").select("doc_id", T.one_line(F.col("text")).alias("line"))


QUOTE = "chr(39) || replace({}, chr(39), chr(39) || chr(34) || chr(39) || chr(34) || chr(39)) || chr(39)"
RESUME_SQL = (
    f"'cd ' || {QUOTE.format('cwd')} || ' && ' || CASE harness WHEN 'pi' THEN 'pi --session ' WHEN 'codex' THEN 'codex resume ' "
    f"WHEN 'claude' THEN 'claude --resume ' ELSE 'opencode --session ' END || {QUOTE.format('native_id')}"
)


@query(f"WITH {S.SESSIONS} SELECT native_id, {RESUME_SQL} AS resume FROM sessions")
def resume_hint(spark, d):
    return corpora.sessions(spark, d).select("native_id", T.resume_hint(F.col("harness"), F.col("native_id"), F.col("cwd")).alias("resume"))


@query(f"SELECT doc_id, {QUOTE.format('replace(text, chr(32), chr(39))')} AS quoted FROM documents")
def shell_quote(spark, d):
    return corpora.read(spark, d, "documents").select("doc_id", T.shell_quote(F.replace("text", F.lit(" "), F.lit("'"))).alias("quoted"))


@query(
    r"""SELECT page_id, CASE WHEN host <> '' AND path <> '' THEN host || '/' || path ELSE '' END AS remote,
  CASE WHEN path <> '' THEN host || '/' || path ELSE '' END AS scp_remote
FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host,
  regexp_replace(trim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), '\.git$', '') AS path FROM pages)"""
)
def normalize_remote(spark, d):
    scp = F.concat(F.lit("git@"), F.regexp_extract("url", "^https?://([^/?#:]*)", 1), F.lit(":"), F.regexp_extract("url", "^https?://[^/?#]*/?([^?#]*)", 1))
    return corpora.read(spark, d, "pages").select("page_id", identity.normalize_remote(F.col("url")).alias("remote"), identity.normalize_remote(scp).alias("scp_remote"))


@query(
    """SELECT conv_id, turn, sha256(strlen(role) || ':' || role || strlen(text) || ':' || text) AS key FROM conversations"""
)
def stable_keys(spark, d):
    return corpora.read(spark, d, "conversations").select("conv_id", "turn", identity.stable_key(F.col("role"), F.col("text")).alias("key"))


# --- chunks --------------------------------------------------------------------------

CHUNKS_SQL = f"""parts AS (
  SELECT doc_id, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS part FROM (SELECT doc_id, {S.windows("coalesce(text, '')")} AS ws FROM documents))"""


def document_chunks(spark, d):
    docs = spread(corpora.read(spark, d, "documents").select("doc_id", T.text_or_empty(F.col("text")).alias("text")))
    return docs.select("doc_id", F.posexplode(chunking.windows(F.col("text"))).alias("part", "text"))


@query(f"WITH {CHUNKS_SQL} SELECT doc_id, part::BIGINT AS part, text FROM parts")
def chunk_documents(spark, d):
    return document_chunks(spark, d).select("doc_id", long(F.col("part")).alias("part"), "text")


@query(f"WITH {CHUNKS_SQL} SELECT doc_id, count(*)::BIGINT AS n_chunks, sum(length(text))::BIGINT AS n_chars, max(length(text))::BIGINT AS longest FROM parts GROUP BY doc_id")
def chunk_stats(spark, d):
    c = document_chunks(spark, d).withColumn("n", F.char_length("text"))
    return c.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("n").alias("n_chars"), long(F.max("n")).alias("longest"))


@query(f"WITH {CHUNKS_SQL} SELECT doc_id, part::BIGINT AS part, sha256('d' || doc_id || chr(0) || part) AS chunk_key, sha256(text) AS text_hash FROM parts")
def chunk_keys(spark, d):
    c = document_chunks(spark, d)
    key = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    return c.select("doc_id", long(F.col("part")).alias("part"), identity.chunk_key(key, F.col("part")).alias("chunk_key"), identity.text_hash(F.col("text")).alias("text_hash"))


# --- lexical -------------------------------------------------------------------------

WORDS = T.query_tokens(LEXICAL)
SESSION_WHERE = "true"


@query(f"WITH {S.SESSIONS} SELECT native_id, harness, cwd, updated_at FROM sessions WHERE native_id = 'conv-7' ORDER BY updated_at DESC LIMIT 100")
def exact_lookup(spark, d):
    s = corpora.sessions(spark, d).where(F.col("native_id") == "conv-7")
    return s.orderBy(F.desc("updated_at")).limit(channels.TOP).select("native_id", "harness", "cwd", "updated_at")


@query(f"WITH {S.SESSION_ROWS}, {S.bm25(WORDS, {'t_content': 1.0})} SELECT term, df::BIGINT AS df, n_docs::BIGINT AS n_docs, round(avg_len, 6) AS avg_len, round(idf, 6) AS idf FROM idf, sizes")
def bm25_term_stats(spark, d):
    t = bm25.term_stats(corpora.session_rows(spark, d), ["t_content"], list(dict.fromkeys(WORDS))).where("df > 0")
    return t.select("term", "df", "n_docs", F.round("avg_len", 6).alias("avg_len"), F.round("idf", 6).alias("idf"))


@query(f"WITH {S.SESSION_ROWS}, {S.bm25(WORDS, {'t_content': 1.0})} SELECT row_id, round(raw, 6) AS score FROM scores")
def bm25_single_column(spark, d):
    return bm25.score_scan(corpora.session_rows(spark, d), {"t_content": 1.0}, WORDS).select("row_id", F.round("bm25", 6).alias("score"))


@query(f"WITH {S.SESSION_ROWS}, {S.bm25(WORDS, S.SESSION_WEIGHTS)} SELECT row_id, round(raw, 6) AS score, round(plain, 6) AS plain FROM scores")
def bm25_weighted_columns(spark, d):
    out = bm25.score_scan(corpora.session_rows(spark, d), dict(channels.SESSIONS.weights), WORDS, unweighted="plain")
    return out.select("row_id", F.round("bm25", 6).alias("score"), F.round("plain", 6).alias("plain"))


WEIGHTS = dict(channels.SESSIONS.weights)


def stored_index(rows: DataFrame) -> segments.Index:
    """The inverted index of search rows as it is stored: one segment."""
    return segments.Index([kept(segments.segment(rows, None, WEIGHTS))])


def kept(s: segments.Segment) -> segments.Segment:
    s = s.stored(cut(s.blocks))
    return replace(s, terms=cut(s.terms), gone=cut(s.gone))


def earlier_rows(rows: DataFrame) -> DataFrame:
    """Search rows as they were before a change: a third has another text, a seventh wasn't there, and some more were."""
    n = F.pmod(F.xxhash64("row_id"), F.lit(21))
    other = F.when(n % 3 == 0, F.slice("t_content", 1, 5)).otherwise(F.col("t_content"))
    before = rows.where(n % 7 != 3).withColumn("t_content", other).withColumn("grams", F.when(n % 3 == 0, T.grams_of(other)).otherwise(F.col("grams")))
    return before.unionByName(rows.where(n == 5).withColumn("row_id", F.concat(F.lit("old-"), "row_id")))


@query(SQL["bm25_weighted_columns"].replace(", round(plain, 6) AS plain", ""))
def bm25_postings(spark, d):
    index = stored_index(corpora.session_rows(spark, d))
    return segments.scores(index, segments.WORD, WORDS).select("row_id", F.round("raw", 6).alias("score"))


@query(SQL["bm25_weighted_columns"])
def postings_incremental(spark, d):
    """The scores after a change that is stored as a second segment: those of an index made anew."""
    rows = corpora.session_rows(spark, d)
    before = earlier_rows(rows)
    wanted = ["row_id", *WEIGHTS, "grams"]
    added, removed = (cut(x) for x in segments.difference(before.select(*wanted), rows.select(*wanted), WEIGHTS))
    index = segments.Index([kept(segments.segment(before, None, WEIGHTS, 1)), kept(segments.segment(added, removed, WEIGHTS, 2))])
    return segments.scores(index, segments.WORD, WORDS).select("row_id", F.round("raw", 6).alias("score"), F.round("plain", 6).alias("plain"))


@query(SQL["bm25_weighted_columns"])
def postings_merged(spark, d):
    """The same after both segments are merged."""
    rows = corpora.session_rows(spark, d)
    before = earlier_rows(rows)
    wanted = ["row_id", *WEIGHTS, "grams"]
    added, removed = (cut(x) for x in segments.difference(before.select(*wanted), rows.select(*wanted), WEIGHTS))
    both = segments.Index([kept(segments.segment(before, None, WEIGHTS, 1)), kept(segments.segment(added, removed, WEIGHTS, 2))])
    one = segments.Index([kept(segments.merged(both, 0))])
    return segments.scores(one, segments.WORD, WORDS).select("row_id", F.round("raw", 6).alias("score"), F.round("plain", 6).alias("plain"))


LEX_SQL = f"WITH {S.SESSION_ROWS}, {S.lexical(WORDS, S.SESSION_WEIGHTS, ('t_content', 't_name', 't_cwd'), 'true', 'raw', True)}"


@query(f"WITH {S.SESSION_ROWS}, {S.bm25(WORDS, S.SESSION_WEIGHTS)} SELECT r.row_id, round(s.raw, 6) AS score FROM search_rows r JOIN scores s USING (row_id) ORDER BY round(s.raw, 9), r.updated_at DESC, r.row_id LIMIT 100")
def lexical_top100(spark, d):
    s = bm25.score_scan(corpora.session_rows(spark, d), dict(channels.SESSIONS.weights), WORDS)
    return s.orderBy(F.round("bm25", 9), F.desc("updated_at"), "row_id").limit(channels.TOP).select("row_id", F.round("bm25", 6).alias("score"))


@query(f"{LEX_SQL} SELECT row_id, coverage::BIGINT AS coverage FROM lex_cov")
def lexical_coverage(spark, d):
    return channels.lexical_rows(corpora.session_rows(spark, d), channels.SESSIONS, WORDS, F.lit(True)).select("row_id", long(F.col("coverage")).alias("coverage"))


@query(f"{LEX_SQL} SELECT row_id, pos FROM lexical")
def lexical_reliability(spark, d):
    return channels.lexical(corpora.session_rows(spark, d), channels.SESSIONS, WORDS, F.lit(True)).select("row_id", "pos")


# --- fuzzy and semantic --------------------------------------------------------------

GRAMS = T.query_grams(TYPOS)
FUZ_SQL = f"WITH {S.SESSION_ROWS}, {S.fuzzy(GRAMS, 'true')}"


@query(f"{FUZ_SQL} SELECT row_id, round(by_, 6) AS score, n_shared::BIGINT AS n_shared FROM fuz_pre")
def fuzzy_prefilter(spark, d):
    top = channels.fuzzy_prefilter(corpora.session_rows(spark, d), GRAMS, F.lit(True))
    return top.select("row_id", F.round("by", 6).alias("score"), long(F.col("n_shared")).alias("n_shared"))


@query(SQL["fuzzy_prefilter"])
def gram_postings(spark, d):
    """The same from the inverted index, of which only slots that can hold one of the best are read."""
    rows = corpora.session_rows(spark, d)
    top, _ = segments.top(stored_index(rows), segments.GRAM, GRAMS, channels.keys_of(rows, F.lit(True)), channels.PREFILTER, first=4)
    return top.select("row_id", F.round("by", 6).alias("score"), long(F.col("n_shared")).alias("n_shared"))


@query(SQL["lexical_top100"])
def lexical_top100_blocks(spark, d):
    """The best by BM25 from the inverted index, of which only slots that can hold one of them are read."""
    rows = corpora.session_rows(spark, d)
    top, _ = segments.top(stored_index(rows), segments.WORD, WORDS, channels.keys_of(rows, F.lit(True)), channels.TOP, first=4)
    return top.select("row_id", F.round("raw", 6).alias("score"))


@query()
def blocks_read(spark, d):
    """Of a search for the ten best: blocks of its terms, and those read."""
    rows = corpora.session_rows(spark, d)
    top, read = segments.top(stored_index(rows), segments.WORD, WORDS, channels.keys_of(rows, F.lit(True)), 10, first=4)
    return top.select("row_id", F.round("raw", 6).alias("score"), F.lit(read.blocks).cast("bigint").alias("blocks"), F.lit(read.read).cast("bigint").alias("blocks_read"))


@query(f"{FUZ_SQL} SELECT row_id, round(raw, 9) AS similarity, pos FROM fuzzy")
def fuzzy_channel(spark, d):
    return channels.fuzzy(corpora.session_rows(spark, d), channels.SESSIONS, GRAMS, F.lit(True)).select("row_id", F.round("raw", 9).alias("similarity"), "pos")


V0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


@query(f"SELECT e.vec_id, round({S.dot('e.embedding', 'v.embedding')}, 6) AS similarity FROM embeddings e, {V0} v")
def dot_product(spark, d):
    v = query_vector(spark, d)
    return corpora.read(spark, d, "embeddings").select("vec_id", F.round(vectors.dot(F.col("embedding"), vectors.vector(v.values)), 6).alias("similarity"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def l2_norm(spark, d):
    return corpora.read(spark, d, "embeddings").select("vec_id", F.round(vectors.l2_norm(F.col("embedding")), 6).alias("norm"))


@query(f"SELECT e.vec_id, round({S.dot('e.embedding', 'v.embedding')}, 6) AS similarity FROM embeddings e, {V0} v ORDER BY round({S.dot('e.embedding', 'v.embedding')}, 9) DESC, e.vec_id LIMIT 100")
def semantic_topk(spark, d):
    v = query_vector(spark, d)
    s = corpora.read(spark, d, "embeddings").withColumn("s", F.round(vectors.dot(F.col("embedding"), vectors.vector(v.values)), 9))
    return s.orderBy(F.desc("s"), "vec_id").limit(channels.TOP).select("vec_id", F.round("s", 6).alias("similarity"))


@query(
    f"""SELECT q.vec_id AS query, e.vec_id AS key, round({S.dot('e.embedding', 'q.embedding')}, 6) AS similarity
FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round({S.dot('e.embedding', 'q.embedding')}, 9) DESC, e.vec_id) <= 100"""
)
def semantic_nearest(spark, d):
    """The stated queries, every vector whose number is divisible by 20, against all vectors."""
    e = corpora.read(spark, d, "embeddings")
    found = blocks.nearest(e, e.where("vec_id % 20 = 0"), key="vec_id", vector="embedding")
    return found.select("query", "key", F.round("similarity", 6).alias("similarity"))


@query(SQL["semantic_nearest"])
def semantic_cells(spark, d):
    """The same from cells of vectors, of which only those that can hold one of the best are read."""
    e = corpora.read(spark, d, "embeddings")
    found, _ = cells.search(cells.build(e, "vec_id", "embedding"), e.where("vec_id % 20 = 0"), query="vec_id", vector="embedding")
    return found.select("query", "key", F.round("similarity", 6).alias("similarity"))


@query()
def cells_read(spark, d):
    """Of the searches for the ten nearest: pairs of a query and a cell, and those compared."""
    e = corpora.read(spark, d, "embeddings")
    found, read = cells.search(cells.build(e, "vec_id", "embedding"), e.where("vec_id % 20 = 0"), query="vec_id", vector="embedding", k=10)
    return found.select("query", "key", F.round("similarity", 6).alias("similarity"), F.lit(read.pairs).cast("bigint").alias("pairs"), F.lit(read.read).cast("bigint").alias("pairs_read"))


@query(
    f"""WITH g AS (SELECT doc_id, {S.grams(S.toks("coalesce(text, '')"))} AS g FROM documents),
q AS (SELECT item_id AS query, {S.grams(S.toks("coalesce(text, '')"))} AS q FROM benchmark WHERE item_id % 20 = 0)
SELECT query, doc_id AS key, round(len(list_intersect(q, g)) / len(q)::DOUBLE, 9) AS similarity FROM g, q WHERE len(q) > 0 AND round(len(list_intersect(q, g)) / len(q)::DOUBLE, 9) >= 0.25
QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(len(list_intersect(q, g)) / len(q)::DOUBLE, 9) DESC, doc_id) <= 100"""
)
def fuzzy_nearest(spark, d):
    """The stated queries, every benchmark item whose number is divisible by 20, against all documents."""
    docs = spread(corpora.read(spark, d, "documents")).select(F.col("doc_id").alias("key"), T.gram_set(F.coalesce("text", F.lit(""))).alias("grams"))
    asked = corpora.read(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("key"), T.gram_set(F.coalesce("text", F.lit(""))).alias("grams"))
    return blocks.similar_texts(docs, asked, key="key").drop("place")


@query(SQL["dot_product"] + f" WHERE round({S.dot('e.embedding', 'v.embedding')}, 9) >= {THRESHOLD}")
def semantic_threshold(spark, d):
    v = query_vector(spark, d)
    out = vectors.similarities(corpora.read(spark, d, "embeddings"), "embedding", v.values)
    return out.where(F.round("similarity", 9) >= THRESHOLD).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("SELECT vec_id, true AS same, len(embedding)::BIGINT AS dims, (4 * len(embedding))::BIGINT AS n_bytes FROM embeddings")
def vector_codec(spark, d):
    e = corpora.read(spark, d, "embeddings").select("vec_id", "embedding", vectors.encode("embedding").alias("blob"))
    e = e.withColumn("back", vectors.decode("blob"))
    return e.select("vec_id", (F.col("embedding") == F.col("back")).alias("same"), long(F.size("back")).alias("dims"), long(F.octet_length("blob")).alias("n_bytes"))


# --- fusion --------------------------------------------------------------------------

SESSION_CTES = (
    f"{S.SESSION_ROWS}, {S.exact('sessions', 'session_key', 'native_id', LEXICAL, 'true', chr(39) * 2)}, "
    f"{S.lexical(WORDS, S.SESSION_WEIGHTS, ('t_content', 't_name', 't_cwd'), '{where}', 'raw', True)}, "
    f"{S.fuzzy(T.query_grams(LEXICAL), '{where}')}, {S.semantic('{where}', THRESHOLD)}"
)
FUSED_COLS = "rank, group_key, round(score, 9) AS score, exact_rank, lexical_rank, fuzzy_rank, semantic_rank, round(similarity, 6) AS similarity, row_id"


def session_ctes(where: str, group_where: str = "true") -> str:
    return SESSION_CTES.replace("{where}", where).replace(f"native_id = '{LEXICAL}' AND true", f"native_id = '{LEXICAL}' AND {group_where}")


def fused_columns(df: DataFrame) -> DataFrame:
    return df.select("rank", "group_key", F.round("score", 9).alias("score"), "exact_rank", "lexical_rank", "fuzzy_rank", "semantic_rank", F.round("similarity", 6).alias("similarity"), "row_id")


def session_hybrid(spark, d, f: filters.SessionFilters, text: str = LEXICAL) -> DataFrame:
    return search.hybrid(corpora.session_groups(spark, d), corpora.session_rows(spark, d), channels.SESSIONS, text, f, query_vector(spark, d))


@query(f"WITH {session_ctes('true')}, {S.fused(True, 100)} SELECT {FUSED_COLS} FROM fused")
def rrf_fusion_sessions(spark, d):
    return fused_columns(session_hybrid(spark, d, filters.SessionFilters(limit=100)))


@query(
    f"""WITH {session_ctes('true')}, {S.fused(True, 3)}
SELECT rank, s.harness, s.native_id AS session_id, s.name, s.cwd, s.started_at, s.updated_at, {S.shorten(S.one_line('f.text'), 320)} AS excerpt,
  {RESUME_SQL} AS resume, round(score, 9) AS score, exact_rank, lexical_rank, fuzzy_rank, semantic_rank, round(similarity, 6) AS similarity
FROM fused f JOIN sessions s ON s.session_key = f.group_key"""
)
def hybrid_search(spark, d):
    """The flagship: default limit, result rows with excerpts and resume commands."""
    out = search.session_results(session_hybrid(spark, d, filters.SessionFilters()), corpora.sessions(spark, d))
    return out.withColumn("score", F.round("score", 9)).withColumn("similarity", F.round("similarity", 6))


FILTER_SQL = "harness IN ('pi', 'claude') AND (cwd = '/work/p1' OR starts_with(lower(cwd), '/work/p1/') OR cwd <> '') AND updated_at >= 2000 AND role = 'user'"


@query(f"WITH {session_ctes(FILTER_SQL, FILTER_SQL.replace(' AND role = ' + chr(39) + 'user' + chr(39), ''))}, {S.fused(True, 10)} SELECT {FUSED_COLS} FROM fused")
def hybrid_search_filtered(spark, d):
    return fused_columns(session_hybrid(spark, d, filters.SessionFilters(harnesses=("pi", "Claude"), roles=("user",), since=2000, limit=10)))


#: Every benchmark item whose number is divisible by 20, with the vector of its number.
ASKED_SQL = "SELECT b.item_id AS query, coalesce(b.text, '') AS text, e.embedding AS vector FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id WHERE b.item_id % 20 = 0"
MANY_COLS = f"query, {FUSED_COLS}"


def asked_items(spark, d) -> DataFrame:
    vectors_ = corpora.read(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    items = corpora.read(spark, d, "benchmark").where("item_id % 20 = 0").join(vectors_, "item_id", "left")
    return items.select(F.col("item_id").alias("query"), F.coalesce("text", F.lit("")).alias("text"), "vector")


def many_columns(df: DataFrame) -> DataFrame:
    return df.select("query", "rank", "group_key", F.round("score", 9).alias("score"), "exact_rank", "lexical_rank", "fuzzy_rank", "semantic_rank", F.round("similarity", 6).alias("similarity"), "row_id")


@query(
    f"""WITH {S.SESSION_ROWS}, {S.many(ASKED_SQL, S.SESSION_WEIGHTS, ('t_content', 't_name', 't_cwd'), 'sessions', 'session_key', 'native_id', True, 'true', 'true', 'raw', True, True, THRESHOLD, 10)}
SELECT {MANY_COLS} FROM fused"""
)
def hybrid_many_sessions(spark, d):
    """The stated queries against all sessions, in one plan."""
    rows = corpora.session_rows(spark, d, corpora.passing)
    texts = lambda ids: corpora.session_rows(spark, d, corpora.passing, ids)
    out = batch.hybrid_many(corpora.session_groups(spark, d), rows, channels.SESSIONS, asked_items(spark, d), filters.SessionFilters(limit=10), corpora.FINGERPRINT, THRESHOLD, texts)
    return many_columns(out)


@query(
    f"""WITH {S.MEMORY_ROWS}, {S.many(ASKED_SQL, S.MEMORY_WEIGHTS, ('t_content', 't_source', 't_project'), 'memories', 'id', 'id', False, 'archived_at IS NULL', 'archived_at IS NULL', 'plain', False, False, THRESHOLD, 10)}
SELECT {MANY_COLS} FROM fused"""
)
def hybrid_many_memories(spark, d):
    """The stated queries against all notes that aren't archived."""
    rows = corpora.memory_rows(spark, d, corpora.passing)
    groups = corpora.memories(spark, d).withColumn("group_key", F.col("id"))
    out = batch.hybrid_many(groups, rows, channels.MEMORIES, asked_items(spark, d), filters.MemoryFilters(all_projects=True, limit=10), corpora.FINGERPRINT, THRESHOLD)
    return many_columns(out)


MEMORY_WORDS, MEMORY_GRAMS = T.query_tokens(MEMORY_QUERY), T.query_grams(MEMORY_QUERY)


def memory_ctes(where: str) -> str:
    return (
        f"{S.MEMORY_ROWS}, {S.exact('memories', 'id', 'id', MEMORY_QUERY, where, 'text')}, "
        f"{S.lexical(MEMORY_WORDS, S.MEMORY_WEIGHTS, ('t_content', 't_source', 't_project'), where, 'plain', False)}, "
        f"{S.fuzzy(MEMORY_GRAMS, where)}, {S.semantic(where, THRESHOLD)}"
    )


def memory_hybrid(spark, d, f: filters.MemoryFilters) -> DataFrame:
    rows = corpora.memory_rows_alone(spark, d)
    groups = corpora.memories(spark, d).withColumn("group_key", F.col("id"))
    return search.hybrid_scan(groups, rows, channels.MEMORIES, MEMORY_QUERY, f, query_vector(spark, d), corpora.note_vectors(spark, d), "doc_id")


@query(f"WITH {memory_ctes('archived_at IS NULL')}, {S.fused(False, 50)} SELECT {FUSED_COLS} FROM fused")
def rrf_fusion_memories(spark, d):
    return fused_columns(memory_hybrid(spark, d, filters.MemoryFilters(all_projects=True, limit=50)))


@query(f"WITH {memory_ctes(MW := 'archived_at IS NULL AND (scope = ' + chr(39) + 'global' + chr(39) + ' OR (scope = ' + chr(39) + 'project' + chr(39) + ' AND project_key = ' + chr(39) + 'src1' + chr(39) + '))')}, {S.fused(False, 3)} SELECT {FUSED_COLS} FROM fused")
def memory_search(spark, d):
    return fused_columns(memory_hybrid(spark, d, filters.MemoryFilters(project_key="src1")))


@query(
    f"""SELECT 'sessions' AS corpus, rank, group_key FROM (WITH {session_ctes('true')}, {S.fused(True, 3)} SELECT * FROM fused)
UNION ALL SELECT 'memories', rank, group_key FROM (WITH {memory_ctes('archived_at IS NULL')}, {S.fused(False, 3)} SELECT * FROM fused)"""
)
def combined_search(spark, d):
    """Both corpora, ranked apart."""
    s = session_hybrid(spark, d, filters.SessionFilters()).select(F.lit("sessions").alias("corpus"), "rank", "group_key")
    return s.unionByName(memory_hybrid(spark, d, filters.MemoryFilters(all_projects=True)).select(F.lit("memories").alias("corpus"), "rank", "group_key"))


# --- filters -------------------------------------------------------------------------


def session_filter(where: str):
    return f"WITH {S.SESSIONS} SELECT native_id, harness, cwd, updated_at FROM sessions WHERE {where}"


def filtered_sessions(spark, d, **options) -> DataFrame:
    f = filters.SessionFilters(**options)
    return corpora.sessions(spark, d).where(f.predicate(with_chunk=False)).select("native_id", "harness", "cwd", "updated_at")


@query(session_filter("harness IN ('codex', 'claude')"))
def filter_harness(spark, d):
    return filtered_sessions(spark, d, harnesses=("Codex", "claude", "codex"))


@query(session_filter("cwd = '/work/p2' OR cwd ILIKE '/work/p2/%'"))
def filter_path(spark, d):
    return filtered_sessions(spark, d, path="/work/p2/")


@query(session_filter("updated_at >= 5000 AND updated_at <= 40003"))
def filter_dates(spark, d):
    return filtered_sessions(spark, d, since=5000, before=40003)


@query(f"WITH {S.ENTRIES} SELECT entry_key, role FROM entries WHERE role IN ('assistant')")
def filter_roles(spark, d):
    return corpora.entries(spark, d).where(filters.SessionFilters(roles=("assistant",)).predicate()).select("entry_key", "role")


@query(f"WITH {S.MEMORIES} SELECT id, scope, project_key FROM memories WHERE archived_at IS NULL AND (scope = 'global' OR (scope = 'project' AND project_key = 'src3'))")
def filter_memory_scope(spark, d):
    return corpora.memories(spark, d).where(filters.MemoryFilters(project_key="src3").predicate()).select("id", "scope", "project_key")


# --- maintenance ---------------------------------------------------------------------

OLD = "event_id % 10 <> 0"
NEW = "event_id % 10 <> 1"
KEY_SQL = "'k' || event_id"
OLD_SQL = f"old_ AS (SELECT {KEY_SQL} AS source_key, event_type AS harness, 'v' || user_id AS version FROM events WHERE {OLD})"
NEW_SQL = f"new_ AS (SELECT {KEY_SQL} AS source_key, event_type AS harness, CASE WHEN event_id % 4 = 0 THEN 'w' ELSE 'v' END || user_id AS version FROM events WHERE {NEW})"


def sources_pair(spark, d) -> tuple[DataFrame, DataFrame]:
    e = corpora.read(spark, d, "events")
    key = F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("source_key")
    user = F.col("user_id").cast("string")
    old = e.where(OLD).select(key, F.col("event_type").alias("harness"), F.concat(F.lit("v"), user).alias("version"))
    new = e.where(NEW).select(key, F.col("event_type").alias("harness"), F.concat(F.when(F.col("event_id") % 4 == 0, "w").otherwise("v"), user).alias("version"))
    return old, new


STATUS_SQL = "CASE WHEN o.source_key IS NULL THEN 'new' WHEN n.source_key IS NULL THEN 'missing' WHEN o.version = n.version THEN 'unchanged' ELSE 'changed' END"


@query(f"WITH {OLD_SQL}, {NEW_SQL} SELECT coalesce(o.source_key, n.source_key) AS source_key, {STATUS_SQL} AS status FROM old_ o FULL JOIN new_ n ON o.source_key = n.source_key")
def version_diff(spark, d):
    return maintenance.version_diff(*sources_pair(spark, d))


@query(f"WITH {OLD_SQL}, {NEW_SQL} SELECT {STATUS_SQL} AS status, count(*) AS n FROM old_ o FULL JOIN new_ n ON o.source_key = n.source_key GROUP BY 1")
def run_counters(spark, d):
    return maintenance.version_diff(*sources_pair(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {OLD_SQL}, {NEW_SQL} SELECT coalesce(n.source_key, o.source_key) AS source_key, coalesce(n.harness, o.harness) AS harness, coalesce(n.version, o.version) AS version FROM old_ o FULL JOIN new_ n ON o.source_key = n.source_key")
def upsert_sources(spark, d):
    return maintenance.upsert(*sources_pair(spark, d), "source_key")


ORDERS_SQL = """o AS (SELECT o_orderkey AS id, sha256(o_orderstatus) AS text_hash, o_totalprice AS embedding, 'f1' AS fp FROM orders WHERE o_orderkey % 3 <> 0),
n AS (SELECT o_orderkey AS id, sha256(CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE o_orderstatus END) AS text_hash, NULL::DOUBLE AS embedding, '' AS fp FROM orders WHERE o_orderkey % 4 <> 0)"""


@query(
    f"""WITH {ORDERS_SQL} SELECT coalesce(n.id, o.id) AS id, coalesce(n.text_hash, o.text_hash) AS text_hash,
  CASE WHEN n.id IS NULL OR o.text_hash = n.text_hash THEN o.embedding ELSE n.embedding END AS embedding,
  CASE WHEN n.id IS NULL OR o.text_hash = n.text_hash THEN o.fp ELSE n.fp END AS fp FROM o FULL JOIN n ON o.id = n.id"""
)
def upsert_preserve_embedding(spark, d):
    r = corpora.read(spark, d, "orders")
    old = r.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.sha2("o_orderstatus", 256).alias("text_hash"), F.col("o_totalprice").alias("embedding"), F.lit("f1").alias("fp"))
    status = F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(F.col("o_orderstatus"))
    new = r.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("id"), F.sha2(status, 256).alias("text_hash"), F.lit(None).cast("double").alias("embedding"), F.lit("").alias("fp"))
    return maintenance.upsert(old, new, "id", keep=("embedding", "fp"), same="text_hash")


@query(f"WITH {OLD_SQL}, {NEW_SQL} SELECT * FROM old_ WHERE source_key IN (SELECT source_key FROM new_)")
def delete_missing_sources(spark, d):
    old, new = sources_pair(spark, d)
    return maintenance.delete_missing(old, new)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def cascade_delete(spark, d):
    kept = corpora.read(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return maintenance.cascade(corpora.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), kept, "l_orderkey")


@query("SELECT DISTINCT event_type AS harness FROM events WHERE event_type NOT IN ('click', 'view')")
def delete_removed_harness(spark, d):
    old, new = sources_pair(spark, d)
    return maintenance.removed_harnesses(old, new, ("click", "view"))


@query(
    """SELECT doc_id, source, doc_id % 3 AS generation FROM documents d
WHERE source IS NULL OR source NOT IN ('src1', 'src2') OR doc_id % 3 = 2"""
)
def stale_generation_delete(spark, d):
    docs = corpora.read(spark, d, "documents").select("doc_id", "source", (F.col("doc_id") % 3).alias("generation"))
    reread = spark.createDataFrame([("src1", 2), ("src2", 2)], "source string, generation bigint")
    return maintenance.delete_stale(docs, reread, "source")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_writer_wins(spark, d):
    e = corpora.read(spark, d, "events").select("user_id", "event_type", "event_id")
    return chunking.last_writer(e, "event_id", "user_id")


@query(f"WITH {S.MEMORIES} SELECT id FROM memories WHERE embedding IS NULL ORDER BY id LIMIT 32")
def pending_embeddings(spark, d):
    return maintenance.pending(corpora.memories(spark, d), corpora.FINGERPRINT).orderBy("id").limit(32).select("id")


@query(f"WITH {S.MEMORIES} SELECT nth // 32 AS batch, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS nth FROM memories WHERE embedding IS NULL) GROUP BY 1")
def backfill_batches(spark, d):
    """The pending rows in id order, 32 a batch; numbered with per-partition offsets."""
    p = maintenance.pending(corpora.memories(spark, d), corpora.FINGERPRINT).select("id")
    numbered = number_rows(p, "id")
    return numbered.groupBy(F.floor(F.col("nth") / 32).alias("batch")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def number_rows(df: DataFrame, *key: str, buckets: int = 64) -> DataFrame:
    """``nth``: the place of unique keys in their order, from 0, without one task for all.

    Range bounds come from quantiles of the keys' hashes' order, so both passes agree:
    rows are bucketed by comparing with bounds taken once."""
    place = F.struct(*key)
    bounds = df.select(*key).orderBy(F.xxhash64(*key)).limit(buckets - 1).collect()
    cuts = [F.struct(*[F.lit(r[k]).cast(df.schema[k].dataType).alias(k) for k in key]) for r in bounds]
    bucket = F.size(F.filter(F.array(*cuts), lambda x: x <= place)) if cuts else F.lit(0)
    b = df.withColumn("_b", bucket)
    sizes = b.groupBy("_b").agg(F.count("*").alias("_n"))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_b"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_o"))  # one row a bucket
    own = F.row_number().over(Window.partitionBy("_b").orderBy(*key)) - 1
    return b.withColumn("_r", own).join(F.broadcast(offsets), "_b").withColumn("nth", F.col("_o") + F.col("_r")).drop("_b", "_r", "_o")


@query(
    f"""WITH {S.SESSION_ROWS} SELECT (SELECT count(*) FROM (SELECT DISTINCT cwd FROM sessions)) AS sources, (SELECT count(*) FROM sessions) AS sessions, count(*) AS chunks,
  count(embedding) AS embedded, count(*) - count(embedding) AS pending, (SELECT count(*) FROM events WHERE event_type = 'error') AS parser_errors FROM search_rows"""
)
def index_stats(spark, d):
    s = corpora.sessions(spark, d)
    errors = corpora.read(spark, d, "events").where("event_type = 'error'")
    return maintenance.index_stats(s.select("cwd").distinct(), s, corpora.chunks(spark, d), errors, corpora.FINGERPRINT)


@query(f"WITH {S.MEMORIES} SELECT count(*) FILTER (WHERE archived_at IS NULL) AS active, count(archived_at) AS archived, count(embedding) AS embedded, count(*) - count(embedding) AS pending FROM memories")
def memory_stats(spark, d):
    return maintenance.memory_stats(corpora.memories(spark, d), corpora.FINGERPRINT)


@query("SELECT row_number() OVER (ORDER BY event_type, 'k' || event_id) AS nth, event_type AS harness, 'k' || event_id AS path FROM events WHERE event_type = 'error' OR event_id % 97 = 0")
def parser_errors_sorted(spark, d):
    e = corpora.read(spark, d, "events").where("event_type = 'error' or event_id % 97 = 0")
    e = e.select(F.col("event_type").alias("harness"), F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("path"))
    return maintenance.sorted_errors(number_rows(e, "harness", "path")).select(long(F.col("nth") + 1).alias("nth"), "harness", "path")


def queries() -> dict[str, Query]:
    from . import catalogue_logs, catalogue_records

    return QUERIES | catalogue_records.QUERIES | catalogue_logs.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import catalogue_logs, catalogue_records

    return SQL | catalogue_records.SQL | catalogue_logs.SQL
