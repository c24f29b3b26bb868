"""The registered queries in DuckDB's SQL, over the same tables. PRELUDE has all steps as common table expressions."""

from __future__ import annotations

from ..functions.text import ASPECTS, CLOUD_STOP_WORDS, SENTIMENT_COLORS, SENTIMENT_LABELS, TOOL_NAMES
from ..operators.words import DOMAIN_FREQUENCY, DOMAIN_WORDS
from .queries import COMMON, QUERIES


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def detected(text: str) -> str:
    cases = ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower({text}), {quoted([k])})' for k in keys)} THEN '{name}' END" for name, keys in ASPECTS.items())
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^a-z0-9]+'), lambda x: x <> '')"


def mapped(value: str, names: dict[str, str]) -> str:
    return f"CASE {value} {' '.join(f'WHEN {quoted([k])} THEN {quoted([v])}' for k, v in names.items())} ELSE {value} END"


SNIPPET = "CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE coalesce(text, '') END"
DOT = "coalesce(list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 0)"

PRELUDE = f"""
WITH RECURSIVE asked AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{q}', {v})" for i, q, v in QUERIES)}) AS t(query_id, q, vec_id)),
docs AS (
  SELECT d.doc_id, split_part(d.text, '.', 1) AS title, d.text, d.source, list_filter([d.lang, e.event_type], lambda x: x IS NOT NULL) AS tools,
         CASE WHEN l.quality IS NULL THEN 'not_applicable' WHEN l.quality = 0 THEN 'negative' WHEN l.toxic = 1 THEN 'mixed' ELSE 'positive' END AS sentiment,
         CASE WHEN l.quality IS NULL THEN 'neutral' ELSE 'opinionated' END AS subjectivity,
         {detected("d.text")} AS aspect_names, CAST(o.o_orderdate AS TIMESTAMP) AS date, CAST(floor(e.value) AS INT) AS upvotes, v.embedding AS vector
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN events e ON e.event_id = d.doc_id
  LEFT JOIN orders o ON o.o_orderkey = d.doc_id LEFT JOIN embeddings v ON v.vec_id = d.doc_id
),
told AS (
  SELECT 'title' AS field, doc_id, {tokens("title")} AS toks FROM docs UNION ALL SELECT 'text', doc_id, {tokens("text")} FROM docs
),
stats AS (SELECT field, count(*) AS n_docs, sum(len(toks)) / count(*) AS avgdl FROM told WHERE len(toks) > 0 GROUP BY field),
terms AS (SELECT DISTINCT query_id, unnest({tokens("q")}) AS term FROM asked),
posted AS (
  SELECT term, field, doc_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT field, doc_id, len(toks) AS dl, unnest(toks) AS term FROM told)
  WHERE term IN (SELECT term FROM terms) GROUP BY term, field, doc_id
),
vocab AS (SELECT term, field, count(*) AS df FROM posted GROUP BY term, field),
weighed AS (
  SELECT p.term, p.doc_id, p.field, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) AS s
  FROM posted p JOIN vocab USING (term, field) JOIN stats USING (field)
),
keyword_all AS (
  SELECT query_id, doc_id, round(sum(s), 9) AS score FROM (SELECT term, doc_id, max(CASE field WHEN 'title' THEN 2 ELSE 1 END * s) AS s FROM weighed GROUP BY term, doc_id) JOIN terms USING (term) GROUP BY query_id, doc_id
),
keyword_ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS ord FROM keyword_all),
keyword AS (SELECT * FROM keyword_ranked WHERE ord <= 100),
question AS (SELECT query_id, q, embedding AS query_vector, {detected("q")} AS detected FROM asked LEFT JOIN embeddings USING (vec_id)),
vector_all AS (
  SELECT query_id, doc_id, round((1 + {DOT.format(a="vector", b="query_vector")}) / 2, 9) AS score FROM docs, question WHERE vector IS NOT NULL AND query_vector IS NOT NULL AND len(vector) = len(query_vector)
),
vector_ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS ord FROM vector_all),
vectors AS (SELECT * FROM vector_ranked WHERE ord <= 100),
fused AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, keyword_rank NULLS LAST, vector_rank NULLS LAST) AS INT) AS ord FROM (
    SELECT coalesce(k.query_id, v.query_id) AS query_id, coalesce(k.doc_id, v.doc_id) AS doc_id,
           round(coalesce(CAST(1 AS DOUBLE) / (60 + k.ord), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + v.ord), 0), 12) AS score, k.ord AS keyword_rank, v.ord AS vector_rank, coalesce(v.score, 0) AS vector_score
    FROM keyword k FULL JOIN vectors v ON k.query_id = v.query_id AND k.doc_id = v.doc_id
  )
),
hits AS (SELECT fused.*, title, text, source, tools, sentiment, subjectivity, aspect_names, date, upvotes, vector, detected, query_vector FROM fused JOIN docs USING (doc_id) JOIN question USING (query_id)),
boosted AS (
  SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, ord) AS INT) AS ord)
  FROM (SELECT * REPLACE (CASE WHEN list_has_any(aspect_names, detected) THEN score * 1.3 ELSE score END AS score) FROM hits)
),
boosted_ties AS (
  SELECT *, coalesce(abs(score - lag(score) OVER w) < 0.005, false) OR coalesce(abs(score - lead(score) OVER w) < 0.005, false) AS near_tie FROM boosted WINDOW w AS (PARTITION BY query_id ORDER BY ord)
),
aged AS (SELECT *, greatest(floor((epoch(TIMESTAMP '2002-01-01') - epoch(date)) / 86400), 0) AS days FROM boosted_ties),
decayed AS (
  SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, ord) AS INT) AS ord)
  FROM (SELECT * REPLACE (round(CASE WHEN near_tie AND date IS NOT NULL THEN score * exp(-0.001 * days) ELSE score END, 12) AS score) FROM aged)
)"""

SEVEN = "query_id, ord, doc_id"
_TREND = """
SELECT strftime({bucket}, '{form}') AS date, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (sentiment = 'mixed') AS mixed,
       count(*) FILTER (sentiment = 'not_applicable') AS not_applicable, count(*) AS count, round(avg(coalesce(upvotes, 0)), 2) AS avg_upvotes
FROM {rows} WHERE date IS NOT NULL GROUP BY 1"""


def trend(granularity: str, rows: str = "docs") -> str:
    return PRELUDE + _TREND.format(bucket=f"date_trunc('{granularity}', date)", form="%Y-%m" if granularity == "month" else "%Y-%m-%d", rows=rows)


def enriched(rows: str, similarity: str) -> str:
    return f"""
SELECT query_id, ord, doc_id, round(score, 4) AS score, {similarity} AS similarity_score, keyword_rank, vector_rank, title, {SNIPPET} AS snippet, source, strftime(date, '%Y-%m-%d') AS date, sentiment,
       array_to_string(tools, ',') AS tools, array_to_string(list_transform(aspect_names, lambda a: a || ':' || sentiment), ',') AS aspects, source AS subreddit, coalesce(upvotes, 0) AS upvotes
FROM {rows}"""


def diverse(rows: str, limit: str = "") -> str:
    """Greedy choice, step by step."""
    return f"""{PRELUDE},
raws AS (SELECT query_id, ord, doc_id, vector, {DOT.format(a="vector", b="query_vector")} AS raw, query_vector FROM {rows}),
pool AS (
  SELECT query_id, ord, vector, round(CASE WHEN max(raw) OVER w > min(raw) OVER w THEN (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) ELSE raw END, 12) AS rel
  FROM raws WHERE ord <= 50 WINDOW w AS (PARTITION BY query_id)
),
near AS (SELECT a.query_id, a.ord AS a, b.ord AS b, {DOT.format(a="a.vector", b="b.vector")} AS d FROM pool a JOIN pool b USING (query_id)),
chosen AS (
  SELECT query_id, 1 AS step, [min({{'v': -rel, 'o': ord}}).o] AS picked FROM pool GROUP BY query_id
  UNION ALL
  SELECT query_id, step + 1, list_append(picked, min({{'v': -val, 'o': ord}}).o)
  FROM (
    SELECT s.query_id, s.step, s.picked, p.ord, round(0.8 * p.rel - (1 - 0.8) * max(n.d), 12) AS val
    FROM chosen s JOIN pool p ON p.query_id = s.query_id AND NOT list_contains(s.picked, p.ord) JOIN near n ON n.query_id = p.query_id AND n.a = p.ord AND list_contains(s.picked, n.b)
    GROUP BY s.query_id, s.step, s.picked, p.ord, p.rel
  ) GROUP BY query_id, step, picked
),
last AS (SELECT query_id, arg_max(picked, step) AS picked FROM chosen GROUP BY query_id)
SELECT r.query_id, CASE WHEN r.ord <= 50 THEN CAST(list_position(l.picked, r.ord) AS INT) ELSE r.ord END AS ord, doc_id FROM raws r JOIN last l USING (query_id) {limit}"""


def counted(value: str, facet: str) -> str:
    return f"(SELECT '{facet}' AS facet, value, count(*) AS count FROM (SELECT {value} AS value FROM docs) WHERE trim(value) <> '' GROUP BY value ORDER BY count DESC, value LIMIT 100)"


def value_facet(column: str, where: str = "") -> str:
    return f"""{PRELUDE}
SELECT * FROM (SELECT query_id, {column} AS value, count(*) AS count, CAST(row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, min(ord)) AS INT) AS place FROM hits WHERE {column} <> '' GROUP BY query_id, {column}) {where}"""


def boolean() -> str:
    """BOOLEAN, each question as a condition on a document's words and columns, with the sum of its words' scores."""
    has = lambda w: f"(list_contains(a.toks, '{w}') OR list_contains(b.toks, '{w}'))"
    phrase = "(contains(' ' || array_to_string(a.toks, ' ') || ' ', ' general public ') OR contains(' ' || array_to_string(b.toks, ' ') || ' ', ' general public '))"
    begins = "(len(list_filter(a.toks, lambda x: starts_with(x, 'licen'))) > 0 OR len(list_filter(b.toks, lambda x: starts_with(x, 'licen'))) > 0)"
    asked = (
        (("license", "version", "token"), f"{has('license')} AND ({has('version')} OR {has('token')}) AND NOT {has('apache')}"),
        (("license", "general", "public"), f"list_contains(a.toks, 'license') OR {phrase}"),
        ((), f"{begins} AND d.source = 'src3'"),
        (("version",), f"NOT {has('license')} AND {has('version')}"),
        ((), f"d.sentiment = 'mixed' AND NOT ({has('the')} OR {has('der')})"),
    )
    found = " UNION ALL ".join(f"SELECT {i} AS query_id, d.doc_id FROM docs d JOIN told a ON a.doc_id = d.doc_id AND a.field = 'title' JOIN told b ON b.doc_id = d.doc_id AND b.field = 'text' WHERE {where}" for i, (_, where) in enumerate(asked, 1))
    words = ", ".join(f"({i}, '{w}')" for i, (terms, _) in enumerate(asked, 1) for w in terms)
    return f"""{PRELUDE},
wanted AS (SELECT * FROM (VALUES {words}) AS t(query_id, term)),
found AS ({found}),
wanted_posted AS (
  SELECT term, field, doc_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT field, doc_id, len(toks) AS dl, unnest(toks) AS term FROM told)
  WHERE term IN (SELECT term FROM wanted) GROUP BY term, field, doc_id
),
wanted_parts AS (
  SELECT term, doc_id, max(CASE field WHEN 'title' THEN 2 ELSE 1 END * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS s
  FROM wanted_posted JOIN (SELECT term, field, count(*) AS df FROM wanted_posted GROUP BY term, field) USING (term, field) JOIN stats USING (field) GROUP BY term, doc_id
),
wanted_scores AS (SELECT query_id, doc_id, round(sum(s), 9) AS score FROM wanted_parts JOIN wanted USING (term) GROUP BY query_id, doc_id)
SELECT query_id, doc_id, coalesce(round(score, 6), 0) AS score FROM found LEFT JOIN wanted_scores USING (query_id, doc_id)"""


def common() -> str:
    """The best ten of COMMON, by scoring all that match."""
    words = ", ".join(f"({i}, '{w.lstrip('+-')}', {w[0] == '+'}, {w[0] == '-'})" for i, q in COMMON for w in q.split())
    return f"""{PRELUDE},
common AS (SELECT * FROM (VALUES {words}) AS t(query_id, term, must, banned)),
common_posted AS (
  SELECT term, field, doc_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT field, doc_id, len(toks) AS dl, unnest(toks) AS term FROM told)
  WHERE term IN (SELECT term FROM common) GROUP BY term, field, doc_id
),
common_parts AS (
  SELECT term, doc_id, max(CASE field WHEN 'title' THEN 2 ELSE 1 END * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS s
  FROM common_posted JOIN (SELECT term, field, count(*) AS df FROM common_posted GROUP BY term, field) USING (term, field) JOIN stats USING (field) GROUP BY term, doc_id
),
common_scores AS (
  SELECT query_id, doc_id, round(sum(s), 9) AS score FROM common_parts JOIN common USING (term) GROUP BY query_id, doc_id
  HAVING NOT bool_or(banned) AND count(*) FILTER (must) = (SELECT count(*) FROM common c WHERE c.query_id = common.query_id AND c.must)
)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS ord FROM common_scores
QUALIFY ord <= 10"""


def spelling() -> str:
    domain = ", ".join(f"('{w}')" for w in dict.fromkeys(DOMAIN_WORDS))
    return f"""{PRELUDE},
known AS (
  SELECT word, max(n) AS n FROM (
    SELECT unnest(toks) AS word, 1 AS one FROM told WHERE field = 'text'
  ) t(word, one) JOIN (SELECT word AS w2, count(*) AS n FROM (SELECT unnest(toks) AS word FROM told WHERE field = 'text') GROUP BY word) ON w2 = word GROUP BY word
),
every AS (SELECT word, max(n) AS n FROM (SELECT word, n FROM known UNION ALL SELECT word, {DOMAIN_FREQUENCY} FROM (VALUES {domain}) AS d(word)) GROUP BY word),
wrong AS (
  SELECT query_id, i - 1 AS pos, t[i] AS token FROM (SELECT query_id, t, unnest(range(1, len(t) + 1)) AS i FROM (
    SELECT query_id, regexp_split_to_array(trim(q), '\\s+') AS t FROM (VALUES (1, 'licnese of cusror 12345 a:b'), (2, 'aparche verison teh'), (3, 'zzzzzzzzzz refactr und')) AS v(query_id, q)))
),
odd AS (SELECT * FROM wrong WHERE length(token) > 2 AND NOT contains(token, ':') AND NOT regexp_full_match(token, '[0-9]+') AND lower(token) NOT IN (SELECT word FROM every)),
pairs AS (
  SELECT o.*, e.word, e.n, CASE WHEN len(list_filter(range(0, length(token) - 1), lambda i: lower(token)[1:i] || lower(token)[i + 2:i + 2] || lower(token)[i + 1:i + 1] || lower(token)[i + 3:] = e.word)) > 0 AND lower(token) <> e.word
         THEN 1 ELSE levenshtein(lower(token), e.word) END AS distance
  FROM odd o JOIN every e ON abs(length(o.token) - length(e.word)) <= 2
)
SELECT query_id, CAST(pos AS INT) AS pos, token, arg_min(word, {{'d': distance, 'n': -n, 'w': word}}) AS correction, CAST(min(distance) AS INT) AS distance FROM pairs WHERE distance <= 2 GROUP BY query_id, pos, token"""


def oracle_sql() -> dict[str, str]:
    p = PRELUDE
    decayed_plain = f"""{p},
ties AS (SELECT *, coalesce(abs(score - lag(score) OVER w) < 0.005, false) OR coalesce(abs(score - lead(score) OVER w) < 0.005, false) AS near_tie FROM hits WINDOW w AS (PARTITION BY query_id ORDER BY ord)),
older AS (SELECT *, round(CASE WHEN near_tie AND date IS NOT NULL THEN score * exp(-0.001 * greatest(floor((epoch(TIMESTAMP '2002-01-01') - epoch(date)) / 86400), 0)) ELSE score END, 12) AS s2 FROM ties)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, ord) AS INT) AS ord, doc_id, round(s2, 6) AS score, near_tie FROM older"""
    found = f"{p} SELECT {SEVEN} FROM hits WHERE "
    return {
        "bm25_single_field": f"""{p}, single AS (SELECT query_id, doc_id, round(sum(s), 9) AS score FROM weighed JOIN terms USING (term) WHERE field = 'text' GROUP BY query_id, doc_id),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS ord FROM single)
SELECT query_id, doc_id, round(score, 6) AS score, ord FROM placed WHERE ord <= 100""",
        "bm25_dismax_title2": f"{p} SELECT query_id, doc_id, round(score, 6) AS score, ord FROM keyword",
        "keyword_search_page": p + enriched("(SELECT k.*, k.ord AS keyword_rank, CAST(NULL AS INT) AS vector_rank, docs.* EXCLUDE (doc_id) FROM keyword k JOIN docs USING (doc_id) WHERE ord BETWEEN 11 AND 20)", "CAST(NULL AS DOUBLE)"),
        "bm25_after_upserts": f"{p} SELECT query_id, doc_id, round(score, 6) AS score, ord FROM keyword",
        "boolean_questions": boolean(),
        "bm25_pruned_top10": common(),
        "keyword_pages_after": f"{p} SELECT query_id, doc_id, round(score, 6) AS score, ord - 100 AS ord FROM keyword_ranked WHERE ord BETWEEN 101 AND 150",
        "knn_topk": f"{p} SELECT query_id, doc_id, round(score, 6) AS score, ord FROM vectors",
        "semantic_search_threshold": f"{p} SELECT {SEVEN}, round(score, 6) AS score FROM vectors WHERE score >= 0.55",
        "rrf_fuse": f"{p} SELECT query_id, doc_id, round(score, 6) AS score, keyword_rank, vector_rank, round(vector_score, 6) AS vector_score, ord FROM fused",
        "rrf_explain": f"""{p} SELECT query_id, doc_id, concat_ws('; ', CASE WHEN keyword_rank > 0 THEN printf('Keyword(rank=%d): 1/(60+%d) = %.4f', keyword_rank, keyword_rank, CAST(1 AS DOUBLE) / (60 + keyword_rank)) END,
  CASE WHEN vector_rank > 0 THEN printf('Vector(rank=%d): 1/(60+%d) = %.4f', vector_rank, vector_rank, CAST(1 AS DOUBLE) / (60 + vector_rank)) END,
  printf('Total: %.4f', coalesce(CAST(1 AS DOUBLE) / (60 + keyword_rank), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + vector_rank), 0))) AS explanation FROM fused""",
        "hybrid_search": p + enriched("decayed WHERE ord <= 10", "round(vector_score, 4)"),
        "hybrid_search_diverse": diverse("decayed", "WHERE CASE WHEN r.ord <= 50 THEN list_position(l.picked, r.ord) ELSE r.ord END <= 20"),
        "hybrid_min_similarity": f"{p} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY ord) AS INT) AS ord, doc_id, round(score, 6) AS score, round(vector_score, 6) AS vector_score FROM fused WHERE vector_score >= 0.6",
        "sentiment_boost": f"""{p} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s2, 12) DESC, ord) AS INT) AS ord, doc_id, round(s2, 6) AS score
FROM (SELECT *, score * CASE sentiment WHEN 'positive' THEN 1.2 WHEN 'negative' THEN 0.8 ELSE 1.0 END AS s2 FROM hits)""",
        "aspect_detect": f"{p} SELECT doc_id, array_to_string(aspect_names, ',') AS detected FROM docs",
        "aspect_boost": f"{p} SELECT {SEVEN}, round(score, 6) AS score FROM boosted",
        "near_tie_flags": f"""{p} SELECT {SEVEN}, coalesce(abs(score - lag(score) OVER w) < 0.0002, false) OR coalesce(abs(score - lead(score) OVER w) < 0.0002, false) AS near_tie
FROM fused WINDOW w AS (PARTITION BY query_id ORDER BY ord)""",
        "time_decay": decayed_plain,
        "mmr_order": diverse("hits"),
        "filter_date_range": found + "date IS NULL OR (date >= TIMESTAMP '1996-03-01' AND date < TIMESTAMP '1999-07-01')",
        "filter_tools_any": found + "list_has_any(tools, ['fr', 'click'])",
        "filter_sentiment": found + "sentiment = 'positive' AND list_has_any(tools, ['en', 'purchase']) AND (date IS NULL OR date >= TIMESTAMP '1995-06-01')",
        "filter_source_post_limit": found + "source = 'src3'",
        "filter_subjectivity": found + "subjectivity = 'opinionated'",
        "filter_aspect": found + "len(list_filter(aspect_names, lambda a: contains(a, 'ux'))) > 0",
        "facet_tools": f"""{p}, seen AS (SELECT query_id, ord, unnest(range(1, len(tools) + 1)) AS pos, tools FROM hits)
SELECT query_id, tools[pos] AS value, count(*) AS count, CAST(row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, min(ord * 100 + pos)) AS INT) AS place FROM seen GROUP BY query_id, tools[pos]""",
        "facet_sentiment": value_facet("sentiment"),
        "facet_source": value_facet("source"),
        "facet_top10_source": value_facet("source", "WHERE place <= 10"),
        "corpus_stats": f"{p} SELECT 'total' AS facet, 'documents' AS value, count(*) AS count FROM docs UNION ALL {counted('unnest(tools)', 'tools')} UNION ALL {counted('sentiment', 'sentiment')} UNION ALL {counted('source', 'subreddit')}",
        "trend_day": trend("day"),
        "trend_week": trend("week"),
        "trend_month": trend("month"),
        "trend_after_upserts": trend("month"),
        "stats_after_upserts": f"{p} SELECT 'total' AS facet, 'documents' AS value, count(*) AS count FROM docs UNION ALL {counted('unnest(tools)', 'tools')} UNION ALL {counted('sentiment', 'sentiment')} UNION ALL {counted('source', 'subreddit')}",
        "trend_events_day": "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS count, round(avg(coalesce(value, 0)), 2) AS avg_upvotes FROM events WHERE ts IS NOT NULL GROUP BY 1",
        "trend_hybrid_threshold": trend("month", "(SELECT docs.* FROM vector_all JOIN docs USING (doc_id) WHERE score >= 0.55)"),
        "trend_keyword": trend("month", "(SELECT docs.* FROM keyword_all JOIN docs USING (doc_id))"),
        "trend_aspect": trend("month", "(SELECT * FROM docs WHERE len(list_filter(aspect_names, lambda a: contains(a, 'ux'))) > 0)"),
        "sentiment_chart": f"{p} SELECT sentiment AS value, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS share, {mapped('sentiment', SENTIMENT_LABELS)} AS label, {mapped('sentiment', SENTIMENT_COLORS)} AS color FROM docs GROUP BY sentiment",
        "sentiment_share": f"{p} SELECT sentiment AS value, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS share, {mapped('sentiment', SENTIMENT_LABELS)} AS label FROM docs GROUP BY sentiment",
        "word_cloud_top60": f"""{p}, w AS (
  SELECT query_id, CASE WHEN round(vector_score, 4) > 0 THEN 1 + round(vector_score, 4) ELSE 1.0 END AS w, unnest({tokens(f"title || ' ' || ({SNIPPET})")}) AS word FROM hits WHERE ord <= 50
), sums AS (
  SELECT query_id, word, round(sum(w), 6) AS weight FROM w WHERE length(word) >= 3 AND NOT regexp_full_match(word, '[0-9]+') AND word NOT IN ({quoted(CLOUD_STOP_WORDS)}) GROUP BY query_id, word
), placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, word) AS INT) AS place FROM sums)
SELECT query_id, word, CAST(floor(weight + 0.5) AS BIGINT) AS weight, place, CASE WHEN weight / max(weight) OVER w > 0.6 THEN 1 WHEN weight / max(weight) OVER w > 0.3 THEN 2 ELSE 3 END AS tier
FROM placed WHERE place <= 60 WINDOW w AS (PARTITION BY query_id)""",
        "suggest_titles": f"""{p}, head AS (
  SELECT k.query_id, k.ord, coalesce(nullif(trim(title), ''), CASE WHEN length(trim(text)) > 80 THEN trim(text)[1:80] || '...' ELSE trim(text) END) AS full_ FROM keyword k JOIN docs USING (doc_id) WHERE k.ord <= 8
), firsts AS (SELECT query_id, full_, min(ord) AS ord FROM head WHERE full_ <> '' GROUP BY query_id, full_)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY ord) AS INT) AS place, CASE WHEN length(full_) > 80 THEN full_[1:80] || '...' ELSE full_ END AS suggestion FROM firsts""",
        "spell_candidates": spelling(),
        "snippet_enrich": f"SELECT doc_id, {SNIPPET} AS snippet FROM documents",
        "paginate": f"{p} SELECT {SEVEN} FROM fused WHERE ord BETWEEN 15 AND 21",
        "page_counts": f"{p} SELECT query_id, count(*) AS total_count, (count(*) + 9) // 10 AS total_pages FROM fused GROUP BY query_id",
        "doc_lookup": "SELECT * FROM documents WHERE doc_id = 42",
        "match_all": f"{p} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS INT) AS ord, doc_id FROM docs, asked",
        "phrase_and_must_terms": f"""{p} SELECT doc_id FROM told WHERE field = 'text' AND list_contains(toks, 'version') AND NOT list_contains(toks, 'apache') AND contains(' ' || array_to_string(toks, ' ') || ' ', ' general public ')""",
        "health_counts": f"""{p} SELECT 'documents' AS component, count(*) AS rows, CASE WHEN count(*) > 0 THEN 'healthy' ELSE 'unhealthy' END AS status FROM docs
UNION ALL SELECT 'vectors', count(*), CASE WHEN count(*) > 0 THEN 'healthy' ELSE 'unhealthy' END FROM docs WHERE vector IS NOT NULL""",
        "upsert_latest": """WITH latest AS (SELECT user_id AS doc_id, arg_max(value, event_id) AS score, max(event_id) + 1 AS version FROM events GROUP BY user_id)
SELECT * FROM latest UNION ALL SELECT event_id AS doc_id, value AS score, CAST(0 AS BIGINT) AS version FROM events WHERE NOT EXISTS (SELECT 1 FROM latest WHERE doc_id = event_id)""",
        "combine_text": r"""SELECT doc_id, coalesce(nullif(regexp_replace(concat_ws(' ', nullif(split_part(text, '.', 1), ''), nullif(chr(10) || ' ' || text, ''), nullif(source, '')), '^\s+|\s+$', '', 'g'), ''), '[No text content]') AS combined FROM documents""",
        "aspect_normalise": """SELECT event_id, array_to_string(list_transform(json_keys(props), lambda k: k || ':' || json_extract_string(props, k)), ',') AS from_object, event_type || ',x' AS from_list, '' AS from_text FROM events""",
        "aspect_parse": f"""{p} SELECT doc_id, unnest(list_concat(aspect_names, ['plain', 'a'])) AS name, unnest(list_concat(list_transform(aspect_names, lambda a: sentiment), [NULL, 'b:c'])) AS polarity FROM docs""",
        "text_norm_tokens": f"SELECT token, count(*) AS n FROM (SELECT unnest({tokens('text')}) AS token FROM documents) GROUP BY token",
        "index_build": f"{p}, every AS (SELECT field, doc_id, unnest(toks) AS term FROM told) SELECT term, field, count(DISTINCT doc_id) AS df, any_value(n_docs) AS n_docs, round(any_value(avgdl), 6) AS avgdl FROM every JOIN stats USING (field) GROUP BY term, field",
        "tool_display_names": f"{p} SELECT tool, {mapped('tool', TOOL_NAMES)} AS name FROM (SELECT DISTINCT unnest(list_concat(tools, ['claude_code', 'v0'])) AS tool FROM docs)",
    }
