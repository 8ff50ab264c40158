"""DuckDB SQL for the queries, written from the formulas."""

from __future__ import annotations

import math

from corvane.functions.text import ABBREVIATIONS, DESCRIBE_STOPWORDS, STOPWORDS
from corvane.operators.embed import PRICING
from corvane.plans.queries import DIMS, FIXED_CENTROIDS, GATES, IDENTIFIERS, NOW, QUERY_TEXT, QUERY_VECTOR


def q(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def vec(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


QV = vec(QUERY_VECTOR)


def tok(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(regexp_replace({x}, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: length(w) >= 2 AND NOT list_contains({q(STOPWORDS)}, w))"


def norm(v: str) -> str:
    return f"sqrt(list_sum(list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE)))"


def unit(v: str) -> str:
    return f"(CASE WHEN {norm(v)} > 0 THEN list_transform({v}, lambda x: x::DOUBLE / {norm(v)}) ELSE {v}::DOUBLE[] END)"


def dot(a: str, b: str) -> str:
    return f"list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"


def cos(a: str, b: str) -> str:
    return f"coalesce({dot(a, b)} / nullif({norm(a)} * {norm(b)}, 0), 0)"


SUMMARY = f"round(list_sum(v), 6) AS total, round({norm('v')}, 6) AS norm, len(v)::INTEGER AS dims"

# BM25 over a relation docs(id, text) and queries asked(query_id, text).
BM25 = f"""
tokens AS (SELECT id, {tok("text")} AS w FROM docs),
corpus AS (SELECT count(*) AS n, coalesce(avg(len(w)), 0) AS avg_length FROM tokens),
postings AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM tokens) GROUP BY ALL),
terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
qterms AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tok("text")}) AS term FROM asked) GROUP BY ALL),
scores AS (
  SELECT query_id, p.id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg_length))) AS score
  FROM qterms JOIN terms USING (term) JOIN postings p USING (term) JOIN tokens t ON t.id = p.id, corpus GROUP BY ALL HAVING score > 0
)"""
ALL = "WITH docs AS (SELECT doc_id AS id, text FROM documents), asked AS (SELECT item_id AS query_id, text FROM benchmark)," + BM25
RANKED = ", ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scores)"

FUSED = f"""
WITH docs AS (SELECT doc_id AS id, text, lang, embedding FROM documents JOIN embeddings ON doc_id = vec_id),
asked AS (SELECT 0 AS query_id, '{QUERY_TEXT}' AS text),{BM25},
fused AS (
  SELECT d.id, {cos("embedding", QV)} AS cosine, coalesce(s.score, 0) AS bm25, (SELECT coalesce(max(score), 1) FROM scores) AS bm25_max
  FROM docs d LEFT JOIN scores s ON s.id = d.id
), boosted AS (
  SELECT f.*, 0.1 * coalesce(quality, 0) AS quality_boost, -0.25 * coalesce(toxic, 0) AS toxic_boost FROM fused f LEFT JOIN labels l ON l.doc_id = f.id
)"""
LEX = "(CASE WHEN bm25_max > 0 THEN bm25 / bm25_max ELSE 0 END)"
FUSED_SCORE = f"0.7 * cosine + 0.3 * {LEX}"
BOOST_SCORE = f"0.7 * (cosine + quality_boost + toxic_boost) + 0.3 * {LEX}"


def centroids(side: bool = False) -> str:
    more = ", side" if side else ""
    pick = ", CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END AS side" if side else ""
    return f"""SELECT id{more}, list(x ORDER BY pos) AS embedding FROM (
      SELECT id{more}, pos, avg(x::DOUBLE) AS x FROM (SELECT label::VARCHAR AS id{pick}, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL) GROUP BY ALL"""


MATRIX = f"WITH c AS ({centroids()}), matrix AS (SELECT c.id AS a_id, e.vec_id AS b_id, {dot(unit('c.embedding'), unit('e.embedding'))} AS similarity FROM c, embeddings e)"


def silhouette(sample: int, most: int) -> str:
    def taken(n, i, m):
        return f"({n} <= {m} OR (ceil({i} / ({n} / {m}.0::DOUBLE)) < {m} AND floor(ceil({i} / ({n} / {m}.0::DOUBLE)) * ({n} / {m}.0::DOUBLE)) = {i}))"

    return f"""
WITH base AS (
  SELECT vec_id, label, {unit("embedding")} AS v, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS j, count(*) OVER (PARTITION BY label) AS m FROM embeddings
), means AS (
  SELECT p.vec_id, p.label, o.label AS other, avg(1 - {dot("p.v", "o.v")}) AS d
  FROM base p JOIN base o ON p.vec_id <> o.vec_id WHERE {taken("p.n", "p.i", sample)} AND {taken("o.m", "o.j", most)} GROUP BY ALL
), ab AS (
  SELECT vec_id, coalesce(min(d) FILTER (label = other), 0) AS a, min(d) FILTER (label <> other) AS b FROM means GROUP BY vec_id
)
SELECT round(coalesce(avg(CASE WHEN b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 0), 6) AS silhouette FROM ab"""


def classified(votes: str) -> str:
    up = ", ".join(f"('p{i}', {vec(FIXED_CENTROIDS[i])}, NULL)" for i in range(3))
    return f"""
WITH lab AS (
  SELECT id::INTEGER * 2 + side AS ord, {unit("embedding")} AS u, [id, 'p' || (id::INTEGER % 3), 'unknown'] AS ids FROM ({centroids(True)})
), known AS (
  SELECT id AS cluster, {unit("embedding")} AS centroid, 0.9 AS threshold FROM ({centroids()})
  UNION ALL SELECT a, {unit("b")}, c FROM (VALUES {up}) AS x(a, b, c)
), cand AS (SELECT vec_id, {unit("embedding")} AS v FROM embeddings
), near AS (
  SELECT vec_id, ids, row_number() OVER (PARTITION BY vec_id ORDER BY {dot("v", "u")} DESC, ord) AS rank FROM cand, lab
), votes AS (
  SELECT vec_id, rank, unnest(list_zip(voted, range(len(voted))), recursive := true) FROM (SELECT vec_id, rank, {votes} AS voted FROM near WHERE rank <= 5)
), named AS (SELECT vec_id, rank, #3 AS cluster, #4 AS pos FROM (SELECT * FROM votes)
), tally AS (
  SELECT vec_id, cluster, count(*) AS votes, min(rank * 100 + pos) AS first FROM named WHERE cluster IN (SELECT cluster FROM known) GROUP BY ALL
), won AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, first) AS place, sum(votes) OVER (PARTITION BY vec_id) AS total_votes FROM tally
), out AS (
  SELECT c.vec_id, w.cluster, w.votes, w.total_votes, 1 - {dot("c.v", "k.centroid")} AS distance, coalesce(k.threshold, 'infinity'::DOUBLE) AS threshold
  FROM cand c LEFT JOIN won w ON w.vec_id = c.vec_id AND place = 1 LEFT JOIN known k ON k.cluster = w.cluster
)
SELECT vec_id, CASE WHEN distance <= threshold THEN cluster END AS cluster_id, round(coalesce(distance, 'infinity'::DOUBLE), 6) AS distance,
       coalesce(votes, 0)::BIGINT AS votes, coalesce(total_votes, 0)::BIGINT AS total_votes, coalesce(distance <= threshold, false) AS accepted FROM out"""


def best_of(ranks: dict[str, float]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in ranks.items())
    ranked = f"list_filter(list_transform(ids, lambda x: CASE x {cases} END), lambda r: r IS NOT NULL)"
    return f"CASE WHEN len({ranked}) = 0 THEN [] ELSE [ids[list_position(list_transform(ids, lambda x: CASE x {cases} END), list_max({ranked}))]] END"


DISTANCES = f"WITH c AS ({centroids()}), found AS (SELECT label, vec_id, 1 - {dot(unit('e.embedding'), unit('c.embedding'))} AS distance FROM embeddings e JOIN c ON c.id = e.label::VARCHAR)"

RUNS = (
    ALL
    + RANKED
    + """, top AS (
  SELECT r.*, l.doc_id IS NOT NULL AS good FROM ranked r LEFT JOIN labels l ON l.doc_id = r.id AND quality = 1 AND toxic = 0 WHERE rank <= 20
), lists AS (
  SELECT query_id, list(id ORDER BY rank) FILTER (rank <= 10) AS returned, list(id ORDER BY rank) FILTER (good) AS expected FROM top GROUP BY query_id
), runs AS (
  SELECT a.query_id, coalesce(returned, []) AS returned, coalesce(expected, []) AS expected FROM asked a LEFT JOIN lists USING (query_id)
), hits AS (
  SELECT *, len(list_filter(returned[1:5], lambda x: list_contains(expected, x))) AS hits5, len(list_filter(expected, lambda x: list_contains(returned, x))) AS found,
         list_min(list_filter(list_transform(range(1, len(returned) + 1), lambda i: CASE WHEN list_contains(expected, returned[i]) THEN i END), lambda i: i IS NOT NULL)) AS first,
         coalesce(list_sum(list_transform(range(1, least(10, len(returned)) + 1), lambda i: CASE WHEN list_contains(expected, returned[i]) THEN 1 / log2(i + 1) ELSE 0 END)), 0) AS dcg,
         list_sum(list_transform(range(1, greatest(1, least(10, len(expected))) + 1), lambda i: 1 / log2(i + 1))) AS idcg,
         CASE WHEN len(returned) = 0 THEN 1.0 ELSE 0.0 END AS nothing, len(expected) = 0 AS none FROM runs
), scored AS (
  SELECT query_id, CASE WHEN none THEN nothing ELSE hits5 / 5.0 END AS precision, CASE WHEN none THEN nothing ELSE hits5 / least(5, len(expected))::DOUBLE END AS hit_rate,
         CASE WHEN none THEN nothing ELSE found / len(expected)::DOUBLE END AS recall, CASE WHEN none THEN nothing ELSE coalesce(1.0::DOUBLE / first, 0) END AS mrr,
         CASE WHEN none THEN nothing ELSE dcg / idcg END AS ndcg FROM hits
)"""
)
METRICS = ("precision", "hit_rate", "recall", "mrr", "ndcg")
SUMMARY_SQL = RUNS + ", summary AS (SELECT count(*) AS n_queries, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS) + " FROM scored)"

HASH = r"sha256(lower(regexp_replace(regexp_replace(text, '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g'), '[\t\n\x0B\f\r ]+', ' ', 'g')))"
STORED = f"stored AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'stale' ELSE {HASH} END AS content_hash FROM documents WHERE doc_id % 7 <> 0)"
SHOULD = f"WITH {STORED}, judged AS (SELECT d.doc_id, {HASH} AS hash, coalesce({HASH} <> s.content_hash, true) AS should_embed FROM documents d LEFT JOIN stored s ON s.doc_id = d.doc_id)"


def price(i: int) -> str:
    return "CASE model " + " ".join(f"WHEN '{m}' THEN {p[i]}" for m, p in PRICING.items() if p[i] is not None) + " ELSE 0 END"


COST = f"""WITH calls AS (
  SELECT event_id, event_type AS operation, {q([*PRICING, "unlisted"])}[user_id % 5 + 1] AS model, floor(abs(value) * 10)::BIGINT AS tokens_in, floor(abs(value) * 3)::BIGINT AS tokens_out, ts AS created_at FROM events
), costs AS (SELECT *, (tokens_in * {price(0)}::DOUBLE + tokens_out * {price(1)}::DOUBLE) / 1000000 AS cost_usd FROM calls)"""
JOBS = "WITH jobs AS (SELECT event_id AS id, CASE WHEN value < 20 THEN 'pending' WHEN value < 60 THEN 'running' ELSE 'done' END AS status, ts AS updated_at FROM events)"
_ABBR = "CASE lower(p) " + " ".join(f"WHEN '{k}' THEN {q(v.split())}" for k, v in ABBREVIATIONS.items()) + " ELSE [] END"
_EXTRA = " ".join(f"UNION ALL SELECT {-1 - i}, '{x}'" for i, x in enumerate(IDENTIFIERS))


def nearest_sql() -> str:
    unit_c = [[x / math.sqrt(sum(y * y for y in c)) for x in c] for c in FIXED_CENTROIDS]
    rows = ", ".join(f"({i}, {vec(c)})" for i, c in enumerate(unit_c))
    return f"""WITH c(cluster_id, c) AS (VALUES {rows}), d AS (SELECT vec_id, cluster_id, 1 - {dot(unit("embedding"), "c")} AS distance FROM embeddings, c)
SELECT vec_id, arg_min(cluster_id, distance)::INTEGER AS cluster_id, round(min(distance), 6) AS distance FROM d GROUP BY vec_id"""


TERMS_W = f"list_concat(list_transform({tok('text')}, lambda t: {{'t': t, 'w': 1.0}}), list_transform({tok('lang')}, lambda t: {{'t': t, 'w': 0.1}}))"
ANOU = "list_sum(list_transform(list_filter(ws, lambda x: x.t = 'anou'), lambda x: x.w))"

# The terms of each article, each once, in order of their first place.
TERM_LISTS = f"""SELECT doc_id AS article_id, string_agg(w || '=' || length(w), ';' ORDER BY p) AS terms FROM documents LEFT JOIN (
  SELECT doc_id, w, min(p) AS p FROM (SELECT doc_id, unnest({tok("text")}) AS w, generate_subscripts({tok("text")}, 1) AS p FROM documents) GROUP BY ALL
) USING (doc_id) GROUP BY doc_id"""
NEED = "ceil(length(coalesce(text, '')) / 1.5::DOUBLE)::BIGINT"

ORACLES = {
    "tokenize_terms": f"SELECT doc_id, len({tok('text')})::INTEGER AS n_terms, array_to_string({tok('text')}, ' ') AS terms FROM documents",
    "bm25_corpus_stats": ALL + " SELECT n, round(avg_length, 6) AS avg_length FROM corpus",
    "bm25_term_df": ALL + " SELECT term, df FROM terms",
    "bm25_postings": ALL + " SELECT id, term, tf FROM postings",
    "bm25_score": ALL + " SELECT query_id, id, round(score, 6) AS score FROM scores",
    "bm25_batch_topk": ALL + RANKED + " SELECT query_id, id, rank::INTEGER AS rank, round(score, 6) AS score FROM ranked WHERE rank <= 5",
    "bm25_normalized": ALL + " SELECT query_id, id, round(max(score) OVER w, 6) AS best, round(score / max(score) OVER w, 6) AS normalized FROM scores WINDOW w AS (PARTITION BY query_id)",
    "query_expand": f"""
WITH asked AS (SELECT item_id, text FROM benchmark {_EXTRA}),
terms AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) AS t, generate_subscripts(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> ''), 1) AS i FROM asked),
parts AS (SELECT item_id, i, t, string_split(regexp_replace(t, '([a-z])([A-Z])', '\\1 \\2', 'g'), ' ') AS ps FROM terms),
more AS (SELECT item_id, i, unnest(CASE WHEN len(ps) > 1 THEN list_append(ps, t) ELSE [t] END) AS p, generate_subscripts(CASE WHEN len(ps) > 1 THEN list_append(ps, t) ELSE [t] END, 1) AS j FROM parts),
words AS (SELECT item_id, i, j, unnest(list_concat([p], {_ABBR})) AS w, generate_subscripts(list_concat([p], {_ABBR}), 1) AS k FROM more),
firsts AS (SELECT item_id, lower(w) AS lw, arg_min(w, i * 1000000 + j * 1000 + k) AS w, min(i * 1000000 + j * 1000 + k) AS pos FROM words GROUP BY ALL),
joined AS (SELECT item_id, string_agg(w, ' ' ORDER BY pos) AS expanded FROM firsts GROUP BY item_id)
SELECT a.item_id, coalesce(expanded, '') AS expanded FROM asked a LEFT JOIN joined USING (item_id)""",
    "top_terms_by_lang": f"""
WITH tokens AS (SELECT lang, doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 2 AND NOT list_contains({q(DESCRIBE_STOPWORDS)}, w)) AS ws FROM documents),
spots AS (SELECT lang, doc_id, unnest(ws) AS term, generate_subscripts(ws, 1) AS pos FROM tokens),
once AS (SELECT lang, doc_id, term, min(pos) AS pos FROM spots GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang, doc_id ORDER BY pos) AS place FROM once),
counted AS (SELECT lang, term, count(*) AS df, arg_min(place, doc_id) AS place, min(doc_id) AS first FROM placed GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY df DESC, first, place)::INTEGER AS rank FROM counted)
SELECT lang, term, df, rank FROM ranked WHERE rank <= 20""",
    "query_rewrite": """
WITH turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)
SELECT conv_id, turn, role, concat_ws(' ', lag(text, 2) OVER w, lag(text) OVER w, text) AS rewritten FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text)""",
    "embedding_dims": "SELECT vec_id, len(embedding)::INTEGER AS dims FROM embeddings",
    "content_hash_dups": f"SELECT {HASH} AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "sanitize_text": "WITH r AS (SELECT doc_id, CASE WHEN text = '' THEN ' ' ELSE substr(text, 1, 4000) END AS c FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1, '')) SELECT doc_id, length(c)::INTEGER AS n_chars, sha256(c) AS digest FROM r",
    "hash_path": "SELECT page_id, substr(sha256(url), 1, 16) AS path_hash FROM pages",
    "l2_normalize": f"SELECT vec_id, {SUMMARY} FROM (SELECT vec_id, {unit('embedding')} AS v FROM embeddings)",
    "matryoshka_truncate": f"SELECT vec_id, {SUMMARY} FROM (SELECT vec_id, {unit('embedding[1:16]')} AS v FROM embeddings)",
    "cosine_pairs": f"SELECT a.vec_id, round({cos('a.embedding', 'b.embedding')}, 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "knn_topk": f"WITH r AS (SELECT q.vec_id AS query_id, e.vec_id, 1 - {cos('e.embedding', 'q.embedding')} AS distance FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM r) SELECT query_id, vec_id, rank, round(distance, 6) AS distance FROM n WHERE rank <= 5",
    "rank_by_vector": f"SELECT vec_id, round(s, 6) AS similarity FROM (SELECT vec_id, {cos('embedding', QV)} AS s FROM embeddings WHERE embedding IS NOT NULL) WHERE s > 0 ORDER BY s DESC, vec_id LIMIT 20",
    "conditional_similarity": f"SELECT doc_id, round(CASE WHEN embedding IS NULL THEN 0 ELSE {cos('embedding', QV)} END, 6) AS similarity FROM documents LEFT JOIN embeddings ON doc_id = vec_id",
    "point_distance": f"SELECT vec_id, round(1 - {cos('embedding', QV)}, 6) AS distance FROM embeddings",
    "knn_l2_join": f"WITH n AS (SELECT vec_id, list_distance(embedding::DOUBLE[], {QV}) AS x FROM embeddings ORDER BY x, vec_id LIMIT 25) SELECT doc_id, lang, round(x, 6) AS distance FROM n JOIN documents ON doc_id = vec_id",
    "embedding_codec_roundtrip": "SELECT vec_id, (4 * len(embedding))::INTEGER AS n_bytes, 0.0::DOUBLE AS worst FROM embeddings",
    "similarity_matrix": MATRIX + " SELECT a_id, b_id, round(similarity, 6) AS similarity FROM matrix",
    "find_threshold": MATRIX + " SELECT round(CASE WHEN 100 >= (SELECT count(*) FROM matrix) THEN 0 ELSE (SELECT min(similarity) FROM (SELECT similarity FROM matrix ORDER BY similarity DESC LIMIT 100)) END, 6) AS threshold",
    "pairs_above_threshold": MATRIX + " SELECT a_id, b_id, round(similarity, 6) AS similarity FROM matrix WHERE similarity >= 0.2",
    "hybrid_score": FUSED + f" SELECT id, round(cosine, 6) AS cosine, round(bm25, 6) AS bm25, round({FUSED_SCORE}, 6) AS score FROM fused ORDER BY score DESC, id LIMIT 20",
    "hybrid_boosts": FUSED + f" SELECT id, round({BOOST_SCORE}, 6) AS score FROM boosted",
    "hybrid_explain_parts": FUSED + f" SELECT id, round(cosine, 6) AS cosine, round({LEX}, 6) AS normalized_bm25, round(quality_boost, 6)::DOUBLE AS quality_boost, round(toxic_boost, 6)::DOUBLE AS toxic_boost, round({BOOST_SCORE}, 6) AS final_score FROM boosted",
    "hybrid_formula_text": FUSED + f" SELECT id, printf('(1-0.3)*(%.3f+%.3f)+0.3*%.3f=%.3f', cosine::DOUBLE, (quality_boost + toxic_boost)::DOUBLE, {LEX}::DOUBLE, ({BOOST_SCORE})::DOUBLE) AS formula FROM boosted",
    "rerank_boosts": FUSED + f" SELECT f.id, round({FUSED_SCORE} + 0.5 * coalesce(quality, 0) + coalesce(n_chars, 0) / 100000.0::DOUBLE, 6) AS final_score FROM fused f LEFT JOIN labels l ON l.doc_id = f.id LEFT JOIN documents d ON d.doc_id = f.id",
    "fts_and_match": f"SELECT doc_id, lang FROM documents WHERE list_has_all({tok('text')}, ['anou', 'eran'])",
    "fts_websearch": f"WITH d AS (SELECT doc_id, lang, ' ' || array_to_string({tok('text')}, ' ') || ' ' AS s FROM documents) SELECT doc_id, lang FROM d WHERE (contains(s, ' anou ') AND contains(s, ' ed ')) OR (contains(s, ' eran ') AND NOT contains(s, ' tionan '))",
    "fts_hybrid_rank": f"""
WITH c AS (SELECT doc_id AS id, {cos("embedding", QV)} AS similarity, {TERMS_W} AS ws FROM documents JOIN embeddings ON doc_id = vec_id),
r AS (SELECT id, similarity, {ANOU} / (1 + ln(1 + {ANOU})) AS text_rank FROM c WHERE {ANOU} > 0),
s AS (SELECT *, 0.7 * similarity + 0.3 * text_rank / greatest(max(text_rank) OVER (), 1e-9) AS score FROM r)
SELECT id, round(similarity, 6) AS similarity, round(text_rank, 6)::DOUBLE AS text_rank, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 20""",
    "kmeans_assign_step": nearest_sql(),
    "kmeans_update_step": f"""
WITH a AS ({nearest_sql()}),
m AS (SELECT cluster_id, pos, avg(x) AS x FROM (SELECT cluster_id, unnest({unit("embedding")}) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings JOIN a USING (vec_id)) GROUP BY ALL)
SELECT cluster_id, pos::INTEGER AS "at", round(x / sqrt(sum(x * x) OVER (PARTITION BY cluster_id)), 6) AS x FROM m""",
    "silhouette_exact": silhouette(10**12, 10**12),
    "silhouette_sampled": silhouette(100, 20),
    "silhouette_packed": silhouette(150, 30).replace(", 6) AS silhouette", ", 4) AS silhouette"),
    "classify_vote_all": classified("ids"),
    "classify_vote_subset": classified("list_filter(ids, lambda x: x IN ('p0', 'p1', '3'))"),
    "classify_vote_deepest": classified(best_of({"p0": 1, "p1": 1, "p2": 1, **{str(i): 2 for i in range(5)}})),
    "classify_vote_specific": classified(best_of({"p0": 0.5, "p1": 0.9, **{str(i): 0.7 for i in range(10)}})),
    "sample_near_centroid": DISTANCES + ", r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id)::INTEGER AS rank FROM found) SELECT label, vec_id, rank, round(distance, 6) AS distance FROM r WHERE rank <= 5",
    "sample_at_mode": DISTANCES
    + """, shape AS (SELECT label, count(*) AS size, min(distance) AS low, max(distance) - min(distance) AS span, least(20, ceil(count(*) / 5.0)) AS bins FROM found GROUP BY label),
b AS (SELECT f.*, size, low, span / bins AS width, least(floor((distance - low) / nullif(span / bins, 0)), bins - 1) AS bin FROM found f JOIN shape USING (label)),
held AS (SELECT label, bin, count(*) AS h FROM b GROUP BY ALL), peak AS (SELECT label, arg_min(bin, -h * 1000 + bin) AS peak FROM held GROUP BY label),
g AS (SELECT b.*, CASE WHEN size <= 10 OR width = 0 THEN 0 ELSE abs(distance - (low + (peak + 0.5) * width)) END AS gap FROM b JOIN peak USING (label)),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY gap, distance, vec_id) AS rank FROM g)
SELECT label, vec_id, round(distance, 6) AS distance FROM r WHERE rank <= 10""",
    **{f"eval_{n}": RUNS + f" SELECT query_id, round({m}, 6)::DOUBLE AS {m} FROM scored" for n, m in zip(("precision", "hitrate", "recall", "mrr", "ndcg"), METRICS, strict=True)},
    "eval_summary": SUMMARY_SQL + " SELECT * FROM summary",
    "eval_gates": SUMMARY_SQL + f", long AS (UNPIVOT summary ON {', '.join(METRICS)} INTO NAME metric VALUE actual), gates(metric, threshold) AS (VALUES {', '.join(f'({m!r}, {x}::DOUBLE)' for m, x in GATES)}) SELECT metric, threshold, actual, actual >= threshold AS passed FROM gates JOIN long USING (metric)",
    "dedup_should_embed": SHOULD + " SELECT * FROM judged",
    "dedup_mark": SHOULD + " SELECT s.doc_id, CASE WHEN should_embed THEN hash ELSE content_hash END AS content_hash FROM stored s JOIN judged USING (doc_id)",
    "embed_batches_fixed": "WITH n AS (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 64 AS batch FROM documents) SELECT source, batch, count(*) AS n, min(doc_id) AS first_id FROM n GROUP BY ALL",
    "embed_batches_budget": f"""
WITH RECURSIVE n AS (SELECT source, doc_id, {NEED} AS need, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
walk AS (
  SELECT source, doc_id, r, 0::BIGINT AS batch, 1::BIGINT AS items, need AS used FROM n WHERE r = 1
  UNION ALL
  SELECT n.source, n.doc_id, n.r, CASE WHEN items >= 256 OR used + need > 200000 THEN batch + 1 ELSE batch END,
         CASE WHEN items >= 256 OR used + need > 200000 THEN 1 ELSE items + 1 END, CASE WHEN items >= 256 OR used + need > 200000 THEN need ELSE used + need END
  FROM walk JOIN n ON n.source = walk.source AND n.r = walk.r + 1
)
SELECT source, batch, count(*) AS n, min(doc_id) AS first_id FROM walk GROUP BY ALL""",
    "cost_per_event": COST + " SELECT event_id, model, round(cost_usd, 9) AS cost_usd FROM costs",
    "cost_ledger": COST + " SELECT operation, model, count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in, round(sum(cost_usd), 6) AS cost_usd FROM costs GROUP BY ALL",
    "cost_summary": COST + " SELECT operation, model, count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(sum(cost_usd), 6) AS cost_usd FROM costs GROUP BY ALL",
    "cost_cap": COST + f" SELECT round(coalesce(sum(cost_usd), 0), 6) AS spent, coalesce(sum(cost_usd), 0) >= 0.0001 AS exceeded FROM costs WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 60 MINUTES",
    "cost_projection": "SELECT source, round(count(*) * (avg(n_chars) / 4) * 0.13 / 1000000, 9) AS large, round(count(*) * (avg(n_chars) / 4) * 0.02 / 1000000, 9) AS fallback FROM documents GROUP BY source",
    "usage_totals": "SELECT conv_id, coalesce(sum(length(text)) FILTER (role = 'user'), 0)::BIGINT AS input_tokens, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS output_tokens FROM conversations GROUP BY conv_id",
    "ensure_cached": "SELECT doc_id AS id, CASE WHEN hit THEN 'c' ELSE 'g' END || length(text) AS value, hit FROM (SELECT *, doc_id % 3 <> 0 AND doc_id % 4 <> 0 AS hit FROM documents)",
    "cas_update": JOBS + " SELECT id, CASE WHEN id % 2 = 0 AND status = 'pending' THEN 'running' ELSE status END AS status, id % 2 = 0 AND status = 'pending' AS updated FROM jobs",
    "detect_orphans": JOBS + f" SELECT id, status FROM jobs WHERE status IN ('pending', 'running') AND updated_at < TIMESTAMP '{NOW}' - INTERVAL 86400500 MILLISECONDS",
    "pipeline_run_log": """SELECT event_id AS id, event_type AS run_type, CASE WHEN user_id % 4 = 0 THEN 'running' WHEN user_id % 5 = 0 THEN 'failed' ELSE 'completed' END AS status,
CASE WHEN user_id % 4 <> 0 THEN 90000::BIGINT END AS duration_ms, CASE WHEN user_id % 4 <> 0 THEN 10::BIGINT END AS records_processed, CASE WHEN user_id % 4 <> 0 THEN 7::BIGINT END AS records_created,
CASE WHEN user_id % 4 <> 0 THEN 1::BIGINT END AS records_failed, CASE WHEN user_id % 4 <> 0 AND user_id % 5 = 0 THEN 'boom' END AS error_message FROM events""",
    "glossary_find_save": f"WITH w AS ({TERM_LISTS}) SELECT article_id, terms FROM w UNION ALL SELECT -5, NULL",
    "ensure_terms": f"WITH w AS ({TERM_LISTS}) SELECT article_id, CASE WHEN article_id % 3 = 0 THEN 'held=4' ELSE terms END AS terms, article_id % 3 <> 0 AND terms IS NOT NULL AS generated FROM w UNION ALL SELECT -5, NULL, false",
    "description_find_save": """SELECT doc_id AS article_id, '{"lang":"' || lang || '","n_chars":' || n_chars || '}' AS description FROM documents UNION ALL SELECT -5, NULL""",
    "ensure_description": """SELECT doc_id AS article_id, CASE WHEN doc_id % 4 <> 0 AND doc_id % 3 = 0 THEN 'held' ELSE '{"lang":"' || lang || '","n_chars":' || n_chars || '}' END AS description, doc_id % 4 = 0 OR doc_id % 3 <> 0 AS generated FROM documents""",
    "batch_poll": JOBS + " SELECT id, CASE WHEN status = 'done' THEN 'ended' ELSE 'in_progress' END AS status, status = 'done' AS done FROM jobs",
    "batch_results": "WITH r AS (SELECT event_id, user_id % 4 = 0 AS bad, user_id % 5 = 0 AS broken, props FROM events) SELECT event_id AS custom_id, CASE WHEN bad THEN 'error' WHEN broken THEN 'unparsed' ELSE 'data' END AS outcome, CASE WHEN NOT bad AND NOT broken THEN json_extract_string(props, '$.k') END AS k FROM r",
    "sql_params": "SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 30 AND l_discount <= 10 GROUP BY l_returnflag",
    "sql_cte": "WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders WHERE o_totalprice >= 1000 GROUP BY o_custkey) SELECT c_nationkey, count(*) AS n, round(max(total), 2) AS most FROM spent JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey",
    "file_formats": "SELECT n_nationkey, n_name, n_regionkey, kind FROM nation, (SELECT unnest(['parquet', 'orc', 'json', 'csv']) AS kind) WHERE n_regionkey >= 1",
    "sql_in_list": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice > 1000 GROUP BY o_orderpriority",
    "sql_in_empty": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE false GROUP BY o_orderpriority",
    "stream_upsert": "SELECT doc_id, lang, n_chars FROM documents UNION ALL SELECT unnest([-1, -2]), 'own', -1",
    "stream_cost_window": "WITH w AS (SELECT unnest(generate_series(time_bucket(INTERVAL 5 MINUTES, ts) - INTERVAL 55 MINUTES, time_bucket(INTERVAL 5 MINUTES, ts), INTERVAL 5 MINUTES)) AS window_start, value FROM events) SELECT window_start, round(sum(value), 6) AS spent, count(*) AS calls FROM w GROUP BY window_start",
}
assert DIMS == len(QUERY_VECTOR)
