"""One query per operator over the standard tables. Query vectors and texts are fixed literals; rows are never subset."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import metrics, text, vector
from corvane.operators import classify as kc
from corvane.operators import ann, cluster, embed, hybrid, lexical, ranking, state
from corvane.sources.sql import InList, SqlStore, files, tagged
from corvane import streaming

DIMS = 64
QUERY_VECTOR = [round(math.cos(1.7 * i) / 8, 6) for i in range(DIMS)]
QUERY_TEXT = "anou eran threble onou tionan heed oner anou"
FIXED_CENTROIDS = [[round(math.sin((c + 1) * (i + 1) * 0.7), 6) for i in range(DIMS)] for c in range(4)]
IDENTIFIERS = ["getUserAuth", "dbCfg msg", "ML reqCtx db DB", "fooBar FOO bar val", "", "HTTPServer utilFn"]
NOW = "2024-01-30 23:59:00"


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


def query_vector():
    return vector.literal(QUERY_VECTOR)


def scratch(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corvane-")
    return f"{base.rstrip('/')}/corvane/{name}-{uuid.uuid4().hex}"


def literals(spark, rows, schema):
    names = schema.split(", ")
    items = [F.struct(*(F.lit(v).cast(n.split()[1]).alias(n.split()[0]) for v, n in zip(row, names, strict=True))) for row in rows]
    return spark.range(1).select(F.inline(F.array(*items)))


# Lexical


def tokenize_terms(spark, d):
    tokens = text.tokenize(F.col("text"))
    return t(spark, d, "documents").select("doc_id", F.size(tokens).alias("n_terms"), F.array_join(tokens, " ").alias("terms"))


def _index(spark, d):
    return lexical.build_index(t(spark, d, "documents"), key="doc_id", path=scratch(spark, "bm25"))


def bm25_corpus_stats(spark, d):
    return _index(spark, d).corpus.select("n", r6("avg_length").alias("avg_length"))


def bm25_term_df(spark, d):
    return _index(spark, d).terms


def bm25_postings(spark, d):
    return _index(spark, d).postings


def _scores(spark, d):
    return lexical.score(_index(spark, d), t(spark, d, "benchmark"), key="item_id")


def bm25_score(spark, d):
    return _scores(spark, d).select("query_id", "id", r6("score").alias("score"))


def _ranked(scores, k):
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def bm25_batch_topk(spark, d):
    return _ranked(_scores(spark, d), 5).select("query_id", "id", "rank", r6("score").alias("score"))


def bm25_normalized(spark, d):
    path = scratch(spark, "scores")
    _scores(spark, d).write.parquet(path)  # read twice: for the best, and to be divided
    out = lexical.normalized(spark.read.parquet(path), t(spark, d, "benchmark"), key="item_id")
    return out.select("query_id", "id", r6("best").alias("best"), r6("normalized").alias("normalized"))


def query_expand(spark, d):
    extra = literals(spark, [(-1 - i, x) for i, x in enumerate(IDENTIFIERS)], "item_id bigint, text string")
    return t(spark, d, "benchmark").select("item_id", "text").unionByName(extra).select("item_id", text.expand_query(F.col("text")).alias("expanded"))


def query_rewrite(spark, d):
    """Each turn asked together with the two before it, abbreviations expanded."""
    turns = t(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("ord", F.struct("turn", "role", "text"))
    return text.rewrite_queries(turns, lambda q, earlier: F.concat_ws(" ", earlier, q), session="conv_id", order="ord", query="text", history=2).select("conv_id", "turn", "role", "rewritten")


def embedding_dims(spark, d):
    return t(spark, d, "embeddings").select("vec_id", F.size(vector.of_dims(F.col("embedding"), DIMS)).alias("dims"))


def top_terms_by_lang(spark, d):
    return lexical.top_terms(t(spark, d, "documents"), "lang")


def content_hash_dups(spark, d):
    hashed = t(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def sanitize_text(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "text").unionByName(literals(spark, [(-1, "")], "doc_id bigint, text string"))
    clean = text.sanitize(F.col("text"))
    return rows.select("doc_id", F.length(clean).alias("n_chars"), F.sha2(clean, 256).alias("digest"))


def hash_path(spark, d):
    return t(spark, d, "pages").select("page_id", text.hash_path(F.col("url")).alias("path_hash"))


# Vectors


def _summary(v):
    return [r6(F.aggregate(v, F.lit(0.0), lambda s, x: s + x)).alias("total"), r6(vector.norm(v)).alias("norm"), F.size(v).alias("dims")]


def l2_normalize(spark, d):
    return t(spark, d, "embeddings").select("vec_id", vector.normalize(F.col("embedding")).alias("v")).select("vec_id", *_summary(F.col("v")))


def matryoshka_truncate(spark, d):
    return t(spark, d, "embeddings").select("vec_id", vector.truncate_and_normalize(F.col("embedding"), 16).alias("v")).select("vec_id", *_summary(F.col("v")))


def cosine_pairs(spark, d):
    e = t(spark, d, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", r6(vector.cosine_similarity(F.col("embedding"), F.col("other"))).alias("similarity"))


def _centroids(spark, d, *more):
    """Means of the vectors of each label (and more): a few rows, whatever the size."""
    e = t(spark, d, "embeddings").select(F.col("label").cast("string").alias("id"), *more, F.posexplode("embedding").alias("at", "x"))
    names = ["id", *(m if isinstance(m, str) else "side" for m in more)]
    means = e.groupBy(*names, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(*names).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("embedding"))


def knn_topk(spark, d):
    """Every row whose id is divisible by 50 against all rows, in blocks."""
    out = ranking.knn_blocks(t(spark, d, "embeddings"), F.col("vec_id") % 50 == 0, 5, path=scratch(spark, "knn"), key="vec_id")
    return out.select("query_id", F.col("id").alias("vec_id"), "rank", r6("distance").alias("distance"))


def ann_topk(spark, d):
    """``knn_topk`` by the inverted lists."""
    path, rows = scratch(spark, "ann"), t(spark, d, "embeddings")
    index = ann.build(rows, path=f"{path}/index", lists=32, key="vec_id")
    out = index.search(rows.where("vec_id % 50 = 0"), 5, path=path, probes=20, key="vec_id")
    return out.select("query_id", F.col("id").alias("vec_id"), "rank", r6("distance").alias("distance"))


def rank_by_vector(spark, d):
    return ranking.rank_by_vector(t(spark, d, "embeddings"), query_vector(), key="vec_id", threshold=0.0, limit=20).select("vec_id", r6("similarity").alias("similarity"))


def conditional_similarity(spark, d):
    joined = t(spark, d, "documents").join(t(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left")
    return joined.select("doc_id", r6(vector.conditional_similarity(F.col("embedding"), query_vector())).alias("similarity"))


def point_distance(spark, d):
    return t(spark, d, "embeddings").select("vec_id", r6(vector.cosine_distance(F.col("embedding"), query_vector())).alias("distance"))


def knn_l2_join(spark, d):
    asked = spark.range(1).select(F.lit(0).alias("query_id"), query_vector().alias("embedding"))
    near = ranking.knn(asked, t(spark, d, "embeddings"), 25, key="vec_id", metric="l2")
    return near.join(t(spark, d, "documents"), F.col("id") == F.col("doc_id")).select("doc_id", "lang", r6("distance").alias("distance"))


def embedding_codec_roundtrip(spark, d):
    e = t(spark, d, "embeddings").withColumn("blob", vector.serialize("embedding"))
    back = vector.deserialize("blob")
    error = F.aggregate(F.zip_with(back, vector.doubles(F.col("embedding")), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: F.greatest(s, x))
    return e.select("vec_id", F.octet_length("blob").alias("n_bytes"), error.alias("worst"))


def _matrix(spark, d):
    return ranking.similarity_matrix(_centroids(spark, d), t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))


def similarity_matrix(spark, d):
    return _matrix(spark, d).select("a_id", "b_id", r6("similarity").alias("similarity"))


def find_threshold(spark, d):
    return ranking.find_threshold(_matrix(spark, d), 100).select(r6("threshold").alias("threshold"))


def pairs_above_threshold(spark, d):
    return ranking.pairs_above(_matrix(spark, d), 0.2).select("a_id", "b_id", r6("similarity").alias("similarity"))


# Hybrid


def _candidates(spark, d):
    joined = t(spark, d, "documents").join(t(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    return joined.select(F.col("doc_id").alias("id"), "text", "lang", "source", "embedding")


def _fused(spark, d):
    """Candidates with cosine and BM25 over the candidates alone."""
    c = _candidates(spark, d)
    asked = literals(spark, [(0, QUERY_TEXT)], "query_id int, text string")
    path = scratch(spark, "fused")
    lexical.score(lexical.build_index(c, path=f"{path}/tokens"), asked).select("id", F.col("score").alias("bm25")).write.parquet(f"{path}/scores")
    scores = spark.read.parquet(f"{path}/scores")  # read twice: for the best, and to be fused
    best = scores.agg(F.coalesce(F.max("bm25"), F.lit(1.0)).alias("bm25_max"))
    out = c.select("id", vector.cosine_similarity(F.col("embedding"), query_vector()).alias("cosine")).join(scores, "id", "left").crossJoin(F.broadcast(best))
    return out.withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))


def hybrid_score(spark, d):
    out = _fused(spark, d).withColumn("score", hybrid.hybrid_score(F.col("cosine"), F.col("bm25"), F.col("bm25_max"), 0.3))
    return out.select("id", r6("cosine").alias("cosine"), r6("bm25").alias("bm25"), r6("score").alias("score")).orderBy(F.desc("score"), "id").limit(20)


def _boosted(spark, d):
    labels = t(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    out = _fused(spark, d).join(labels, "id", "left")
    one = lambda w, c: F.struct(F.lit(w).alias("weight"), F.coalesce(F.col(c), F.lit(0)).cast("double").alias("value"))
    return out.withColumn("boosts", F.create_map(F.lit("quality"), one(0.1, "quality"), F.lit("toxic"), one(-0.25, "toxic")))


def hybrid_boosts(spark, d):
    score = hybrid.hybrid_score(F.col("cosine"), F.col("bm25"), F.col("bm25_max"), 0.3, F.col("boosts"))
    return _boosted(spark, d).select("id", r6(score).alias("score"))


def hybrid_explain_parts(spark, d):
    e = hybrid.explanation(F.col("cosine"), F.col("bm25"), F.col("bm25_max"), 0.3, F.col("boosts"))
    out = _boosted(spark, d).select("id", e.alias("e"))
    return out.select("id", r6("e.cosine").alias("cosine"), r6("e.normalized_bm25").alias("normalized_bm25"), r6(F.col("e.boosts")["quality"]).alias("quality_boost"), r6(F.col("e.boosts")["toxic"]).alias("toxic_boost"), r6("e.final_score").alias("final_score"))


def hybrid_formula_text(spark, d):
    e = hybrid.explanation(F.col("cosine"), F.col("bm25"), F.col("bm25_max"), 0.3, F.col("boosts"))
    out = _boosted(spark, d).select("id", e.alias("e"), hybrid.boost_total(F.col("boosts")).alias("b"))
    return out.select("id", hybrid.formula_text(F.lit(0.3), "e.cosine", "b", "e.normalized_bm25", "e.final_score").alias("formula"))


def rerank_boosts(spark, d):
    results = _fused(spark, d).select("id", hybrid.hybrid_score(F.col("cosine"), F.col("bm25"), F.col("bm25_max"), 0.3).alias("final_score"))
    labels = t(spark, d, "labels")
    rerankers = {
        "quality": lambda _: labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("boost")),
        "length": lambda _: t(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") / 100000.0).alias("boost")),
    }
    return hybrid.apply_rerankers(results, rerankers, {"quality": 0.5}).select("id", r6("final_score").alias("final_score"))


def fts_and_match(spark, d):
    terms = text.tokenize(F.col("text"))
    return t(spark, d, "documents").where(hybrid.matches_all(terms, F.lit("anou eran"))).select("doc_id", "lang")


WEB = 'the anou "ed an" of OR eran -tionan'


def fts_websearch(spark, d):
    return t(spark, d, "documents").where(hybrid.websearch(text.tokenize(F.col("text")), WEB)).select("doc_id", "lang")


def fts_hybrid_rank(spark, d):
    out = hybrid.hybrid_rank(_candidates(spark, d), query_vector(), "anou", columns={"text": "A", "lang": "D"}, path=scratch(spark, "ranked"))
    return out.select("id", r6("similarity").alias("similarity"), r6("text_rank").alias("text_rank"), r6("score").alias("score"))


# Clusters


def kmeans_assign_step(spark, d):
    unit = [[x / math.sqrt(sum(y * y for y in c)) for x in c] for c in FIXED_CENTROIDS]
    return cluster.assign(t(spark, d, "embeddings"), unit, key="vec_id").select("vec_id", "cluster_id", r6("distance").alias("distance"))


def kmeans_update_step(spark, d):
    unit = [[x / math.sqrt(sum(y * y for y in c)) for x in c] for c in FIXED_CENTROIDS]
    after = cluster.lloyd_step(t(spark, d, "embeddings"), unit, key="vec_id")
    rows = [(i, j, float(x)) for i, c in enumerate(after) for j, x in enumerate(c)]
    return spark.createDataFrame(rows, "cluster_id int, at int, x double").select("cluster_id", "at", r6("x").alias("x"))


def kmeans_fit(spark, d):
    found = cluster.kmeans(t(spark, d, "embeddings"), 4, seed=42, key="vec_id", max_iterations=10, path=scratch(spark, "kmeans"))
    return found.assignments.select("vec_id", "cluster_id", r6("distance").alias("distance"))


def kmeans_packed(spark, d):
    found = cluster.kmeans(t(spark, d, "embeddings"), 4, seed=42, key="vec_id", max_iterations=10, packed=True, path=scratch(spark, "kmeans"))
    return found.centroids.select("cluster_id", "size")


def kmeans_search(spark, d):
    found = cluster.kmeans_search(t(spark, d, "embeddings"), 2, 4, seed=42, key="vec_id", max_iterations=4, path=scratch(spark, "kmeans"))
    return spark.createDataFrame([(i, c.k, round(c.silhouette, 6), c.iterations, c.converged) for i, c in enumerate(found)], "place int, k int, silhouette double, iterations int, converged boolean")


def silhouette_exact(spark, d):
    return cluster.exact_silhouette(t(spark, d, "embeddings"), group="label").select(r6("silhouette").alias("silhouette"))


def silhouette_packed(spark, d):
    """Over vectors that are kept as 4-byte numbers of unit length."""
    unit = F.transform(vector.normalize(F.col("embedding")), lambda x: x.cast("float"))
    rows = t(spark, d, "embeddings").select("vec_id", "label", unit.alias("embedding"))
    return cluster.silhouette(rows, order="vec_id", group="label", sample=150, most=30, packed=True).select(F.round("silhouette", 4).alias("silhouette"))


def silhouette_sampled(spark, d):
    return cluster.silhouette(t(spark, d, "embeddings"), order="vec_id", group="label", sample=100, most=20).select(r6("silhouette").alias("silhouette"))


def _classified(spark, d, strategy):
    side = F.when(F.element_at("embedding", 1) > 0, 1).otherwise(0).alias("side")
    labeled = _centroids(spark, d, side)
    parent = F.concat(F.lit("p"), (F.col("id").cast("int") % 3).cast("string"))
    labeled = labeled.select((F.col("id").cast("int") * 2 + F.col("side")).alias("ord"), "embedding", F.array(F.col("id"), parent, F.lit("unknown")).alias("cluster_ids"))
    own = _centroids(spark, d).select(F.col("id").alias("cluster_id"), F.col("embedding").alias("centroid"), F.lit(0.9).alias("threshold"))
    up = literals(spark, [(f"p{i}", *FIXED_CENTROIDS[i]) for i in range(3)], "cluster_id string, " + ", ".join(f"c{j} double" for j in range(DIMS)))
    up = up.select("cluster_id", F.array(*(f"c{j}" for j in range(DIMS))).alias("centroid"), F.lit(None).cast("double").alias("threshold"))
    out = kc.classify(t(spark, d, "embeddings"), labeled, own.unionByName(up), path=scratch(spark, "classify"), k=5, strategy=strategy, key="vec_id")
    return out.select("vec_id", "cluster_id", r6("distance").alias("distance"), "votes", "total_votes", "accepted")


def classify_vote_all(spark, d):
    return _classified(spark, d, kc.vote_all)


def classify_vote_subset(spark, d):
    return _classified(spark, d, kc.vote_subset(["p0", "p1", "3"]))


def classify_vote_deepest(spark, d):
    return _classified(spark, d, kc.vote_highest({"p0": 1, "p1": 1, "p2": 1, **{str(i): 2 for i in range(5)}}))


def classify_vote_specific(spark, d):
    return _classified(spark, d, kc.vote_highest({"p0": 0.5, "p1": 0.9, **{str(i): 0.7 for i in range(10)}}))


def _distances(spark, d):
    own = _centroids(spark, d).select(F.col("id").cast("int").alias("cluster_id"), F.col("embedding").alias("centroid"))
    return kc.distances(t(spark, d, "embeddings"), own, key="vec_id", group="label")


def sample_near_centroid(spark, d):
    return kc.near_centroid(_distances(spark, d), key="vec_id", group="label").select("label", "vec_id", "rank", r6("distance").alias("distance"))


def sample_at_mode(spark, d):
    return kc.at_mode(_distances(spark, d), key="vec_id", group="label").select("label", "vec_id", r6("distance").alias("distance"))


# Evaluation


def _runs(spark, d):
    """Each benchmark text as a query: its 10 best documents, and of its 20 best those labelled good."""
    top = _ranked(_scores(spark, d), 20).join(t(spark, d, "labels").where("quality = 1 AND toxic = 0").select(F.col("doc_id").alias("id"), F.lit(True).alias("good")), "id", "left")
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("rank", "id")))), lambda x: x["id"])
    runs = top.groupBy("query_id").agg(listed(F.col("rank") <= 10).alias("returned"), listed(F.col("good")).alias("expected"))
    every = t(spark, d, "benchmark").select(F.col("item_id").alias("query_id")).join(runs, "query_id", "left")
    none = F.array().cast("array<bigint>")
    return every.select("query_id", F.coalesce("returned", none).alias("returned"), F.coalesce("expected", none).alias("expected"))


def _metric(name):
    def query(spark, d):
        return metrics.evaluate(_runs(spark, d), 5).select("query_id", r6(name).alias(name))

    return query


def eval_summary(spark, d):
    return metrics.summarize(metrics.evaluate(_runs(spark, d), 5)).select("n_queries", *(r6(m).alias(m) for m in metrics.METRICS))


GATES = [("precision", 0.2), ("hit_rate", 0.99), ("recall", 0.1), ("mrr", 0.3), ("ndcg", 0.95)]


def eval_gates(spark, d):
    gates = literals(spark, GATES, "metric string, threshold double")
    out = metrics.evaluate_gates(metrics.summarize(metrics.evaluate(_runs(spark, d), 5)), gates)
    return out.select("metric", "threshold", r6("actual").alias("actual"), "passed")


# Embedding and cost


def _stored(spark, d):
    """A snapshot of hashes in which some documents are absent, some null and some stale."""
    rows = t(spark, d, "documents").where("doc_id % 7 <> 0")
    state_of = F.col("doc_id") % 3
    return rows.select("doc_id", F.when(state_of == 0, F.lit(None)).when(state_of == 1, F.lit("stale")).otherwise(text.content_hash(F.col("text"))).alias("content_hash"))


def dedup_should_embed(spark, d):
    return embed.should_embed(t(spark, d, "documents"), _stored(spark, d), key="doc_id")


def dedup_mark(spark, d):
    return embed.mark_embedded(_stored(spark, d), dedup_should_embed(spark, d).where("should_embed"), key="doc_id")


def embed_batches_fixed(spark, d):
    return embed.fixed_batches(t(spark, d, "documents"), 64, order="doc_id", group="source").groupBy("source", "batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def embed_batches_budget(spark, d):
    numbered = embed.budget_batch_numbers(t(spark, d, "documents"), order="doc_id", group="source")
    return numbered.groupBy("source", "batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def embed_hashing(spark, d):
    out = embed.embed(t(spark, d, "documents"), embed.TruncatingProvider(embed.HashingProvider(64), 16), key="doc_id")
    return out.select("doc_id", F.size("embedding").alias("dims"), r6(vector.norm(F.col("embedding"))).alias("norm"))


def _cost_events(spark, d):
    e = t(spark, d, "events")
    model = F.element_at(F.array(*(F.lit(m) for m in [*embed.PRICING, "unlisted"])), (F.col("user_id") % 5 + 1).cast("int"))
    out = e.select("event_id", F.col("event_type").alias("operation"), model.alias("model"), F.floor(F.abs("value") * 10).alias("tokens_in"), F.floor(F.abs("value") * 3).alias("tokens_out"), F.col("ts").alias("created_at"))
    return out.withColumn("cost_usd", embed.cost_usd(F.col("model"), F.col("tokens_in"), F.col("tokens_out")))


def cost_per_event(spark, d):
    return _cost_events(spark, d).select("event_id", "model", F.round("cost_usd", 9).alias("cost_usd"))


def cost_ledger(spark, d):
    """Calls appended to a ledger, priced, and read back."""
    ledger = state.Snapshot(spark, f"{scratch(spark, 'ledger')}/cost", embed.COST_SCHEMA)
    calls = _cost_events(spark, d).withColumn("created_at", F.col("created_at").cast("timestamp"))
    embed.record_costs(calls.where("operation <> 'click'"), ledger)
    embed.record_costs(calls.where("operation = 'click'"), ledger)
    return ledger.read().groupBy("operation", "model").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), r6(F.sum("cost_usd")).alias("cost_usd"))


def cost_summary(spark, d):
    return embed.cost_summary(_cost_events(spark, d)).withColumn("cost_usd", r6("cost_usd"))


def cost_cap(spark, d):
    return embed.cost_cap(_cost_events(spark, d), 0.0001, F.lit(NOW).cast("timestamp")).select(r6("spent").alias("spent"), "exceeded")


def cost_projection(spark, d):
    s = t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.avg("n_chars").alias("chars"))
    return s.select("source", *(F.round(embed.projected_cost(F.col("docs"), F.col("chars") / 4, m), 9).alias(n) for m, n in (("text-embedding-3-large", "large"), ("unlisted", "fallback"))))


def usage_totals(spark, d):
    turns = t(spark, d, "conversations").select("conv_id", F.when(F.col("role") == "user", F.length("text")).alias("input_tokens"), F.when(F.col("role") == "assistant", F.length("text")).alias("output_tokens"))
    return embed.usage_totals(turns, "input_tokens", "output_tokens", by="conv_id")


# State


def ensure_cached(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    cache = docs.select("id", F.when(F.col("id") % 4 != 0, F.concat(F.lit("c"), F.length("text").cast("string"))).alias("value")).where("id % 3 <> 0")
    return state.ensure_cached(docs, cache, lambda miss: miss.select("id", F.concat(F.lit("g"), F.length("text").cast("string")).alias("value")))


def _jobs(spark, d):
    status = F.when(F.col("value") < 20, "pending").when(F.col("value") < 60, "running").otherwise("done")
    return t(spark, d, "events").select(F.col("event_id").alias("id"), status.alias("status"), F.col("ts").alias("updated_at"))


def cas_update(spark, d):
    jobs = _jobs(spark, d)
    wanted = jobs.where("id % 2 = 0").select("id", F.lit("pending").alias("from_status"), F.lit("running").alias("to_status"))
    return state.cas_update(jobs, wanted).select("id", "status", "updated")


def detect_orphans(spark, d):
    return state.orphans(_jobs(spark, d), ["pending", "running"], 86_400_500, F.lit(NOW).cast("timestamp")).select("id", "status")


def pipeline_run_log(spark, d):
    e = t(spark, d, "events")
    ledger = state.start_runs(e.select(F.col("event_id").alias("id"), F.col("event_type").alias("run_type"), F.col("ts").alias("started_at")))
    ended = e.where("user_id % 4 <> 0").select(F.col("event_id").alias("id"), (F.col("ts") + F.expr("INTERVAL 90 SECONDS")).alias("finished_at"), F.lit(10).cast("long").alias("processed"), F.lit(7).cast("long").alias("created"), F.lit(1).cast("long").alias("failed"), F.when(F.col("user_id") % 5 == 0, "boom").alias("error"))
    return state.finish_runs(ledger, ended).select("id", "run_type", "status", "duration_ms", "records_processed", "records_created", "records_failed", "error_message")


def _terms_of(docs):
    """A glossary row for each term of an article, in order; ids are article * 2^20 + place."""
    placed = docs.select("article_id", F.posexplode(F.array_distinct(text.tokenize(F.col("text")))).alias("at", "keyword"))
    return placed.select((F.col("article_id") * 2**20 + F.col("at")).alias("id"), "article_id", "keyword", F.length("keyword").cast("string").alias("definition"))


def _articles(spark, d):
    """All documents and one that nothing is known of."""
    return t(spark, d, "documents").select(F.col("doc_id").alias("article_id"), "text", "lang", "n_chars").unionByName(literals(spark, [(-5, None, None, None)], "article_id bigint, text string, lang string, n_chars bigint"))


def _listed(found, *more):
    return found.select("article_id", F.array_join(F.transform("terms", lambda x: F.concat(x["keyword"], F.lit("="), x["definition"])), ";").alias("terms"), *more)


def glossary_find_save(spark, d):
    articles = _articles(spark, d)
    made = _terms_of(articles)
    return _listed(state.find_terms(state.save_terms(made.limit(0), made), articles))


def ensure_terms(spark, d):
    """The glossary holds one term for every third article; the others' are generated."""
    articles = _articles(spark, d)
    held = articles.where("article_id % 3 = 0").select((F.col("article_id") * 2**20).alias("id"), "article_id", F.lit("held").alias("keyword"), F.lit("4").alias("definition"))
    return _listed(state.ensure_terms(held, articles, _terms_of)[0], "generated")


def description_find_save(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("article_id"), "lang", "n_chars")
    empty = docs.limit(0).select(F.col("article_id").alias("id"), "article_id", F.lit("").alias("description"))
    saved = state.save_descriptions(empty, docs.select(F.col("article_id").alias("id"), "article_id", F.struct("lang", "n_chars").alias("value")))
    return state.find_descriptions(saved, _articles(spark, d))


def ensure_description(spark, d):
    """The store holds null for every fourth article, a text for every other third; the rest are generated."""
    articles = _articles(spark, d).where("article_id >= 0")
    text_of = F.when(F.col("article_id") % 4 == 0, F.lit(None)).otherwise(F.lit("held"))
    store = articles.where("article_id % 4 = 0 OR article_id % 3 = 0").select(F.col("article_id").alias("id"), "article_id", text_of.alias("description"))
    make = lambda rows: rows.select((F.col("article_id") + 2**40).alias("id"), "article_id", F.struct("lang", "n_chars").alias("value"))
    return state.ensure_description(store, articles, make)[0]


def batch_poll(spark, d):
    jobs = _jobs(spark, d).select("id", F.when(F.col("status") == "done", "ended").otherwise("in_progress").alias("status"))
    return state.poll_table(jobs)


def batch_results(spark, d):
    e = t(spark, d, "events")
    kind = F.when(F.col("user_id") % 4 == 0, "errored").otherwise("succeeded")
    message = F.when(F.col("user_id") % 5 == 0, "{broken").otherwise(F.col("props"))
    out = state.batch_results(e.select(F.col("event_id").alias("custom_id"), kind.alias("type"), message.alias("message")), "k string")
    return out.select("custom_id", "outcome", F.col("data.k").alias("k"))


# SQL


def sql_params(spark, d):
    store = SqlStore(spark, {"corvane_lineitem": t(spark, d, "lineitem")})
    return store.query("SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM corvane_lineitem WHERE l_quantity >= $1 AND l_quantity < $2 AND l_discount <= $1 GROUP BY l_returnflag", [10, 30])


def sql_cte(spark, d):
    store = SqlStore(spark, {"corvane_orders": t(spark, d, "orders"), "corvane_customer": t(spark, d, "customer")})
    sql = "WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS total FROM corvane_orders WHERE o_totalprice >= $1 GROUP BY o_custkey) SELECT c_nationkey, count(*) AS n, round(max(total), 2) AS most FROM spent JOIN corvane_customer ON c_custkey = o_custkey GROUP BY c_nationkey"
    return store.query(sql, [1000])


def file_formats(spark, d):
    """A table written in every format, and read through the source for files."""
    path, nations, found = scratch(spark, "files"), t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), None
    schema = ", ".join(f"{c} {k}" for c, k in nations.dtypes)
    for kind in ("parquet", "orc", "json", "csv"):
        nations.write.format(kind).save(f"{path}/{kind}")
        rows = files(spark, f"{path}/{kind}", kind, schema, since=1, since_column="n_regionkey").withColumn("kind", F.lit(kind))
        found = rows if found is None else found.unionByName(rows)
    return found


def _in_list(spark, d, values):
    store = SqlStore(spark, {"corvane_orders": t(spark, d, "orders")})
    sql, args = tagged(["SELECT o_orderpriority, count(*) AS n FROM corvane_orders WHERE o_orderstatus IN ", " AND o_totalprice > ", " GROUP BY o_orderpriority"], [InList(values), 1000.0])
    return store.query(sql, **args)


def sql_in_list(spark, d):
    return _in_list(spark, d, ["F", "P"])


def sql_in_empty(spark, d):
    return _in_list(spark, d, [])


# Streams


def stream_upsert(spark, d):
    """The whole table through the upsert, over stale rows and rows of the target's own."""
    base = scratch(spark, "upsert")
    rows = t(spark, d, "documents")
    target = state.Snapshot(spark, f"{base}/table", "doc_id long, lang string, n_chars long")
    stale = rows.where("lang = 'en'").select("doc_id", F.lit("old").alias("lang"), F.lit(-1).cast("long").alias("n_chars"))
    target.replace(stale.unionByName(literals(spark, [(-1, "own", -1), (-2, "own", -1)], "doc_id bigint, lang string, n_chars bigint")))
    stream = streaming.collect(spark, f"{d}/documents.parque[t]", rows.schema).select("doc_id", "lang", "n_chars")
    streaming.upsert_stream(stream, target, key="doc_id", order="n_chars", checkpoint=f"{base}/progress").awaitTermination()
    return target.read()


def stream_cost_window(spark, d):
    base = scratch(spark, "spend")
    rows = t(spark, d, "events")
    stream = streaming.collect(spark, f"{d}/events.parque[t]", rows.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    found = streaming.spend_windows(stream, ts="ts", cost="value")

    def write(batch, number):
        batch.write.parquet(f"{base}/out/{number}")

    found.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out/0").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), r6("spent").alias("spent"), "calls")


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_terms, bm25_corpus_stats, bm25_term_df, bm25_postings, bm25_score, bm25_batch_topk, bm25_normalized, query_expand, query_rewrite, embedding_dims, top_terms_by_lang, content_hash_dups, sanitize_text,
        hash_path, l2_normalize, matryoshka_truncate, cosine_pairs, knn_topk, ann_topk, rank_by_vector, conditional_similarity, point_distance, knn_l2_join, embedding_codec_roundtrip, similarity_matrix,
        find_threshold, pairs_above_threshold, hybrid_score, hybrid_boosts, hybrid_explain_parts, hybrid_formula_text, rerank_boosts, fts_and_match, fts_websearch, fts_hybrid_rank,
        kmeans_assign_step, kmeans_update_step, kmeans_fit, kmeans_packed, kmeans_search, silhouette_exact, silhouette_sampled, silhouette_packed, classify_vote_all, classify_vote_subset, classify_vote_deepest,
        classify_vote_specific, sample_near_centroid, sample_at_mode, eval_summary, eval_gates, dedup_should_embed, dedup_mark, embed_batches_fixed, embed_batches_budget, embed_hashing,
        cost_per_event, cost_ledger, cost_summary, cost_cap, cost_projection, usage_totals, ensure_cached, cas_update, detect_orphans, pipeline_run_log, glossary_find_save, ensure_terms, description_find_save, ensure_description,
        batch_poll, batch_results, sql_params, sql_cte, file_formats, sql_in_list, sql_in_empty, stream_upsert, stream_cost_window,
    )
} | {f"eval_{n}": _metric(m) for n, m in (("precision", "precision"), ("hitrate", "hit_rate"), ("recall", "recall"), ("mrr", "mrr"), ("ndcg", "ndcg"))}
