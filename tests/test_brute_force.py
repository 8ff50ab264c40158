"""Queries that have no SQL against plain Python over the same tables, and operators around them."""

import asyncio
import io
import json
import math

import numpy as np
import pytest
from corvane.functions import text, vector
from corvane.functions.retry import EventLog
from corvane.operators import ann, cluster, embed, hybrid, lexical, numbering, state
from corvane.queries import QUERIES
from corvane.sources import migrations, sql
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def vectors(spark):
    rows = sorted(map(tuple, spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()))
    return [i for i, _ in rows], np.array([v for _, v in rows], np.float64)


def plain_kmeans(x, k, seed, most):
    """(assignment, distances, centroids, iterations, converged) of one run, start points drawn by squared distance."""
    rng, n = cluster.Rng(cluster.mix_seed(seed, k, 0)), len(x)
    centroids = [x[math.floor(rng() * n)]]
    while len(centroids) < k:
        w = (1 - x @ np.array(centroids).T).min(axis=1) ** 2
        target = rng() * w.sum()
        centroids.append(x[int(np.flatnonzero(np.cumsum(w) >= target)[0])])
    at, c = np.zeros(n, int), np.array(centroids)
    for iteration in range(most):
        new = (1 - x @ c.T).argmin(axis=1)
        if (new == at).all():
            return at, 1 - (x * c[at]).sum(axis=1), c, iteration + 1, True
        at = new
        means = np.array([x[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(k)])
        c = means / np.linalg.norm(means, axis=1, keepdims=True)
    return at, 1 - (x * c[at]).sum(axis=1), c, most, False


def test_kmeans_fit(spark):
    ids, x = vectors(spark)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at, distance, _, _, _ = plain_kmeans(x, 4, 42, 10)
    got = {r.vec_id: (r.cluster_id, r.distance) for r in QUERIES["kmeans_fit"](spark, SF).collect()}
    assert [got[i][0] for i in ids] == at.tolist() and np.allclose([got[i][1] for i in ids], distance, atol=2e-6)


def test_kmeans_packed(spark):
    _, x = vectors(spark)
    at = plain_kmeans(x, 4, 42, 10)[0]
    assert {r.cluster_id: r["size"] for r in QUERIES["kmeans_packed"](spark, SF).collect()} == dict(enumerate(np.bincount(at, minlength=4).tolist()))


def plain_silhouette(x, at):
    d, values = 1 - x @ x.T, []
    for i, own in enumerate(at):
        mates = np.flatnonzero((at == own) & (np.arange(len(at)) != i))
        a = d[i, mates].mean() if len(mates) else 0.0
        b = min(d[i, at == j].mean() for j in set(at.tolist()) - {own})
        values.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(values))


def test_kmeans_search(spark):
    ids, x = vectors(spark)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = []
    for k in (2, 3, 4):
        at, _, _, iterations, converged = plain_kmeans(x, k, 42, 4)
        found.append((k, plain_silhouette(x, at), iterations, converged))
    found.sort(key=lambda r: -r[1])
    got = [(r.k, r.silhouette, r.iterations, r.converged) for r in QUERIES["kmeans_search"](spark, SF).orderBy("place").collect()]
    assert max(np.bincount(plain_kmeans(x, 2, 42, 4)[0])) > 200  # so the score is the capped one, and close to the whole
    assert [g[0] for g in got] == [f[0] for f in found] and [g[2:] for g in got] == [f[2:] for f in found]
    assert all(abs(g[1] - f[1]) < 0.02 for g, f in zip(got, found))


def test_embed_hashing(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    provider = embed.TruncatingProvider(embed.HashingProvider(64), 16)
    got = {r.doc_id: (r.dims, r.norm) for r in QUERIES["embed_hashing"](spark, SF).collect()}
    assert len(got) == len(rows)
    for i, t in rows.items():
        v = provider.embed([(t or " ")[:4000] or " "])[0]
        assert got[i] == (16, round(float(np.linalg.norm(v)), 6))


def test_rows_are_numbered_in_their_groups(spark):
    rows = [(i * 7 % 501, "abc"[i % 3]) for i in range(501)] + [(None, "d")]
    df = spark.createDataFrame(rows, "o long, g string").repartition(3)
    for group in ("g", None):
        for ranges in (1, 5, 64):
            want, seen = {}, {}
            for o, g in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
                k = g if group else 0
                want[o] = seen[k] = seen.get(k, -1) + 1
            got = {r.o: (r.i, r.n) for r in numbering.numbered(df, order="o", group=group, ranges=ranges).collect()}
            assert {o: i for o, (i, _) in got.items()} == want
            assert {n for _, n in got.values()} == ({167, 1} if group else {502})
    words = spark.createDataFrame([(w,) for w in "the quick brown fox jumps over a lazy dog".split()], "w string")
    assert [r.w for r in numbering.numbered(words, order="w").orderBy("i").collect()] == sorted(r.w for r in words.collect())
    assert numbering.numbered(words.limit(0), order="w").collect() == []


def test_index_ids_and_saved_tokens(spark, tmp_path):
    docs = spark.createDataFrame([(1, "protein folding"), (2, None), (3, "folding")], "id int, text string")
    asked = spark.createDataFrame([(0, "protein folding")], "query_id int, text string")
    plain = sorted(map(tuple, lexical.score(lexical.build_index(docs), asked).collect()))
    assert plain == sorted(map(tuple, lexical.score(lexical.build_index(docs, path=f"file://{tmp_path}/i", check_ids=True), asked).collect()))
    with pytest.raises(lexical.DuplicateIds):
        lexical.build_index(docs.unionByName(docs), check_ids=True)


def test_stop_words_ask_nothing(spark):
    found = spark.createDataFrame([("alpha beta",), ("gamma",)], "t string")
    for q, n in (("the alpha", 1), ("the of", 0), ('"the alpha" -gamma', 1), ("alpha -the", 1), ("theAlpha", 1)):
        assert found.where(hybrid.websearch(text.tokenize(F.col("t")), q)).count() == n


def test_rewriting_sees_the_session_so_far(spark):
    rows = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z"), ("a", 3, "w")], "session string, ord int, query string")
    out = text.rewrite_queries(rows, lambda q, earlier: F.concat_ws("|", F.array_join(earlier, ","), q), history=1)
    assert {(r.session, r.ord): r.rewritten for r in out.collect()} == {("a", 1): "|x", ("a", 2): "x|y", ("a", 3): "y|w", ("b", 1): "|z"}
    assert set(out.columns) == {*rows.columns, "rewritten"}


def test_costs_are_recorded_in_their_context(spark, tmp_path):
    ledger = state.Snapshot(spark, f"file://{tmp_path}/cost", embed.COST_SCHEMA)
    embed.record_cost("chat", "haiku", 1, 1)  # no context: nothing is kept
    with pytest.raises(ZeroDivisionError):
        with embed.cost_context(ledger):
            embed.record_cost("chat", "haiku", 1_000_000, 100_000)
            embed.record_cost("embed", "unlisted", 5, 0)
            raise ZeroDivisionError
    with embed.cost_context(ledger):
        pass
    assert sorted((r.operation, r.tokens_in, r.cost_usd) for r in ledger.read().collect()) == [("chat", 1_000_000, 1.5), ("embed", 5, 0.0)]
    server = embed.LocalServiceProvider(lambda texts: [[1.0]] * len(texts), models=lambda: ["nomic-embed-text:latest"])
    with embed.cost_context(ledger):
        assert len(server.embed(["abcde"] * 100)) == 100
    assert ledger.read().where("model = 'nomic-embed-text'").agg(F.sum("tokens_in")).first()[0] == 200
    assert server.check_availability() == {"available": True}
    server.models = lambda: ["other"]
    assert not server.check_availability()["available"]
    server.models = lambda: 1 / 0
    assert "cannot reach" in server.check_availability()["error"]


def test_terms_and_descriptions_are_made_once(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "article_id long")
    calls = []

    def terms(missing):
        calls.append(sorted(r.article_id for r in missing.collect()))
        return missing.where("article_id < 3").select(F.col("article_id").alias("id"), "article_id", F.lit("k").alias("keyword"), F.lit("d").alias("definition"))

    glossary = spark.createDataFrame([(10, 1, "old", "o")], "id long, article_id long, keyword string, definition string")
    out, saved = state.ensure_terms(glossary, asked, terms)
    assert {r.article_id: (r.terms and r.terms[0].keyword, r.generated) for r in out.collect()} == {1: ("old", False), 2: ("k", True), 3: (None, False)}
    out, _ = state.ensure_terms(saved, asked, terms)
    assert not any(r.generated for r in out.collect()) and calls == [[2, 3], [3]]
    store = spark.createDataFrame([(1, 1, None), (2, 2, "kept")], "id long, article_id long, description string")
    make = lambda rows: rows.select((F.col("article_id") + 10).alias("id"), "article_id", F.struct(F.lit(1).alias("x")).alias("value"))
    out, saved = state.ensure_description(store, asked, make)
    assert {r.article_id: (r.description, r.generated) for r in out.collect()} == {1: ('{"x":1}', True), 2: ("kept", False), 3: ('{"x":1}', True)}
    assert not any(r.generated for r in state.ensure_description(saved, asked, make)[0].collect())


def test_snapshots_survive_a_crash(spark, tmp_path):
    snap = state.Snapshot(spark, f"file://{tmp_path}/t", "id int")
    one = lambda i: spark.createDataFrame([(i,)], "id int")
    snap.replace(one(1))
    (tmp_path / "t" / "v1").mkdir()  # a write that never ended
    (tmp_path / "t" / "v1" / "part-0.parquet").write_bytes(b"half")
    assert [r.id for r in snap.read().collect()] == [1]
    snap.replace(one(2))
    snap.replace(one(3))
    assert [r.id for r in snap.read().collect()] == [3] and not (tmp_path / "t" / "v1").exists()


def test_transactions_are_all_or_nothing(spark, tmp_path, monkeypatch):
    snaps = {t: state.Snapshot(spark, f"file://{tmp_path}/{t}", "id int") for t in ("a", "b")}
    store = sql.SqlStore(spark, snapshots=snaps)
    one = lambda i: spark.createDataFrame([(i,)], "id int")
    both = lambda i: store.transaction(lambda s: (s.run("a", one(i)), s.run("b", one(i))))
    seen = lambda: [[r.id for r in snaps[t].read().collect()] for t in ("a", "b")]
    both(1)
    assert seen() == [[1], [1]]
    real = state.Snapshot.stage

    def broken(self, rows, mark=""):
        if self.path.endswith("/b"):
            raise OSError("disk")
        real(self, rows, mark)

    with monkeypatch.context() as m:
        m.setattr(state.Snapshot, "stage", broken)
        with pytest.raises(OSError):
            both(2)
    assert seen() == [[1], [1]]
    with monkeypatch.context() as m:  # all written, the mark is not
        m.setattr(state.Snapshot, "finish", lambda self, mark: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            both(3)
    assert seen() == [[1], [1]]
    both(4)
    assert seen() == [[4], [4]]


def test_results_stream_from_json_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"custom_id": "1", "result": {"type": "succeeded", "message": "{\\"k\\": \\"x\\"}"}}\n\n{"custom_id": "2", "result": {"type": "errored"}}\n')
    stream = state.batch_results(state.result_stream(spark, f"file://{tmp_path}/in"), "k string")
    stream.writeStream.format("memory").queryName("corvane_results").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c").start().awaitTermination()
    assert {r.custom_id: (r.outcome, r.data and r.data.k) for r in spark.table("corvane_results").collect()} == {"1": ("data", "x"), "2": ("error", None)}


def test_another_engine_may_cluster(spark):
    class Noted(cluster.LocalClusters):
        asked = []

        def cluster(self, rows, k, **options):
            self.asked.append(k)
            return super().cluster(rows, k, **options)

    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1])], "id int, embedding array<double>")
    found = cluster.kmeans_search(df, 2, 9, seed=1, provider=Noted())
    assert Noted.asked == [2, 3] and len(found) == 2


def test_vectors_of_other_lengths_are_refused(spark):
    with pytest.raises(Exception, match="expected 64 dimensions"):
        from corvane.functions.vector import of_dims

        spark.range(1).select(of_dims(F.array(F.lit(1.0)), 64)).collect()


def test_inverted_lists_find_nine_in_ten(spark, tmp_path):
    exact = {(r.query_id, r.vec_id) for r in QUERIES["knn_topk"](spark, SF).collect()}
    found = {(r.query_id, r.vec_id) for r in QUERIES["ann_topk"](spark, SF).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    index = ann.build(rows, path=f"file://{tmp_path}/i", lists=9, key="vec_id", block=50)
    assert sum(len(r.ids) // 8 for r in index.blocks.collect()) == rows.count()
    whole = index.search(rows.where("vec_id % 50 = 0"), 5, path=f"file://{tmp_path}/q", probes=9, key="vec_id")
    assert {(r.query_id, r.id) for r in whole.collect()} == exact


def test_tables_of_a_database(spark):
    """The engine that comes with Spark, in memory."""
    url, driver = "jdbc:derby:memory:corvane;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = [(i, "n%d" % i) for i in range(40)]
    spark.createDataFrame(rows, "id int, name string").write.format("jdbc").options(url=url, dbtable="items", driver=driver).save()
    whole = sql.jdbc(spark, url, "items", driver=driver)
    parted = sql.jdbc(spark, url, "items", key="id", low=0, high=40, parts=4, driver=driver)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parted.collect())) == rows and parted.rdd.getNumPartitions() == 4
    store = sql.SqlStore(spark, {"corvane_items": whole})
    assert store.query("SELECT name FROM corvane_items WHERE id = $1", [7]).first().name == "n7"
    with pytest.raises(ValueError):
        sql.jdbc(spark, url, "items", key="id; drop")


def test_events():
    out = io.StringIO()
    log = EventLog(True, out, domains=["search"], repo="r")
    log.event("search.done", n=1)
    log.event("other.done")
    log.event("nodomain")
    log.correlate(session_id="s", collection=3)

    async def work():
        with pytest.raises(KeyError):
            with log.timing("search.slow", k=2):
                await asyncio.sleep(0)
                raise KeyError("x")

    asyncio.run(work())
    EventLog(False, out).event("search.silent")
    first, second = map(json.loads, out.getvalue().splitlines())
    assert (first["event"], first["repo"], first["n"]) == ("search.done", "r", 1) and len(first["session_id"]) == 16 and first["ts"]
    assert second["session_id"] == "s" and second["collection"] == 3 and second["error.type"] == "KeyError" and second["duration_ms"] >= 0 and second["k"] == 2


def test_a_migration_that_does_not_parse_changes_nothing(spark, tmp_path):
    folder = tmp_path / "m"
    folder.mkdir()
    (folder / "1_a.sql").write_text("CREATE OR REPLACE TEMP VIEW corvane_half AS SELECT 1 AS x; SELEKT 2;")
    ledger = state.Snapshot(spark, f"file://{tmp_path}/ledger", migrations.SCHEMA)
    with pytest.raises(Exception, match="SELEKT|PARSE"):
        migrations.migrate(spark, str(folder), ledger)
    assert migrations.current(ledger) == 0 and not spark.catalog.tableExists("corvane_half")
    (folder / "1_a.sql").write_text("CREATE OR REPLACE TEMP VIEW corvane_half AS SELECT 1 AS x;")
    assert migrations.migrate(spark, str(folder), ledger) == [1]


def test_a_remote_service_fails_as_a_whole():
    sizes = []

    def serve(texts):
        sizes.append(len(texts))
        if len(sizes) > 2:
            raise ValueError("gone")
        return [[1.0]] * len(texts)

    remote = embed.RemoteProvider(serve, 1)
    assert len(remote.embed(["a"] * 200)) == 200 and sizes == [128, 72]
    with pytest.raises(ValueError):
        remote.embed(["a"])


def test_norms_are_computed_once(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>")
    out = df.select(vector.normalize(F.col("v")).alias("u"))
    assert [r.u for r in out.collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("SQRT") == 1


def test_silhouettes_are_no_product_of_parts(spark):
    df = spark.createDataFrame([(i, i % 3, [1.0 + i % 3, i % 7 + 0.5, 1.0]) for i in range(300)], "id long, cluster_id int, embedding array<double>")
    out = cluster.silhouette(df, sample=50, most=20)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString().split("Join")[1]  # members are dealt
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()
    spread = cluster.silhouette(df.drop("cluster_id"), sample=50, most=20, placed=df.select("id", "cluster_id"))
    assert abs(out.first().silhouette - spread.first().silhouette) < 1e-12


def test_searches_order_the_rows_once(spark, tmp_path):
    df = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(40)], "id long, embedding array<double>")
    found = cluster.kmeans_search(df, 2, 4, seed=3, max_iterations=5, path=f"file://{tmp_path}/k")
    assert len(list(tmp_path.glob("*-rows"))) == 1
    for one in found:
        alone = cluster.kmeans(df, one.k, seed=3, max_iterations=5)
        assert abs(alone.silhouette - one.silhouette) < 1e-9 and (alone.iterations, alone.converged) == (one.iterations, one.converged)


def test_scores_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, " ".join(["alpha", "beta", "gamma", "delta"][j % 4] for j in range(i % 9))) for i in range(200)] + [(900, None), (901, "omega")], "id int, text string")
    asked = spark.createDataFrame([("a", "alpha beta alpha"), ("b", "gamma"), ("c", "nothing of it"), ("d", None), ("e", "omega alpha")], "query_id string, text string")
    index = lexical.build_index(docs)
    local, joined = lexical.score(index, asked), lexical.score(index, asked, most=3)
    assert "Exchange" not in local._jdf.queryExecution().executedPlan().toString() and local.schema.names == joined.schema.names
    x, y = ({(r.query_id, r.id): r.score for r in s.collect()} for s in (local, joined))
    assert len(x) == local.count() and x.keys() == y.keys() and all(abs(x[i] - y[i]) < 1e-12 for i in x) and ("e", 901) in x
    assert lexical.score(lexical.build_index(docs.limit(0)), asked).count() == lexical.score(index, asked.limit(0)).count() == lexical.score(lexical.build_index(docs.where("id = 900")), asked).count() == 0


def test_top_terms_by_count_then_place(spark):
    rows = [(3, "x", "pear plum fig"), (1, "x", "fig kiwi pear kiwi"), (2, "y", "lime date"), (5, "y", None), (4, None, "nut oat")]
    out = lexical.top_terms(spark.createDataFrame(rows, "doc_id long, lang string, text string"), "lang", limit=3)
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    want = {("x", "fig", 2, 1), ("x", "pear", 2, 2), ("x", "kiwi", 1, 3), ("y", "lime", 1, 1), ("y", "date", 1, 2), (None, "nut", 1, 1), (None, "oat", 1, 2)}
    assert {tuple(r) for r in out.collect()} == want


def test_terms_are_made_once(spark):
    out = QUERIES["ensure_terms"](spark, SF)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1
