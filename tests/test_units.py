"""Exact values of operators that SQL can't express, and edge cases."""

import json
import math

import pytest
from corvane.functions import metrics, retry, text, vector
from corvane.operators import classify as kc
from corvane.operators import cluster, embed, hybrid, lexical, ranking, state
from corvane.queries import QUERIES
from corvane.sources import config, migrations, sql
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text(spark):
    t = lambda s: one(spark, text.tokenize(F.lit(s)))
    assert t("getUserName of the Café x1 a") == ["get", "user", "name", "caf", "x1"] and t("getHTTPUser") == ["get", "httpuser"] and t("") == []
    e = lambda s, d=None: one(spark, text.expand_query(F.lit(s), d))
    assert e("getUserAuth") == "get User Auth authentication getUserAuth" and e("cfg constructor") == "cfg config configuration constructor" and e("a A", {}) == "a" and e("") == ""
    assert one(spark, text.content_hash(F.lit("\u00a0 A\tB \ufeff"))) == one(spark, text.content_hash(F.lit("a b")))
    assert one(spark, text.sanitize(F.lit(""))) == " "


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, vector.normalize(a)) == [0.6, 0.8] and one(spark, vector.normalize(F.array(F.lit(0.0)))) == [0.0]
    assert one(spark, vector.cosine_similarity(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0
    with pytest.raises(Exception, match="differ in length"):
        one(spark, vector.cosine_similarity(a, F.array(F.lit(1.0))))
    v = one(spark, vector.truncate_and_normalize(F.array(*(F.lit(i / 8) for i in range(1, 9))), 4))
    assert len(v) == 4 and math.isclose(sum(x * x for x in v), 1)
    assert one(spark, vector.vector_cast(vector.vector_text(a))) == [3.0, 4.0]
    for dims in (0, 65):
        with pytest.raises(ValueError):
            embed.TruncatingProvider(embed.HashingProvider(64), dims)


def test_metrics(spark):
    def m(f, returned, expected, *k):
        lit = lambda x: F.array(*(F.lit(y) for y in x)).cast("array<string>")
        return one(spark, f(lit(returned), lit(expected), *k))

    assert m(metrics.precision_at_k, ["a", "x"], ["a"], 5) == 0.2 and m(metrics.precision_at_k, [], [], 5) == 1 and m(metrics.precision_at_k, ["a"], [], 5) == 0
    assert m(metrics.hit_rate_at_k, ["a", "x", "y"], ["a", "b", "c"], 5) == pytest.approx(1 / 3)
    assert m(metrics.recall, ["a"], ["a", "b"]) == 0.5 and m(metrics.mrr, ["x", "y", "a"], ["a"]) == pytest.approx(1 / 3) and m(metrics.mrr, ["x"], ["a"]) == 0
    assert m(metrics.ndcg, ["x", "a"], ["a"]) == pytest.approx(1 / math.log2(3)) and m(metrics.ndcg, ["a", "b"], ["a", "b"]) == pytest.approx(1)
    with pytest.raises(ValueError):
        metrics.precision_at_k(F.lit(None), F.lit(None), 0)
    none = spark.createDataFrame([], "passed boolean")
    assert metrics.all_gates_passed(none).first().passed is True


def test_fusion_and_reranking(spark):
    h = lambda *a: one(spark, hybrid.hybrid_score(*(F.lit(x) for x in a[:3]), a[3], *a[4:]))
    assert h(0.8, 5.0, 10.0, 0.0) == 0.8 and h(0.8, 5.0, 10.0, 1.0) == 0.5 and h(0.8, 5.0, 10.0, 0.3) == pytest.approx(0.71) and h(0.8, 5.0, 0.0, 0.5) == pytest.approx(0.4)
    boosts = F.create_map(F.lit("a"), F.struct(F.lit(0.1).alias("weight"), F.lit(0.5).alias("value")), F.lit("b"), F.struct(F.lit(0.2).alias("weight"), F.lit(0.3).alias("value")))
    assert h(0.8, 0.0, 1.0, 0.0, boosts) == pytest.approx(0.91)
    rows = spark.createDataFrame([("x", 0.8, 0), ("y", 0.5, 1)], "id string, final_score double, ord int")
    up = {"r": lambda _: spark.createDataFrame([("y", 0.5)], "id string, boost double")}
    assert [r.id for r in hybrid.apply_rerankers(rows, up, ordinal="ord").collect()] == ["y", "x"]
    assert hybrid.apply_rerankers(rows, up, enabled=False) is rows
    found = spark.createDataFrame([("protein folding works",), ("folding the protein",), ("other",)], "t string")
    assert found.where(hybrid.websearch(text.tokenize(F.col("t")), '"protein folding" OR other')).count() == 2 and found.where(hybrid.websearch(text.tokenize(F.col("t")), "protein -works")).count() == 1


def test_thresholds(spark):
    m = spark.createDataFrame([("a", i, s) for i, s in enumerate((0.9, 0.3, 0.7, 0.1, 0.8, 0.5))], "a_id string, b_id int, similarity double")
    t = lambda k, x=m: ranking.find_threshold(x, k).first().threshold
    assert [t(k) for k in (1, 2, 3, 4, 6, 9)] == [0.9, 0.8, 0.7, 0.5, 0, 0] and t(0) == math.inf and t(1, m.limit(0)) == 0
    assert ranking.pairs_above(m, 0.7).count() == 3 and len(ranking.grouped_pairs(m, 0.85).collect()) == 1


def test_neighbours_of_rows(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.distance) for r in QUERIES["knn_topk"](spark, sf).collect()}
    want = {(r.query_id, r["rank"]): (r.id, round(r.distance, 6)) for r in ranking.knn(asked, e, 5, key="vec_id").collect()}
    assert len(want) == 5 * asked.count() > 0 and got.keys() == want.keys()
    assert all(got[x][0] == want[x][0] and got[x][1] == pytest.approx(want[x][1], abs=2e-6) for x in want)
    odd = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0]), (None, [1.0, 0.0]), (7, [-1.0, 0.0]), (8, [3.0, 0.0])]
    df = spark.createDataFrame(odd, "id long, embedding array<double>")
    for block in (1, 2, 100):
        found = ranking.knn_blocks(df, F.col("id").isin(1, 4, 6), 4, path=f"file://{tmp_path}/{block}", block=block, query_block=1)
        assert sorted((r.query_id, r["rank"], r.id, r.distance) for r in found.collect()) == [(1, 1, 1, 0), (1, 2, 2, 0), (1, 3, 8, 0), (1, 4, 3, 1), (6, 1, 6, 0)]


def points():
    """Three clusters of 30, noise 0.1; the generator multiplies as floats and masks to 31 bits."""
    rows = []
    for c, seed in enumerate((42, 99, 7)):
        s = seed
        for i in range(30):
            v = []
            for j in range(4):
                s = int(float(s) * 1103515245.0 + 12345.0) % 2**31
                v.append((1.0 if j == c else 0.0) + (s / 2**31 - 0.5) * 0.2)
            rows.append((c * 30 + i, v))
    return rows


def test_kmeans(spark):
    assert [hex(cluster.mix_seed64(*x)) for x in ((42, 2, 0), (42, 2, 1), (42, 3, 0), (42, 4, 4))] == ["0x761a44e8f7283712", "0x89d075fba46d6161", "0x18381731303afc2f", "0xfdc88ab475753af2"]
    df = spark.createDataFrame(points(), "id int, embedding array<double>")
    sizes = lambda c: sorted(r["size"] for r in c.centroids.collect())
    two, three, single = cluster.kmeans(df, 2, seed=42, runs=5), cluster.kmeans(df, 3, seed=1), cluster.kmeans(df, 1, seed=3)
    assert sizes(two) == [30, 60] and sizes(three) == [30, 30, 30] and three.converged and three.silhouette > 0.5 and single.silhouette == 0
    first = single.centroids.first().centroid
    assert min(abs(sum(x * y for x, y in zip(first, v)) / math.sqrt(sum(x * x for x in v)) - 1) for _, v in points()) < 1e-12
    assert sizes(cluster.kmeans(df, 2, seed=42, runs=5, packed=True)) == [30, 60]
    for k in (0, 91):
        with pytest.raises(ValueError):
            cluster.kmeans(df, k, seed=1)
    assert cluster.kmeans(df.limit(0), 2, seed=1).assignments.count() == 0
    one_each = spark.createDataFrame([(0, [1.0, 0.0], "a"), (1, [0.0, 1.0], "b")], "id int, embedding array<double>, cluster_id string")
    assert cluster.silhouette(one_each).first().silhouette == 1 and cluster.silhouette(one_each.limit(1)).first().silhouette == 0


def test_exact_silhouette(spark, tmp_path):
    # Of 600 in one label, the 200 that the capped score compares with are not like the rest.
    turn = lambda i, c: [math.cos(0.1 * (i % 3) ** 2 + c), math.sin(0.1 * (i % 3) ** 2 + c), 0.01 * (i % 7)]
    rows = [(i, turn(i, 0.0), 0) for i in range(600)] + [(1000 + i, turn(i, 1.0), 1) for i in range(30)] + [(2000, turn(0, 2.0), 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = cluster.silhouette(df, order="vec_id", group="label", sample=10**6, most=10**6).first().silhouette
    capped = cluster.silhouette(df, order="vec_id", group="label").first().silhouette
    got = QUERIES["silhouette_exact"](spark, f"file://{tmp_path}").first().silhouette
    assert got == round(whole, 6) != round(capped, 6)
    odd = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 0.0], "a"), (3, [1.0, 1.0], "b"), (4, None, "b"), (5, [0.0, 1.0], None), (6, [0.0, 2.0], "b")], "id int, embedding array<double>, cluster_id string")
    for x in (odd, odd.limit(0), odd.limit(1), odd.where("cluster_id = 'a'")):
        assert cluster.exact_silhouette(x).first().silhouette == pytest.approx(cluster.silhouette(x).first().silhouette, abs=1e-12)


def test_classify(spark, tmp_path):
    labeled = spark.createDataFrame([(i, v, c) for i, (v, c) in enumerate([([1.0, 0.0], ["a", "root"]), ([0.9, 0.1], ["a"]), ([0.0, 1.0], ["b", "root"])])], "ord int, embedding array<double>, cluster_ids array<string>")
    clusters = spark.createDataFrame([("a", [1.0, 0.0], 0.5), ("b", [0.0, 1.0], 0.01)], "cluster_id string, centroid array<double>, threshold double")
    cand = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.3, 1.0])], "id int, embedding array<double>")
    out = {r.id: r for r in kc.classify(cand, labeled, clusters, path=f"file://{tmp_path}/a", k=1).collect()}
    assert (out[1].cluster_id, out[1].votes, out[1].accepted) == ("a", 1, True) and out[2].cluster_id is None and out[2].distance > 0.01 and not out[2].accepted
    out = kc.classify(cand, labeled.limit(0), clusters, path=f"file://{tmp_path}/b").collect()
    assert all(r.distance == math.inf and r.votes == 0 for r in out)
    assert one(spark, kc.vote_highest({"x": 1, "y": 3, "z": 3})(F.array(F.lit("x"), F.lit("y"), F.lit("z")))) == ["y"] and one(spark, kc.vote_subset([])(F.array(F.lit("x")))) == []


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "protein folding protein"), (2, "cell biology"), (3, "folding")], "id int, text string")
    s = lambda q: {r.id: r.score for r in lexical.score(lexical.build_index(docs), spark.createDataFrame([(0, q)], "query_id int, text string")).collect()}
    assert set(s("protein folding")) == {1, 3} and s("nothing here") == {}
    assert s("protein protein")[1] == pytest.approx(2 * s("protein")[1])


def test_batches_and_providers(spark):
    assert [len(b) for b in embed.budget_batches(["x" * 150_000] * 5)] == [2, 2, 1] and embed.budget_batches([]) == []

    def halving(texts):
        calls.append(len(texts))
        if len(texts) > 2:
            raise embed.TooLarge
        return [[1.0]] * len(texts)

    calls = []
    assert embed.HttpProvider(halving, 1, fixed=4).embed(["a"] * 4) == [[1.0]] * 4 and calls == [4, 2, 2]

    def failing(_):
        raise ValueError("no")

    p = embed.HttpProvider(failing, 1, fixed=2)
    assert p.embed(["a", "b", "c"]) == [[], [], []]
    with pytest.raises(ValueError):
        p.embed_single("a")
    rows = spark.createDataFrame([(1, "s", "x" * 150_000), (2, "s", "x" * 150_000), (3, "s", "x" * 150_000), (1, "t", None)], "id int, source string, text string")
    out = {(r.source, r.id): r.batch for r in embed.budget_batch_numbers(rows, order="id", group="source").collect()}
    assert out == {("s", 1): 0, ("s", 2): 0, ("s", 3): 1, ("t", 1): 0}


def test_retry():
    waits = []

    def flaky(attempt):
        if attempt < 3:
            raise retry.RateLimited(retry_after_ms=7 if attempt == 1 else None)
        return attempt

    assert retry.retry_with_backoff(flaky, max_delay_ms=1500, sleep=lambda s: waits.append(round(s * 1000))) == 3 and waits == [1000, 7, 1500]
    with pytest.raises(ValueError):
        retry.retry_with_backoff(lambda _: (_ for _ in ()).throw(ValueError()), sleep=lambda s: None)


def test_sql(spark, tmp_path):
    assert sql.numbered_to_named("a = $2 AND b = $1 AND c = '$9' AND d = $1") == "a = :p2 AND b = :p1 AND c = '$9' AND d = :p1"
    for bad in ("a = $2", "a = $1 AND b = $3"):
        with pytest.raises(ValueError):
            sql.numbered_to_named(bad)
    with pytest.raises(ValueError):
        sql.numbered_to_marks("$2 $1")
    with pytest.raises(ValueError):
        sql.safe_identifier("x; drop")
    assert sql.tagged(["x IN ", ""], [sql.InList([])])[0] == "x IN (SELECT NULL WHERE FALSE)"
    snap = state.Snapshot(spark, f"file://{tmp_path}/t", "id int, name string")
    store = sql.SqlStore(spark, snapshots={"t": snap})
    row = lambda i: spark.createDataFrame([(i, "n")], snap.schema)
    store.transaction(lambda s: s.run("t", row(1)))
    with pytest.raises(ZeroDivisionError):
        store.transaction(lambda s: (s.run("t", row(2)), 1 / 0))
    with pytest.raises(RuntimeError):
        store.transaction(lambda s: s.transaction(lambda _: None))
    assert [r.id for r in snap.read().collect()] == [1]
    snap.upsert(spark.createDataFrame([(1, "new"), (3, "n")], snap.schema), "id")
    assert sorted(map(tuple, snap.read().collect())) == [(1, "new"), (3, "n")]


def test_upsert_of_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "n_chars").collect()]
    assert sorted(map(tuple, QUERIES["stream_upsert"](spark, sf).collect())) == sorted([*docs, (-1, "own", -1), (-2, "own", -1)])


def test_migrations(spark, tmp_path):
    assert migrations.statements("CREATE x; -- a ; ' b\nINSERT 'a;b'; /* ; */ $$ x; y $$;") == ["CREATE x", "INSERT 'a;b'", "$$ x; y $$"]
    folder = tmp_path / "m"
    folder.mkdir()
    (folder / "002_b.sql").write_text("CREATE OR REPLACE TEMP VIEW corvane_m2 AS SELECT * FROM corvane_m1;")
    (folder / "001_a.sql").write_text("CREATE OR REPLACE TEMP VIEW corvane_m1 AS SELECT 1 AS x;")
    ledger = state.Snapshot(spark, f"file://{tmp_path}/ledger", migrations.SCHEMA)
    assert migrations.migrate(spark, str(folder), ledger) == [1, 2] and migrations.migrate(spark, str(folder), ledger) == []
    assert migrations.current(ledger) == migrations.latest(str(folder)) == 2


def test_config(tmp_path):
    assert config.merged({"a": {"b": 1, "c": [1, 2]}, "d": 1}, {"a": {"c": [3]}, "d": None}) == {"a": {"b": 1, "c": [3]}, "d": 1}
    user = config.save_global({"k": 1}, tmp_path / "u" / "c.json")
    (tmp_path / config.NAME).write_text(json.dumps({"k": 2}))
    assert config.load({"k": 0, "z": 9}, str(tmp_path), user) == {"k": 2, "z": 9}


def test_batches_of_a_client():
    class Client:
        def create(self, requests):
            return {"id": "b1"}

        def retrieve(self, i):
            return {"processing_status": "ended" if i == "b1" else "in_progress"}

        def results(self, i):
            return [{"custom_id": "1", "result": {"type": "succeeded", "message": "2"}}, {"custom_id": "2", "result": {"type": "errored"}}, {"custom_id": "3", "result": {"type": "succeeded", "message": "x"}}]

    c = Client()
    assert state.submit_batch(c, [{}, {}]) == ("b1", 2) and [p["done"] for p in state.poll_batches(c, ["b1", "b2"])] == [True, False]
    out = list(state.iterate_results(c, "b1", lambda i, m: int(m)))
    assert out[0]["data"] == 2 and "error" in out[1] and isinstance(out[2]["error"], ValueError)
