"""The pipeline's stages against brute force, each on its own input, and as a whole on a small corpus."""

import random

import corpus_pipeline as c
from corvane.llm.work import Workspace
from pyspark.sql import functions as F
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_small_operators import benchmark_brute
from tests.llm.test_suffix_dedup import brute as passage_brute

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs, work = spark.read.parquet(f"{SF}/documents.parquet"), Workspace(spark, "test")
    columns, seen = docs.columns, {}
    assert [n.split("_")[0] for n, _ in c.STAGES] == ["quality", "minhash", "suffix", "benchmark", "best"]
    for name, stage in c.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = work.save(stage(spark, docs, SF), name)
        seen[name] = (before, docs.collect())
        if name != c.STAGES[-1][0]:
            assert docs.columns == columns
    before, after = seen["quality_classifier"]
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id: r.text for r in after}
    assert all(before[i] == t for i, t in kept.items())
    clean, rest = ([i for i in before if i in labels and (labels[i] == (1, 0)) == x] for x in (True, False))
    # 87 labels are all that there is to learn from here.
    assert sum(i in kept for i in clean) >= 0.98 * len(clean) and sum(i not in kept for i in rest) >= 0.5 * len(rest) > 0
    before, after = seen["minhash_near_dedup"]
    rows = near_brute(list(before.items()), 5, 80)
    assert {r.doc_id for r in after} == {i for i, _, _, kept in rows if kept}
    before, after = seen["suffix_array_dedup"]
    removed = {i: n for i, _, n, _, _ in passage_brute(list(before.items()), c.PASSAGE_BYTES)}
    kept = {r.doc_id: r.text for r in after}
    for i, t in before.items():
        if not removed[i]:
            assert kept[i] == t
        elif i in kept:
            assert len(t.encode()) - removed[i] - 6 <= len(kept[i].encode()) <= len(t.encode()) - removed[i]
    before, after = seen["benchmark_decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, _, hit, _ in benchmark_brute(list(before.items()), items, 10) if not hit}
    kept = {r.doc_id: r.text for r in after}
    assert all(kept[i] == before[i] for i in clean)
    assert all(not hit for _, _, hit, _ in benchmark_brute([x for x in kept.items() if x[0] not in clean], items, 10))
    before, after = seen["best_fit_packing"]
    assert {r.doc_id for r in after} == set(before)


def test_run_on_a_clean_corpus_keeps_it(spark, tmp_path):
    r = random.Random(4)
    say = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n))
    rows = [(i, say(r.randint(30, 90)), "en", "s%d" % (i % 3), 1) for i in range(40)] + [(50, None, "en", None, 0), (51, "", None, "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, say(20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = c.run(spark, f"file://{tmp_path}")
    assert out.select(F.count_distinct("doc_id")).first()[0] == len(rows)


def test_odd_documents(spark, tmp_path):
    """Clashing names, repeated and null ids, and an empty table pass through every stage."""
    r = random.Random(6)
    say = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n))
    passage = say(60)
    rows = [(i, say(40), "en", "s", 1, i, i, i, i) for i in range(20)]
    rows += [(30, passage + say(50), "en", "s", 1, 0, 0, 0, 0), (40, say(50) + passage, "en", "s", 1, 0, 0, 0, 0), (40, passage + say(45), "en", "s", 1, 1, 1, 1, 1)]
    rows += [(None, say(30), None, None, None, 2, 2, 2, 2), (None, None, None, None, None, 3, 3, 3, 3), (3, rows[3][1], "en", "s", 1, 4, 4, 4, 4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept long, n_words long, corvane_evidence long, gone_key long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, say(20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        work, n = Workspace(spark, "odd"), docs.count()
        for name, stage in c.STAGES[:-1]:
            after = work.save(stage(spark, docs, f"file://{tmp_path}"), name)
            assert after.columns == docs.columns
            docs = after
        found = sorted(((x.doc_id is None, x.doc_id or 0, x.text or "") for x in docs.collect()))
        assert len(found) == (n - 1 if n else 0)  # the row that repeats id and text goes
        if n:
            assert not any(passage in t for _, i, t in found if i == 40) and any(t.startswith(passage) for _, i, t in found if i == 30)
        assert work.save(c.STAGES[-1][1](spark, docs, f"file://{tmp_path}"), "last").select("doc_id").distinct().count() == len({(a, b) for a, b, _ in found})
