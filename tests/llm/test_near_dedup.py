import random
import re

from corvane.llm.near_dedup import drop_near_duplicates, near_duplicates, op4_minhash_near_dedup

SCHEMA = "doc_id long, text string, component string"


def brute(rows, shingle, percent):
    sets = []
    for i, t, *_ in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        m = min(shingle, len(w))
        sets.append((i, {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if w else set()))
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where: dict = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    for k, (i, s) in enumerate(sets):
        counts: dict = {}
        for x in s:
            for j in where[x]:
                if j < k:
                    counts[j] = counts.get(j, 0) + 1
        for j, c in counts.items():
            if i is not None and sets[j][0] is not None and 100 * c >= percent * (len(s) + len(sets[j][1]) - c):
                a, b = sorted((root(i), root(sets[j][0])))
                parent[b] = a
    return sorted(((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets), key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


def corpus(seed, n=150):
    r = random.Random(seed)
    words = ["Word%d" % k for k in range(400)] + ["Ünd"] * 20
    rows, bases = [], [[r.choice(words) for _ in range(r.choice((2, 3, 5, 40, 120)))] for _ in range(12)]
    for i in range(n):
        b = list(r.choice(bases))
        for _ in range(r.choice((0, 0, 1, 2, 3, 6))):
            b[r.randrange(len(b))] = r.choice(words)
        rows.append((n - i, r.choice((" ", "\n", " \t ")).join(b), "c"))
    rows += [(900, None, None), (901, "", "x"), (902, " \n", "x"), (None, rows[0][1], "x"), (903, rows[5][1].upper(), "x"), (903, rows[5][1].upper(), "x")]
    return rows


def test_against_brute_force(spark):
    for seed, (shingle, percent) in enumerate(((3, 85), (5, 80))):
        rows = corpus(seed)
        got = result(near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), shingle=shingle, percent=percent))
        assert got == brute(rows, shingle, percent)


def test_crowded_buckets_of_unlike_texts_keep_their_links(spark):
    """Texts that share four fifths, so they meet in bands though few are links; no pair may be lost."""
    r = random.Random(5)
    common = ["c%d" % k for k in range(100)]
    tails = [["t%d-%d" % (i, k) for k in range(14)] for i in range(60)]
    rows = [(i, " ".join(common + tail), "") for i, tail in enumerate(tails)]
    rows += [(100 + i, " ".join(common + tails[i][:12] + ["u%d" % i, "v%d" % i]), "") for i in range(0, 60, 7)]
    r.shuffle(rows)
    got = result(near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=1, percent=85))
    assert got == brute(rows, 1, 85)


def test_empty_table_and_kept_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).collect() == []
    rows = [(2, "a b c d e f g", "two"), (1, "a b c d e f g", "one"), (3, None, "three")]
    assert sorted(map(tuple, drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())) == [(1, "a b c d e f g", "one"), (3, None, "three")]


def test_repeated_and_null_ids(spark):
    x, y, z = ("".join(" %s%d" % (c, k) for k in range(20)) for c in "xyz")
    rows = [(5, x, "a"), (5, x, "a"), (5, y, "b"), (3, x, "c"), (7, z, "d"), (7, z, "d"), (8, z, "e"), (9, None, "f"), (9, None, "f"), (None, x, "g"), (None, x, "g")]
    out = drop_near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, out), key=repr) == sorted([(5, y, "b"), (3, x, "c"), (7, z, "d"), (9, None, "f"), (None, x, "g"), (None, x, "g")], key=repr)


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert result(op4_minhash_near_dedup(spark, "/root/testdata/sf0.01")) == brute(rows, 3, 85)


def test_columns_of_any_name(spark):
    names = ["gone_key", "corvane_gone", "id", "near_row", "text_digest", "component_id", "Kept"]
    for ids in ((2, 1, 3), (2, 2, 3)):
        rows = [(i, t, *range(k * 10, k * 10 + len(names))) for k, (i, t) in enumerate(zip(ids, ("a b c d e f g", "a b c d e f g", None)))]
        df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` long" for c in names))
        out = drop_near_duplicates(df)
        assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == sorted({min(ids[:2]), 3})


def test_a_crowd_of_partners_is_dealt(spark, monkeypatch):
    from corvane.llm import near_dedup

    monkeypatch.setattr(near_dedup, "CROWD", 3)
    rows = corpus(4)
    assert result(near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), shingle=3, percent=85)) == brute(rows, 3, 85)
