import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from corvane.llm import ngram_lm
from corvane.llm.ngram_lm import discounts, op9_lm_scoring, score_texts

SCHEMA = "doc_id long, text string, block string"


def tokens(t):
    return [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x] + ["</s>"]


def brute(rows, order=3):
    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    three, uses, uni = Counter(), Counter(), Counter()
    for i, t, *_ in rows:
        if not out_of(i):
            w = ["<s>", "<s>"] + tokens(t)
            uni.update(w[2:])
            three.update(zip(w, w[1:], w[2:]))
            uses.update(zip(w[:-1], w[1:-1]))
    two = Counter((v, w) for _, v, w in (three if order == 3 else three.elements()))
    one = Counter(w for _, w in two)
    after_two, after_one, of_one = defaultdict(Counter), defaultdict(Counter), Counter()
    for (u, v, _), n in three.items():
        after_two[u, v][min(n, 3)] += 1
    for (v, _), n in two.items():
        after_one[v][min(n, 3)] += 1
        of_one[v] += n
    d3, d2, d1 = (discounts([sum(1 for n in c.values() if n == k) for k in (1, 2, 3, 4)]) for c in (three, two, one))
    N, V, L = sum(uni.values()), len(uni), len(two)
    spare = sum(d1[min(n, 3)] for n in one.values())

    def p1(w):
        return (one[w] - d1[min(one[w], 3)] + spare / (V + 1)) / L if L else 1 / (V + 1)

    def p2(v, w):
        if not of_one[v]:
            return p1(w)
        return (two[v, w] - d2[min(two[v, w], 3)] + sum(d2[k] * n for k, n in after_one[v].items()) * p1(w)) / of_one[v]

    def p3(u, v, w):
        if order == 2 or not uses[u, v]:
            return p2(v, w)
        return (three[u, v, w] - d3[min(three[u, v, w], 3)] + sum(d3[k] * n for k, n in after_two[u, v].items()) * p2(v, w)) / uses[u, v]

    found = []
    for i, t, *_ in rows:
        w = tokens(t)
        base = sum(math.log10((uni[x] + 0.5) / (N + 0.5 * (V + 1))) for x in w)
        padded = ["<s>", "<s>"] + w
        found.append((i, out_of(i), len(w), sum(1 for x in w if uni[x]), N, round(base, 5), round(sum(math.log10(p3(*g)) for g in zip(padded, padded[1:], w)), 5)))
    if L:
        for u, v in [("<s>", "<s>"), *list(uses)[:20]]:
            assert abs(sum(p3(u, v, w) for w in uni) + p3(u, v, "never seen") - 1) < 1e-9
    return sorted(found, key=repr)


def result(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    r = random.Random(3)
    words = ["the", "of", "Ünd", "été", "THE"] + ["w%d" % k for k in range(80)]
    rows = [(i, r.choice((" ", "\n", " \t")).join(r.choice(words[: r.randint(5, 85)]) for _ in range(r.randint(1, 60))), "b") for i in range(120)]
    rows += [(200, None, None), (201, "", "b"), (None, "the of the of", "b"), (202, rows[0][1], "b"), (202, rows[0][1], "b"), (203, "  lead and trail \n", "b"), (204, "x" * 5000, "b")]
    for parts in (1, 3, 20):  # grams that one block holds alone, and such that many share
        for order in (2, 3):
            assert result(score_texts(spark.createDataFrame(rows, SCHEMA).repartition(parts), order=order)) == brute(rows, order)


def test_no_training_rows_and_empty_table(spark):
    only = [(i, "a b", "b") for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]
    assert result(score_texts(spark.createDataFrame(only, SCHEMA))) == brute(only)
    assert score_texts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_large_counts_and_wide_gaps_travel():
    r = np.random.default_rng(1)
    for h in (np.array([7], np.uint64), np.sort(r.integers(0, 2**63, 5).astype(np.uint64)), np.sort(r.integers(0, 2**63, 100_000).astype(np.uint64))):
        assert (ngram_lm.decode_keys(ngram_lm.encode_keys(h)) == h).all()
    for v in ([[0, 255]], [[256, 1]], [[2**32, 3]], [[2**62, 0]]):
        assert (ngram_lm.decode_values(ngram_lm.encode_values(np.array(v)), 2) == v).all()


def test_query_beats_unigrams_on_held_out_texts(spark):
    rows = [r for r in op9_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(rows) > 100 and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_few_large_counts_travel_beside_many_small_ones():
    v = np.arange(4000).reshape(-1, 2) % 250
    v[7], v[900, 1] = (255, 2**40), 256
    blob = ngram_lm.encode_values(v)
    assert (ngram_lm.decode_values(blob, 2) == v).all() and len(blob) < 4100


def test_query_scores_by_trigrams(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert result(op9_lm_scoring(spark, "/root/testdata/sf0.001")) == brute([tuple(r) for r in rows])


def test_order_of_numbers_that_agree_in_their_upper_bits():
    r = np.random.default_rng(2)
    for n in (0, 1, 5, 3000, 100_000):
        wide, near = r.integers(0, 2**64, n, dtype=np.uint64), np.uint64(1 << 63) + r.integers(0, 50, n, dtype=np.uint64)
        for h in (wide, near, np.concatenate([wide, near, near[:7]]), np.append(wide >> np.uint64(40), np.uint64(2**64 - 1))):
            order, out = ngram_lm.sorted_by(h)
            assert (order == np.argsort(h, kind="stable")).all() and (out == np.sort(h)).all()
            found, place = ngram_lm.ranked(h)
            assert (found == np.unique(h)).all() and (found[place] == h).all()
