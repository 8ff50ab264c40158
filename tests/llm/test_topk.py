import random

import pytest
from corvane.llm.topk import top_k
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k):
    import math

    import numpy as np

    vectors = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], set()
    for i, q in vectors:
        if i % 5 or i in seen:
            continue
        seen.add(i)
        found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in vectors if j != i and len(v) == len(q))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def result(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def test_against_brute_force(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(8)], "s") for i in range(300)]
    rows += [(400 + i, rows[7][1], "s") for i in range(30)] + [(401, rows[7][1], "s")]
    rows += [(500, None, None), (505, [1.0, None] * 4, "n"), (510, [float("nan")] * 8, "n"), (515, [float("inf")] * 8, "n"), (520, [0.5] * 3, "s"), (521, [-0.5] * 3, "s"), (None, rows[0][1], "s"), (525, [0.0] * 8, "z")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for k, rescored in ((10, 12), (3, 1000), (400, 5)):
        got = result(top_k(df, F.col("vec_id") % 5 == 0, k=k, block=64, query_block=16, rescored=rescored))
        assert got == brute(rows, k)


def test_empty_table(spark):
    assert top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 5 == 0).collect() == []


def test_rows_of_one_id_are_one_query(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (100, [0.0, 1.0]), (1, [0.5, 0.25]), (1, [0.25, 0.5]), (2, [-1.0, 0.75]), (3, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for block in (1, 2, 100):
        out = top_k(df, F.col("vec_id") == 100, k=4, scale=100, block=block, query_block=block)
        assert sorted((r["rank"], r.vec_id, r.score) for r in out.collect()) == [(1, 2, 7500), (2, 1, 5000), (3, 1, 5000), (4, 3, 0)]


def test_scores_beyond_doubles_and_beyond_integers(spark):
    big = 2.0**29
    rows = [(0, [big + 1.0, 1.0]), (1, [big + 1.0, 3.0]), (2, [big + 1.0, 2.0]), (3, [-big, 0.0])]
    out = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=3, scale=1).collect()
    a = 2**29 + 1
    assert sorted((r["rank"], r.vec_id, r.score) for r in out) == [(1, 1, a * a + 3), (2, 2, a * a + 2), (3, 3, -(2**29) * a)]
    with pytest.raises(Exception, match="too large|64-bit"):
        top_k(spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
