"""Retrieval metrics over arrays of returned and expected ids, and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("precision", "hit_rate", "recall", "mrr", "ndcg")


def _positive(k: int) -> int:
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    return k


def _hits(returned: Column, expected: Column) -> Column:
    return F.size(F.filter(returned, lambda x: F.array_contains(expected, x)))


def _or_empty(returned: Column, expected: Column, value: Column) -> Column:
    """With nothing expected: 1 if nothing was returned, else 0."""
    nothing = F.when(F.size(returned) == 0, 1.0).otherwise(0.0)
    return F.when(F.size(expected) == 0, nothing).otherwise(value.cast("double"))


def precision_at_k(returned: Column, expected: Column, k: int) -> Column:
    return _or_empty(returned, expected, _hits(F.slice(returned, 1, _positive(k)), expected) / F.lit(float(k)))


def hit_rate_at_k(returned: Column, expected: Column, k: int) -> Column:
    most = F.least(F.lit(_positive(k)), F.size(expected))
    return _or_empty(returned, expected, F.try_divide(_hits(F.slice(returned, 1, k), expected).cast("double"), most.cast("double")))


def recall(returned: Column, expected: Column) -> Column:
    found = F.size(F.filter(expected, lambda x: F.array_contains(returned, x)))
    return _or_empty(returned, expected, F.try_divide(found.cast("double"), F.size(expected).cast("double")))


def mrr(returned: Column, expected: Column) -> Column:
    ranks = F.filter(F.transform(returned, lambda x, i: F.when(F.array_contains(expected, x), i + 1)), lambda r: r.isNotNull())
    return _or_empty(returned, expected, F.coalesce(1.0 / F.array_min(ranks), F.lit(0.0)))


def ndcg(returned: Column, expected: Column, k: int = 10) -> Column:
    gains = F.transform(F.slice(returned, 1, _positive(k)), lambda x, i: F.when(F.array_contains(expected, x), 1.0 / F.log2(i + 2.0)).otherwise(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.size(expected)))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return _or_empty(returned, expected, F.aggregate(gains, F.lit(0.0), lambda s, x: s + x) / ideal)


def evaluate(runs: DataFrame, k: int, *, ndcg_k: int = 10, returned: str = "returned", expected: str = "expected") -> DataFrame:
    r, e = F.col(returned), F.col(expected)
    return runs.withColumns(dict(zip(METRICS, (precision_at_k(r, e, k), hit_rate_at_k(r, e, k), recall(r, e), mrr(r, e), ndcg(r, e, ndcg_k)), strict=True)))


def summarize(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("n_queries"), *(F.avg(m).alias(m) for m in METRICS))


def evaluate_gates(summary: DataFrame, gates: DataFrame) -> DataFrame:
    """A row per gate (metric, threshold) with what was measured and whether it passes (equality does)."""
    long = summary.unpivot([], list(METRICS), "metric", "actual")
    return gates.join(F.broadcast(long), "metric").select("metric", "threshold", "actual", (F.col("actual") >= F.col("threshold")).alias("passed"))


def all_gates_passed(results: DataFrame) -> DataFrame:
    return results.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"))
