"""Vector ranking, all-pairs similarity and thresholds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.vector import cosine_similarity, dot, l2_distance, normalize


def rank_by_vector(rows: DataFrame, query: Column, *, key: str = "id", vector: str = "embedding", threshold: float | None = None, where: Column | None = None, limit: int = 20) -> DataFrame:
    """Rows by cosine similarity to one vector; above ``threshold`` strictly, ties by key."""
    found = rows.where(F.col(vector).isNotNull())
    if where is not None:
        found = found.where(where)
    found = found.withColumn("similarity", cosine_similarity(F.col(vector), query))
    if threshold is not None:
        found = found.where(F.col("similarity") > threshold)
    return found.orderBy(F.desc("similarity"), key).limit(limit)


def knn(queries: DataFrame, rows: DataFrame, k: int, *, query_key: str = "query_id", key: str = "id", vector: str = "embedding", metric: str = "cosine") -> DataFrame:
    """Each query's k nearest rows (queries in ``vector`` too); a window keeps k per task before it shuffles."""
    q = queries.select(F.col(query_key).alias("query_id"), F.col(vector).alias("query_vector"))
    pairs = rows.select(F.col(key).alias("id"), F.col(vector).alias("v")).crossJoin(q)
    value = l2_distance(F.col("v"), F.col("query_vector")) if metric == "l2" else 1 - cosine_similarity(F.col("v"), F.col("query_vector"))
    pairs = pairs.select("query_id", "id", value.alias("distance"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def _packed(rows: DataFrame, key: str, vector: str, block: int) -> DataFrame:
    """Unit vectors in blocks of one length each."""
    kinds = {"dims": pa.int32(), "ids": pa.binary(), "vectors": pa.binary()}

    def row(dims, ids, vectors):
        x = np.array(vectors, np.float64).reshape(len(ids), dims)
        n = np.sqrt((x * x).sum(axis=1, keepdims=True))
        x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
        values = (dims, np.array(ids, np.int64).tobytes(), x.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds.values(), strict=True)], list(kinds))

    def run(batches):
        waiting: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not v.is_valid or not len(v.values) or v.values.null_count:
                    continue
                x = np.asarray(v.values, np.float64)
                if not np.isfinite(x).all():
                    continue
                ids, vectors = waiting.setdefault(len(x), ([], []))
                ids.append(i)
                vectors.append(x)
                if len(ids) == block:
                    yield row(len(x), *waiting.pop(len(x)))
        for dims, (ids, vectors) in waiting.items():
            yield row(dims, ids, vectors)

    return rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "dims int, ids binary, vectors binary")


def knn_blocks(rows: DataFrame, queries: Column, k: int, *, path: str, key: str = "id", vector: str = "embedding", block: int = 8192, query_block: int = 512) -> DataFrame:
    """As ``knn`` by cosine distance, for many queries: the rows of which ``queries`` holds, against all rows (a query's
    own row too), as products of blocks; each pair of blocks gives at most k rows a query. Intermediate tables go to
    ``path``.

    Null ids, and vectors that are null or empty or hold a null, NaN or infinity, take no part; vectors meet those of their own
    length; ties go by key.
    """
    return knn_between(rows.where(queries), rows, k, path=path, query_key=key, key=key, vector=vector, block=block, query_block=query_block)


def knn_between(queries: DataFrame, rows: DataFrame, k: int, *, path: str, query_key: str = "query_id", key: str = "id", vector: str = "embedding", block: int = 8192, query_block: int = 512) -> DataFrame:
    """``knn_blocks`` of the rows of one table against those of another; keys are integers."""
    spark = rows.sparkSession
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def save(df, name, at_once):
        before = spark.conf.get(conf)
        spark.conf.set(conf, at_once)
        try:
            df.write.parquet(f"{path}/{name}")
        finally:
            spark.conf.set(conf, before)
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    asked = queries.select(query_key, vector)
    n = asked.count()
    index = save(_packed(rows, key, vector, block), "rows", 1024)
    packed = save(_packed(asked.repartition(max(1, -(-n // query_block)), query_key), query_key, vector, query_block), "queries", 1024)
    pairs = index.crossJoin(packed.select(*(F.col(c).alias(f"q_{c}") for c in ("dims", "ids", "vectors"))))

    def run(batches):
        for batch in batches:
            for one in batch.to_pylist():
                dims = one["dims"]
                if dims != one["q_dims"]:  # as a condition Spark would join by it, in one task
                    continue
                ids, q_ids = np.frombuffer(one["ids"], np.int64), np.frombuffer(one["q_ids"], np.int64)
                x, q = np.frombuffer(one["vectors"]).reshape(-1, dims), np.frombuffer(one["q_vectors"]).reshape(-1, dims)
                rough, out = q @ x.T, []
                # Products of matrices may differ in the last bits for equal vectors; who may be among the k is summed anew.
                bar = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] - 1e-9 if len(ids) > k else np.full(len(q), -np.inf)
                for row in range(len(q)):
                    who = np.flatnonzero(rough[row] >= bar[row])
                    distance = 1 - (x[who] * q[row]).sum(axis=1)
                    best = np.lexsort((ids[who], distance))[:k]
                    out.append((np.full(len(best), q_ids[row]), ids[who[best]], distance[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "id", "distance"])

    met = save(pairs.mapInArrow(run, "query_id long, id long, distance double"), "met", 1)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def similarity_matrix(a: DataFrame, b: DataFrame, *, key: str = "id", vector: str = "embedding") -> DataFrame:
    """All pairs in long form. Vectors are normalised once, so a pair costs one inner product."""
    left = a.select(F.col(key).alias("a_id"), normalize(F.col(vector)).alias("u"))
    right = b.select(F.col(key).alias("b_id"), normalize(F.col(vector)).alias("v"))
    return left.crossJoin(right).select("a_id", "b_id", dot(F.col("u"), F.col("v")).alias("similarity"))


def find_threshold(matrix: DataFrame, target: int) -> DataFrame:
    """One row: the target-th largest similarity; 0 if the matrix has no more than target values; infinity if target < 1."""
    total = matrix.agg(F.count("*").alias("total"))
    kth = matrix.orderBy(F.desc("similarity")).limit(max(target, 0)).agg(F.min("similarity").alias("kth"))
    value = F.when(F.lit(target) >= F.col("total"), 0.0).when(F.lit(target) <= 0, F.lit(math.inf)).otherwise(F.col("kth"))
    return total.crossJoin(kth).select(value.alias("threshold"))


def pairs_above(matrix: DataFrame, threshold: float) -> DataFrame:
    return matrix.where(F.col("similarity") >= threshold)


def grouped_pairs(matrix: DataFrame, threshold: float) -> DataFrame:
    """Pairs by row; rows without any are absent."""
    return pairs_above(matrix, threshold).groupBy("a_id").agg(F.sort_array(F.collect_list(F.struct("b_id", "similarity"))).alias("pairs"))
