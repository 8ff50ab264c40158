"""Exact top-k by inner product over an impact-ordered index, a score at a time.

Components are quantised, x to floor(scale * x). The index holds the vectors in blocks; a block's postings (component,
vector, value) lie in one list, in segments of descending quantised impact (|value| by powers of two), within a segment
by component, and each vector has the norm of what it still has outside the segments read so far.

A block of queries reads a block of vectors segment by segment: each posting adds its exact product to the accumulators
of its vector, and nothing else of the vectors is touched. After each segment what is missing from a score is at most
|query| * |rest of the vector| (Cauchy-Schwarz), which gives each candidate a lower and an upper bound. A query stops
only on proof: when at most ``rescored`` candidates have an upper bound that reaches its k-th best lower bound (ties
count as reaching), or all segments are read. Those possible members, however many, are rescored exactly. Scores that
earlier blocks of the same task have reached raise the bar for later ones, and a block whose longest vector can't reach
a query's bar isn't read for it.

Queries are blocks of rows of a table too and meet the vectors' blocks as pairs of packed rows, so nothing is broadcast
by this code and no block grows with the data. Each pair gives at most k rows a query.

Defined cases: null vectors and vectors with a null or non-finite component take no part; vectors of another length
than a query's are no candidates of it; a null id takes no part; query rows of one id, equal or not, are one query, to
which a candidate row has its best score; repeated candidates are all ranked, and rows with the query's own id are left
out; with fewer than k candidates all are returned; an empty table gives no rows; extra columns are ignored. Scores
beyond 53 bits are computed as 64-bit integers without bounds; where even those could overflow an error is raised.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.work import Workspace, lean, read

BLOCK = 8_192
PACKED = "dims int, ids binary, rows binary, vectors binary, cells binary, ends binary"
NAMES = [x.split()[0] for x in PACKED.split(", ")]


def pack(rows: DataFrame, key: str, vector: str, *, scale: int, block: int, index: bool) -> DataFrame:
    """Blocks of quantised vectors, with their postings in impact order if they are to be searched."""

    def row(dims, ids, numbers, vectors):
        x = np.concatenate(vectors)
        cells, ends = postings(x) if index else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        values = [np.array(ids, np.int64).tobytes(), np.array(numbers, np.int64).tobytes(), x.astype("<i8").tobytes(), cells.tobytes(), ends.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), *(pa.array([v], pa.binary()) for v in values)], NAMES)

    def run(batches):
        waiting: dict[int, tuple[list, list, list]] = {}
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                number += 1
                x = v.values
                if i is None or not v.is_valid or x is None or x.null_count:
                    continue
                x = np.asarray(x, dtype=np.float64)
                if not np.isfinite(x).all():
                    continue
                x = np.floor(x * scale)
                if len(x) and np.abs(x).max() >= 2.0**62:
                    raise OverflowError(f"a component of row {i} is too large for 64-bit integers")
                ids, numbers, vectors = waiting.setdefault(len(x), ([], [], []))
                ids.append(i)
                numbers.append(number)
                vectors.append(x.astype(np.int64)[None])
                if len(ids) == block:
                    yield row(len(x), *waiting.pop(len(x)))
        for dims, some in waiting.items():
            yield row(dims, *some)

    return rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).mapInArrow(lean(run), PACKED)


def postings(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells (component * vectors + vector) by descending impact level, then component, and where each segment ends. Zeros
    have no posting."""
    size = np.abs(x.T).reshape(-1)
    level = np.frexp(size.astype(np.float64))[1]
    level[size == 0] = 0
    order = np.argsort(-level, kind="stable")
    order = order[: int((level > 0).sum())]
    kinds = level[order]
    return order.astype(np.int32), (np.append(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1, len(kinds)) if len(kinds) else np.zeros(0)).astype(np.int64)


def search(q_ids, q, ids, x, cells, ends, k: int, bar: np.ndarray, rescored: int):
    """(query place, candidate place, score) of each query's possible best k; ``bar``: scores to reach, raised here."""
    n, dims = x.shape
    out = []
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    norms, rest = np.sqrt((qf**2).sum(axis=1)), (xf**2).sum(axis=1)
    longest = norms.max(initial=0) * np.sqrt(rest.max(initial=0))
    if longest >= 2.0**62:
        raise OverflowError("scores may not fit 64-bit integers")
    if longest >= 2.0**53:  # doubles would round
        for row in range(len(q)):
            who = np.flatnonzero(ids != q_ids[row])
            exact = x[who] @ q[row]
            best = np.lexsort((ids[who], -exact))[:k]
            out.append((np.full(len(best), row), who[best], exact[best]))
        return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    active = np.flatnonzero(norms * np.sqrt(rest.max(initial=0)) * (1 + 1e-9) + 1e-6 >= bar)
    # A row of accumulators per vector, so that a posting adds to neighbours.
    score, turned, start = np.zeros((n, len(active))), np.ascontiguousarray(qf[active].T), 0
    for step in range(1, len(ends) + 1) or [0]:
        if not len(active):
            break
        if step:
            part = cells[start : ends[step - 1]].astype(np.int64)
            start = ends[step - 1]
            component, vectors = part // n, part % n
            edges = np.searchsorted(component, np.arange(dims + 1))
            for j in np.unique(component).tolist():
                who = vectors[edges[j] : edges[j + 1]]
                value = xf[who, j]
                score[who] += value[:, None] * turned[j]
                rest[who] -= value**2
        last = step == len(ends)
        error = np.sqrt(np.maximum(rest, 0))[:, None] * norms[active] * (0 if last else 1 + 1e-9) + (0 if last else 1e-6)
        own = ids[:, None] == q_ids[active]
        low = np.where(own, -np.inf, score - error)
        top = np.partition(low, n - k, axis=0)[n - k] if n >= k else np.full(len(active), -np.inf)
        possible = (score + error >= np.maximum(top, bar[active])) & ~own
        ready = np.full(len(active), last) | (possible.sum(axis=0) <= max(rescored, k))
        for row in np.flatnonzero(ready):
            who = np.flatnonzero(possible[:, row])
            exact = x[who] @ q[active[row]]
            best = np.lexsort((ids[who], -exact))[:k]
            out.append((np.full(len(best), active[row]), who[best], exact[best]))
            if len(best) == k:
                bar[active[row]] = max(bar[active[row]], exact[best[-1]])
        if ready.any():
            active, score, turned = active[~ready], score[:, ~ready], np.ascontiguousarray(turned[:, ~ready])
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3


def top_k(rows: DataFrame, queries: Column, *, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, query_block: int = 512, rescored: int = 64) -> DataFrame:
    """query_id, rank, key and score of each query's k best; ``queries`` says which rows are queries."""
    spark = rows.sparkSession
    work = Workspace(spark, "topk")
    asked = rows.where(queries).select(key, vector).distinct()
    n, ids = asked.agg(F.count("*"), F.count_distinct(key)).first()
    repeated = n > ids  # several vectors of one id: one query
    index = work.save(pack(rows, key, vector, scale=scale, block=block, index=True), "index")
    packed = work.save(pack(asked.repartition(max(1, -(-n // query_block)), key), key, vector, scale=scale, block=query_block, index=False), "queries")
    pairs = index.crossJoin(packed.select(*(F.col(c).alias(f"q_{c}") for c in ("dims", "ids", "vectors"))))

    def run(batches):
        bars: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                dims = row["dims"]
                if dims != row["q_dims"]:  # as a condition Spark would join by it, in one task
                    continue
                ids, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], "<i8").reshape(-1, dims)
                q_ids, q = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_vectors"], "<i8").reshape(-1, dims)
                if len(bars) > 64:
                    bars.clear()
                bar = bars.setdefault(row["q_ids"] + row["q_vectors"], np.full(len(q_ids), -np.inf))
                a, b, s = search(q_ids, q, ids, x, np.frombuffer(row["cells"], np.int32), np.frombuffer(row["ends"], np.int64), k, bar, rescored)
                numbers = np.frombuffer(row["rows"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[a]), pa.array(ids[b]), pa.array(numbers[b]), pa.array(s.astype(np.int64))], ["query_id", "id", "row", "score"])

    met = work.save(pairs.mapInArrow(lean(run), "query_id long, id long, row long, score long"), "met", rows=1)
    if repeated:
        met = met.groupBy("query_id", "id", "row").agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return met.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")


def op8_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH whole AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT) AS score
  FROM whole q, whole c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id GROUP BY q.vec_id, c.vec_id, c.r
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
