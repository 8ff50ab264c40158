"""Approximate neighbours: an inverted-list index over unit vectors.

Lists belong to centroids that are fitted on a bounded sample; every row is indexed, in blocks of its list, so a list
that holds a third of all rows is many blocks. A query reads the ``probes`` lists whose centroids are nearest: more
probes, more recall; with all lists the answer is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 4_096
PACKED = {"list": pa.int32(), "ids": pa.binary(), "vectors": pa.binary()}


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=-1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def fit(sample: np.ndarray, lists: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means from the rows that are spread widest."""
    x = unit(sample)
    lists = min(lists, len(x))
    c = [x[0]]
    best = x @ c[0]
    while len(c) < lists:
        c.append(x[int(best.argmin())])
        best = np.maximum(best, x @ c[-1])
    c = np.array(c)
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        some = np.bincount(at, minlength=lists) > 0
        c[some] = unit(sums[some])
    return c


def _vectors(batches, dims: int):
    """(ids, unit vectors) of each batch; null, odd or non-finite vectors and null ids are left out."""
    for batch in batches:
        ids, xs = [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if i is not None and v.is_valid and len(v.values) == dims and not v.values.null_count:
                x = np.asarray(v.values, np.float64)
                if np.isfinite(x).all():
                    ids.append(i)
                    xs.append(x)
        if ids:
            yield np.array(ids, np.int64), unit(np.array(xs))


def _pack(rows: DataFrame, centroids: np.ndarray, probes: int, block: int) -> DataFrame:
    """Blocks of the rows of a list; each row goes to its ``probes`` nearest lists."""
    shared, dims = rows.sparkSession.sparkContext.broadcast(centroids), centroids.shape[1]

    def row(at, ids, xs):
        values = (at, np.concatenate(ids).tobytes(), np.concatenate(xs).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, PACKED.values(), strict=True)], list(PACKED))

    def run(batches):
        waiting: dict[int, list] = {}
        for ids, x in _vectors(batches, dims):
            near = np.argsort(-(x @ shared.value.T), axis=1, kind="stable")[:, :probes]
            for at in np.unique(near).tolist():
                mine = (near == at).any(axis=1)
                held = waiting.setdefault(at, [[], [], 0])
                held[0].append(ids[mine])
                held[1].append(x[mine])
                held[2] += int(mine.sum())
                if held[2] >= block:
                    yield row(at, *waiting.pop(at)[:2])
        for at, held in waiting.items():
            yield row(at, *held[:2])

    return rows.mapInArrow(run, "list int, ids binary, vectors binary")


@dataclass
class ListIndex:
    blocks: DataFrame
    centroids: np.ndarray

    def search(self, queries: DataFrame, k: int, *, path: str, probes: int = 8, key: str = "id", vector: str = "embedding") -> DataFrame:
        """query_id, id, rank and cosine distance of up to k rows of the lists that each query reads (its own row too)."""
        asked = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        _pack(asked, self.centroids, probes, 512).write.parquet(f"{path}/queries")
        packed = queries.sparkSession.read.parquet(f"{path}/queries").select("list", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
        dims = self.centroids.shape[1]

        def run(batches):
            for batch in batches:
                for one in batch.to_pylist():
                    ids, q_ids = np.frombuffer(one["ids"], np.int64), np.frombuffer(one["q_ids"], np.int64)
                    x, q = np.frombuffer(one["vectors"]).reshape(-1, dims), np.frombuffer(one["q_vectors"]).reshape(-1, dims)
                    out = []
                    for i, distance in zip(q_ids, 1 - q @ x.T, strict=True):
                        best = np.lexsort((ids, distance))[:k]
                        out.append((np.full(len(best), i), ids[best], distance[best]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "id", "distance"])

        met = self.blocks.join(packed, "list").mapInArrow(run, "query_id long, id long, distance double")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
        return met.withColumn("rank", rank).where(F.col("rank") <= k)


def build(rows: DataFrame, *, path: str, lists: int = 64, sample: int = 20_000, key: str = "id", vector: str = "embedding", block: int = BLOCK) -> ListIndex:
    """An index of every row, with centroids fitted on at most ``sample`` rows, those of the smallest hash of the key."""
    slim = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    drawn = slim.where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    if not drawn:
        raise ValueError("no vectors to index")
    dims = len(drawn[0].v)
    centroids = fit(np.array([r.v for r in drawn if len(r.v) == dims]), lists)
    _pack(slim, centroids, 1, block).write.parquet(path)
    return ListIndex(rows.sparkSession.read.parquet(path), centroids)
