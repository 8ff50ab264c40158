"""k-means by cosine distance and silhouettes.

Each Lloyd step is one job: centroids (k vectors) go out, k sums come back. Rows stay in the DataFrame. Start points
are drawn as D^2 weighting has it, walked in the order of ``order``; the walk runs over partial sums of partitions and
then inside one, so it reads no more than a partition's weights.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.vector import dot, normalize
from corvane.operators.numbering import numbered

MASK = 2**64 - 1


def splitmix(x: int) -> int:
    x &= MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def mix_seed64(master: int, k: int, run: int) -> int:
    return splitmix(splitmix((master ^ (k * 0x9E3779B97F4A7C15)) & MASK) ^ run)


def mix_seed(master: int, k: int, run: int) -> int:
    x = mix_seed64(master, k, run)
    return (x ^ (x >> 32)) & 0xFFFFFFFF


# Seeds, shifts and multipliers of the generator below and the mixers above.
class Rng:
    """Four 32-bit words of state; the seeds of the last three are products of floats, low bits lost."""

    def __init__(self, seed: int):
        self.s = [(seed & 0xFFFFFFFF) or 1, *((int(float(seed) * m) % 2**32) or 1 for m in (2654435761.0, 2246822519.0, 3266489917.0))]

    def __call__(self) -> float:
        s0, s1, s2, s3 = self.s
        m = 0xFFFFFFFF
        five = s1 * 5
        rotated = ((five << 7) & m) | ((five & m) >> 25)
        signed = rotated - 2**32 if rotated >= 2**31 else rotated
        t = (s1 << 9) & m
        s2 ^= s0
        s3 ^= s1
        s1 ^= s2
        s0 ^= s3
        s2 ^= t
        s3 = ((s3 << 11) & m) | (s3 >> 21)
        self.s = [s0, s1, s2, s3]
        return (signed * 9 % 2**32) / 2**32


@dataclass
class Clusters:
    k: int
    centroids: DataFrame  # cluster_id, centroid, size
    assignments: DataFrame  # key, cluster_id, distance
    inertia: float
    iterations: int
    converged: bool
    silhouette: float = 0.0


def listed(spark, centroids) -> DataFrame:
    """Centroids as one row (``corvane_all``: array of struct(c, cluster_id)), to be sent to every task as a table; they are no
    part of the plan."""
    rows = [[{"c": [float(x) for x in c], "cluster_id": i} for i, c in enumerate(centroids)]]
    kind = pa.list_(pa.struct([("c", pa.list_(pa.float64())), ("cluster_id", pa.int32())]))
    return spark.createDataFrame(pa.table({"corvane_all": pa.array(rows, kind)}))  # from Arrow: no Python worker starts for it


def matrix(vectors: pa.Array, dtype: str) -> np.ndarray:
    """The rows of an Arrow array of lists of one length."""
    if vectors.null_count or len(set(np.diff(vectors.offsets).tolist())) > 1:
        raise ValueError("vectors are null or differ in length")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(vectors), -1).astype(np.float64)


def nearest(vector: Column, centroids: Column) -> Column:
    """struct(distance, cluster_id) of the nearest of ``listed`` centroids; ties: the lowest number. ``vector`` is of unit length."""
    return F.array_min(F.transform(centroids, lambda x: F.struct((1 - dot(vector, x["c"])).alias("distance"), x["cluster_id"].alias("cluster_id"))))


def assign(rows: DataFrame, centroids: list, *, key: str = "id", vector: str = "embedding", measured: list | None = None, packed: bool = False) -> DataFrame:
    """key, cluster_id of the nearest centroid, and distance to it (or to the one of that number in ``measured``)."""
    unit = F.col(vector).cast("array<double>") if packed else normalize(F.col(vector))
    spark = rows.sparkSession
    near = rows.select(F.col(key).alias("key"), unit.alias("v")).crossJoin(F.broadcast(listed(spark, centroids))).select("key", "v", nearest(F.col("v"), F.col("corvane_all")).alias("x"))
    out = near.select("key", "v", "x.cluster_id", "x.distance")
    if measured is not None:
        out = out.crossJoin(F.broadcast(listed(spark, measured))).withColumn("distance", 1 - dot(F.col("v"), F.col("corvane_all")[F.col("cluster_id")]["c"]))
    return out.select(F.col("key").alias(key), "cluster_id", "distance")


class _Rows:
    """Normalised vectors in order: a table under ``path``, which a lost executor does not take with it, or else kept on the
    executors' disks and made again where one is lost."""

    def __init__(self, rows: DataFrame, key: str, vector: str, order: str, dtype: str, path: str | None = None):
        self.path = path
        ordered = rows.select(F.col(order).alias("ord"), F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).repartitionByRange("ord").sortWithinPartitions("ord")
        unit = normalize(F.col("v")) if dtype == "float64" else F.col("v")
        self.df = ordered.select("ord", "key", unit.alias("v")).withColumn("part", F.spark_partition_id())
        self.df = self.keep(self.df, "rows")
        self.dtype = dtype
        self.counts = [(r.part, r.n) for r in self.df.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()]
        self.n = sum(n for _, n in self.counts)

    def keep(self, table: DataFrame, name: str) -> DataFrame:
        """``table``, saved beside the rows or kept on the executors' disks."""
        if not self.path:
            return table.persist(StorageLevel.DISK_ONLY)
        table.write.parquet(f"{self.path}-{name}")
        return table.sparkSession.read.schema(table.schema).parquet(f"{self.path}-{name}")

    def at(self, i: int) -> np.ndarray:
        for part, n in self.counts:
            if i < n:
                row = self.df.where(F.col("part") == part).select("ord", "v").orderBy("ord").offset(i).limit(1).first()
                return np.array(row.v, self.dtype)
            i -= n
        raise IndexError(i)

    def weights(self, centroids: list[np.ndarray], part: int | None = None):
        c, dtype = np.array(centroids, np.float64), self.dtype

        def run(batches):
            for batch in batches:
                if len(batch):
                    w = (1 - matrix(batch["v"], dtype) @ c.T).min(axis=1) ** 2
                    yield pa.RecordBatch.from_arrays([batch["part"], batch["ord"], pa.array(w)], ["part", "ord", "w"])

        ord_type = dict(self.df.dtypes)["ord"]
        out = (self.df if part is None else self.df.where(F.col("part") == part)).select("part", "ord", "v").mapInArrow(run, f"part int, ord {ord_type}, w double")
        if part is not None:
            return [r.w for r in out.orderBy("ord").collect()]
        return {r.part: r.w for r in out.groupBy("part").agg(F.sum("w").alias("w")).collect()}

    def draw(self, centroids: list[np.ndarray], rng) -> np.ndarray:
        sums = self.weights(centroids)
        target, before = rng() * sum(sums.get(p, 0.0) for p, _ in self.counts), 0
        for part, n in self.counts:
            if target - sums.get(part, 0.0) <= 0:
                for i, w in enumerate(self.weights(centroids, part)):
                    target -= w
                    if target <= 0:
                        return self.at(before + i)
            else:
                target -= sums.get(part, 0.0)
            before += n
        return self.at(0)

    def step(self, centroids: list[np.ndarray], previous: list[np.ndarray] | None):
        """Sums, counts, inertia and how many rows changed their cluster since ``previous`` (None: all were in 0)."""
        c, old, dtype = np.array(centroids, np.float64), None if previous is None else np.array(previous, np.float64), self.dtype
        k, dims = c.shape

        def run(batches):
            sums, counts, inertia, changed = np.zeros((k, dims)), np.zeros(k), 0.0, 0
            for batch in batches:
                if not len(batch):
                    continue
                x = matrix(batch["v"], dtype)
                d = 1 - x @ c.T
                at = d.argmin(axis=1)
                before = np.zeros(len(x), int) if old is None else (1 - x @ old.T).argmin(axis=1)
                changed += int((at != before).sum())
                inertia += float(d[np.arange(len(x)), at].sum())
                for j in np.unique(at):
                    sums[j] += x[at == j].sum(axis=0)
                counts += np.bincount(at, minlength=k)
            yield pa.RecordBatch.from_pydict({"cluster_id": pa.array(range(k), pa.int32()), "sums": pa.array(sums.tolist(), pa.list_(pa.float64())), "n": counts, "inertia": [inertia] + [0.0] * (k - 1), "changed": [changed] + [0] * (k - 1)})

        out = self.df.select("v").mapInArrow(run, "cluster_id int, sums array<double>, n double, inertia double, changed long")
        parts = out.select("cluster_id", F.posexplode("sums").alias("at", "x"), "n", "inertia", "changed")
        rows = parts.groupBy("cluster_id", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), F.sum("changed").alias("changed")).collect()  # k * dims rows
        sums, counts = np.zeros((k, dims)), np.zeros(k)
        for r in rows:
            sums[r.cluster_id, r.at], counts[r.cluster_id] = r.x, r.n
        first = next(r for r in rows if r.cluster_id == 0 and r.at == 0)
        return sums, counts, first.inertia, first.changed


def moved(sums, counts, centroids: list[np.ndarray]) -> list[np.ndarray]:
    """The normalised means of the members; a centroid without any stays."""
    return [s / n / (np.linalg.norm(s / n) or 1.0) if n else c for s, n, c in zip(sums, counts, centroids, strict=True)]


def lloyd_step(rows: DataFrame, centroids: list, *, key: str = "id", vector: str = "embedding", packed: bool = False) -> list[np.ndarray]:
    """The centroids after one of the steps that ``kmeans`` repeats."""
    data = _Rows(rows, key, vector, key, "float32" if packed else "float64")
    try:
        start = [np.array(c, np.float64) for c in centroids]
        sums, counts, _, _ = data.step(start, None)
        return moved(sums, counts, start)
    finally:
        data.df.unpersist()


class ClusterProvider(Protocol):
    """What may cluster in place of ``kmeans``: another engine, a remote service."""

    def cluster(self, rows: DataFrame, k: int, **options) -> Clusters: ...


class LocalClusters:
    def cluster(self, rows: DataFrame, k: int, **options) -> Clusters:
        return kmeans(rows, k, **options)


def kmeans(rows: DataFrame, k: int, *, seed: int, key: str = "id", vector: str = "embedding", order: str | None = None, max_iterations: int = 100, runs: int = 1, packed: bool = False, on_progress=None, path: str | None = None, data: _Rows | None = None) -> Clusters:
    """The best of ``runs`` by inertia. ``packed``: 4-byte vectors taken as they are, and no silhouette. ``data``: the ordered
    rows, where several calls share them; they stay."""
    if k <= 0:
        raise ValueError(f"k must be positive, got {k}")
    order = order or key
    shared, narrow = data is not None, None
    data = data or _Rows(rows, key, vector, order, "float32" if packed else "float64", path)
    spark = rows.sparkSession
    try:
        if not data.n:
            empty = spark.createDataFrame([], f"cluster_id int, centroid array<double>, size long")
            return Clusters(k, empty, rows.select(key).limit(0).selectExpr("*", "0 cluster_id", "0.0D distance"), 0.0, 0, True)
        if k > data.n:
            raise ValueError(f"k ({k}) exceeds item count ({data.n})")
        best = None
        for run in range(runs):
            rng = Rng(mix_seed(seed, k, run))
            centroids = [data.at(math.floor(rng() * data.n)).astype(np.float64)]
            while len(centroids) < k:
                centroids.append(data.draw(centroids, rng).astype(np.float64))
            used, converged, iteration, inertia = None, False, 0, 0.0
            while iteration < max_iterations:
                sums, counts, inertia, changed = data.step(centroids, used)
                if on_progress:
                    on_progress(iteration, inertia)
                if not changed:
                    converged = True
                    break
                used = centroids
                centroids = moved(sums, counts, centroids)
                iteration += 1
            if best is None or inertia < best[1]:
                # Members are those of the last assignment, distances those to the last centroids.
                best = (centroids, inertia, iteration + converged, converged, centroids if converged or used is None else used)
        centroids, inertia, iterations, converged, judged = best
        placed = assign(rows, judged, key=key, vector=vector, measured=centroids, packed=packed)
        sizes = placed.groupBy("cluster_id").agg(F.count("*").alias("size"))
        table = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cluster_id int, centroid array<double>")
        found = Clusters(k, table.join(sizes, "cluster_id", "left").fillna(0, ["size"]), placed, inertia, iterations, converged)
        if not packed and k > 1 and data.n > 1:
            narrow = data.keep(assign(data.df, judged, key="ord", vector="v", packed=True).select("ord", "cluster_id"), f"placed-{k}")
            found.silhouette = silhouette(data.df, order="ord", vector="v", packed=True, placed=narrow).first().silhouette
        return found
    finally:
        if narrow is not None:
            narrow.unpersist()
        if not shared:
            data.df.unpersist()


def kmeans_search(rows: DataFrame, low: int, high: int, *, seed: int, provider: ClusterProvider | None = None, **options) -> list[Clusters]:
    """Every k of the range that the rows allow, best silhouette first."""
    n = rows.count()
    path, ks = options.pop("path", None), range(low, min(high, n) + 1)
    each = lambda k: {"path": f"{path}/{k}"} if path else {}
    if provider or not ks or low <= 0:
        by = provider or LocalClusters()
        return sorted((by.cluster(rows, k, seed=seed, **options, **each(k)) for k in ks), key=lambda c: -c.silhouette)
    key, vector = options.get("key", "id"), options.get("vector", "embedding")
    data = _Rows(rows, key, vector, options.get("order") or key, "float32" if options.get("packed") else "float64", path)
    try:
        return sorted((kmeans(rows, k, seed=seed, data=data, **options) for k in ks), key=lambda c: -c.silhouette)
    finally:
        data.df.unpersist()


def stride_ids(rows: DataFrame, most: int, *, order: str, group: str | None = None) -> DataFrame:
    """Of each group of n rows all, or those at floor(s * n / most) by ``order``, whose values are unique: ``corvane_picked``
    and the group. Ids alone are numbered."""
    narrow = rows.select(order, *([group] if group else []))
    step = F.col("n") / F.lit(float(most))
    s = F.ceil(F.col("i") / step)
    taken = (F.col("n") <= most) | ((F.floor(s * step) == F.col("i")) & (s < most))
    return numbered(narrow, order=order, group=group).where(taken).select(F.col(order).alias("corvane_picked"), *([group] if group else []))


def stride_sample(rows: DataFrame, most: int, *, order: str, group: str | None = None) -> DataFrame:
    """The rows of ``stride_ids``."""
    return rows.join(stride_ids(rows, most, order=order, group=group), F.col(order).eqNullSafe(F.col("corvane_picked")), "left_semi")


def silhouette(rows: DataFrame, *, order: str = "id", group: str = "cluster_id", vector: str = "embedding", sample: int = 2000, most: int = 200, packed: bool = False, placed: DataFrame | None = None) -> DataFrame:
    """One row; ``packed``: vectors are of unit length and taken as they are. At most ``sample`` points against at most ``most`` members of each cluster; both bounds are part of the
    definition, and the sampled sides are what is joined. A point alone in its cluster has a = 0; one cluster: 0.

    ``placed``: ``order`` and ``group`` of the rows, where the rows don't have the group. The points, whose number is bounded,
    go to the members as a table; a product of two distributed sides has as many tasks as the product of their parts.
    """
    unit_of = (lambda v: v.cast("array<double>")) if packed else normalize
    narrow = (rows if placed is None else placed).select(F.col(order).alias("ord"), F.col(group).alias("cluster"))
    vectors = rows.select(F.col(order).alias("ord"), F.col(vector).alias("raw"))
    drawn = stride_sample(narrow, sample, order="ord").withColumnRenamed("ord", "corvane_picked")

    def whole(picked: DataFrame, v: str) -> DataFrame:
        found = vectors.join(picked, F.col("ord").eqNullSafe(F.col("corvane_picked"))).select("ord", "cluster", "raw")
        return found.withColumn(v, unit_of(F.col("raw"))).drop("raw")

    members = whole(stride_ids(narrow, most, order="ord", group="cluster"), "u").select(F.col("ord").alias("m"), F.col("cluster").alias("other"), "u")
    # Members are few bytes but much work: dealt by number, they are not gathered in one task.
    pairs = members.repartition(rows.sparkSession.sparkContext.defaultParallelism).join(F.broadcast(whole(F.broadcast(drawn), "v")), F.expr("ord <> m"))
    means = pairs.groupBy("ord", "cluster", "other").agg(F.avg(1 - dot(F.col("v"), F.col("u"))).alias("d"))
    point = means.groupBy("ord", "cluster").agg(F.coalesce(F.min(F.when(F.col("cluster") == F.col("other"), F.col("d"))), F.lit(0.0)).alias("a"), F.min(F.when(F.col("cluster") != F.col("other"), F.col("d"))).alias("b"))
    most_ab = F.greatest("a", "b")
    value = F.when(F.col("b").isNull() | (most_ab == 0), 0.0).otherwise((F.col("b") - F.col("a")) / most_ab)
    return point.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("silhouette"))


def exact_silhouette(rows: DataFrame, *, group: str = "cluster_id", vector: str = "embedding") -> DataFrame:
    """One row: ``silhouette`` of every point against every member. A mean of cosine distances to a cluster is one product
    with the sum of its unit vectors, so the work is points times clusters; the sums travel as one row."""
    slim = rows.select(F.col(group).alias("cluster"), normalize(F.col(vector)).alias("v"))
    sizes = slim.where("v IS NOT NULL").groupBy("cluster").agg(F.count("*").alias("n"))
    parts = slim.select("cluster", F.posexplode("v").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("x"))
    sums = parts.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("s"))
    listed = sums.join(sizes, "cluster").agg(F.collect_list(F.struct("cluster", "n", "s")).alias("all"))
    own = F.get(F.filter("all", lambda c: c["cluster"] == F.col("cluster")), F.lit(0))
    alone = F.coalesce(own["n"] <= 1, F.lit(True))
    a = F.when(alone, 0.0).otherwise(1 - (dot(F.col("v"), own["s"]) - dot(F.col("v"), F.col("v"))) / F.greatest(own["n"] - 1, F.lit(1)))
    b = F.array_min(F.transform(F.filter("all", lambda c: c["cluster"] != F.col("cluster")), lambda c: 1 - dot(F.col("v"), c["s"]) / c["n"]))
    point = slim.crossJoin(F.broadcast(listed)).select(F.coalesce(a, F.lit(0.0)).alias("a"), b.alias("b"))
    most_ab = F.greatest("a", "b")
    value = F.when(F.col("b").isNull() | (most_ab == 0), 0.0).otherwise((F.col("b") - F.col("a")) / most_ab)
    return point.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("silhouette"))
