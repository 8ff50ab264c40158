"""kNN classification by votes, and representatives of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.vector import dot, normalize
from corvane.operators.ranking import knn_between


def vote_all(ids: Column) -> Column:
    return ids


def vote_subset(allowed: list[str]):
    return lambda ids: F.filter(ids, lambda x: x.isin(allowed)) if allowed else F.slice(ids, 1, 0)


def vote_highest(ranks: dict[str, float]):
    """The one id of the highest rank; ties: the first. Serves depth in a tree and specificity alike."""
    table = F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv)).cast("map<string,double>")

    def vote(ids: Column) -> Column:
        ranked = F.filter(F.transform(ids, lambda x, i: F.struct((-table[x]).alias("r"), i.alias("i"), x.alias("id"))), lambda x: x["r"].isNotNull())
        return F.when(F.size(ranked) > 0, F.array(F.array_min(ranked)["id"])).otherwise(F.slice(ids, 1, 0))

    return vote


def classify(candidates: DataFrame, labeled: DataFrame, clusters: DataFrame, *, path: str, k: int = 16, strategy=vote_all, key: str = "id", vector: str = "embedding", order: str = "ord") -> DataFrame:
    """key, cluster_id (null unless accepted), distance, votes, total_votes, accepted.

    labeled: order, vector, cluster_ids. clusters: cluster_id, centroid, threshold (null: none). The most votes win;
    ties go to the cluster that was voted for first. A candidate without votes has no distance. Keys and orders are integers;
    candidates meet labelled rows in blocks, whose tables go to ``path``.
    """
    c = candidates.select(F.col(key).alias("cand"), normalize(F.col(vector)).alias("v"))
    near = knn_between(candidates, labeled, k, path=path, query_key=key, key=order, vector=vector).select(F.col("query_id").alias("cand"), F.col("id").alias("ord"), "rank")
    votes = near.join(labeled.select(F.col(order).alias("ord"), "cluster_ids"), "ord").select("cand", "rank", F.posexplode(strategy(F.col("cluster_ids"))).alias("at", "cluster"))
    known = clusters.select(F.col("cluster_id").alias("cluster"), normalize(F.col("centroid")).alias("centroid"), "threshold")
    tally = votes.join(known.select("cluster"), "cluster", "left_semi").groupBy("cand", "cluster").agg(F.count("*").alias("votes"), F.min(F.struct("rank", "at")).alias("first"))
    won = tally.groupBy("cand").agg(F.min(F.struct((-F.col("votes")).alias("n"), "first", "cluster")).alias("best"), F.sum("votes").alias("total_votes"))
    won = won.select("cand", (-F.col("best.n")).alias("votes"), F.col("best.cluster").alias("cluster"), "total_votes").join(known, "cluster")
    out = c.join(won, "cand", "left").withColumn("distance", 1 - dot(F.col("v"), F.col("centroid")))
    accepted = F.coalesce(F.col("distance") <= F.coalesce("threshold", F.lit(float("inf"))), F.lit(False))
    return out.select(F.col("cand").alias(key), F.when(accepted, F.col("cluster")).alias("cluster_id"), F.coalesce("distance", F.lit(float("inf"))).alias("distance"), F.coalesce("votes", F.lit(0)).alias("votes"), F.coalesce("total_votes", F.lit(0)).alias("total_votes"), accepted.alias("accepted"))


def distances(members: DataFrame, clusters: DataFrame, *, key: str = "id", group: str = "cluster_id", vector: str = "embedding") -> DataFrame:
    c = clusters.select(F.col("cluster_id").alias(group), normalize(F.col("centroid")).alias("c"))
    return members.join(c, group).select(group, key, (1 - dot(normalize(F.col(vector)), F.col("c"))).alias("distance"))


def near_centroid(found: DataFrame, n: int = 5, *, key: str = "id", group: str = "cluster_id") -> DataFrame:
    rank = F.row_number().over(W.partitionBy(group).orderBy("distance", key))
    return found.withColumn("rank", rank).where(F.col("rank") <= n)


def at_mode(found: DataFrame, n: int = 10, *, key: str = "id", group: str = "cluster_id") -> DataFrame:
    """The n members nearest to the middle of the fullest of at most 20 bins of distance (ties: the first bin, the nearer
    to the centroid); all of a small cluster, the first n where all distances are equal."""
    shape = found.groupBy(group).agg(F.count("*").alias("size"), F.min("distance").alias("low"), F.max("distance").alias("high"))
    shape = shape.withColumn("bins", F.least(F.lit(20), F.ceil(F.col("size") / 5))).withColumn("width", (F.col("high") - F.col("low")) / F.col("bins"))
    binned = found.join(shape, group).withColumn("bin", F.least(F.floor(F.try_divide(F.col("distance") - F.col("low"), F.col("width"))), F.col("bins") - 1))
    fullest = binned.groupBy(group, "bin").agg(F.count("*").alias("held")).groupBy(group).agg(F.min(F.struct((-F.col("held")).alias("h"), "bin")).alias("best")).select(group, F.col("best.bin").alias("peak"))
    gap = F.when((F.col("size") <= n) | (F.col("width") == 0), F.lit(0.0)).otherwise(F.abs(F.col("distance") - (F.col("low") + (F.col("peak") + 0.5) * F.col("width"))))
    rank = F.row_number().over(W.partitionBy(group).orderBy("gap", "distance", key))
    return binned.join(fullest, group, "left").withColumn("gap", gap).withColumn("rank", rank).where(F.col("rank") <= n).select(group, key, "distance", "rank")
