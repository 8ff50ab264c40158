"""Sharding by a Feistel permutation of global row numbers.

Rows get global numbers 0 .. n-1 in the order of their key. A keyed Feistel network over the smallest even-width power
of two that covers n, cycle-walked until the value is below n, permutes them. A row's place p gives shard p mod k and
slot p div k, so shard sizes differ by at most one row, slots are gapless, and shard and slot of any row follow from
its number, n and the seed alone. The inverse network tells which row holds a slot.

Row numbers come from a range partitioning of narrow rows and counts per partition; there is no global window. The
permutation runs over the whole index, so equal texts, however many, are spread evenly rather than kept together.

Defined cases: a null text has size 1 and the checksum of no bytes; null keys come first; rows that are equal in all
the columns used get places of their own in any order among them; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.work import Workspace, mix64, partitions, read

ROUNDS = 6


def _halves(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, half: int, seed: int, rounds) -> np.ndarray:
    mask, width = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> width, x & mask
    for r in rounds:
        left, right = right, left ^ (mix64(right + np.uint64((seed * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % 2**64)) & mask)
    return (left << width) | right


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Places of row numbers below n; a bijection of 0 .. n-1."""
    half, x = _halves(n), rows.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = _network(x, half, seed, range(ROUNDS))
        while (out := x >= n).any():
            x[out] = _network(x[out], half, seed, range(ROUNDS))
    return x.astype(np.int64)


def row_at(places: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The inverse of ``permute``."""
    half = _halves(n)
    mask, width = np.uint64((1 << half) - 1), np.uint64(half)

    def back(x: np.ndarray) -> np.ndarray:
        left, right = x >> width, x & mask
        for r in reversed(range(ROUNDS)):
            left, right = right ^ (mix64(left + np.uint64((seed * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % 2**64)) & mask), left
        return (left << width) | right

    with np.errstate(over="ignore"):
        x = back(places.astype(np.uint64))
        while (out := x >= n).any():
            x[out] = back(x[out])
    return x.astype(np.int64)


def shard_rows(rows: DataFrame, shards: int, *, order: list[str], seed: int = 20_240_501) -> DataFrame:
    """``rows`` (made narrow by the caller) with row_number, shard and slot. ``order`` must fix the order of rows."""
    spark = rows.sparkSession
    work = Workspace(spark, "sharding")
    index = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sorted_rows = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    kept = work.save(sorted_rows.withColumn("at", F.monotonically_increasing_id()).withColumns({"part": F.shiftrightunsigned("at", 33), "index": index}).drop("at"), "sorted")
    # A row per partition, so the window and the broadcast are as small as the number of tasks.
    counts = kept.groupBy("part").agg(F.count("*").alias("n"))
    base = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"), F.sum("n").over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"))
    numbered = kept.join(F.broadcast(base), "part").withColumn("row_number", F.col("base") + F.col("index"))

    @F.pandas_udf("long")
    def place(row: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), int(total.iloc[0]), seed)) if len(row) else row

    placed = numbered.withColumn("place", place("row_number", "total"))
    return placed.select(*rows.columns, "row_number", F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.expr(f"place div {shards}").alias("slot"))


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    slim = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    out = shard_rows(slim, 16, order=["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
