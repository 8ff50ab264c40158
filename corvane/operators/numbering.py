"""Row numbers of large groups without a task that sees a group whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(rows: DataFrame, *, order: str, group: str | None = None, ranges: int = 64) -> DataFrame:
    """``rows`` (narrow ones) with i, their number by ``order`` from 0 in their group, and n, the group's size.

    The order is cut into ranges at values drawn by hash from the column, so a window sees one range of one group. How many
    rows the ranges before hold is a table of ranges * groups rows.
    """
    spark = rows.sparkSession
    drawn = sorted(r[0] for r in rows.where(F.col(order).isNotNull()).select(order).orderBy(F.xxhash64(order)).limit(16 * ranges).collect())
    cuts = drawn[len(drawn) // ranges :: max(1, len(drawn) // ranges)]
    kind = dict(rows.dtypes)[order]
    table = spark.createDataFrame([(cuts,)], f"corvane_cuts array<{kind}>")
    # A null comes first, in range 0.
    placed = rows.crossJoin(F.broadcast(table)).withColumn("corvane_range", F.coalesce(F.size(F.filter("corvane_cuts", lambda c: c <= F.col(order))), F.lit(0))).drop("corvane_cuts")
    of = F.struct(F.col(group) if group else F.lit(0))
    counts = placed.groupBy(of.alias("corvane_of"), F.col("corvane_range").alias("corvane_at")).agg(F.count("*").alias("corvane_count"))
    w = W.partitionBy("corvane_of")
    before = F.sum("corvane_count").over(w.orderBy("corvane_at").rowsBetween(W.unboundedPreceding, 0)) - F.col("corvane_count")
    counts = counts.select("corvane_of", "corvane_at", before.alias("corvane_before"), F.sum("corvane_count").over(w).alias("n"))
    within = F.row_number().over(W.partitionBy(of, "corvane_range").orderBy(order)) - 1
    out = placed.withColumn("corvane_within", within).join(counts, (of.eqNullSafe(F.col("corvane_of"))) & (F.col("corvane_range") == F.col("corvane_at")))
    return out.select(*rows.columns, (F.col("corvane_before") + F.col("corvane_within")).alias("i"), "n")
