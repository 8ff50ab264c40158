"""Structured Streaming: documents upserted by id, spend over sliding hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.state import Snapshot


def collect(spark: SparkSession, path: str, schema, kind: str = "parquet", since=None, since_column: str = "updated_at") -> DataFrame:
    """A stream of documents from files."""
    stream = spark.readStream.format(kind).schema(schema).load(path)
    return stream if since is None else stream.where(F.col(since_column) >= F.lit(since))


def latest_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row of the greatest order; a partial aggregate, so repeated keys shrink before they move."""
    return rows.groupBy(key).agg(F.max(F.struct(order, F.struct(*rows.columns).alias("row"))).alias("x")).select("x.row.*")


def upsert_stream(stream: DataFrame, target: Snapshot, *, key: str, order: str, checkpoint: str):
    """Starts a query that reads what there is and upserts it; done when it terminates."""

    def write(batch: DataFrame, _: int) -> None:
        target.upsert(latest_by_key(batch, key, order), key)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def spend_windows(events: DataFrame, *, ts: str = "created_at", cost: str = "cost_usd", length: str = "60 minutes", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Spend in sliding windows; works on streams (with a watermark) and tables alike."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    return marked.groupBy(F.window(ts, length, slide)).agg(F.sum(cost).alias("spent"), F.count("*").alias("calls")).select(F.col("window.start").alias("window_start"), "spent", "calls")
