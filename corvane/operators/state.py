"""State kept as snapshots: cache-or-generate, compare-and-set, orphans, run ledger, glossary, descriptions, batch jobs.

Spark has no row locks. A snapshot is replaced whole by one writer (``Snapshot``); concurrent writers need a store that
has transactions.
"""

from __future__ import annotations

import json
import re
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Snapshot:
    """Versions of a table under one path; readers see the latest that was finished.

    A version is finished when its files are (``_SUCCESS``) and, if it is part of a transaction, when that has its mark
    in ``log`` - one file, so all versions of a transaction are finished at once. Versions that a crash left unfinished
    are never read, are in nobody's way and go with the next ones.
    """

    def __init__(self, spark, path: str, schema: str, log: str | None = None):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.log = (log or f"{self.path.rpartition('/')[0]}/_transactions").rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda path: jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _all(self) -> list[tuple[int, str]]:
        """(number, folder) of every version, finished or not."""
        if not self._fs.exists(self._at(self.path)):
            return []
        found = (re.fullmatch(r"v(\d+)(?:-\w+)?", s.getPath().getName()) for s in self._fs.listStatus(self._at(self.path)))
        return sorted((int(m[1]), m[0]) for m in found if m)

    def _finished(self, folder: str) -> bool:
        mark = folder.partition("-")[2]
        return self._fs.exists(self._at(f"{self.path}/{folder}/_SUCCESS")) and (not mark or self._fs.exists(self._at(f"{self.log}/{mark}")))

    def versions(self) -> list[int]:
        return [n for n, folder in self._all() if self._finished(folder)]

    def read(self) -> DataFrame:
        found = [folder for _, folder in self._all() if self._finished(folder)]
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{found[-1]}") if found else self.spark.createDataFrame([], self.schema)

    def stage(self, rows: DataFrame, mark: str = "") -> None:
        """Writes a version; with a ``mark`` it is finished by ``finish(mark)`` alone."""
        found = self._all()
        number = found[-1][0] + 1 if found else 0
        rows.write.parquet(f"{self.path}/v{number}" + (f"-{mark}" if mark else ""))

    def finish(self, mark: str) -> None:
        self._fs.create(self._at(f"{self.log}/{mark}")).close()

    def tidy(self, keep: int = 2) -> None:
        """Deletes all but the last ``keep`` finished versions, and what is unfinished before them."""
        found = self._all()
        finished = [n for n, folder in found if self._finished(folder)][-keep:]
        for n, folder in found:
            if finished and n < finished[0] or finished and n < finished[-1] and not self._finished(folder):
                self._fs.delete(self._at(f"{self.path}/{folder}"), True)

    def replace(self, rows: DataFrame, keep: int = 2) -> None:
        self.stage(rows)
        self.tidy(keep)

    def append(self, rows: DataFrame) -> None:
        self.replace(self.read().unionByName(rows))

    def upsert(self, rows: DataFrame, key: str) -> None:
        self.replace(upsert(self.read(), rows, key))


def upsert(stored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return stored.join(rows.select(key), key, "left_anti").select(*stored.columns).unionByName(rows.select(*stored.columns))


def ensure_cached(requests: DataFrame, cache: DataFrame, generate, *, key: str = "id", value: str = "value") -> DataFrame:
    """key, value and hit: cached values, and generated ones for misses (a cached null is a miss). ``generate`` maps a
    DataFrame of missing requests to one of key and value."""
    found = cache.where(F.col(value).isNotNull()).select(key, value)
    misses = requests.join(found, key, "left_anti")
    hits = requests.select(key).join(found, key).withColumn("hit", F.lit(True))
    return hits.unionByName(generate(misses).select(key, value).withColumn("hit", F.lit(False)))


def generate_with(function, kind: str = "string", *, key: str = "id", text: str = "text", value: str = "value"):
    """A generator for ``ensure_cached`` from a function of one text, run where the rows are."""

    def generate(rows: DataFrame) -> DataFrame:
        def run(batches):
            for pdf in batches:
                yield pd.DataFrame({key: pdf[key], value: [function(t) for t in pdf[text]]})

        return rows.select(key, text).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, {value} {kind}")

    return generate


def cas_update(rows: DataFrame, wanted: DataFrame, *, key: str = "id") -> DataFrame:
    """Rows with their status set where it was as expected. ``wanted``: key, from_status, to_status. Adds ``updated``."""
    w = wanted.select(key, "from_status", "to_status")
    met = F.col("to_status").isNotNull() & (F.col("status") == F.col("from_status"))
    out = rows.join(w, key, "left").withColumn("updated", F.coalesce(met, F.lit(False)))
    return out.select(*(F.when(F.col("updated"), F.col("to_status")).otherwise(F.col("status")).alias(c) if c == "status" else F.col(c) for c in rows.columns), "updated")


def orphans(rows: DataFrame, statuses: list[str], timeout_ms: int, now: Column) -> DataFrame:
    """Rows stuck in one of the statuses for strictly longer than the timeout; no status, no rows."""
    if not statuses:
        return rows.limit(0)
    limit = now - F.make_dt_interval(secs=F.lit(timeout_ms / 1000).cast("decimal(18,6)"))
    return rows.where(F.col("status").isin(statuses) & (F.col("updated_at") < limit))


RUN_SCHEMA = "id long, run_type string, status string, started_at timestamp, completed_at timestamp, duration_ms long, records_processed long, records_created long, records_failed long, error_message string"


def start_runs(requests: DataFrame) -> DataFrame:
    """Ledger rows for requests (id, run_type, started_at)."""
    blank = {"completed_at": "timestamp", "duration_ms": "long", "records_processed": "long", "records_created": "long", "records_failed": "long", "error_message": "string"}
    return requests.select("id", "run_type", F.lit("running").alias("status"), "started_at", *(F.lit(None).cast(t).alias(c) for c, t in blank.items()))


def finish_runs(ledger: DataFrame, results: DataFrame) -> DataFrame:
    """The ledger with results (id, finished_at, processed, created, failed, error): completed, or failed where there is an error."""
    r = ledger.join(results.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left")
    ended = F.col("of").isNotNull()
    ms = F.unix_millis(F.col("finished_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp"))
    put = lambda value, c: F.when(ended, value).otherwise(F.col(c)).alias(c)
    return r.select(
        "id", "run_type", put(F.when(F.col("error").isNull(), "completed").otherwise("failed"), "status"), "started_at", put(F.col("finished_at").cast("timestamp"), "completed_at"), put(ms, "duration_ms"),
        put(F.col("processed"), "records_processed"), put(F.col("created"), "records_created"), put(F.col("failed"), "records_failed"), put(F.col("error"), "error_message"),
    )


def find_terms(glossary: DataFrame, articles: DataFrame, *more, key: str = "article_id") -> DataFrame:
    """Per article its terms by id, null if it has none, and ``more`` aggregates of them."""
    terms = glossary.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "keyword", "definition"))), lambda x: F.struct(x["keyword"].alias("keyword"), x["definition"].alias("definition"))).alias("terms"), *more)
    return articles.select(key).join(terms, key, "left")


def save_terms(glossary: DataFrame, terms: DataFrame) -> DataFrame:
    return glossary.unionByName(terms.select(*glossary.columns))


def find_descriptions(store: DataFrame, articles: DataFrame, *, key: str = "article_id") -> DataFrame:
    found = store.where(F.col("description").isNotNull()).groupBy(key).agg(F.min(F.struct("id", "description")).alias("x"))
    return articles.select(key).join(found, key, "left").select(key, F.col("x.description").alias("description"))


def save_descriptions(store: DataFrame, rows: DataFrame, serializer=F.to_json) -> DataFrame:
    """Appends rows whose ``value`` is serialised (JSON of a struct by default)."""
    return store.unionByName(rows.withColumn("description", serializer(F.col("value"))).select(*store.columns))


def ensure_terms(glossary: DataFrame, requests: DataFrame, generate, *, key: str = "article_id") -> tuple[DataFrame, DataFrame]:
    """(article, terms, generated) of each request, and the glossary with what was made. ``generate`` maps the requests
    that have no terms to rows of the glossary's columns; an article it gives none for has null terms. What was made is
    marked, so that it is made once."""
    made = generate(requests.join(glossary.select(key).distinct(), key, "left_anti")).select(*glossary.columns)
    marked = glossary.withColumn("corvane_made", F.lit(False)).unionByName(made.withColumn("corvane_made", F.lit(True)))
    found = find_terms(marked, requests, F.max("corvane_made").alias("generated"), key=key)
    return found.withColumn("generated", F.coalesce("generated", F.lit(False))), save_terms(glossary, made)


def ensure_description(store: DataFrame, requests: DataFrame, generate, *, key: str = "article_id", serializer=F.to_json) -> tuple[DataFrame, DataFrame]:
    """(article, description, generated) of each request, and the store with what was made. ``generate`` maps the requests
    that have no description to rows of id, article and value; a stored null is no description."""
    known = store.where(F.col("description").isNotNull()).select(key).distinct()
    made = generate(requests.join(known, key, "left_anti"))
    saved = save_descriptions(store, made, serializer)
    fresh = made.select(key).distinct().withColumn("generated", F.lit(True))
    return find_descriptions(saved, requests, key=key).join(fresh, key, "left").withColumn("generated", F.coalesce("generated", F.lit(False))), saved


# Batch jobs. A client has create(requests), retrieve(id) -> dict and results(id) -> iterable of dicts.


def submit_batch(client, requests: list[dict]) -> tuple[str, int]:
    return client.create(requests)["id"], len(requests)


def poll_batch(client, batch_id: str) -> dict:
    state = client.retrieve(batch_id)
    return {"id": batch_id, "status": state["processing_status"], "counts": state.get("request_counts", {}), "done": state["processing_status"] == "ended"}


def poll_batches(client, ids: list[str], concurrency: int = 10) -> list[dict]:
    with ThreadPoolExecutor(concurrency) as pool:
        return list(pool.map(lambda i: poll_batch(client, i), ids))


def iterate_results(client, batch_id: str, parse):
    for entry in client.results(batch_id):
        result = entry["result"]
        if result.get("type") != "succeeded" or not result.get("message"):
            yield {"custom_id": entry["custom_id"], "error": result}
            continue
        try:
            yield {"custom_id": entry["custom_id"], "data": parse(entry["custom_id"], result["message"])}
        except Exception as error:
            yield {"custom_id": entry["custom_id"], "error": error}


def result_stream(spark, path: str) -> DataFrame:
    """Entries (custom_id, type, message) of JSON-lines result files as they arrive, for ``batch_results``."""
    lines = spark.readStream.text(path)
    entry = F.from_json("value", "custom_id string, result struct<type: string, message: string>")
    return lines.where(F.trim("value") != "").select(entry.alias("e")).select("e.custom_id", "e.result.type", "e.result.message")


def poll_table(states: DataFrame) -> DataFrame:
    return states.withColumn("done", F.col("status") == "ended")


def batch_results(entries: DataFrame, schema: str) -> DataFrame:
    """custom_id, outcome (data, error or unparsed) and the parsed message, from rows custom_id, type, message."""
    data = F.from_json("message", schema)
    ok = (F.col("type") == "succeeded") & F.col("message").isNotNull() & (F.col("message") != "")
    good = F.try_parse_json("message").isNotNull()
    return entries.select("custom_id", F.when(~F.coalesce(ok, F.lit(False)), "error").when(good, "data").otherwise("unparsed").alias("outcome"), F.when(ok & good, data).alias("data"))


def to_json(value) -> str:
    return json.dumps(value, sort_keys=True)
