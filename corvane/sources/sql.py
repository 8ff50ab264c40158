"""SQL as the API: parameters, IN lists, identifiers, JDBC and snapshots with all-or-nothing writes."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.state import Snapshot


def safe_identifier(value: str, label: str = "identifier") -> str:
    if not re.fullmatch("[a-zA-Z_][a-zA-Z0-9_]*", value):
        raise ValueError(f"unsafe {label}: {value!r}")
    return value


def numbered_to_named(sql: str) -> str:
    """$1 as :p1; repeats and any order are fine, gaps are not. Quoted text stays."""
    parts = re.split(r"('(?:[^']|'')*')", sql)
    seen = {int(n) for p in parts[::2] for n in re.findall(r"\$(\d+)", p)}
    if seen and seen != set(range(1, max(seen) + 1)):
        raise ValueError(f"placeholders have gaps: {sorted(seen)}")
    return "".join(p if i % 2 else re.sub(r"\$(\d+)", r":p\1", p) for i, p in enumerate(parts))


def numbered_to_marks(sql: str) -> str:
    """$1, $2 ... as ?, for stores that bind by position; they must come in order, without gaps."""
    found = [int(n) for n in re.findall(r"\$(\d+)", sql)]
    if found != list(range(1, len(found) + 1)):
        raise ValueError(f"placeholders must run from $1 in order: {found}")
    return re.sub(r"\$\d+", "?", sql)


class InList(list):
    """A list that a template expands for IN; empty, it matches nothing (and NOT IN everything)."""


def tagged(strings: list[str], values: list) -> tuple[str, dict]:
    """SQL text with :pn and its arguments, from the pieces around values."""
    sql, args = strings[0], {}

    def bind(v) -> str:
        args[f"p{len(args) + 1}"] = v
        return f":p{len(args)}"

    for value, rest in zip(values, strings[1:], strict=True):
        if isinstance(value, InList):
            sql += "(" + (", ".join(bind(v) for v in value) if value else "SELECT NULL WHERE FALSE") + ")"
        else:
            sql += bind(value)
        sql += rest
    return sql, args


class SqlStore:
    """query over registered tables; run and transaction over snapshots."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, snapshots: dict[str, Snapshot] | None = None):
        self.spark, self.snapshots, self._staged = spark, snapshots or {}, None
        for name, df in (tables or {}).items():
            df.createOrReplaceTempView(safe_identifier(name, "table"))

    def query(self, sql: str, params: list | None = None, **named) -> DataFrame:
        args = {f"p{i + 1}": p for i, p in enumerate(params or [])} | named
        return self.spark.sql(numbered_to_named(sql), args=args)

    def run(self, table: str, rows: DataFrame) -> None:
        """Replaces a snapshot; inside a transaction, at its end."""
        if self._staged is None:
            self.snapshots[table].replace(rows)
        else:
            self._staged[table] = rows

    def transaction(self, work):
        """``work(store)``; what it staged is written if it returns, dropped if it raises. Not nested.

        All tables are written first and then finished by one mark in the log they share, so readers see all of a
        transaction or nothing, also if a write fails or the driver dies between two of them.
        """
        if self._staged is not None:
            raise RuntimeError("transactions do not nest")
        self._staged = {}
        try:
            result, mark = work(self), uuid.uuid4().hex
            tables = [self.snapshots[t] for t in self._staged]
            if len({t.log for t in tables}) > 1:
                raise ValueError("tables of one transaction must share a log")
            for snapshot, rows in zip(tables, self._staged.values(), strict=True):
                snapshot.stage(rows, mark)
            if tables:
                tables[0].finish(mark)
            for snapshot in tables:
                snapshot.tidy()
            return result
        finally:
            self._staged = None


def jdbc(spark: SparkSession, url: str, table: str, *, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options) -> DataFrame:
    """A table of a database; with a numeric key, read in ``parts`` ranges. Needs the driver's jar."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key:
        reader = reader.options(partitionColumn=safe_identifier(key), lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def files(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, since=None, since_column: str = "updated_at", **options) -> DataFrame:
    """Files of any format Spark reads; ``since`` is pushed to the scan where the format can."""
    reader = spark.read.format(kind).options(**options)
    found = (reader.schema(schema) if schema else reader).load(path)
    return found if since is None else found.where(F.col(since_column) >= F.lit(since))
