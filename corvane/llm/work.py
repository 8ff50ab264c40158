"""Shared helpers: tables that cut lineage, blobs of numpy arrays, and Arrow access to whole texts."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_libc = ctypes.CDLL(None)

#: Rows handed to a Python worker at once. Whole texts of any length go in, so the number is small.
ARROW_ROWS = 256


class Workspace:
    """A folder of intermediate tables under ``spark.checkpoint.dir``.

    Every table is written once and read again, so a lost executor costs at most the stage that runs. Only where
    the setting is absent and everything runs on this machine (tests) a folder of this machine is used.
    """

    _open: list[list[Workspace]] = []

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="corvane-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.root = spark, f"{base.rstrip('/')}/corvane/{name}-{uuid.uuid4().hex}"
        for spaces in self._open:
            spaces.append(self)

    @classmethod
    @contextmanager
    def temporary(cls):
        """Workspaces made within are deleted at the end; what is to last is saved in one made before."""
        cls._open.append([])
        try:
            yield
        finally:
            for space in cls._open.pop():
                space.drop("")

    def save(self, df: DataFrame, name: str, rows: int = ARROW_ROWS) -> DataFrame:
        with arrow_rows(self.spark, rows), shuffle_files_go(self.spark):
            df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Shield:
    """A table under column names of its own, so that no column of the caller's can be in the way of an operator's.

    ``shield[c]`` is the inner name of column ``c`` (names as Spark resolves them: without regard to case), and
    ``back`` gives the caller's columns their names again.
    """

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.inner = [f"corvane_column_{i}" for i in range(len(self.names))]
        self.df = df.toDF(*self.inner)

    def __getitem__(self, name: str) -> str:
        exact = [i for i, c in enumerate(self.names) if c == name] or [i for i, c in enumerate(self.names) if c.lower() == name.lower()]
        return self.inner[exact[0]]

    def back(self, df: DataFrame, *more: Column) -> DataFrame:
        return df.select(*(F.col(c).alias(n) for c, n in zip(self.inner, self.names, strict=True)), *more)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def shuffle_files_go(spark: SparkSession):
    """What a query shuffled is deleted at its end, not when the driver happens to collect its garbage: what it wrote is
    read from then on."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release_memory() -> None:
    """Gives back to the system what a worker process holds and doesn't use: workers serve many tasks of many stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def lean(run):
    """``run`` (batches to batches) that leaves no unused memory behind."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of literals, made by the JVM alone."""
    fields = [x.strip().split(" ", 1) for x in schema.split(",")]
    if not rows:
        return spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in fields))
    items = [F.struct(*(F.lit(r[name]).cast(kind).alias(name) for name, kind in fields)) for r in rows]
    return spark.range(1).select(F.inline(F.array(*items)))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, n + 1 offsets) of a string column; a null text is empty. Nothing is copied."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def texts_of(column: pa.Array):
    """The texts of a column as bytes, one by one."""
    data, offsets = text_bytes(column)
    view = memoryview(data)
    for i in range(len(offsets) - 1):
        yield bytes(view[offsets[i] : offsets[i + 1]])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
