"""Blocks of whole texts, and exchanges of hash arrays between them.

``pack`` writes the texts as blocks of a few MB, one row each, in a table bucketed by block. Operators scan it as
often as they need; what comes back for a block (small arrays) is joined to it without moving the texts again.
Arrays that travel are split by hash into one blob per block and hash part, sorted and free of repeats, so a value
that fills a third of the corpus travels once per block. Other columns may ride along with their rows, as Arrow data,
so what is decided about a text meets its own row without a join.

A text is never split: a block holds one text at least, however long it is, and is held in memory as a whole.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.work import Workspace, arrow_rows, lean, partitions, text_bytes

BLOCK_BYTES = 4_000_000
LAST = 2**63 - 1  # stands for a null id, after all others


class Blocks:
    def __init__(self, docs: DataFrame, work: Workspace, *, key: str = "doc_id", text: str = "text", carry: list[str] = (), block_bytes: int = BLOCK_BYTES, encode=None):
        """``carry``: columns whose rows go along with their texts (see ``carried``). ``encode(lengths, data)`` gives what is
        kept in their place: a number per text, and bytes."""
        self.spark, self.work, self.parts = docs.sparkSession, work, partitions(docs.sparkSession)
        self.table = f"corvane_{uuid.uuid4().hex}"
        schema = "block long, size long, ids binary, lengths binary, data binary" + ", others binary" * bool(carry)
        names = [x.split()[0] for x in schema.split(", ")]

        def run(batches):
            number, ids, lengths, pieces, size, others = TaskContext.get().partitionId() << 32, [], [], [], 0, []

            def row():
                values = [np.array(ids, np.int64).tobytes(), np.array(lengths, np.int64).tobytes(), b"".join(pieces)]
                if encode:
                    numbers, values[2] = encode(np.array(lengths, np.int64), np.frombuffer(values[2], np.uint8))
                    values[1] = numbers.astype(np.int64).tobytes()
                if carry:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, others[0].schema) as out:
                        out.write_table(pa.Table.from_batches(others))
                    values.append(sink.getvalue().to_pybytes())
                return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([size], pa.int64()), *(pa.array([v], pa.binary()) for v in values)], names)

            for batch in batches:
                data, offsets = text_bytes(batch.column(1))
                rest, start = batch.select(batch.schema.names[2:]), 0
                for i, doc in enumerate(batch.column(0).to_pylist()):
                    piece = data[offsets[i] : offsets[i + 1]].tobytes()
                    if ids and size + len(piece) > block_bytes:
                        if carry and i > start:
                            others.append(rest.slice(start, i - start))
                        yield row()
                        number, ids, lengths, pieces, size, others, start = number + 1, [], [], [], 0, [], i
                    ids.append(LAST if doc is None else doc)
                    lengths.append(len(piece))
                    pieces.append(piece)
                    size += len(piece)
                if carry and batch.num_rows > start:
                    others.append(rest.slice(start))
            if ids:
                yield row()

        packed = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"), *(F.col(c) for c in carry)).mapInArrow(lean(run), schema)
        with arrow_rows(self.spark):
            packed.write.format("parquet").option("path", f"{work.root}/blocks").option("compression", "zstd").bucketBy(self.parts, "block").saveAsTable(self.table)

    def parts_of(self, part_bytes: int) -> int:
        """How many hash parts to make: about one per ``part_bytes`` of text, and no fewer than tasks."""
        return max(self.parts, -(-(self.rows().agg(F.sum("size")).first()[0] or 0) // part_bytes))

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def with_info(self, info: DataFrame) -> DataFrame:
        """Each block with ``info``'s blobs for it as an array (null: none). Only the blobs are shuffled."""
        gathered = info.groupBy("block").agg(F.collect_list("blob").alias("blobs"))
        return self.rows().join(gathered.hint("shuffle_hash"), "block", "left")

    def save(self, df: DataFrame, name: str) -> DataFrame:
        return self.work.save(df, name, rows=1)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        self.work.drop("blocks")


def carried(others: bytes) -> pa.Table:
    """The rows that went along with a block's texts, in their order."""
    return pa.ipc.open_stream(others).read_all()


def map_blocks(df: DataFrame, f, schema: str, others: bool = False) -> DataFrame:
    """f(block, ids, lengths, data, blobs[, others]) yields column lists, or batches as they are to be; one block is in
    memory at a time."""
    has_blobs = "blobs" in df.columns

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                values = {c: one.column(c)[0] for c in one.schema.names}
                blobs = [x.as_py() for x in values["blobs"].values] if has_blobs and values["blobs"].is_valid else []
                rows = f(values["block"].as_py(), np.frombuffer(values["ids"].as_buffer(), np.int64), np.frombuffer(values["lengths"].as_buffer(), np.int64), np.frombuffer(values["data"].as_buffer(), np.uint8), blobs, *([values["others"].as_buffer()] if others else []))
                for out in rows:
                    if out is not None and len(out):
                        yield out if isinstance(out, pa.RecordBatch) else to_batch(out, arrow_schema)

    arrow_schema = None if others else arrow_of(schema)
    df = df if others else df.drop("others")
    return df.mapInArrow(lean(run), schema)


KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def arrow_of(schema: str) -> pa.Schema:
    return pa.schema([(x.split()[0], KINDS[x.split()[1]]) for x in schema.split(", ")])


def to_batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def split(part: np.ndarray, parts: int, *arrays: np.ndarray):
    """(part, arrays of it) for each part that occurs, in the order given within a part."""
    order = np.argsort(part.astype(np.uint32), kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    moved = [a[order] for a in arrays]
    for p in range(parts):
        if edges[p] < edges[p + 1]:
            yield p, [a[edges[p] : edges[p + 1]] for a in moved]


def reduce_parts(df: DataFrame, f, schema: str, parts: int, key: str = "part") -> DataFrame:
    """f(list of rows of a part as tuples) yields (column lists); the rows of a part are its blobs.

    A part is in memory as a whole, and so are few others: there are as many tasks as ``parts``, which grow with the corpus.
    """
    if parts > partitions(df.sparkSession):
        df = df.repartition(parts, key)
    names = df.columns
    arrow_schema = arrow_of(schema)

    def run(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_pylist() for c in names]
        out = [to_batch(x, arrow_schema) for x in f(list(zip(*columns, strict=True))) if x]
        return pa.Table.from_batches(out, arrow_schema)

    return df.groupBy(key).applyInArrow(run, schema)

