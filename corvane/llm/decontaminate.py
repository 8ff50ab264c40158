"""Benchmark decontamination: windows of benchmark words looked up in every document.

Words are runs of ASCII letters and digits and of everything beyond ASCII, A-Z lower-cased. A window is ``n``
consecutive words of an item, or the whole of a shorter item. Each distinct window goes into a sorted hash array with
its word numbers and its items; documents map their words to the benchmark's word numbers (0: no such word), roll one
hash per window length over them, look it up and verify the numbers. Words under a verified window are hit.

Items are cut into pieces that overlap by ``n`` - 1 words, so each window lies in one, and pieces are dealt to chunks
by hash, in as many chunks as it takes for none to exceed ``chunk_bytes`` of text (names of items included). Each chunk
is broadcast on its own, as arrays of about 60 bytes a window; documents pass once per chunk (once, for any usual
benchmark), and the hits so far travel with them. So what is broadcast is bounded at any size of either table, unless a
single word is longer than the bound. Documents are never shuffled.

Defined cases: a null or word-free text has no words and no hits; a very long text is one text like any other; a null,
empty or word-free item has no window; items that repeat id and text are one, others each count; equal windows of
several items hit for all of them; items with a null id are named ""; empty tables give no rows or no hits; other
columns stay as they are in ``decontaminate``; in ``scan`` a kept column that has the name of a result gives way to it.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.work import Shield, Workspace, lean, read, texts_of

#: Letters and digits stay, A-Z become a-z, other ASCII separates; bytes of longer characters stay.
WORDS = bytes(ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))
BASE = 0x9E3779B97F4A7C15
#: Bytes of a piece of an item, about.
PIECE = 64_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class Windows:
    """The windows of a chunk of pieces (item, words joined by spaces)."""

    def __init__(self, pieces: list[tuple[str, bytes]], n: int):
        self.number: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in pieces})
        place = {item: k for k, item in enumerate(self.names)}
        ids = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in text.split()], np.int32) for _, text in pieces]
        item = np.array([place[i] for i, _ in pieces], np.int64)
        self.by_length = []
        for m in sorted({min(n, len(x)) for x in ids if len(x)}):
            mine = [k for k, x in enumerate(ids) if min(n, len(x)) == m]
            rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(ids[k], m) for k in mine])
            owner = np.repeat(item[mine], [len(ids[k]) - m + 1 for k in mine])
            table, inverse = np.unique(rows, axis=0, return_inverse=True)
            pairs = np.unique(inverse.reshape(-1) * len(self.names) + owner)
            hashes = rolled_rows(table)
            order = np.argsort(hashes, kind="stable")
            # Items of window k (in table order): owners[edges[k] : edges[k + 1]].
            edges, owners = np.searchsorted(pairs // len(self.names), np.arange(len(table) + 1)), (pairs % len(self.names)).astype(np.int32)
            self.by_length.append((m, hashes[order], table[order], order, edges, owners))

    def hits(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Word runs (start, end) that are hit, and the items that occur."""
        spans, found = [], set()
        known = np.concatenate([[0], np.cumsum(ids == 0)])
        for m, hashes, table, order, edges, owners in self.by_length:
            if len(ids) < m:
                continue
            starts = np.flatnonzero(known[m:] == known[:-m])
            if not len(starts):
                continue
            h = rolled(ids, m)[starts]
            at = np.searchsorted(hashes, h)
            while len(at):  # once, but for windows that share a hash
                here = (at < len(hashes)) & (hashes[np.minimum(at, len(hashes) - 1)] == h)
                at, h, starts = at[here], h[here], starts[here]
                same = (table[at] == ids[starts[:, None] + np.arange(m)]).all(axis=1)
                spans += [(s, s + m) for s in starts[same].tolist()]
                for k in np.unique(order[at[same]]).tolist():
                    found.update(owners[edges[k] : edges[k + 1]].tolist())
                at = at + 1
        return spans, {self.names[k] for k in found}


def rolled_rows(table: np.ndarray) -> np.ndarray:
    """``rolled`` of each row."""
    out = np.zeros(len(table), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(table.shape[1]):
            out = out * np.uint64(BASE) + table[:, j].astype(np.uint64)
    return out


def rolled(ids: np.ndarray, m: int) -> np.ndarray:
    """A hash of each run of m word numbers."""
    with np.errstate(over="ignore"):
        x, out = ids.astype(np.uint64), np.zeros(len(ids) - m + 1, np.uint64)
        for j in range(m):
            out = out * np.uint64(BASE) + x[j : j + len(out)]
    return out


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


FOUND = "n_words long, hit_starts array<int>, hit_ends array<int>, hit_items array<string>"
NAMES = [x.split()[0] for x in FOUND.split(", ")]


def pieces_of(benchmark: DataFrame, n: int, item: str, text: str) -> DataFrame:
    """Distinct (item, piece): words of items joined by spaces, in pieces that overlap by n - 1 words."""

    def run(batches):
        for batch in batches:
            items, pieces = [], []
            for name, x in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                words, start = words_of(x), 0
                while start < len(words):
                    end, size = start, 0
                    while end < len(words) and (size < PIECE or end < start + n):
                        size += len(words[end]) + 1
                        end += 1
                    items.append(name)
                    pieces.append(b" ".join(words[start:end]))
                    start = end - n + 1 if end < len(words) else end
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(pieces, pa.binary())], ["item", "piece"])

    named = F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item")
    return benchmark.select(named, F.col(text).cast("string").alias("text")).mapInArrow(lean(run), "item string, piece binary").distinct()


def chunked(pieces: DataFrame, chunk_bytes: int) -> tuple[DataFrame, int]:
    """Pieces with the chunk each goes to, and how many chunks there are."""
    size = F.octet_length("item") + F.octet_length("piece")
    row = pieces.agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).first()
    parts = max(1, -(-(row["bytes"] or 0) // chunk_bytes))
    while True:
        dealt = pieces.withColumn("chunk", F.pmod(F.xxhash64("item", "piece"), F.lit(parts)))
        if parts == 1 or parts > 2 * row.n or dealt.groupBy("chunk").agg(F.sum(size).alias("s")).agg(F.max("s")).first()[0] <= chunk_bytes:
            return dealt, parts
        parts *= 2


def _scan(docs: DataFrame, benchmark: DataFrame, *, n: int, keep: list[str], text: str, item: str = "item_id", item_text: str = "text", chunk_bytes: int = 4_000_000) -> DataFrame:
    """``keep`` columns of each document (none may have a name of NAMES) with what was found."""
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "windows")
    dealt, parts = chunked(work.save(pieces_of(benchmark, n, item, item_text), "pieces"), chunk_bytes)
    source = list(dict.fromkeys([*keep, text]))
    state = docs.select(*source)
    for part in range(parts):
        # Bounded by chunk_bytes.
        chunk = [(r.item, bytes(r.piece)) for r in dealt.where(F.col("chunk") == part).select("item", "piece").toLocalIterator()]
        table = spark.sparkContext.broadcast(Windows(chunk, n))
        first = part == 0

        def run(batches, table=table, first=first):
            windows = table.value
            for batch in batches:
                n_words, starts, ends, found = [], [], [], []
                olds = repeat(([], [], [])) if first else zip(*(batch.column(c).to_pylist() for c in NAMES[1:]), strict=True)
                for x, (old_a, old_b, old_items) in zip(texts_of(batch.column(text).cast(pa.string())), olds):
                    words = words_of(x)
                    spans, items = windows.hits(np.array(list(map(windows.number.get, words, repeat(0))), dtype=np.int64)) if words else ([], set())
                    if spans or old_a:
                        runs = merged([*spans, *zip(old_a, old_b, strict=True)])
                        items |= set(old_items)
                    else:
                        runs = []
                    n_words.append(len(words))
                    starts.append([a for a, _ in runs])
                    ends.append([b for _, b in runs])
                    found.append(sorted(items))
                out = [batch.column(c) for c in source]
                new = [pa.array(n_words, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*out, *new], [*source, *NAMES])

        schema = ", ".join(f"`{c}` {t}" for c, t in state.select(*source).dtypes) + ", " + FOUND
        state = state.mapInArrow(lean(run), schema)
        if part + 1 < parts:
            state = work.save(state, f"part{part}")
    return state.select(*keep, *NAMES)


def scan(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, keep: list[str], text: str = "text", **options) -> DataFrame:
    """``keep`` columns of each document with n_words, hit word runs and the items found."""
    shield = Shield(docs)
    kept = [c for c in keep if c.lower() not in NAMES]
    out = _scan(shield.df, benchmark, n=n, keep=[shield[c] for c in kept], text=shield[text], **options)
    return out.select(*(F.col(shield[c]).alias(c) for c in kept), *NAMES)


def without_hits(text: str, starts: list[int], ends: list[int]) -> str:
    """The text without the bytes from the first to the last word of each hit run."""
    data, at = text.encode(), 0
    places = [x.span() for x in re.finditer(rb"[^ ]+", data.translate(WORDS))]
    out = []
    for a, b in zip(starts, ends, strict=True):
        out.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return (b"".join(out) + data[at:]).decode("utf-8", "ignore")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, text: str = "text", drop_share: float = 0.5, **options) -> DataFrame:
    """Documents without their hit runs; those with at least ``drop_share`` of their words hit go. Columns stay."""
    shield = Shield(docs)
    inner = shield[text]
    found = _scan(shield.df, benchmark, n=n, keep=shield.inner, text=inner, **options)
    hit = F.aggregate(F.zip_with("hit_ends", "hit_starts", lambda b, a: b - a), F.lit(0), lambda x, y: x + y)
    found = found.withColumn("hit_words", hit).where((F.col("hit_words") == 0) | (F.col("hit_words") < F.col("n_words") * drop_share))

    @F.pandas_udf("string")
    def cut(t, a, b):
        import pandas as pd

        return pd.Series([x if x is None or not len(s) else without_hits(x, list(s), list(e)) for x, s, e in zip(t, a, b, strict=True)], dtype=object)

    cleaned = F.when(F.size("hit_starts") == 0, F.col(inner)).otherwise(cut(inner, "hit_starts", "hit_ends"))
    return shield.back(found.select(*(cleaned.alias(c) if c == inner else c for c in shield.inner)))


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    # Written here, while few texts at a time go to Python.
    found = Workspace(spark, "op7").save(scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), n=10, keep=["doc_id"]), "found")
    hit = F.aggregate(F.zip_with("hit_ends", "hit_starts", lambda b, a: b - a), F.lit(0), lambda x, y: x + y).cast("long")
    named = F.array_join("hit_items", ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


_WORD_SQL = r"list_filter(regexp_split_to_array(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
ORACLE = f"""
WITH items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_WORD_SQL.format(x="text")} AS w FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM items, LATERAL unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0
), docs AS (
  SELECT doc_id, coalesce({_WORD_SQL.format(x="text")}, []) AS w FROM documents
), lengths AS (SELECT DISTINCT m FROM windows),
spots AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM docs, lengths, LATERAL unnest(range(1, len(w) - m + 2)) AS r(i) WHERE len(w) >= m
), found AS (
  SELECT doc_id, s.m, s.i, item_id FROM spots s JOIN windows USING (m, g)
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM found) GROUP BY doc_id
), names AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS named
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(named, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id)
"""
