"""Packing of tokenised documents into fixed-length sequences, by non-negative least squares over length patterns.

1. Documents are tokenised in place; one longer than ``limit`` is cut. Every piece knows its task and its number among
   that task's pieces of equal length, so its rank among all pieces of a length follows from one count per (task,
   length); no piece is sorted.
2. The histogram of lengths (at most ``limit`` numbers) goes to the driver. All patterns of up to three documents that
   fill a sequence exactly are enumerated; non-negative least squares fits repeat counts to the histogram; counts are
   rounded, fractions carried on from pattern to pattern, within what is there.
3. The residual histogram is packed by best fit in decreasing order, counts at a time: full patterns again, of any
   number of documents.
4. The list of patterns in use is broadcast; rank and length of a piece give its sequence and offset. Its rows are
   bounded by ``limit`` (at most limit^2 / 12 patterns of three, 40 bytes a row: 42 MB for 2048), whatever the data. The
   counts per (task, length) are a table, joined by Spark's choice: broadcast under its size limit, else by a shuffle of
   the narrow pieces.

Defined cases: a null or empty text is one piece, the end token alone; a very long text is cut into pieces; equal pieces
take places in any order among them; repeated rows and null ids are packed each; an empty table gives no rows; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import os
import string
import sys
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.work import Workspace, lean, read

#: ASCII signs but the apostrophe, which may join what follows it.
SIGNS = string.punctuation.replace("'", "")
#: Entries of a worker's memos: chunks of text, and a quarter more of their cores. About 500 bytes each, all told.
KEPT = 1_400_000


class WordTokenizer:
    """Token ids of whole texts by way of their white-space chunks, each tokenised once a worker.

    Sound for tokenizers whose pre-tokens never span white space and never hold letters and signs (the caller's choice of
    file). A chunk of Latin letters and a tail of signs is two pre-tokens in any case, so both are looked up on their own,
    ASCII letters in lower case.
    """

    def __init__(self, path: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.chunks, self.cores, self.kept = Tokenizer.from_file(path), {}, {}, kept
        probe = ["the", "thoningreble", "a", "zzzz", "internationalisation"]
        whole = [self.model.encode(x, add_special_tokens=False).ids for x in probe]
        self.direct = array("I").itemsize == 4 and sys.byteorder == "little" and whole == [[t.id for t in self.model.model.tokenize(x)] for x in probe]

    def learn(self, chunks: list[str]) -> None:
        parts = {}
        for chunk in chunks:
            core = chunk.rstrip(SIGNS)
            if not core.isalpha():
                parts[chunk] = (chunk, "")
            elif core.isascii():
                parts[chunk] = (core.lower(), chunk[len(core) :])
            else:
                parts[chunk] = (core, chunk[len(core) :]) if max(core) < "\u0250" else (chunk, "")
        if len(self.cores) > self.kept * 5 // 4:
            self.cores.clear()
        cores = self.cores
        new = {y for pair in parts.values() for y in pair}.difference(cores)
        if self.direct:  # plain lower-case words go to the model itself, which skips what would not change them
            tokenize = self.model.model.tokenize
            for x in [x for x in new if x.isascii() and x.isalpha() and x.islower()]:
                cores[x] = array("I", [t.id for t in tokenize(x)]).tobytes()
                new.discard(x)
        if new:
            new = list(new)
            found = self.model.encode(new, is_pretokenized=True, add_special_tokens=False)
            ids, word = np.array(found.ids, "<u4").tobytes(), np.array(found.word_ids, np.int64)
            edges = (4 * np.searchsorted(word, np.arange(len(new) + 1))).tolist()
            for k, x in enumerate(new):
                cores[x] = ids[edges[k] : edges[k + 1]]
        for chunk, (core, tail) in parts.items():
            self.chunks[chunk] = cores[core] + cores[tail] if tail else cores[core]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 4-byte ids of each text."""
        split = [text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for text in texts]
        seen: set[str] = set()
        for chunks in split:
            seen.update(chunks)
        new = seen.difference(self.chunks)
        if len(self.chunks) + len(new) > self.kept:
            self.chunks.clear()
            new = seen
        self.learn(list(new))
        get = self.chunks.__getitem__
        return [b"".join(map(get, chunks)) for chunks in split]


_tokenizers: dict[tuple, WordTokenizer] = {}


def tokenizer(path: str, kept: int) -> WordTokenizer:
    """One a worker process, so its memos serve all its tasks."""
    if (path, kept) not in _tokenizers:
        _tokenizers[path, kept] = WordTokenizer(path, kept)
    return _tokenizers[path, kept]


def cut_pieces(docs: DataFrame, path: str, *, limit: int, key: str, text: str, end: int = 0, keep_ids: bool = False, kept: int = KEPT) -> DataFrame:
    """Pieces with their ids' checksum (and, if asked, the ids), the task that cut them and their number there among equals."""
    schema = "doc long, piece int, start long, length long, ids_crc32 long, task long, number long" + ", ids array<int>" * keep_ids

    def run(batches):
        import public_tokenizers

        words, task, seen = tokenizer(public_tokenizers.path(path) if os.sep not in path else path, kept), TaskContext.get().partitionId(), {}
        tail = int(end).to_bytes(4, "little")
        for batch in batches:
            out = [[] for _ in range(7 + keep_ids)]
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), words.ids(texts), strict=True):
                ids += tail
                for piece, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    n = len(part) // 4
                    number = seen.get(n, 0)
                    seen[n] = number + 1
                    row = (doc, piece, at // 4, n, zlib.crc32(part), task, number)
                    for column, value in zip(out, row, strict=False):
                        column.append(value)
                    if keep_ids:
                        out[7].append(np.frombuffer(part, "<u4").astype(np.int32))
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, *[pa.list_(pa.int32())] * keep_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [x.strip().split()[0] for x in schema.split(",")])

    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(lean(run), schema)


def full_patterns(present: np.ndarray, limit: int) -> np.ndarray:
    """Lengths (a >= b >= c, 0: none) of up to three documents that fill a sequence: all of them, at most limit^2 / 12."""
    have = np.zeros(limit + 1, bool)
    have[present] = True
    have[0] = True
    have[limit] = False
    found = [np.zeros((0, 3), np.int64)]
    for b in present[present <= limit // 2]:
        a = present[(present >= b) & (present <= limit - b)]
        c = limit - a - b
        ok = (c <= b) & have[c]
        found.append(np.stack([a[ok], np.full(ok.sum(), b), c[ok]], axis=1))
    return np.concatenate(found)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that bring patterns close to the histogram: min |W (A x - h)|^2 by accelerated projection."""
    if not len(patterns):
        return np.zeros(0)
    n = len(counts)
    h = counts.astype(float)
    h[0] = 0
    scale = max(h.sum(), 1.0)
    weight = np.where(np.arange(n) < n // 8, 0.3, 1.0)  # short pieces fit in anywhere, so they may stay
    weight[0] = 0
    cols = [patterns[:, j] for j in range(3)]

    def fill(x):
        return sum(np.bincount(c, weights=x, minlength=n) for c in cols)

    def back(r):
        return sum(r[c] for c in cols)

    w2, v = weight**2, np.ones(len(patterns))
    for _ in range(20):
        v = back(w2 * fill(v))
        size = np.linalg.norm(v)
        v /= size
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(w2 * (fill(y) - h / scale)) / (1.05 * size))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x * scale


def best_fit(counts: np.ndarray, limit: int) -> list[tuple[int, tuple]]:
    """Patterns (repeats, ((length, times), ...)) by best fit decreasing, all pieces of a length and all equal bins at a time."""
    bins: dict[int, list] = {}
    spaces: list[int] = []
    closed = []

    def put(space, repeats, pattern):
        if not space:
            closed.append((repeats, pattern))
            return
        if space not in bins:
            insort(spaces, space)
            bins[space] = []
        bins[space].append((repeats, pattern))

    for length in range(limit, 0, -1):
        left = int(counts[length])
        while left:
            k = bisect_left(spaces, length)
            if k == len(spaces):
                times = min(limit // length, left)
                repeats = left // times
                put(limit - times * length, repeats, ((length, times),))
                left -= repeats * times
                continue
            space = spaces[k]
            repeats, pattern = bins[space].pop()
            if not bins[space]:
                del bins[space]
                spaces.pop(k)
            times = min(space // length, left)
            used = min(repeats, left // times)
            if used < repeats:
                put(space, repeats - used, pattern)
            put(space - times * length, used, (*pattern, (length, times)))
            left -= used * times
    return closed + [x for group in bins.values() for x in group]


def rounded(patterns: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[tuple[int, tuple]]:
    """Whole repeats of patterns, taken from ``left``.

    A fit spreads over very many patterns of a fraction each, so fractions are carried along: in order of their lengths,
    where neighbours are alike, a pattern has as many repeats as its fraction lifts the sum to the next whole numbers. What
    is not there any more is carried on too.
    """
    out, carried, have = [], 0.0, left.tolist()
    order = np.lexsort(patterns.T)
    for lengths, share in zip(patterns[order].tolist(), x[order].tolist(), strict=True):
        carried += share
        if carried < 0.5:
            continue
        times: dict[int, int] = {}
        for length in lengths:
            if length:
                times[length] = times.get(length, 0) + 1
        n = min(int(carried + 0.5), *(have[length] // k for length, k in times.items()))
        if n:
            carried -= n
            for length, k in times.items():
                have[length] -= n * k
            out.append((n, tuple(times.items())))
    left[:] = have
    return out


def plan(counts: np.ndarray, limit: int) -> list[tuple[int, tuple]]:
    """Patterns with their repeats for a histogram of lengths 0 .. limit."""
    left = counts.astype(np.int64).copy()
    patterns = full_patterns(np.flatnonzero(left[1:limit]) + 1, limit)
    fitted = rounded(patterns, fit(patterns, left), left)
    return fitted + best_fit(left, limit)


def places(patterns: list[tuple[int, tuple]], limit: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, times, offset), by length and first rank."""
    rank, rows, sequence = np.zeros(limit + 1, np.int64), [], 0
    for n, pattern in patterns:
        offset = 0
        for length, times in pattern:
            rows.append((length, rank[length], sequence, times, offset))
            rank[length] += n * times
            offset += length * times
        sequence += n
    table = np.array(rows, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def pack_pieces(docs: DataFrame, path: str, *, limit: int = 2048, key: str = "doc_id", text: str = "text", keep_ids: bool = False, kept: int = KEPT) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset (and ids). ``kept``: entries of a worker's
    memos, which cost memory and save time and change nothing else."""
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    pieces = work.save(cut_pieces(docs, path, limit=limit, key=key, text=text, keep_ids=keep_ids, kept=kept), "pieces")
    counts = work.save(pieces.groupBy("task", "length").agg((F.max("number") + 1).alias("n")), "counts")
    histogram = np.zeros(limit + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `limit` rows
        histogram[r.length] = r.n
    table = spark.sparkContext.broadcast(places(plan(histogram, limit), limit))
    before = F.sum("n").over(W.partitionBy("length").orderBy("task")) - F.col("n")
    base = counts.select("task", "length", before.alias("base"))
    ranked = pieces.join(base, ["task", "length"]).withColumn("rank", F.col("base") + F.col("number"))

    @F.pandas_udf("sequence long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t, length, rank = table.value, length.to_numpy(), rank.to_numpy()
        if not len(length):
            return pd.DataFrame({"sequence": length, "offset": rank})
        row = t[np.searchsorted((t[:, 0] << 48) | t[:, 1], (length << 48) | rank, side="right") - 1]
        within = rank - row[:, 1]
        return pd.DataFrame({"sequence": row[:, 2] + within // row[:, 3], "offset": row[:, 4] + within % row[:, 3] * length})

    out = ranked.withColumn("at", place("length", "rank"))
    return out.select(F.col("doc").alias(key), "piece", "start", "length", "ids_crc32", F.col("at.sequence").alias("sequence_id"), F.col("at.offset").alias("offset"), *(["ids"] if keep_ids else []))


TOKENIZER = "word_bpe_49k.json"


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_pieces(read(spark, sf_dir, "documents"), TOKENIZER, limit=2048)
