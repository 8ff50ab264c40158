"""Near-duplicate documents by min-max hashing.

A document's set: distinct ``shingle``-word shingles of its words (ASCII lower-cased, split at ASCII white space), as
64-bit hashes; with fewer words, the whole sequence as one. Each of ``perms`` permutations gives two signature values,
the least and the greatest image of the set, so a signature needs half the hash evaluations of plain min-hashing.
``rows`` values of different permutations make a band (minima of four permutations, or their maxima).

Equal sets are one class. Between classes:

1. Every band bucket links its members to its smallest class as candidates. Full sets confirm them, which settles
   most of any large group at once, in linear work.
2. In buckets whose members are still in different components, those outside are tried against one member of the
   bucket's component of most members.
3. Members of buckets that are still apart meet on their rarest shingles (prefix filter with positions): two sets that
   reach the threshold share a shingle that is early in both, in any common order of shingles; here by how many such
   members hold it, counted in a sketch of bounded size that only orders, so its errors cost time and no link. Pairs of
   different components that meet there are judged on full sets.

So every pair that shares a band is either in one component already or judged on full sets, nothing is capped, and no
step writes all pairs of a group. Components are found by rounds over tables (``graph``). Pairs at the threshold miss
all bands with a probability of about (1 - s^rows)^bands: 4e-7 at s = 0.85 with 20 bands of 4.

Defined cases: a null, empty or word-free text has an empty set, is linked with nothing and kept; a null id takes no
part: its component is null and it is kept; repeated rows are one class (same component each); extra columns are
ignored or, in ``drop_near_duplicates``, kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.graph import components, relabelled
from corvane.llm.work import Shield, Workspace, lean, mix64, partitions, read, texts_of

BASE = np.uint64(0x9E3779B97F4A7C15)
KEPT_WORDS = 300_000  # of a worker's memo of word hashes


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes, shingle: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    x = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    m = min(shingle, len(words))
    with np.errstate(over="ignore"):
        h = np.zeros(len(words) - m + 1, np.uint64)
        for j in range(m):
            h = h * BASE + x[j : j + len(h)]
        return np.unique(mix64(h + np.uint64(m)))


def permutations(perms: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(4_1985)
    a, b = r.integers(0, 2**63, (2, perms), dtype=np.int64).astype(np.uint64)
    return a * np.uint64(2) + np.uint64(1), b * np.uint64(2)


def bands_of(values: np.ndarray, ends: np.ndarray, perms: int, rows: int) -> np.ndarray:
    """Band keys of documents whose shingles lie one after another; none is empty. 2 * perms / rows keys each."""
    starts, (a, b) = np.concatenate([[0], ends[:-1]]), permutations(perms)
    low, high = np.empty((perms, len(ends)), np.uint64), np.empty((perms, len(ends)), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(perms):
            image = values * a[i] + b[i]
            low[i], high[i] = np.minimum.reduceat(image, starts), np.maximum.reduceat(image, starts)
        out = np.empty((len(ends), 2 * perms // rows), np.uint64)
        for k in range(perms // rows):
            for side, x in enumerate((low, high)):
                h = np.full(len(ends), 2 * k + side + 1, np.uint64)
                for j in range(k * rows, k * rows + rows):
                    h = mix64(h * BASE + x[j])
                out[:, 2 * k + side] = h
    return out


def signatures(docs: DataFrame, *, shingle: int, perms: int, rows: int, key: str, text: str) -> DataFrame:
    """id, n_shingles, set_digest and bands of every row."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            ids, sets = batch.column(0), [shingle_set(t, shingle, hashes) for t in texts_of(batch.column(1))]
            full = [i for i, s in enumerate(sets) if len(s)]
            bands = [None] * len(sets)
            if full:
                found = bands_of(np.concatenate([sets[i] for i in full]), np.cumsum([len(sets[i]) for i in full]), perms, rows).view(np.int64)
                for i, b in zip(full, found, strict=True):
                    bands[i] = b
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "n_shingles", "set_digest", "bands"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(run), "id long, n_shingles long, set_digest binary, bands array<long>")


#: Ids of 8 bytes that may go to every executor; more are joined by a shuffle.
FEW = 1_000_000


def small(ids: DataFrame) -> DataFrame:
    """``ids`` (one narrow column), to be broadcast where their counted number allows it."""
    return ids.hint("broadcast" if ids.count() <= FEW else "shuffle_hash")


def set_table(docs: DataFrame, ids: DataFrame, *, shingle: int, key: str, text: str) -> DataFrame:
    """id and set (sorted 8-byte hashes) of the documents of ``ids``."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, shingle, hashes).tobytes() for t in texts_of(batch.column(1))], pa.binary())], ["id", "set"])

    slim = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return slim.join(small(ids), "id", "left_semi").mapInArrow(lean(run), "id long, set binary")


#: Pairs of one set that a task may see. The partners of a set in more pairs are dealt to several.
CROWD = 1_000


def with_set(pairs: DataFrame, sets: DataFrame, end: str, other: str, work: Workspace, name: str) -> DataFrame:
    """``pairs`` with ``set_<end>``, the set of their id in column ``end``.

    A set in many pairs is copied as often as it takes, and its pairs are dealt among the copies by their other end.
    """
    mine = sets.select(F.col("id").alias(end), F.col("set").alias(f"set_{end}"))
    crowds = work.save(pairs.groupBy(end).agg(F.count("*").alias("n")).where(f"n > {CROWD}").select(F.col(end).alias("crowd"), F.ceil(F.col("n") / CROWD).cast("int").alias("copies")), name)
    some = crowds.count()
    if not some:
        return pairs.join(mine, end)
    if some <= FEW:
        crowds = F.broadcast(crowds)
    copies = F.coalesce("copies", F.lit(1))
    dealt = pairs.join(crowds, F.col(end) == F.col("crowd"), "left").withColumn("copy", F.pmod(F.xxhash64(other), copies).cast("int")).drop("crowd", "copies")
    copied = mine.join(crowds, F.col(end) == F.col("crowd"), "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("crowd", "copies")
    return dealt.join(copied, [end, "copy"]).drop("copy")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, work: Workspace, name: str) -> DataFrame:
    """(x, y) of the pairs (a, b, x, y) whose full sets reach the threshold, as links (a, b)."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("x"), batch.column("y")
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(both) - same))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    joined = with_set(with_set(pairs, sets, "a", "b", work, f"{name}-a"), sets, "b", "a", work, f"{name}-b")
    return joined.select("x", "y", "set_a", "set_b").mapInArrow(lean(run), "a long, b long")


def holders_sketch(sets: DataFrame, total: int) -> np.ndarray:
    """How many sets hold a shingle, by the low bits of its hash: tasks count, the driver gets the sums.

    ``total`` shingles in all sets get about a counter each, from 1 MB of counters up to 4 MB, which is what is sent out.
    """
    piece, bits = 1 << 14, min(20, max(18, total.bit_length()))

    def count(batches):
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(counts, (np.frombuffer(x.as_buffer(), np.uint64) & np.uint64((1 << bits) - 1)).astype(np.int64), 1)
        for k in range(0, 1 << bits, piece):
            if counts[k : k + piece].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([counts[k : k + piece].tobytes()], pa.binary())], ["piece", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.uint32).astype(np.uint64) for x in table.column("counts"))
        return pa.table({"piece": table.column("piece").slice(0, 1), "counts": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    out = np.zeros(1 << bits, np.uint32)
    for r in sets.select("set").mapInArrow(lean(count), "piece int, counts binary").groupBy("piece").applyInArrow(add, "piece int, counts binary").collect():
        out[r.piece : r.piece + piece] = np.frombuffer(bytes(r["counts"]), np.uint32)
    return out


def rarest(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """rep, n, component, shingle, place: the first shingles of each member by rarity, as many as a partner may need."""
    mine = members.join(sets.withColumnRenamed("id", "rep"), "rep")
    total = members.agg(F.sum("n")).first()[0] or 0
    sketch = sets.sparkSession.sparkContext.broadcast(holders_sketch(mine, total))

    def run(batches):
        counts = sketch.value
        for batch in batches:
            reps, ns, components, shingles, places = [], [], [], [], []
            for rep, n, component, x in zip(batch.column("rep").to_pylist(), batch.column("n").to_pylist(), batch.column("component").to_pylist(), batch.column("set"), strict=True):
                h = np.frombuffer(x.as_buffer(), np.uint64)
                first = n - (percent * n + 99) // 100 + 1
                held = counts[h & np.uint64(len(counts) - 1)]
                order = np.lexsort((h, held))[:first]
                reps += [rep] * len(order)
                ns += [n] * len(order)
                components += [component] * len(order)
                shingles.append(h[order].view(np.int64))
                places += range(len(order))
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(ns, pa.int64()), pa.array(components, pa.int64()), pa.array(np.concatenate(shingles) if shingles else []).cast(pa.int64()), pa.array(places, pa.int64())], ["rep", "n", "component", "shingle", "place"])

    return mine.select("rep", "n", "component", "set").mapInArrow(lean(run), "rep long, n long, component long, shingle long, place long")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, perms: int = 48, rows: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id and kept (id = component_id)."""
    work = Workspace(docs.sparkSession, "near")
    signed = work.save(signatures(docs, shingle=shingle, perms=perms, rows=rows, key=key, text=text), "signed")
    full = signed.where("set_digest IS NOT NULL AND id IS NOT NULL")
    classes = work.save(full.groupBy("set_digest").agg(F.min("id").alias("rep"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    slots = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    near = f"100 * least(n, m) >= {percent} * greatest(n, m)"

    # 1. Buckets of two or more, with their smallest class. Sets are made once, for their members alone.
    heads = slots.groupBy("bucket").agg(F.count("*").alias("members"), F.min(F.struct("rep", "n")).alias("head")).where("members > 1")
    members = work.save(slots.join(heads, "bucket").select("bucket", "rep", "n", "head"), "members")
    ids = work.save(members.select(F.col("rep").alias("id")).distinct(), "ids")
    sets = work.save(set_table(docs, ids, shingle=shingle, key=key, text=text), "sets")
    pairs = work.save(members.select(F.col("head.rep").alias("a"), F.col("rep").alias("b"), "n", F.col("head.n").alias("m")).where("a < b").where(near).select("a", "b").distinct(), "pairs1")
    links = work.save(confirmed(pairs.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y")), sets, percent, work, "crowds1"), "links1")
    labels = components(links, work, "first-")

    # 2. and 3. Only buckets that still hold several components, whose merging is a graph of components.
    members = members.select("bucket", "rep", "n")
    for step in (2, 3):
        labels = work.save(labels, f"labels{step}")
        placed = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        per = placed.groupBy("bucket", "component").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("rep", "bucket").alias("h"), "rep", "n")).alias("pick"))
        apart = per.groupBy("bucket").agg(F.count("*").alias("n_components"), F.max(F.struct("size", "component", "pick")).alias("most")).where("n_components > 1")
        placed = work.save(placed.join(apart, "bucket").select("bucket", "rep", "n", "component", "most"), f"placed{step}")
        if not placed.count():
            break
        if step == 2:
            members = placed.select("bucket", "rep", "n")
            tried = placed.where("component <> most.component").select("rep", "n", "component", F.col("most.pick.rep").alias("other"), F.col("most.pick.n").alias("m"), F.col("most.component").alias("other_component"))
        else:
            firsts = work.save(rarest(placed.select("rep", "n", "component").distinct(), sets, percent), "firsts")
            seconds = firsts.select("shingle", F.col("rep").alias("other"), F.col("n").alias("m"), F.col("component").alias("other_component"), F.col("place").alias("other_place"))
            early = (F.least(F.col("n") - F.col("place"), F.col("m") - F.col("other_place")) * (100 + percent)) >= percent * (F.col("n") + F.col("m"))
            tried = firsts.join(seconds, "shingle").where((F.col("rep") < F.col("other")) & (F.col("component") != F.col("other_component")) & early)
        ends = [F.struct(F.col(x).alias("id"), F.col(y).alias("of")) for x, y in (("rep", "component"), ("other", "other_component"))]
        ordered = tried.where(near).select(F.least(*ends).alias("p"), F.greatest(*ends).alias("q"))
        pairs = work.save(ordered.select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), F.col("p.of").alias("x"), F.col("q.of").alias("y")).distinct(), f"pairs{step}")
        if pairs.count():
            links = work.save(confirmed(pairs, sets, percent, work, f"crowds{step}"), f"links{step}")
            labels = relabelled(labels, components(links, work, f"step{step}-"))

    of_class = classes.select("set_digest", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("set_digest", F.coalesce("component", "rep").alias("component"))
    out = signed.select("id", "n_shingles", "set_digest").join(of_class, "set_digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    out = work.save(out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")), "out")
    work.drop("signed", "classes", "members", "ids", "sets", "firsts", *(f"{x}{k}" for x in ("pairs", "links", "labels", "placed") for k in (1, 2, 3)))
    return out


def drop_near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without all but one document (the smallest id) of each group; columns stay.

    Rows that repeat id and text are one; rows of one id and several texts are judged each, in order of their digests;
    rows with a null id stay.
    """
    shield = Shield(docs)
    own, key, text = shield.df, shield[key], shield[text]
    if own.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").head(1):
        work = Workspace(docs.sparkSession, "numbered")
        order = [key, "corvane_digest"]
        single = own.where(F.col(key).isNotNull()).withColumn("corvane_digest", F.sha2(F.col(text).cast("string"), 256)).dropDuplicates(order)
        ordered = single.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
        numbered = work.save(ordered.withColumn("corvane_row", F.monotonically_increasing_id()), "numbered")
        kept = _without_copies(numbered, key="corvane_row", text=text, **options).select(*shield.inner).unionByName(own.where(F.col(key).isNull()))
    else:
        kept = _without_copies(own, key=key, text=text, **options)
    return shield.back(kept)


def _without_copies(docs: DataFrame, *, key: str, **options) -> DataFrame:
    gone = near_duplicates(docs, key=key, **options).where("NOT kept").select(F.col(key).alias("corvane_gone"))
    return docs.join(small(gone), F.col(key) == F.col("corvane_gone"), "left_anti")


def op4_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=3, percent=85, perms=40, rows=4)
