"""Removal of passages that a document with a smaller id holds too, byte for byte.

A byte goes if a ``span``-byte string over it also starts in a document with a smaller id. Strings are judged on the
input; whole texts count, and none crosses a document.

The structure is a sparse suffix index, run-compressed. Of all suffixes only those at anchors are kept: the position
of the smallest ``gram``-byte hash in each ``span``-byte window (so every string of ``span`` bytes has its anchor at
one and the same place wherever it occurs). Anchored suffixes are ordered by the hash of their gram and of their
context, the bytes on both sides that any window through the anchor can see. Suffixes with equal context form a run -
the equal neighbours that a Burrows-Wheeler transform turns into runs in repetitive corpora - and a run keeps one
sample, its smallest document. Matching statistics are then taken per window: in a run that a smaller document opens,
all windows match; in other runs of a gram with several contexts, the run's first document asks which cores of its
windows (about 42 bytes) other documents hold, and windows over those are looked up by their own hash. All else cannot
match.

A full r-index of the corpus is not built: its backward search names one occurrence, not the smallest document, and
its transform needs the corpus sorted as one string. See the README.

Contexts are dealt by their own hash and grams by theirs, so a phrase that a third of all rows hold in as many contexts
is no one task's load.

Work per block of texts is numpy; between blocks travel sorted arrays of distinct hashes (see ``blocks``), so a passage
in a third of all rows travels once per block. Gram hashes are only a filter; contexts and windows are compared by 64
bits.

Defined cases: a null or empty text has no bytes and loses none; a text is never split, and a very long one is a block of
its own, at some tens of bytes of memory a byte; texts shorter than ``span`` lose nothing; a null id
counts as larger than all others; rows with the same id never remove each other's bytes; repeated rows under a larger
id go whole; an empty table gives no rows; other columns are ignored (``dedup_passages`` keeps them).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.blocks import LAST, Blocks, carried, map_blocks, reduce_parts, split
from corvane.llm.work import Shield, Workspace, mix64, read

GRAM, GAP, GROUP = 16, 64, 9
#: Bytes of text a hash part, about.
PART_BYTES = 16_000_000
TABLE = np.random.default_rng(50_016).integers(0, 2**63, 257, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
SEVERAL = np.uint64(2**64 - 1)  # stands for a gram's contexts where a block has several
C1, C2 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Anchors:
    """The anchors of a block: document, gram position, first and last window start, part, gram and key (its context)."""

    def __init__(self, lengths: np.ndarray, data: np.ndarray, span: int, parts: int):
        n_docs, width = len(lengths), span - GRAM + 1
        starts = GAP + np.concatenate([[0], np.cumsum(lengths + GAP)[:-1]]) if n_docs else np.zeros(0, np.int64)
        size = int((lengths + GAP).sum()) + GAP + 2 * span
        codes, doc = np.full(size, 256, np.int16), np.full(size, -1, np.int32)
        at = np.concatenate([[0], np.cumsum(lengths)])
        for i in range(n_docs):
            codes[starts[i] : starts[i] + lengths[i]] = data[at[i] : at[i + 1]]
            doc[starts[i] : starts[i] + lengths[i]] = i
        self.starts, self.size, self.span = starts, size, span
        with np.errstate(over="ignore"):
            h, k = TABLE[codes], 1
            del codes
            while k < GRAM:
                h = h[:-k] * np.uint64(pow(BASE, k, 2**64)) + h[k:]
                k *= 2
            self.h = h
            bits = np.uint64(max(1, size.bit_length()))
            low = np.uint64((1 << int(bits)) - 1)
            m = ((h * C1) & ~low) | np.arange(len(h), dtype=np.uint64)
            k = 1
            while 2 * k <= width:
                m = np.minimum(m[:-k], m[k:])
                k *= 2
            if width > k:
                m = np.minimum(m[: -(width - k)], m[width - k :])
            n = size - span + 1
            place = (m[:n] & low).astype(np.int64)
            valid = (doc[:n] >= 0) & (doc[:n] == doc[span - 1 : span - 1 + n])
            first = valid.copy()
            first[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
            last = valid.copy()
            last[:-1] &= (place[1:] != place[:-1]) | ~valid[1:]
            self.lo, self.hi = np.flatnonzero(first), np.flatnonzero(last)
            self.p, self.doc = place[self.lo], doc[self.lo]
            gram = mix64(h[self.p])
            left, right = span - GRAM, span
            context, at = np.zeros(len(self.p), np.uint64), -left
            while at + GRAM < right:
                context = (context ^ h[self.p + at]) * C2 + np.uint64(1)
                context ^= context >> np.uint64(29)
                at += GRAM
            self.key = mix64((context ^ h[self.p + right - GRAM]) * C2)
            self.part, self.gram = (self.key % np.uint64(parts)).astype(np.int64), gram

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct grams in order, a context of each, and whether it has several."""
        order = np.lexsort((self.key, self.gram))
        g, k = self.gram[order], self.key[order]
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        starts = np.flatnonzero(new)
        return g[starts], k[starts], k[starts] != k[np.append(starts[1:], len(g)) - 1]

    def hashes(self, at: np.ndarray, length: int, kind: int) -> np.ndarray:
        """Of the strings of ``length`` bytes that start at ``at``."""
        with np.errstate(over="ignore"):
            x, k = np.full(len(at), kind, np.uint64), 0
            while k + GRAM < length:
                x = mix64((x ^ self.h[at + k]) * C2 + np.uint64(3))
                k += GRAM
            return mix64((x ^ self.h[at + length - GRAM]) * C2)

    def cores(self, which: np.ndarray):
        """The windows through each of these anchors in groups of neighbours: (anchors, core hashes, first, last window).

        All windows of a group cover its core, so windows can be equal only where cores are.
        """
        p, lo, hi = self.p[which], self.lo[which], self.hi[which]
        for kind, near in enumerate(range(0, self.span - GRAM + 1, GROUP)):
            far = min(near + GROUP - 1, self.span - GRAM)
            first, last = np.maximum(lo, p - far), np.minimum(hi, p - near)
            some = np.flatnonzero(first <= last)
            yield which[some], self.hashes(p[some] - near, self.span - far + near, kind + 1), first[some], last[some]


def ranks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in order, and the place of each document's id among them."""
    return np.unique(ids, return_inverse=True)


def first_of(part: np.ndarray, key: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct (part, key): an order of all entries, where each group starts in it, and each entry's group minimum."""
    order = np.lexsort((rank, key, part))
    k, p = key[order], part[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1])
    group = np.cumsum(new) - 1
    least = np.empty(len(k), rank.dtype)
    least[order] = rank[order][new][group] if len(k) else rank[order]
    return order[new], new, least


def encode_ids(ids: np.ndarray) -> bytes:
    """Ids as 4-byte distances where they fit."""
    base = int(ids.min())
    near = int(ids.max()) - base < 2**32
    return base.to_bytes(8, "little", signed=True) + bytes([near]) + ((ids - base).astype(np.uint32) if near else ids).tobytes()


def decode_ids(blob: bytes) -> np.ndarray:
    if blob[8]:
        return np.frombuffer(blob, np.uint32, offset=9).astype(np.int64) + int.from_bytes(blob[:8], "little", signed=True)
    return np.frombuffer(blob, np.int64, offset=9)


def _send(part, key, ids, block, parts, *more):
    rows = [[], [], [], [], *([] for _ in more)]
    for p, (k, i, *rest) in split(part, parts, key, ids, *more):
        for column, value in zip(rows, (p, block, k.tobytes(), encode_ids(i), *(r.tobytes() for r in rest)), strict=True):
            column.append(value)
    return rows if rows[0] else None


def covered(docs: DataFrame, work: Workspace, *, span: int, key: str, text: str, carry: list[str] = ()) -> tuple[Blocks, DataFrame]:
    """The blocks of the texts and, for each, blobs of covered windows: pairs (first start, last start) as 4-byte numbers."""
    blocks = Blocks(docs, work, key=key, text=text, carry=carry)
    parts = blocks.parts_of(PART_BYTES)

    def runs(block, ids, lengths, data, _):
        a, (names, rank) = Anchors(lengths, data, span, parts), ranks(ids)
        if not len(a.p):
            return
        one, _, _ = first_of(a.part, a.key, rank[a.doc])
        out = _send(a.part[one], a.key[one], names[rank[a.doc[one]]], block, parts)
        yield [*out, [b""] * len(out[0])]
        # Of a gram with several contexts here a mark goes out, not all of them: at most one entry a gram and block.
        grams, only, many = a.grams()
        out = [[] for _ in range(5)]
        for p, (g, k) in split((grams % np.uint64(parts)).astype(np.int64), parts, grams, np.where(many, SEVERAL, only)):
            for column, value in zip(out, (parts + p, block, g.tobytes(), b"", k.tobytes()), strict=True):
                column.append(value)
        yield out

    def open_runs(rows):
        key = np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows])
        source = np.repeat(np.arange(len(rows)), [len(r[2]) // 8 for r in rows])
        context = rows[0][0] < parts
        value = np.concatenate([decode_ids(r[3]) if context else np.frombuffer(r[4], np.uint64) for r in rows])
        order = np.lexsort((value, key))
        k, v = key[order], value[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        group, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        if context:  # which documents have a smaller one in their run, and which
            least = v[starts][group]
            told = np.flatnonzero(least < v)
        else:  # which grams have several contexts, for the blocks that know one
            least = k
            several = v[starts] != v[np.append(starts[1:], len(v)) - 1]
            told = np.flatnonzero(several[group] & (v != SEVERAL))
        out = [[], []]
        for s, (kk, least_of) in split(source[order][told], len(rows), k[told], least[told]):
            out[0].append(rows[s][1])
            out[1].append(b"\0" + kk.tobytes() + least_of.tobytes() if context else b"\1" + kk.tobytes())
        yield out if out[0] else None

    def contexts(block, ids, lengths, data, blobs):
        a, (names, rank) = Anchors(lengths, data, span, parts), ranks(ids)
        if not len(a.p):
            return
        own = rank[a.doc]
        _, _, least = first_of(a.part, a.key, own)
        done = least < own
        later = [np.frombuffer(x, np.uint64, offset=1) for x in blobs if x[0] == 0]
        grams, _, many = a.grams()
        contested = np.sort(np.concatenate([grams[many], *(np.frombuffer(x, np.uint64, offset=1) for x in blobs if x[0] == 1)]))
        # The gram is not sent back: the context covers it.
        if later:
            k, g = np.concatenate([x[: len(x) // 2] for x in later]), np.concatenate([x[len(x) // 2 :] for x in later]).view(np.int64)
            order = np.argsort(k, kind="stable")
            k, g = k[order], g[order]
            spot = np.minimum(np.searchsorted(k, a.key), len(k) - 1)
            done |= (k[spot] == a.key) & (g[spot] < names[own])
        spans = np.stack([a.lo[done], a.hi[done]], axis=1).astype(np.uint32)
        yield [[-1], [block], [spans.tobytes()], [b""], [b""]] if len(spans) else None
        if not len(contested):
            return
        asked = np.flatnonzero(~done & (contested[np.minimum(np.searchsorted(contested, a.gram), len(contested) - 1)] == a.gram))
        if not len(asked):
            return
        yield [[-2], [block], [np.unique(a.key[asked]).tobytes()], [b""], [b""]]
        groups = list(a.cores(asked))
        core, doc = np.concatenate([g[1] for g in groups]), own[np.concatenate([g[0] for g in groups])]
        part = (core % np.uint64(parts)).astype(np.int64)
        one, new, least = first_of(part, core, doc)
        several = np.unique(core[least < doc])
        yield _send(part[one], core[one], names[doc[one]], block, parts, np.isin(core[one], several))

    def shared_cores(rows):
        key = np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows])
        ids = np.concatenate([decode_ids(r[3]) for r in rows])
        several = np.concatenate([np.frombuffer(r[4], bool) for r in rows])
        source = np.repeat(np.arange(len(rows)), [len(r[2]) // 8 for r in rows])
        order = np.lexsort((ids, key))
        k, i = key[order], ids[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        group = np.cumsum(new) - 1
        last = np.append(np.flatnonzero(new)[1:] - 1, len(k) - 1)
        shared = (i[last] > i[new]) | (np.bincount(group, weights=several[order]) > 0)
        told = np.flatnonzero(shared[group])
        out = [[], []]
        for s, (kk,) in split(source[order][told], len(rows), k[told]):
            out[0].append(rows[s][1])
            out[1].append(b"\1" + kk.tobytes())
        yield out if out[0] else None

    def windows(block, ids, lengths, data, blobs):
        keys = [np.frombuffer(x, np.uint64, offset=1) for x in blobs if x[0] == 0]
        shared = [np.frombuffer(x, np.uint64, offset=1) for x in blobs if x[0] == 1]
        if not keys or not shared:
            return
        a, (names, rank) = Anchors(lengths, data, span, parts), ranks(ids)
        own = rank[a.doc]
        _, _, least = first_of(a.part, a.key, own)
        asked = np.flatnonzero((least == own) & np.isin(a.key, np.concatenate(keys)))
        shared = np.concatenate(shared)
        at, doc = [], []
        for which, core, first, last in a.cores(asked):
            pick = np.isin(core, shared)
            which, first, counts = which[pick], first[pick], (last - first + 1)[pick]
            at.append(np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
            doc.append(np.repeat(own[which], counts))
        at, doc = np.concatenate(at), np.concatenate(doc)
        if not len(at):
            return
        whash = a.hashes(at, span, 0)
        part = (whash % np.uint64(parts)).astype(np.int64)
        _, _, least = first_of(part, whash, doc)
        here = least < doc
        if here.any():
            yield [[-1], [block], [np.stack([at[here], at[here]], axis=1).astype(np.uint32).tobytes()], [b""], [b""]]
        rest = ~here
        yield _send(part[rest], whash[rest], names[doc[rest]], block, parts, at[rest].astype(np.uint32))

    def look_up(rows):
        key = np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows])
        ids = np.concatenate([decode_ids(r[3]) for r in rows])
        at = np.concatenate([np.frombuffer(r[4], np.uint32) for r in rows])
        source = np.repeat(np.arange(len(rows)), [len(r[2]) // 8 for r in rows])
        order = np.lexsort((ids, key))
        k, i = key[order], ids[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        hit = np.flatnonzero(i[new][np.cumsum(new) - 1] < i)
        out = [[], []]
        for s, (spots,) in split(source[order][hit], len(rows), at[order][hit]):
            out[0].append(rows[s][1])
            out[1].append(np.stack([spots, spots], axis=1).tobytes())
        yield out if out[0] else None

    sent = map_blocks(blocks.rows(), runs, "part int, block long, keys binary, ids binary, grams binary")
    # A table of its own: what all blocks sent, by far the largest exchange, is deleted before the next one.
    told = blocks.save(reduce_parts(sent, open_runs, "block long, blob binary", parts), "told")
    shape = "part int, block long, keys binary, ids binary, more binary"
    asked = blocks.save(map_blocks(blocks.with_info(told), contexts, shape), "asked")
    work.drop("told")
    own_keys = asked.where("part = -2").select("block", F.concat(F.lit(b"\0"), "keys").alias("blob"))
    cores = reduce_parts(asked.where("part >= 0"), shared_cores, "block long, blob binary", parts)
    looked = blocks.save(map_blocks(blocks.with_info(own_keys.unionByName(cores)), windows, shape), "looked")
    found = reduce_parts(looked.where("part >= 0"), look_up, "block long, blob binary", parts)
    known = asked.unionByName(looked).where("part = -1").select("block", F.col("keys").alias("blob"))
    return blocks, known.unionByName(found)


def removed_runs(blobs: list[bytes], lengths: np.ndarray, span: int) -> list[np.ndarray]:
    """Per document the maximal removed runs as rows (start, end) of bytes."""
    starts = GAP + np.concatenate([[0], np.cumsum(lengths + GAP)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    out = [np.zeros((0, 2), np.int64)] * len(lengths)
    if not blobs:
        return out
    spans = np.concatenate([np.frombuffer(b, np.uint32).reshape(-1, 2) for b in blobs]).astype(np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    a, b = spans[:, 0], np.maximum.accumulate(spans[:, 1] + span)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    a, b = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
    doc = np.searchsorted(starts, a, side="right") - 1
    edges = np.searchsorted(doc, np.arange(len(lengths) + 1))
    for i in np.unique(doc):
        out[i] = np.stack([a[edges[i] : edges[i + 1]], b[edges[i] : edges[i + 1]]], axis=1) - starts[i]
    return out


def kept_bytes(text: bytes, runs: np.ndarray) -> bytes:
    if not len(runs):
        return text
    at, out = 0, []
    for a, b in runs.tolist():
        out.append(text[at:a])
        at = b
    return b"".join(out) + text[at:]


def passages(docs: DataFrame, *, span: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans and kept_sha256 (of the exact remaining bytes)."""
    work = Workspace(docs.sparkSession, "passages")
    shield = Shield(docs)
    blocks, info = covered(shield.df, work, span=span, key=shield[key], text=shield[text])

    def judge(block, ids, lengths, data, blobs):
        at, found = np.concatenate([[0], np.cumsum(lengths)]), removed_runs(blobs, lengths, span)
        out = [[] for _ in range(5)]
        for i, doc in enumerate(ids.tolist()):
            kept = kept_bytes(data[at[i] : at[i + 1]].tobytes(), found[i])
            row = (None if doc == LAST else doc, int(lengths[i]), int(lengths[i]) - len(kept), len(found[i]), hashlib.sha256(kept).hexdigest())
            for column, value in zip(out, row, strict=True):
                column.append(value)
        yield out

    result = blocks.save(map_blocks(blocks.with_info(info), judge, f"{key} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), "judged")
    blocks.drop()
    work.drop("asked", "looked")
    return result


def dedup_passages(docs: DataFrame, *, span: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without the passages that a smaller id holds; those of which nothing is left go. Other columns stay.

    Every row, whatever its id, has the decisions on its own text: rows travel with their texts. Where a removed run
    cuts a character, its stray bytes go too. A null text stays null.
    """
    work = Workspace(docs.sparkSession, "passages")
    shield = Shield(docs)
    inner = shield[text]
    own = shield.df.withColumns({"corvane_key": F.col(shield[key]).cast("long"), "corvane_text": F.col(inner).cast("string")})
    null = F.col(inner).isNull().alias("corvane_null")
    carry = [c for c in shield.inner if c != inner]
    blocks, info = covered(own.select("corvane_key", "corvane_text", *carry, null), work, span=span, key="corvane_key", text="corvane_text", carry=[*carry, "corvane_null"])
    kinds = dict(own.dtypes)

    def judge(block, ids, lengths, data, blobs, others):
        at, found, rows = np.concatenate([[0], np.cumsum(lengths)]), removed_runs(blobs, lengths, span), carried(others).combine_chunks()
        texts, stays = [], []
        for i, null in enumerate(rows.column("corvane_null").to_pylist()):
            kept = kept_bytes(data[at[i] : at[i + 1]].tobytes(), found[i]).decode("utf-8", "ignore" if len(found[i]) else "strict")
            texts.append(None if null else kept)
            stays.append(not len(found[i]) or bool(kept.strip()))
        rows = rows.drop_columns(["corvane_null"]).append_column(inner, pa.array(texts, pa.string())).filter(pa.array(stays, pa.bool_()))
        yield from rows.to_batches()

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", " * bool(carry) + f"`{inner}` string"
    result = blocks.save(map_blocks(blocks.with_info(info), judge, schema, others=True), "judged")
    blocks.drop()
    work.drop("asked", "looked")
    return shield.back(result)


def op5_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return passages(read(spark, sf_dir, "documents"), span=50)
