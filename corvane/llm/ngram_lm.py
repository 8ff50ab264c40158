"""Scores of texts under an interpolated modified Kneser-Ney model, of bigrams or trigrams, that is counted in Spark.

Tokens are the ASCII-lower-cased words of a text, then one end token; begin symbols stand before the first.

    P3(w|uv) = (max(c(uvw) - D3, 0) + G3(uv) P2(w|v)) / c(uv)
    P2(w|v)  = (max(n(vw) - D2, 0) + G2(v) P1(w)) / n(v.)
    P1(w)    = (max(N1+(.w) - D1, 0) + G1 / (V + 1)) / N1+(..)

c counts in training texts, N1+(.x) is the number of distinct tokens before x there, and n is N1+(.vw) below P3, but c
where bigrams are the highest ``order``. Each D depends on the count it is taken from (1, 2, 3 or more) and comes from the
counts of counts of its level, and each G gives back what the D of its context took. A context that was never seen leaves
the lower level alone.

Texts are tokenised once, into blocks of word hashes and token numbers (see ``blocks``). The model is kept as sorted
arrays of 64-bit hashes, one shard for each range of hashes. A block sends a shard its distinct n-grams, sorted, once,
with their counts in the block; the shard merges what all blocks sent into its array and answers each block in the order
of its own question, so no key comes back. Exchanges build and ask the model: counts of bigrams, then words; for
trigrams, counts of trigrams and continuations and followers of bigrams stand between the two. What one block alone
holds - most of what is rare - needs no exchange beyond the first: a trigram is sent only if other blocks hold its
context too, and a bigram's continuations only if it occurs twice at least, since one occurrence has one continuation.

A worker holds a block, or one shard, at a time. The shards are merged with sorted questions rather than mapped whole
into every worker: the arrays grow with the corpus (see the README). How many shards there are follows from the size of
the corpus. Any part of it that repeats an n-gram, however often, sends it once per block.

Defined cases: a null or empty text is the end token alone; a text is never split, and a very long one is a block of its
own, at about 100 bytes of memory a byte; a null id is training data; repeated rows count and are scored each; without
training rows every probability is the uniform one; an empty table gives no rows; extra columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.blocks import LAST, Blocks, map_blocks, reduce_parts
from corvane.llm.work import Shield, Workspace, mix64, read

BLOCK_BYTES = 12_000_000
#: Bytes of text a shard, about.
SHARD_BYTES = 24_000_000
END, BEGIN = mix64(np.array([1, 2], np.uint64))
C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BIGRAM, TRIGRAM, CONTEXT, WORD = range(4)  # the exchanges
COLUMNS = {BIGRAM: 1, TRIGRAM: 1, CONTEXT: 4, WORD: 6}


def held_out(ids: np.ndarray, of: int, fold: int) -> np.ndarray:
    return np.array([i != LAST and zlib.crc32(str(i).encode()) % of == fold for i in ids.tolist()], bool)


def tokenised(lengths: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Tokens per text, and: the number of distinct words, their hashes in order, each token's place among them. Both
    symbols are always among the words."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    texts = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    ends, coded = np.asarray(lists.offsets).astype(np.int64), lists.values.dictionary_encode()
    words, index = coded.dictionary.cast(pa.large_binary()).to_pylist(), np.asarray(coded.indices).astype(np.int64)
    real = np.array([len(w) > 0 for w in words], bool)[index] if len(words) else np.zeros(0, bool)
    kept = np.concatenate([[0], np.cumsum(real)])
    counts = np.diff(kept[ends]) + 1
    found = np.array([END, BEGIN, *map(xxhash.xxh3_64_intdigest, words)], np.uint64)
    hashes, place = np.unique(found, return_inverse=True)
    token = np.full(int(counts.sum()), place[0], np.int32)
    inner = np.ones(len(token), bool)
    inner[np.cumsum(counts) - 1] = False
    token[inner] = place[index[real] + 2]
    return counts, len(hashes).to_bytes(8, "little") + hashes.tobytes() + token.tobytes()


def sorted_by(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of 64-bit numbers, and the numbers in it.

    Numbers are sorted with their places in the low bits, which is several times as fast as sorting places by them. The
    few that agree in all upper bits are put right afterwards.
    """
    if not len(h):
        return np.zeros(0, np.int64), h
    least = h.min()
    low = np.uint64((1 << len(h).bit_length()) - 1)
    packed = (h - least) << np.uint64(64 - max(1, int(h.max() - least).bit_length()))
    packed &= ~low
    packed |= np.arange(len(h), dtype=np.uint64)
    packed.sort()
    order = (packed & low).astype(np.int64)
    out = h[order]
    wrong = np.flatnonzero(out[1:] < out[:-1])
    if len(wrong) > 1000:
        order = np.argsort(h, kind="stable")
        return order, h[order]
    for at in wrong.tolist():
        a, b = np.searchsorted(packed, [packed[at] & ~low, packed[at] | low]).tolist()
        b += b < len(packed) and packed[b] == packed[at] | low
        order[a:b] = order[a:b][np.lexsort((order[a:b], h[order[a:b]]))]
        out[a:b] = h[order[a:b]]
    return order, out


def ranked(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and the place of each entry among them."""
    order, h = sorted_by(h)
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    place = np.empty(len(h), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return h[new], place


class Grams:
    """Words, bigrams and trigrams of a block, each kind in order of its hashes, and where each token's are among them.

    One more bigram than the texts have, (BEGIN, BEGIN), is the context of first tokens; it is no gram of its own. For an
    ``order`` of 2 there are no trigrams.
    """

    def __init__(self, counts: np.ndarray, payload: np.ndarray, train: np.ndarray, order: int):
        n = int(payload[:8].view(np.uint64)[0])
        self.words = payload[8 : 8 + 8 * n].view(np.uint64)
        self.token = payload[8 + 8 * n :].view(np.int32)
        self.n_tokens, self.starts = counts, np.cumsum(counts) - counts
        begin = np.int32(np.searchsorted(self.words, BEGIN))
        before = np.empty_like(self.token)
        before[1:], before[self.starts] = self.token[:-1], begin
        self.trained = np.repeat(train, counts)
        with np.errstate(over="ignore"):
            left, right = self.words * C1, mix64(self.words) * C2
            self.bigrams, at = ranked(mix64(np.append(left[before] + right[self.token], left[begin] + right[begin])))
            self.bigram, self.start = at[:-1], int(at[-1])
            self.v, self.w = np.full((2, len(self.bigrams)), begin, np.int32)
            self.v[self.bigram], self.w[self.bigram] = before, self.token
            self.word_count = self._counts(self.token, len(self.words))
            self.bigram_count = self._counts(self.bigram, len(self.bigrams))
            self.bigram_count[self.start] = int(train.sum())
            if order == 2:
                return
            self.context = np.empty_like(self.bigram)
            self.context[1:], self.context[self.starts] = self.bigram[:-1], self.start
            left, right = self.bigrams * C2, mix64(self.words + C1)
            self.trigrams, self.trigram = ranked(mix64(left[self.context] + right[self.token]))
            self.head, self.tail = np.empty((2, len(self.trigrams)), np.int32)  # its first and last two tokens
            self.head[self.trigram], self.tail[self.trigram] = self.context, self.bigram
        self.trigram_count = self._counts(self.trigram, len(self.trigrams))

    def _counts(self, place: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(place[self.trained], minlength=n).astype(np.int64)


class Model:
    """What a block knows after the exchanges told it so far."""

    def __init__(self, g: Grams, blobs: list[bytes], order: int):
        self.g, self.blobs, self.order = g, blobs, order
        told = self.told(BIGRAM)[:, 0]
        # Of each bigram: its count in all blocks, whether this block is the one that speaks for it, whether others hold it.
        self.count, self.own, self.shared = told >> 2, (told & 2 > 0) & (told > 3), told & 1 > 0
        self.own[g.start] = False
        if order == 2:
            return
        known = self.count[g.head] > 0
        self.asked3 = np.flatnonzero(known & self.shared[g.head])
        self.asked2 = np.flatnonzero(self.shared & (self.count > 1))

    def told(self, kind: int) -> np.ndarray:
        """The answers of all shards in the order the block asked."""
        mine = sorted((int.from_bytes(b[1:9], "little"), b) for b in self.blobs if b[0] == kind)
        return np.concatenate([decode_values(b[9:], COLUMNS[kind]) for _, b in mine]) if mine else np.zeros((0, COLUMNS[kind]), np.int64)

    @functools.cached_property
    def trigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Counts of trigrams in all blocks, and which this block speaks for."""
        g = self.g
        count = g.trigram_count.copy()
        count[self.count[g.head] == 0] = 0
        own = count > 0
        told = self.told(TRIGRAM)[:, 0]
        count[self.asked3], own[self.asked3] = told >> 1, (told & 1 > 0) & (told > 1)
        return count, own

    def continuations(self) -> np.ndarray:
        """Of each bigram by this block's trigrams: distinct tokens before it, followers seen once, twice, more often."""
        g = self.g
        count, own = self.trigrams
        n = len(g.bigrams)
        return np.stack([np.bincount(g.tail[own], minlength=n), *(np.bincount(g.head[own & pick], minlength=n) for pick in (count == 1, count == 2, count > 2))], axis=1)

    def contexts(self) -> np.ndarray:
        """The same by all trigrams; the bare counts, where bigrams are the highest order."""
        if self.order == 2:
            return self.count[:, None]
        out = self.continuations()
        once = self.shared & (self.count == 1)
        out[once] = (1, 1, 0, 0)  # nothing follows the end token, and nothing asks what does
        out[self.asked2] = self.told(CONTEXT)
        return out


def shards(h: np.ndarray, parts: int) -> np.ndarray:
    """Where each shard's range starts among sorted hashes, and the end."""
    return np.searchsorted(h, np.array([(p << 64) // parts for p in range(1, parts)], np.uint64))


def encode_keys(h: np.ndarray) -> bytes:
    """Sorted 64-bit numbers: the first, and 6-byte steps where they fit."""
    steps = np.diff(h)
    if len(steps) and steps.max() >= 2**48:
        return b"\0" + h.tobytes()
    return b"\1" + h[:1].tobytes() + (steps & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (steps >> np.uint64(32)).astype(np.uint16).tobytes()


def decode_keys(blob: bytes) -> np.ndarray:
    if not blob[0]:
        return np.frombuffer(blob, np.uint64, offset=1)
    n = (len(blob) - 9) // 6
    low, high = np.frombuffer(blob, np.uint32, n, 9), np.frombuffer(blob, np.uint16, n, 9 + 4 * n)
    steps = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
    return np.cumsum(np.concatenate([np.frombuffer(blob, np.uint64, 1, 1), steps]), dtype=np.uint64)


def encode_values(v: np.ndarray) -> bytes:
    """Columns of counts, in as few bytes each as the largest takes; in one each where few are larger, which follow."""
    flat = np.ascontiguousarray(v.T).ravel()
    large = flat >= 255
    if large.any() and 8 * int(large.sum()) < len(flat):
        return b"\0" + len(flat).to_bytes(8, "little") + np.where(large, 255, flat).astype(np.uint8).tobytes() + flat[large].astype(np.int64).tobytes()
    size = next(k for k in (1, 2, 4, 8) if not v.size or int(v.max()) < 1 << (8 * k - (k == 8)))
    return bytes([size]) + flat.astype(f"<u{size}").tobytes()


def decode_values(blob: bytes, columns: int) -> np.ndarray:
    if blob[0]:
        return np.frombuffer(blob, f"<u{blob[0]}", offset=1).reshape(columns, -1).T.astype(np.int64)
    n = int.from_bytes(blob[1:9], "little")
    flat = np.frombuffer(blob, np.uint8, n, 9).astype(np.int64)
    flat[flat == 255] = np.frombuffer(blob, np.int64, offset=9 + n)
    return flat.reshape(columns, -1).T


def ask(block: int, h: np.ndarray, values: np.ndarray, parts: int):
    """Rows (part, block, keys, values) to the shards, of sorted hashes and a row of values for each."""
    out, edges = [[], [], [], []], [0, *shards(h, parts).tolist(), len(h)]
    for p in range(parts):
        a, b = edges[p], edges[p + 1]
        if a < b:
            for column, x in zip(out, (p, block, encode_keys(h[a:b]), encode_values(values[a:b])), strict=True):
                column.append(x)
    return out


def merge(rows, columns: int):
    """A shard: the sums of its keys' values, each question's places among the keys, where a key is asked for first, how
    many blocks ask for each, and where each block's questions start."""
    keys, values = [decode_keys(r[2]) for r in rows], [decode_values(r[3], columns) for r in rows]
    edges = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    key, value = np.concatenate(keys), np.concatenate(values)
    order, key = sorted_by(key)  # blocks stay in order
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    place, first = np.empty(len(key), np.int64), np.zeros(len(key), bool)
    place[order] = np.cumsum(new) - 1
    first[order[new]] = True
    sums = np.stack([np.add.reduceat(value[order, c], np.flatnonzero(new)) for c in range(columns)], axis=1)
    return sums, place, first, np.bincount(place), edges


def answers(rows, kind: int, values: np.ndarray, edges: np.ndarray):
    out = [[], []]
    for i, r in enumerate(rows):
        out[0].append(r[1])
        out[1].append(bytes([kind]) + int(r[0]).to_bytes(8, "little") + encode_values(values[edges[i] : edges[i + 1]]))
    return out


def by_block(rows):
    return sorted(rows, key=lambda r: r[1])


def discounts(n: list[int]) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more, from the numbers of things counted once to four times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))])


def times(values: np.ndarray) -> list[int]:
    """How many are 1, 2, 3 and 4."""
    return [int((values == k).sum()) for k in (1, 2, 3, 4)]


def score_texts(docs: DataFrame, *, order: int = 3, of: int = 5, fold: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score. ``order``: 2 or 3."""
    if order not in (2, 3):
        raise ValueError(f"order must be 2 or 3, not {order}")
    shield = Shield(docs)
    work = Workspace(docs.sparkSession, "ngrams")
    blocks = Blocks(shield.df, work, key=shield[key], text=shield[text], block_bytes=BLOCK_BYTES, encode=tokenised)
    parts = blocks.parts_of(SHARD_BYTES)
    sent = "part int, block long, keys binary, values binary"
    said = "block long, blob binary"

    def grams(ids, counts, payload) -> Grams:
        return Grams(counts, payload, ~held_out(ids, of, fold), order)

    def ask_bigrams(block, ids, counts, payload, _):
        g = Grams(counts, payload, ~held_out(ids, of, fold), 2)
        yield ask(block, g.bigrams, g.bigram_count[:, None], parts)

    def tell_bigrams(rows):
        rows = by_block(rows)
        sums, place, first, holders, edges = merge(rows, 1)
        yield answers(rows, BIGRAM, (sums[place, 0] * 4 + first * 2 + (holders[place] > 1))[:, None], edges)

    def ask_trigrams(block, ids, counts, payload, blobs):
        m = Model(grams(ids, counts, payload), blobs, order)
        yield ask(block, m.g.trigrams[m.asked3], m.g.trigram_count[m.asked3, None], parts)

    def tell_trigrams(rows):
        rows = by_block(rows)
        sums, place, first, _, edges = merge(rows, 1)
        yield answers(rows, TRIGRAM, (sums[place, 0] * 2 + first)[:, None], edges)

    def ask_contexts(block, ids, counts, payload, blobs):
        m = Model(grams(ids, counts, payload), blobs, order)
        count, own = m.trigrams
        out = ask(block, m.g.bigrams[m.asked2], m.continuations()[m.asked2], parts)
        yield [*out, *([0] * len(out[0]) for _ in range(4))]
        yield [[-1], [block], [b""], [b""], *([x] for x in times(count[own]))]

    def tell_contexts(rows):
        rows = by_block(rows)
        sums, place, _, _, edges = merge(rows, 4)
        yield answers(rows, CONTEXT, sums[place], edges)

    def ask_words(block, ids, counts, payload, blobs):
        m = Model(grams(ids, counts, payload), blobs, order)
        g, own, before = m.g, m.own, m.contexts()[:, 0]
        n = len(g.words)
        classes = [np.bincount(g.v[own & pick], minlength=n) for pick in (before == 1, before == 2, before > 2)]
        stats = [g.word_count, np.bincount(g.w[own], minlength=n), np.bincount(g.v[own], weights=before[own], minlength=n).astype(np.int64), *classes]
        out = ask(block, g.words, np.stack(stats, axis=1), parts)
        yield [*out, *([0] * len(out[0]) for _ in range(4))]
        yield [[-1], [block], [b""], [b""], *([x] for x in times(before[own]))]

    totals = ["tokens", "kinds", "links", "m1", "m2", "m3", "m4", "more"]

    def tell_words(rows):
        rows = by_block(rows)
        sums, place, _, _, edges = merge([r[:4] for r in rows], 6)
        known = sums[sums[:, 0] > 0]
        of_shard = [int(known[:, 0].sum()), len(known), int(known[:, 1].sum()), *times(known[:, 1]), int((known[:, 1] > 2).sum())]
        out = answers(rows, WORD, sums[place], edges)
        yield [*out, *([x] + [0] * (len(out[0]) - 1) for x in of_shard)]

    def summed(df, names) -> list[int]:
        return [int(x) for x in df.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in names)).first()]

    counted = ["n1", "n2", "n3", "n4"]
    more = sent + "".join(f", {c} long" for c in counted)

    def with_trigrams(bigrams):
        """What blocks are told of bigrams and trigrams, and the counts of counts of trigrams."""
        trigrams = work.save(reduce_parts(map_blocks(blocks.with_info(bigrams), ask_trigrams, sent), tell_trigrams, said, parts), "trigrams")
        info = bigrams.unionByName(trigrams)
        asked = blocks.save(map_blocks(blocks.with_info(info), ask_contexts, more), "asked")
        contexts = work.save(reduce_parts(asked.where("part >= 0").select("part", "block", "keys", "values"), tell_contexts, said, parts), "contexts")
        return info.unionByName(contexts), summed(asked, counted)

    bigrams = work.save(reduce_parts(map_blocks(blocks.rows(), ask_bigrams, sent), tell_bigrams, said, parts), "bigrams")
    info = bigrams
    n3 = [0, 0, 0, 0]
    if order == 3:
        info, n3 = with_trigrams(bigrams)
    asked = blocks.save(map_blocks(blocks.with_info(info), ask_words, more), "words")
    n2 = summed(asked, counted)
    words = work.save(reduce_parts(asked.where("part >= 0").select("part", "block", "keys", "values"), tell_words, said + "".join(f", {c} long" for c in totals), parts), "answers")
    t = dict(zip(totals, summed(words, totals), strict=True))
    d3, d2, d1 = discounts(n3), discounts(n2), discounts([t["m1"], t["m2"], t["m3"], t["m4"]])

    def score(block, ids, counts, payload, blobs):
        m, out = Model(grams(ids, counts, payload), blobs, order), held_out(ids, of, fold)
        g, stats, pairs = m.g, m.told(WORD), m.contexts()
        one = np.full(len(stats), 1.0 / (t["kinds"] + 1))
        if t["links"]:
            before = stats[:, 1]
            spare = d1[1] * t["m1"] + d1[2] * t["m2"] + d1[3] * t["more"]
            one = (before - d1[np.minimum(before, 3)] + spare * one) / t["links"]
        with np.errstate(divide="ignore", invalid="ignore"):
            v, before = g.v[g.bigram], pairs[g.bigram, 0]
            of_v = stats[v, 2].astype(float)
            p = np.where(of_v > 0, (before - d2[np.minimum(before, 3)] + (stats[v, 3:6] @ d2[1:]) * one[g.token]) / of_v, one[g.token])
            if order == 3:
                c, uses = m.trigrams[0][g.trigram], m.count[g.context].astype(float)
                p = np.where(uses > 0, (c - d3[np.minimum(c, 3)] + (pairs[g.context, 1:] @ d3[1:]) * p) / uses, p)
        base = np.log10((stats[:, 0] + 0.5) / (t["tokens"] + 0.5 * (t["kinds"] + 1)))
        total = lambda x: np.add.reduceat(x, g.starts) if len(g.starts) else x[:0]
        known = total((stats[:, 0] > 0)[g.token].astype(np.int64))
        yield [[None if i == LAST else i for i in ids.tolist()], out, g.n_tokens, known, np.full(len(ids), t["tokens"]), total(base[g.token]), total(np.log10(p))]

    schema = f"{key} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    result = blocks.save(map_blocks(blocks.with_info(info.unionByName(words.select("block", "blob"))), score, schema), "scores")
    blocks.drop()
    work.drop("bigrams", "trigrams", "asked", "contexts", "words", "answers")
    return result


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"))
