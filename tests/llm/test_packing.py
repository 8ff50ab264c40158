import os
import random
import zlib

import numpy as np
import public_tokenizers
from corvane.llm.packing import TOKENIZER, best_fit, op2_best_fit_packing, pack_pieces, plan
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, piece string"


def check(rows, docs, limit):
    """Pieces of every document in full, ids as the tokenizer has them, sequences gapless and within the limit."""
    model, left = Tokenizer.from_file(public_tokenizers.path(TOKENIZER)), {}
    for i, t in docs:
        ids = model.encode(t or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), limit)):
            part = np.array(ids[at : at + limit], "<u4")
            left.setdefault((i, piece, at, len(part), zlib.crc32(part.tobytes())), []).append(1)
    for r in rows:
        left[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)].pop()
    assert not any(left.values())
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert all(n <= limit for n in at.values())
    return len(at), sum(at.values())


def test_pieces_of_odd_texts(spark):
    r = random.Random(1)
    words = ["the", "Thon.", "été", "it's", "<|endoftext|>", "áb", "日本語", "x" * 40, "THE!!", "3.14", " ", "\u001c", "İ", "ς", "ΑΣ", "naïve,", "co-op", "tab\tnl\nx", "tianer$$$", "ofthe.***", "a_b", "x_", "don't!", "it's$", "it'", "élan&&&", "ÉLAN!", "e\u0301!", "\u0149!", "\u01c5.", "\u02bcs", "кот!", "$", "x'$", "\xaa.", "ß?"]
    docs = [(i, r.choice((" ", "\n", "  ")).join(r.choice(words) for _ in range(r.randint(0, 200)))) for i in range(80)]
    docs += [(100, None), (101, ""), (None, "null id"), (102, docs[3][1]), (102, docs[3][1]), (103, "word " * 3000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], SCHEMA).repartition(3)
    check(pack_pieces(df, TOKENIZER, limit=64).collect(), docs, 64)
    assert pack_pieces(df.limit(0), TOKENIZER, limit=64).collect() == []


def test_plans_hold_the_histogram():
    r = np.random.default_rng(1)
    for lengths in (r.lognormal(6.3, 0.9, 50_000), r.lognormal(5.5, 0.5, 30_000), [5, 2048, 1], [], [1100] * 50):
        counts = np.bincount(np.clip(np.array(lengths), 1, 2048).astype(int), minlength=2049) if len(lengths) else np.zeros(2049, int)
        held = np.zeros(2049, int)
        patterns = plan(counts, 2048)
        for n, pattern in patterns:
            assert sum(a * b for a, b in pattern) <= 2048
            for a, b in pattern:
                held[a] += n * b
        assert (held == counts).all()
        assert sum(n for n, _ in patterns) <= sum(n for n, _ in best_fit(counts, 2048))


def test_query_packs_near_the_bound(spark):
    rows = op2_best_fit_packing(spark, "/root/testdata/sf0.01").collect()
    docs = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    used, tokens = check(rows, docs, 2048)
    assert used <= 1.02 * -(-tokens // 2048) and os.path.exists(public_tokenizers.path(TOKENIZER))
