"""URL filters, chat formatting, sharding, decontamination and the quality classifier on small and odd tables."""

import hashlib
import re
import zlib

import numpy as np
from corvane.llm import chat_format, decontaminate, quality, sharding, url_filter
from corvane.llm.work import literal_table
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rules(spark):
    return literal_table(spark, url_filter.RULES, "rule_host string, rule_path string, verdict string")


def test_urls(spark):
    urls = [
        None, "", "no scheme", "://", "http://", "HTTP://A.Example.COM/en/7198#top", "https://example.com/en/6", "https://xexample.com/en/7", "http://x.example.net/de/81?q", "http://net/de/", "http://net", "http://org?/es/",
        "http://a.org/es/http://b.com/en/", "http://com/en", "http://..com/en/7", "x://e\nx.org/es/\n?a", "http://" + "a." * 3000 + "com/en/" + "p" * 9000, "https://adult.org/ES/",
    ]
    rows = [(i, u, "clash", "clash") for i, u in enumerate(urls)] + [(5, urls[5], "x", "x"), (None, urls[5], "x", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0] if u else ""
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [r for r in url_filter.RULES if (host == r["rule_host"] or host.endswith("." + r["rule_host"])) and path.startswith(r["rule_path"])]
        best = max(fit, key=lambda r: len(r["rule_host"] + r["rule_path"]), default=None)
        return host, path, best and best["rule_host"] + best["rule_path"], best["verdict"] if best else "allow"

    expected = sorted(((i, *judge(u)) for i, u, *_ in rows), key=repr)
    for bound in (20_000, 0):  # broadcast and shuffled
        assert sorted(map(tuple, url_filter.judge_urls(pages, rules(spark), broadcast_rules=bound).collect()), key=repr) == expected
    assert url_filter.judge_urls(pages.limit(0), rules(spark)).collect() == []
    assert {r.verdict for r in url_filter.judge_urls(pages, rules(spark).limit(0)).collect()} == {"allow"}


def test_chats(spark):
    said = ["", None, "plain", r"\### Assistant: </turn> ok", "</turn>\n", "### user:\nx</turn>\n", "<", "#", "\\", "\\b", "\\h\\l\\c", "</turn", ">\n", "a</turn>", "####", "ends with \\", "\n", ":\n", "é日本\U0001f600", "x" * 20000]
    rows = [(c, t, role, s, "x") for c in (1, None) for t, s in enumerate(said) for role in ("user", "assistant", "odd:\n### role", None)] + [(2, 0, "user", "same", "x")] * 2 + [(2, None, "assistant", "first", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    chats = chat_format.format_chats(df)
    low = lambda x: (x is not None, x or 0)
    for c in (1, 2, None):
        turns = sorted(((t, r or "", s or "") for i, t, r, s, _ in rows if i == c), key=lambda x: (low(x[0]), x[1].encode(), x[2].encode()))
        r = chats.where(F.col("conv_id").eqNullSafe(F.lit(c))).first()
        assert [(x.role, x.text) for x in r.recovered] == [t[1:] for t in turns]
        assert r.formatted.count("</turn>\n") == len(turns)
        back = []
        for m in r.mask:
            x = r.formatted.encode()[m.start : m.start + m.length].decode()
            for code, raw in (("\\c", ":"), ("\\h", "#"), ("\\l", "<"), ("\\b", "\\")):
                x = x.replace(code, raw)
            back.append(x)
        assert back == [t[2] for t in turns if t[1] == "assistant"]
        assert chats.where(F.col("conv_id").eqNullSafe(F.lit(c))).select(chat_format.masked_text(F.col("formatted"), F.col("mask"))).first()[0] == "".join(back)
    assert chat_format.format_chats(df.limit(0)).collect() == []


def test_shards(spark):
    for n in (1, 2, 3, 7, 100, 1000):
        places = sharding.permute(np.arange(n), n, 5)
        assert sorted(places.tolist()) == list(range(n)) and (sharding.row_at(places, n, 5) == np.arange(n)).all()
    rows = [(i * 7 % 301, "t%d" % (i % 3)) for i in range(300)] + [(None, None), (5, None), (5, None), (6, ""), (7, "é" * 10000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    once, again = ({tuple(r) for r in sharding.shard_rows(x, 16, order=["doc_id", "text"]).collect()} for x in (df, df.repartition(2)))
    assert once == again and len(once) == len(rows)
    by = {}
    for r in once:
        by.setdefault(r[-2], []).append(r[-1])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard_rows(df.limit(0), 16, order=["doc_id"]).collect() == []


def feistel(x, n, seed):
    """The permutation in plain integers."""
    word = 2**64
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % word
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % word
        return x ^ (x >> 31)

    while True:
        left, right = x >> half, x & ((1 << half) - 1)
        for r in range(6):
            left, right = right, left ^ (mixed((right + seed * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % word) & ((1 << half) - 1))
        x = left << half | right
        if x < n:
            return x


def test_shard_query(spark):
    rows = sharding.op6_sharding(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    order = sorted(rows, key=lambda r: (r.doc_id, r.text_crc32))
    for number, r in enumerate(order):
        place = feistel(number, len(rows), 20_240_501)
        assert (r.row_number, r.shard, r.slot) == (number, place % 16, place // 16)
    assert len(rows) == len(texts) and all((r["size"], r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "rows", None) for r in rows)


def benchmark_brute(docs, items, n):
    words = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    found = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for item, u in items:
            x = words(u)
            m = min(n, len(x))
            for k in range(len(x) - m + 1) if x else ():
                for s in range(len(w) - m + 1):
                    if w[s : s + m] == x[k : k + m]:
                        hit.update(range(s, s + m))
                        names.add("" if item is None else str(item))
        found.append((i, len(w), len(hit), sorted(names)))
    return sorted(found, key=repr)


def test_decontamination(spark):
    item = "One two, THREE four-five six é seven eight nine ten eleven"
    items = [(1, item), (2, item), (3, "short one"), (4, None), (5, "!!"), (None, "null id item here"), (10, "Zwölf Ä"), (6, "one")]
    docs = [(1, "xx " + item + " yy"), (2, item.replace("five", "fife")), (3, None), (4, ""), (5, "a short one, and SHORT\nONE"), (6, "zwölf ä! zwölf Ä"), (7, "w " * 30000 + "null id item here"), (None, "short one"), (5, "a short one, and SHORT\nONE")]
    d = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, items string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    for size in (16_000_000, 60):  # one pass, and several
        out = decontaminate.scan(d, b, n=10, keep=["doc_id"], chunk_bytes=size).collect()
        got = sorted(((r.doc_id, r.n_words, sum(e - s for s, e in zip(r.hit_starts, r.hit_ends)), list(r.hit_items)) for r in out), key=repr)
        assert got == benchmark_brute(docs, items, 10)
    assert decontaminate.scan(d.limit(0), b, keep=["doc_id"]).collect() == []
    assert all(not r.hit_items for r in decontaminate.scan(d, b.limit(0), keep=["doc_id"]).collect())
    clean = {r.doc_id: r.text for r in decontaminate.decontaminate(d.where("doc_id < 4"), b.where("item_id IN (1, 2)"), drop_share=1.0).collect()}
    assert clean == {1: "xx  yy", 2: docs[1][1], 3: None}
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_decontamination_with_columns_of_any_name(spark):
    item = "One two THREE four five six seven eight nine ten eleven"
    d = spark.createDataFrame([(1, "xx " + item + " yy zz vv ww", 7, 8, 9), (2, "clean", 1, 2, 3)], "doc_id long, text string, n_words long, Hit_Items long, corvane_x long")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = decontaminate.decontaminate(d, b, drop_share=0.9)
    assert out.columns == d.columns and sorted(map(tuple, out.collect())) == [(1, "xx  yy zz vv ww", 7, 8, 9), (2, "clean", 1, 2, 3)]
    assert {(r.doc_id, r.n_words) for r in decontaminate.scan(d, b, keep=["doc_id", "n_words"]).collect()} == {(1, 16), (2, 1)}


def test_chunks_hold_their_bound(spark):
    words = " ".join("w%d" % k for k in range(30_000))
    b = spark.createDataFrame([(i, "the same item in many copies of it and so on") for i in range(300)] + [(1000, words)], "item_id long, text string")
    pieces = decontaminate.pieces_of(b, 10, "item_id", "text").cache()
    dealt, parts = decontaminate.chunked(pieces, 80_000)
    sizes = {r.chunk: r.s for r in dealt.groupBy("chunk").agg(F.sum(F.octet_length("item") + F.octet_length("piece")).alias("s")).collect()}
    assert parts > 1 and max(sizes.values()) <= 80_000
    d = spark.createDataFrame([(1, words), (2, "here: the same item in many copies of it and so on"), (3, " ".join(words.split()[9_990:10_030]))], "doc_id long, text string")
    out = {r.doc_id: (sum(e - s for s, e in zip(r.hit_starts, r.hit_ends)), len(r.hit_items)) for r in decontaminate.scan(d, b, keep=["doc_id"], chunk_bytes=80_000).collect()}
    assert out == {1: (30_000, 1), 2: (11, 300), 3: (40, 1)}


def test_quality_query_against_brute_force(spark):
    """Evidence by the same model in one process; rates, strengths and posteriors from plain sums."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows, model = docs.collect(), quality.train(docs, labels)
    p = model([(r.text or "").encode() for r in rows])
    evidence = {r.doc_id: 1 - (1 - a) * (1 - b) for r, (a, b) in zip(rows, p.tolist())}
    sites, hosts = {}, {}
    for r in rows:
        sites.setdefault((r.source, r.lang), []).append(evidence[r.doc_id])
        hosts.setdefault(r.source, []).append(evidence[r.doc_id])
    n, mean = len(rows), sum(evidence.values()) / len(rows)
    within = sum(sum((x - sum(v) / len(v)) ** 2 for x in v) for v in sites.values()) / (n - len(sites))
    of = lambda v: sum(v) / len(v)
    spread2 = sum(len(v) * (of(v) - of(hosts[h])) ** 2 for (h, _), v in sites.items()) - (len(sites) - len(hosts)) * within
    between2 = spread2 / (n - sum(len(v) ** 2 / len(hosts[h]) for (h, _), v in sites.items()))
    between1 = (sum(len(v) * (of(v) - mean) ** 2 for v in hosts.values()) - (len(hosts) - 1) * within) / (n - sum(len(v) ** 2 for v in hosts.values()) / n)
    k1, k2 = (max(1.0, min(within / b, 1e12)) if b > 0 else 1e12 for b in (between1, between2))
    logit = lambda x: np.log(min(max(x, 1e-9), 1 - 1e-9) / (1 - min(max(x, 1e-9), 1 - 1e-9)))
    got = {r.doc_id: r for r in quality.op10_quality_classifier(spark, sf).collect()}
    assert len(got) == n
    for r in rows:
        e, h, s = evidence[r.doc_id], hosts[r.source], sites[r.source, r.lang]
        host = (sum(h) - e + k1 * mean) / (len(h) - 1 + k1)
        path = (sum(s) - e + k2 * host) / (len(s) - 1 + k2)
        posterior = 1 / (1 + np.exp(-(logit(e) + logit(path) - logit(mean))))
        g = got[r.doc_id]
        assert np.allclose([g.evidence, g.host_rate, g.path_rate, g.posterior], [e, host, path, posterior], atol=1e-6) and g.kept == (g.posterior < 0.5)


def test_sites_that_differ_count(spark):
    r = np.random.default_rng(2)
    rows = [(i, "s%d" % (i % 4), "p%d" % (i % 8), float(min(max(r.normal(0.2 + 0.6 * (i % 4 == 1), 0.1), 0.0), 1.0))) for i in range(800)]
    scored = spark.createDataFrame(rows, "id long, host string, path string, corvane_evidence double")
    sites = quality.site_rates(scored, quality.Workspace(spark, "test"), "host", "path")
    w = sites.first()
    assert w.corvane_host_weight < 2 and w.corvane_path_weight > 100
    assert quality.with_posterior(scored, sites, host="host", path="path").count() == 800


def test_quality_on_held_out_labels(spark):
    """Models see other labels than those they are held against."""
    d = "/root/testdata/sf0.1"
    labels, docs = spark.read.parquet(f"{d}/labels.parquet"), spark.read.parquet(f"{d}/documents.parquet")
    seen = labels.where("pmod(xxhash64(doc_id), 2) = 0")
    out = quality.judge(docs, seen, keep=["doc_id"]).join(labels.where("pmod(xxhash64(doc_id), 2) = 1"), "doc_id")
    counts = {(r.quality, r.toxic): (r.n, r.rejected) for r in out.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.sum((F.col("corvane_posterior") >= 0.5).cast("int")).alias("rejected")).collect()}
    clean, toxic, junk = counts[1, 0], counts[1, 1], counts[0, 0]
    assert clean[1] <= 0.01 * clean[0] and toxic[1] >= 0.95 * toxic[0] and junk[1] >= 0.97 * junk[0]


def test_quality_of_odd_tables(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a " * 50000, "en", "s", 1), (3, "a " * 50000, "en", "s", 1), (None, "Calm words here.", "de", None, 3), (4, "éà " * 40, "fr", "t", 9)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (99, 0, 1), (3, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        out = quality.judge(df, lab, keep=["doc_id"]).collect()
        assert len(out) == len(rows) and all(0 <= r.corvane_posterior <= 1 for r in out)
    assert quality.judge(df.limit(0), labels).collect() == []
    clash = df.withColumns({"corvane_evidence": F.lit(5), "K": F.lit(6), "corvane_column_0": F.lit(7)})
    assert quality.keep_good(clash, labels).columns == clash.columns and {r.corvane_evidence for r in quality.keep_good(clash, labels).collect()} == {5}
    assert len(quality.judge(clash, labels).collect()) == len(rows)
    assert quality.keep_good(df, labels.limit(0)).columns == df.columns
