"""Quality classifier: document evidence, shrunk by empirical-Bayes posteriors of host and path.

Document classifier. Two logistic models on a bounded sample of labelled rows (at most ``sample`` rows, the smallest
by a hash of the id, one per sketch of five-word shingles so that copies don't vote twice). Junk is learnt from how
often each kind of word occurs - a word's kind is its pattern of upper and lower case, digits and signs, hashed to one
of ``KINDS`` numbers; which kinds are bad is for the labels to say - and from length and repetition. Toxic is learnt
from words and word beginnings that the sample's toxic documents hold far more often than the others. A document's
evidence is the probability that it is junk or toxic. Scoring reads every whole document once.

Hierarchy. Grouped aggregation sums evidence over all documents of each path (source and language here) and host
(source). A host's rate is its mean shrunk toward the corpus rate, a path's rate is its mean shrunk toward its host's,
both without the document itself. How strongly is estimated from the same sums: the pseudo-documents of a level are the
variance within paths over the variance between the level's means (Buehlmann and Straub), so a level whose sites differ
no more than chance has sites that count for nothing. The posterior adds the log-odds of the path's rate, relative to
the corpus rate, to those of the evidence; ``reject`` and above goes.

Group sums are partial before they are shuffled, so a source with a third of all rows is no load; sites are joined
back by Spark's own choice of join. The driver holds at most ``sample`` rows of about 1 KB and the lexicon: marks held
by at least one in a hundred of the sample's toxic documents, so at most a hundred times as many as such a document
has.

Defined cases: a null or word-free text has no words and is judged by its site and the model's intercept alone, and
kept unless that says otherwise; a very long text is one text like any other; a null source or language is a site of
its own; labels that are null, repeated or of unknown documents add nothing or their row; without labels of both kinds
a model says its corpus share; repeated rows are judged each; an empty table gives no rows; extra columns stay, in
``judge`` only where they don't have the name of a result.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.work import Shield, Workspace, lean, read, texts_of

KINDS = 256
BEGINNINGS = (4, 5, 6, 7, 8)
STEM = 4  # bytes; no beginning is shorter
EDGE = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")
#: Upper and lower case, digits, beyond ASCII; other signs stand for themselves.
CLASSES = bytes(ord("A") if chr(c).isupper() else ord("a") if chr(c).islower() else ord("0") if chr(c).isdigit() else c for c in range(128)) + b"u" * 128
RUN = re.compile(rb"(.)\1+", re.S)
KEPT_PATTERNS = 50_000  # of a worker's memo


class Kinds(dict):
    """Kind numbers of words whose characters were replaced by their classes, remembered: there are few such patterns."""

    def __missing__(self, pattern: bytes) -> int:
        if len(self) >= KEPT_PATTERNS:
            self.clear()
        value = self[pattern] = zlib.crc32(RUN.sub(rb"\1\1", pattern)) % KINDS
        return value


def shape(text: bytes, kinds: Kinds) -> np.ndarray:
    """Roots of the shares of word kinds, then repetition, variety and lengths."""
    words, patterns = text.split(), text.translate(CLASSES).split()
    n = len(words)
    some = max(n, 1)
    counts = np.bincount(np.fromiter(map(kinds.__getitem__, patterns), np.int64, n), minlength=KINDS)
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    more = (math.sqrt(repeated / some), len(set(words)) / min(some, 400), math.log1p(n), math.log1p(len(text) / some))
    return np.concatenate([np.sqrt(counts / some), more]).astype(np.float32)


def marks_of(word: bytes):
    """Hashes of a word and its beginnings, in whole characters."""
    yield xxhash.xxh3_64_intdigest(b"=" + word) >> 1
    text = word.decode("utf-8", "ignore")
    for k in BEGINNINGS:
        if len(text) > k:
            yield xxhash.xxh3_64_intdigest(b"^" + text[:k].encode()) >> 1


def stem_of(word: bytes) -> int:
    """The first bytes of a word, which all its marks share: most words need no more than a look at these."""
    return int.from_bytes(word[:STEM])


def word_set(text: bytes) -> set[bytes]:
    return set(EDGE.sub(b" ", text.lower()).split())


def marks_in(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct marks of a text, with their stems."""
    found = {m: stem_of(w) for w in word_set(text) for m in marks_of(w)}
    return np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))


def sketch(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    step = [b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))]
    return min(map(xxhash.xxh3_64_intdigest, step)) >> 1


class Logistic:
    """Ridge logistic regression by Newton steps on standardised columns."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.scale[self.scale < 1e-5] = 1.0  # a column that never varies says nothing
        z = np.hstack([np.ones((len(x), 1)), (x - self.mean) / self.scale])
        w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
        penalty[0] = 1e-3
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            hessian = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(hessian, z.T @ (y - p) - penalty * w)
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        self.w = w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.w[0] + (x - self.mean) / self.scale @ self.w[1:], -30, 30)))


class Share:
    """Stands for a model where the sample has one kind only."""

    def __init__(self, value: float):
        self.value = value

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def model(x, y):
    return Logistic(x, y) if 0 < y.sum() < len(y) else Share(float(y.mean()) if len(y) else 0.0)


class Evidence:
    """The document classifier. ``lexicon``: weight and log count by mark; ``stems``: of all its marks."""

    def __init__(self, lexicon: dict[int, tuple[float, float]], stems, junk, toxic):
        self.lexicon, self.junk, self.toxic = lexicon, junk, toxic
        self.stems, self.kinds = {int(x).to_bytes(STEM).lstrip(b"\0") for x in stems}, Kinds()

    def lexical(self, text: bytes) -> list[float]:
        """How many words are marks, and the sum and the best of their weights and log counts; a word has its best mark's."""
        stems, found = self.stems, []
        for word in [w for w in word_set(text) if w[:STEM] in stems] if stems else ():
            best = max((self.lexicon[m] for m in marks_of(word) if m in self.lexicon), default=None)
            if best:
                found.append(best)
        weights = sorted(w for w, _ in found)
        return [min(len(found), 4), min(sum(weights), 20.0), max(weights, default=0.0), max((n for _, n in found), default=0.0)]

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """(junk, toxic) probabilities of each text; word-free ones get the models' word on nothing."""
        shapes, lexical = np.zeros((len(texts), KINDS + 4), np.float32), np.zeros((len(texts), 4))
        for i, text in enumerate(texts):
            shapes[i], lexical[i] = shape(text, self.kinds), self.lexical(text)
        return np.stack([self.junk(shapes), self.toxic(lexical)], axis=1)


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", sample: int = 20_000, odds: float = 3.0) -> Evidence:
    """Fits on at most ``sample`` labelled rows."""
    work = Workspace(docs.sparkSession, "quality")
    chosen = labels.select(F.col("doc_id").alias("k"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).dropna().orderBy(F.xxhash64("k"), "k", "quality", "toxic").limit(sample)
    # At most `sample` narrow rows go out; texts of the sample are written once and read by the steps below.
    joined = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "k")

    def see(batches):
        kinds = Kinds()
        for batch in batches:
            texts = list(texts_of(batch.column("text")))
            shapes = [shape(t, kinds).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("toxic"), pa.array([sketch(t) for t in texts], pa.int64()), pa.array(shapes, pa.binary()), pa.array(texts, pa.binary())], ["quality", "toxic", "sketch", "shapes", "text"])

    seen = joined.mapInArrow(lean(see), "quality int, toxic int, sketch long, shapes binary, text binary").withColumn("row", F.monotonically_increasing_id())
    seen = work.save(seen, "seen")

    def one_of(*columns):
        """One row of each group; the row numbers that go out are bounded by the sample."""
        rows = seen.groupBy(*columns).agg(F.min("row").alias("row")).select("row")
        return seen.join(F.broadcast(rows), "row", "left_semi")

    one = one_of("sketch", "toxic")
    totals = {r.toxic: r.n for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    found = half = {}, set()
    if bad and good:
        # The whole sample's lexicon judges documents; that of every other sketch only tells the model what marks are worth
        # on texts that did not make them.
        names = ["mark", "stem", "bad", "good", "half_bad", "half_good"]

        def count(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                marks, stems = zip(*(marks_in(x.as_py()) for x in batch.column("text")), strict=True)
                toxic, side = batch.column("toxic").to_numpy(), batch.column("sketch").to_numpy() % 2 == 0
                sizes = [len(m) for m in marks]
                distinct, one, at = np.unique(np.concatenate(marks), return_index=True, return_inverse=True)
                sums = [np.bincount(at, weights=np.repeat(x.astype(float), sizes), minlength=len(distinct)).astype(np.int64) for x in (toxic == 1, toxic != 1, (toxic == 1) & side, (toxic != 1) & side)]
                yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(np.concatenate(stems)[one]), *map(pa.array, sums)], names)

        counts = one.select("toxic", "sketch", "text").mapInArrow(lean(count), ", ".join(f"{c} long" for c in names)).groupBy("mark").agg(F.min("stem").alias("stem"), *(F.sum(c).alias(c) for c in names[2:]))
        counts = work.save(counts.where("bad >= 4"), "marks")

        def listed(b: str, g: str, n_bad: float, n_good: float) -> tuple[dict[int, tuple[float, float]], set[int]]:
            weight = F.log((F.col(b) + 0.5) / (n_bad + 1)) - F.log((F.col(g) + 0.5) / (n_good + 1))
            likely = counts.where(F.col(b) >= max(4, n_bad // 100)).withColumn("weight", weight).where(F.col("weight") >= odds)
            rows = likely.select("mark", "stem", "weight", F.col(b).alias("n")).collect()
            return {r.mark: (r.weight, math.log(r.n)) for r in rows}, {r.stem for r in rows}

        found, half = listed("bad", "good", bad, good), listed("half_bad", "half_good", bad / 2, good / 2)
    trial = Evidence(*half, Share(0.0), Share(0.0))

    def reduce(batches):
        for batch in batches:
            lexical = [trial.lexical(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "quality", "toxic", "sketch", "shapes")), pa.array(lexical, pa.list_(pa.float64()))], ["row", "quality", "toxic", "sketch", "shapes", "lexical"])

    schema = "row long, quality int, toxic int, sketch long, shapes binary, lexical array<double>"
    rows = work.save(one_of("sketch", "quality", "toxic").select("row", "quality", "toxic", "sketch", "shapes", "text").mapInArrow(lean(reduce), schema), "reduced").orderBy("row").collect()  # at most `sample` rows
    work.drop("seen", "marks", "reduced")
    evidence = Evidence(*found, Share(0.0), Share(0.0))
    if rows:
        shapes = np.array([np.frombuffer(r.shapes, np.float32) for r in rows])
        apart = [r for r in rows if r.sketch % 2] or rows
        evidence = Evidence(*found, model(shapes, np.array([1.0 - r.quality for r in rows])), model(np.array([r.lexical for r in apart]), np.array([float(r.toxic) for r in apart])))
    return evidence


JUNK, TOXIC, BAD = "corvane_junk", "corvane_toxic", "corvane_evidence"
RESULTS = [JUNK, TOXIC, BAD, "corvane_host_rate", "corvane_path_rate", "corvane_posterior"]


def with_evidence(docs: DataFrame, evidence: Evidence, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all) with the probabilities of junk, toxic and either."""
    names, shared = keep or docs.columns, docs.sparkSession.sparkContext.broadcast(evidence)
    kinds = dict(docs.dtypes)

    def run(batches):
        judge = shared.value
        for batch in batches:
            p = judge(list(texts_of(batch.column(text).cast(pa.string()))))
            either = 1 - (1 - p[:, 0]) * (1 - p[:, 1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(x) for x in (p[:, 0], p[:, 1], either))], [*names, JUNK, TOXIC, BAD])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", {JUNK} double, {TOXIC} double, {BAD} double"
    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(lean(run), schema)


def logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(p / (1 - p))


#: Bounds of the pseudo-documents of a level: sites that differ by chance alone have the most.
LEAST, MOST = 1.0, 1e12


def site_rates(scored: DataFrame, work: Workspace, host: str, path: str) -> DataFrame:
    """A row per path: sums and counts of evidence of the path, its host and the corpus, and the two levels' strengths."""
    paths = work.save(scored.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count("*").alias("path_n"), F.sum(BAD).alias("path_bad"), F.sum(F.col(BAD) * F.col(BAD)).alias("path_sq")), "paths")
    sums = [F.sum(f"path_{x}").alias(f"host_{x}") for x in ("n", "bad")]
    hosts = paths.groupBy("host").agg(*sums, F.sum(F.col("path_n") * F.col("path_n")).alias("nn"), F.sum(F.col("path_bad") ** 2 / F.col("path_n")).alias("explained"), F.sum("path_sq").alias("host_sq"), F.count("*").alias("k"))
    n, bad = F.col("host_n"), F.col("host_bad")
    # One row, so this join moves one row to each task.
    total = hosts.agg(
        F.sum(n).alias("all_n"), F.sum(bad).alias("all_bad"), F.sum("host_sq").alias("sq"), F.sum("explained").alias("by_path"), F.sum(bad * bad / n).alias("by_host"),
        F.sum(F.col("nn") / n).alias("path_nn"), F.sum(n * n).alias("host_nn"), F.sum("k").alias("paths"), F.count("*").alias("hosts"),
    )
    within = F.greatest(F.col("sq") - F.col("by_path"), F.lit(0.0)) / F.greatest(F.col("all_n") - F.col("paths"), F.lit(1))
    between_paths = F.try_divide(F.col("by_path") - F.col("by_host") - (F.col("paths") - F.col("hosts")) * within, F.col("all_n") - F.col("path_nn"))
    overall = F.col("all_bad") ** 2 / F.col("all_n")
    between_hosts = F.try_divide(F.col("by_host") - overall - (F.col("hosts") - 1) * within, F.col("all_n") - F.col("host_nn") / F.col("all_n"))
    strength = lambda between: F.when(between > 0, F.greatest(F.least(within / between, F.lit(MOST)), F.lit(LEAST))).otherwise(MOST)
    corpus = total.select("all_n", "all_bad", strength(between_hosts).alias("host_weight"), strength(between_paths).alias("path_weight"))
    sites = paths.drop("path_sq").join(hosts.select(F.col("host").alias("host_of"), "host_n", "host_bad"), F.col("host").eqNullSafe(F.col("host_of"))).drop("host_of").crossJoin(F.broadcast(corpus))
    return sites.select(*(F.col(c).alias(f"corvane_{c}") for c in sites.columns))


def with_posterior(scored: DataFrame, sites: DataFrame, *, host: str, path: str) -> DataFrame:
    c = lambda x: F.col(f"corvane_{x}")
    joined = scored.join(sites, F.col(host).eqNullSafe(c("host")) & F.col(path).eqNullSafe(c("path")), "left")
    corpus = c("all_bad") / c("all_n")
    host_rate = (c("host_bad") - F.col(BAD) + c("host_weight") * corpus) / (c("host_n") - 1 + c("host_weight"))
    path_rate = (c("path_bad") - F.col(BAD) + c("path_weight") * host_rate) / (c("path_n") - 1 + c("path_weight"))
    posterior = 1 / (1 + F.exp(-(logit(F.col(BAD)) + logit(path_rate) - logit(corpus))))
    return joined.select(*scored.columns, host_rate.alias("corvane_host_rate"), path_rate.alias("corvane_path_rate"), posterior.alias("corvane_posterior"), c("host_weight"), c("path_weight"))


def _judged(docs: Shield, labels: DataFrame, *, key: str, text: str, host: str, path: str, keep: list[str], **training) -> DataFrame:
    """Inner ``keep`` columns with host, path and RESULTS. Each document is scored once; the scored rows are written."""
    work = Workspace(docs.df.sparkSession, "sites")
    host, path = docs[host], docs[path]
    evidence = train(docs.df, labels.withColumnRenamed(key, "doc_id"), key=docs[key], text=docs[text], **training)
    scored = work.save(with_evidence(docs.df, evidence, text=docs[text], keep=list(dict.fromkeys([*keep, host, path]))), "scored")
    return with_posterior(scored, site_rates(scored, work, host, path), host=host, path=path)


def judge(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", keep: list[str] | None = None, **training) -> DataFrame:
    """``keep`` columns (all), host and path with junk, toxic, evidence, host and path rates, posterior, and the two levels'
    strengths, under names with ``corvane_``."""
    shield, names = Shield(docs), list(dict.fromkeys([*(keep or docs.columns), host, path]))
    out = _judged(shield, labels, key=key, text=text, host=host, path=path, keep=[shield[c] for c in names], **training)
    results = [*RESULTS, "corvane_host_weight", "corvane_path_weight"]
    return out.select(*(F.col(shield[c]).alias(c) for c in names if c.lower() not in results), *results)


def keep_good(docs: DataFrame, labels: DataFrame, *, reject: float = 0.5, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", **training) -> DataFrame:
    """Documents whose posterior is under ``reject``; columns stay."""
    shield = Shield(docs)
    out = _judged(shield, labels, key=key, text=text, host=host, path=path, keep=shield.inner, **training)
    return shield.back(out.where(F.col("corvane_posterior") < reject))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    out = judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), keep=["doc_id"])
    c = lambda x: F.col(f"corvane_{x}").alias(x)
    return out.select("doc_id", "source", "lang", c("junk"), c("toxic"), c("evidence"), c("host_rate"), c("path_rate"), c("posterior"), (F.col("corvane_posterior") < 0.5).alias("kept"))
