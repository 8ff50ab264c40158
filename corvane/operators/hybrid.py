"""Fusion of lexical and semantic scores, explanations, reranking and full-text predicates."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import plain_terms, tokenize
from corvane.functions.vector import cosine_similarity


def boost_total(boosts: Column) -> Column:
    """Sum of weight * value over a map of name to struct(weight, value)."""
    return F.aggregate(F.map_values(boosts), F.lit(0.0), lambda s, x: s + x["weight"] * x["value"])


def hybrid_score(cosine: Column, bm25: Column, bm25_max: Column, weight: float, boosts: Column | None = None) -> Column:
    semantic = cosine if boosts is None else cosine + boost_total(boosts)
    if weight <= 0:
        return semantic
    lexical = F.when(bm25_max > 0, bm25 / bm25_max).otherwise(0.0)
    return (1 - weight) * semantic + weight * lexical


@F.pandas_udf(T.StringType())
def formula_text(weight: pd.Series, cosine: pd.Series, boosts: pd.Series, lexical: pd.Series, final: pd.Series) -> pd.Series:
    """The fused score spelt out, three digits a part."""
    short = lambda x: f"{x:g}"
    return pd.Series([f"(1-{short(w)})*({c:.3f}+{b:.3f})+{short(w)}*{x:.3f}={f:.3f}" for w, c, b, x, f in zip(weight, cosine, boosts, lexical, final, strict=True)], dtype=object)


def explanation(cosine: Column, bm25: Column, bm25_max: Column, weight: float, boosts: Column | None = None) -> Column:
    lexical = F.when(bm25_max > 0, bm25 / bm25_max).otherwise(0.0)
    parts = F.create_map().cast("map<string,double>") if boosts is None else F.transform_values(boosts, lambda _, x: x["weight"] * x["value"])
    return F.struct(cosine.alias("cosine"), lexical.alias("normalized_bm25"), parts.alias("boosts"), hybrid_score(cosine, bm25, bm25_max, weight, boosts).alias("final_score"))


def apply_rerankers(results: DataFrame, rerankers: dict, weights: dict[str, float] | None = None, *, key: str = "id", score: str = "final_score", ordinal: str | None = None, enabled: bool = True) -> DataFrame:
    """Adds weight * boost of each reranker (DataFrame -> DataFrame(key, boost)) to the score.

    ``ordinal`` is the input order and breaks ties. Disabled, nothing changes.
    """
    if not enabled or not rerankers:
        return results
    out, total = results, F.col(score)
    for i, (name, compute) in enumerate(rerankers.items()):
        boosts = compute(results).select(F.col(key), F.col("boost").alias(f"boost_{i}"))
        out = out.join(boosts, key, "left")
        total = total + float((weights or {}).get(name, 1.0)) * F.coalesce(F.col(f"boost_{i}"), F.lit(0.0))
    return out.select(*(total.alias(c) if c == score else F.col(c) for c in results.columns)).orderBy(F.desc(score), *([ordinal] if ordinal else [key]))


# Full text. Terms are those of `tokenize`; there is no stemming, and the rank is a weighted term frequency.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def weighted_terms(columns: dict[str, str]) -> Column:
    """array<struct<term, weight>> of several columns with weights A to D; null columns are empty."""
    parts = []
    for c, grade in columns.items():
        weight = F.lit(WEIGHTS[grade])
        parts.append(F.transform(tokenize(F.coalesce(F.col(c), F.lit(""))), lambda x: F.struct(x.alias("term"), weight.alias("weight"))))  # noqa: B023
    return F.concat(*parts)


def matches_all(terms: Column, query: Column) -> Column:
    """Every term of the query occurs; a query without terms matches nothing."""
    asked = F.array_distinct(tokenize(query))
    return (F.size(asked) > 0) & F.forall(asked, lambda t: F.array_contains(terms, t))


def websearch(terms: Column, query: str) -> Column:
    """Words (all), "quoted phrases" (neighbouring terms), OR, and - before what must not occur. Stop words ask nothing."""
    any_of, all_of = [], []

    def phrase(words: list[str]) -> Column:
        spaced = F.concat(F.lit(" "), F.array_join(terms, " "), F.lit(" "))
        return spaced.contains(" " + " ".join(words) + " ")

    for sign, quoted, word in re.findall(r'(-?)"([^"]*)"|(\S+)', query):
        if word.upper() == "OR":
            if all_of:
                any_of.append(all_of)
                all_of = []
            continue
        negative = sign == "-" or word.startswith("-")
        words = plain_terms(quoted or word)
        if not words:
            continue
        met = phrase(words)
        all_of.append(~met if negative else met)
    if all_of:
        any_of.append(all_of)
    out = F.lit(False)
    for group in any_of:
        part = F.lit(True)
        for x in group:
            part = part & x
        out = out | part
    return out


def text_rank(terms: Column, query: Column) -> Column:
    """Sum over the query's terms of their weighted occurrences, damped by 1 + ln."""
    asked = F.array_distinct(tokenize(query))

    def one(t: Column) -> Column:
        w = F.aggregate(F.filter(terms, lambda x: x["term"] == t), F.lit(0.0), lambda s, x: s + x["weight"])
        return F.when(w > 0, w / (1 + F.ln(1 + w))).otherwise(0.0)

    return F.aggregate(F.transform(asked, one), F.lit(0.0), lambda s, x: s + x)


def hybrid_rank(rows: DataFrame, query: Column, query_text: str, *, columns: dict[str, str], key: str = "id", vector: str = "embedding", weight: float = 0.3, where: Column | None = None, limit: int = 20, path: str | None = None) -> DataFrame:
    """Filter, similarity and rank, rank over the best rank of what passed, weighted sum, best first (ties by key).

    With a ``path`` the scores are written there, since they are read twice: for the best rank, and to be fused.
    """
    found = rows.where(F.col(vector).isNotNull())
    if where is not None:
        found = found.where(where)
    terms = weighted_terms(columns)
    if query_text.strip():
        found = found.where(matches_all(F.transform(terms, lambda x: x["term"]), F.lit(query_text)))
    scored = found.select(key, cosine_similarity(F.col(vector), query).alias("similarity"), text_rank(terms, F.lit(query_text)).alias("text_rank"))
    if path:
        scored.write.parquet(path)
        scored = rows.sparkSession.read.schema(scored.schema).parquet(path)
    best = scored.agg(F.greatest(F.coalesce(F.max("text_rank"), F.lit(0.0)), F.lit(1e-9)).alias("best"))
    fused = scored.crossJoin(F.broadcast(best)).withColumn("score", (1 - weight) * F.col("similarity") + weight * F.col("text_rank") / F.col("best"))
    return fused.drop("best").orderBy(F.desc("score"), key).limit(limit)
