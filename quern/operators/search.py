"""Full-text, vector and rank-fused search."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalars import distance, score
from quern.functions.text import words

K1, B, RRF_K = 1.2, 0.75, 60


def frequency(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == term))


def _once(df: DataFrame, key: str, c: Column) -> DataFrame:
    """key, x. Exploded, so that what filters on x use isn't computed anew for each use."""
    return df.select(key, F.explode(F.array(c)).alias("x"))


def frequencies(docs: DataFrame, key: str, tokens: str | Column, terms: Sequence[str]) -> DataFrame:
    """key, x: dl (tokens), tf (an array with a count for each term), of every document. Texts are tokenised once."""
    c = F.col(tokens) if isinstance(tokens, str) else tokens
    held = _once(docs, key, c).select(key, F.col("x").alias("t"))
    return _once(held, key, F.struct(F.size("t").alias("dl"), F.array(*[frequency(F.col("t"), t) for t in terms]).alias("tf")))


def corpus_statistics(tf: DataFrame, n_terms: int) -> dict:
    """n, avgdl and df (documents that hold each term): one row, for scoring."""
    row = tf.agg(F.count("*").alias("n"), F.avg("x.dl").alias("avgdl"), *[F.count_if(F.col("x.tf")[i] > 0).alias(f"df{i}") for i in range(n_terms)]).first()
    return {"n": row["n"], "avgdl": row["avgdl"] or 1.0, "df": [row[f"df{i}"] for i in range(n_terms)]}


def bm25_score(stats: dict, times: Sequence[int]) -> Column:
    """The score of x (see ``frequencies``); times: how often the query holds each term."""
    total = F.lit(0.0)
    for i, (df, k) in enumerate(zip(stats["df"], times, strict=True)):
        idf = F.log(F.lit((stats["n"] - df + 0.5) / (df + 0.5) + 1))
        f = F.col("x.tf")[i]
        total = total + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("x.dl") / stats["avgdl"])) * k
    return total


def bm25(docs: DataFrame, key: str, tokens: str | Column, terms: Sequence[str], min_score: float = 0.0, only=None) -> DataFrame:
    """key, score, terms (those found) of the documents that hold a term; a term given twice counts twice.

    One row of statistics goes to the driver; term frequencies are counted inside each row,
    so nothing is shuffled by document or term. only: the key of a single document to score.
    """
    unique = list(dict.fromkeys(terms))
    tf = frequencies(docs, key, tokens, unique)
    if not unique:
        return tf.filter("false").select(key, F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("terms"))
    stats = corpus_statistics(tf, len(unique))
    if only is not None:
        tf = frequencies(docs.filter(F.col(key) == only), key, tokens, unique)
    found = F.array_compact(F.array(*[F.when(F.col("x.tf")[i] > 0, t) for i, t in enumerate(unique)]))
    out = tf.filter(F.exists("x.tf", lambda f: f > 0)).select(key, bm25_score(stats, [list(terms).count(t) for t in unique]).alias("score"), found.alias("terms"))
    return out.filter(F.col("score") >= min_score)


def search(docs: DataFrame, key: str, fields: Mapping[str, float], query: Sequence[str], limit: int | None = 10, min_score: float = 0.0, tokenize: Callable[[Column], Column] = words) -> DataFrame:
    """key, score over several text columns with boosts, best first (ties by key); each field has its own statistics."""
    parts = None
    for c, boost in fields.items():
        s = bm25(docs, key, tokenize(F.col(c)), query).select(key, (F.col("score") * boost).alias("score"))
        parts = s if parts is None else parts.union(s)
    out = parts.groupBy(key).agg(F.sum("score").alias("score")) if len(fields) > 1 else parts
    out = out.filter(F.col("score") >= min_score)
    return out if limit is None else out.orderBy(F.desc("score"), key).limit(limit)


def combined(docs: DataFrame, key: str, fields: Sequence[str], query: Sequence[str], limit: int | None = 10, min_score: float = 0.0) -> DataFrame:
    """key, score, terms over the columns taken as one text."""
    out = bm25(docs, key, words(F.concat_ws(" ", *fields)), query, min_score)
    return out if limit is None else out.orderBy(F.desc("score"), key).limit(limit)


def search_page(scored: DataFrame, key: str, limit: int, after: tuple[float, object] | None = None) -> DataFrame:
    """The next rows by (score descending, key); after: score and key of the last row seen."""
    if after is not None:
        scored = scored.filter((F.col("score") < after[0]) | ((F.col("score") == after[0]) & (F.col(key) > after[1])))
    return scored.orderBy(F.desc("score"), key).limit(limit)


def hybrid(df: DataFrame, key: str, exact: Column | None = None, text: tuple[str, Sequence[str]] | None = None, vector: tuple[str, Sequence[float]] | None = None, k: int = 10, min_score: float = 0.0) -> DataFrame:
    """key, score: exact matches (all of rank 1), full text (its best 10) and vectors (the nearest k), fused by rank.

    The methods don't filter each other; min_score counts after fusion.
    """
    lists = []
    if text:
        lists.append(bm25(df, key, words(F.col(text[0])), text[1]).orderBy(F.desc("score"), key).limit(10).select(key, "score"))
    if vector:
        lists.append(nearest(df, key, vector[0], vector[1], k).select(key, "score"))
    parts = [_ranked(x, key) for x in lists]
    if exact is not None:
        parts.append(df.filter(exact).select(key, F.lit(1.0 / (RRF_K + 1)).alias("rr")))
    out = reduce(DataFrame.union, parts).groupBy(key).agg(F.sum("rr").alias("score"))
    return out.filter(F.col("score") >= min_score).orderBy(F.desc("score"), key).limit(k)


def fuse(df: DataFrame, key: str, binary: Sequence[Column] = (), scored: Sequence[DataFrame] = (), limit: int | None = None) -> DataFrame:
    """key, score of several predicates at once. scored: (key, score) each, short lists.

    All binary: the rows that meet all, score 1. All scored: sums of scores. Both kinds: fused by rank, binary matches of rank 1.
    """
    if binary and not scored:
        out = df.filter(reduce(lambda a, b: a & b, binary)).select(key, F.lit(1.0).alias("score"))
    elif scored and not binary:
        out = reduce(DataFrame.union, [s.select(key, "score") for s in scored]).groupBy(key).agg(F.sum("score").alias("score"))
    else:
        parts = [_ranked(s, key) for s in scored] + [df.filter(c).select(key, F.lit(1.0 / (RRF_K + 1)).alias("rr")) for c in binary]
        out = reduce(DataFrame.union, parts).groupBy(key).agg(F.sum("rr").alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), key).limit(limit)


def _ranked(best: DataFrame, key: str, weight: float = 1.0, k: int = RRF_K) -> DataFrame:
    """key, rr: the reciprocal rank of each row of a short list."""
    return best.select(key, (F.lit(float(weight)) / (k + F.row_number().over(Window.orderBy(F.desc("score"), key)))).alias("rr"))


def phrase(tokens: Column, terms: Sequence[str]) -> Column:
    """Whether the terms stand one after the other."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(f" {' '.join(terms)} ")


def prefix(tokens: Column, start: str) -> Column:
    return F.exists(tokens, lambda t: t.startswith(start))


def nearest(
    vectors: DataFrame, key: str, column: str, query: Sequence[float], k: int | None, metric: str = "cosine", min_score: float | None = None,
    condition: Column | None = None, post_filter: bool = False,
) -> DataFrame:
    """key, distance, score of the k nearest (all without k), exactly; ties by key.

    condition: only rows under it count; with post_filter it is tested on the 4 * k nearest only, so there may be fewer than k.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    if condition is not None and post_filter and k is not None:
        wide = nearest(vectors, key, column, query, 4 * k, metric, min_score)
        return wide.join(vectors.filter(condition).select(key), key, "left_semi").orderBy("distance", key).limit(k)
    vectors = vectors if condition is None else vectors.filter(condition)
    out = vectors.filter(F.size(column) == len(query)).select(key, distance(metric, F.col(column), q).alias("distance"))
    out = out.withColumn("score", score(metric, F.col("distance")))
    if min_score is not None:
        out = out.filter(F.col("score") >= min_score)
    return out if k is None else out.orderBy("distance", key).limit(k)


def fused(lists: Sequence[DataFrame], key: str, limit: int, weights: Sequence[float] | None = None, k: int = RRF_K, min_score: float = 0.0) -> DataFrame:
    """key, score: reciprocal ranks of several short lists (key, score) added up; ties by key.

    The lists hold the best few of each method, so ranking each in one task is bounded.
    """
    parts = [_ranked(df, key, weight, k) for df, weight in zip(lists, weights or [1.0] * len(lists), strict=True)]
    ranked = reduce(DataFrame.union, parts)
    out = ranked.groupBy(key).agg(F.sum("rr").alias("score"))
    return out.filter(F.col("score") >= min_score).orderBy(F.desc("score"), key).limit(limit)
