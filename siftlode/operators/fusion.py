"""Fusing the candidate lists of one query and reranking the result, with every tie decided."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAST = 2**31 - 1
#: Labels of rows that a reranker may see.
RETRIEVABLE = ["allowed", "default_retrievable", "eligible"]
PATHS = ["bm25", "exact", "relationship", "vector"]


def weighted_rrf(
    ranked: DataFrame, weights: dict[str, float], k: int = 60, group: list[str] | None = None, use_authority: bool = True, use_freshness: bool = True
) -> DataFrame:
    """Fused candidates of (group, chunk_id): score = sum over paths of weight / (k + best rank).

    ``ranked``: chunk_id, path, rank, authority_rank, first_seen_at, excerpt, excerpt_trusted. An id counts
    once per path at its best rank; a path without weight adds nothing but lists its ids; rows without rank
    add nothing either. The sum runs in path-name order, so it is the same on every run. fused_rank: score
    descending, then rank in exact, bm25 and vector, then (if used) least authority and latest sight, then id.
    The excerpt is that of the first path by name with a trusted one.
    """
    if k <= 0 or any(w < 0 for w in weights.values()):
        raise ValueError("k must be positive and no weight negative")
    group = group or []
    names = sorted(set(PATHS) | set(weights))
    at = lambda p: F.col("path") == p
    trusted = F.col("excerpt_trusted") & F.col("excerpt").isNotNull()
    best = F.struct(F.coalesce("rank", F.lit(LAST)).alias("r"), F.col("excerpt").alias("x"))
    agg = []
    for p in names:
        agg += [F.min(F.when(at(p), F.col("rank"))).alias(f"{p}_rank"), F.min(F.when(at(p) & trusted, best)).alias(f"_{p}_x")]
    f = ranked.groupBy(*group, "chunk_id").agg(
        *agg, F.min("authority_rank").alias("authority_rank"), F.max("first_seen_at").alias("first_seen_at"),
        F.array_sort(F.collect_set("path")).alias("paths"),
    )
    score = F.lit(0.0)
    for p in names:
        w = float(weights.get(p, 0.0))
        if w:
            score = score + F.coalesce(F.lit(w) / (F.lit(float(k)) + F.col(f"{p}_rank")), F.lit(0.0))
    f = f.withColumn("fused_score", score).withColumn("excerpt", F.coalesce(*[F.col(f"_{p}_x.x") for p in names]))
    order = [F.col("fused_score").desc()] + [F.coalesce(F.col(f"{p}_rank"), F.lit(LAST)).asc() for p in ("exact", "bm25", "vector")]
    if use_authority:
        order.append(F.col("authority_rank").asc_nulls_last())
    if use_freshness:
        order.append(F.col("first_seen_at").desc_nulls_last())
    order.append(F.col("chunk_id").asc())
    w = Window.partitionBy(*group).orderBy(*order) if group else Window.partitionBy(F.lit(0)).orderBy(*order)
    # one query's candidates: at most the sum of its paths' limits
    return f.withColumn("fused_rank", F.row_number().over(w)).drop(*[f"_{p}_x" for p in names])


def rerank_inputs(fused: DataFrame, limit: int, max_text: int) -> DataFrame:
    """The first ``limit`` fused candidates with their texts cut to ``max_text``; fails on untrusted or ineligible ones."""
    top = fused.where(F.col("fused_rank") <= limit)
    bad = ~F.coalesce(F.col("excerpt_trusted"), F.lit(False)) | F.col("excerpt").isNull() | ~F.coalesce(F.col("eligibility").isin(RETRIEVABLE), F.lit(False))
    text = F.when(bad, F.raise_error(F.lit("candidate is not trusted and eligible"))).otherwise(F.substring("excerpt", 1, max_text))
    return top.withColumn("truncated", F.length("excerpt") > max_text).withColumn("rerank_text", text)


def overlap_scores(inputs: DataFrame, query: Column, group: list[str]) -> DataFrame:
    """A reranker without a model: distinct words shared with the query, then fused rank, authority, latest sight, id; score n..1."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), F.lit(0)))
    shared = F.size(F.array_intersect(words(F.col("rerank_text")), words(query)))
    order = [
        F.col("_shared").desc(), F.col("fused_rank").asc(), F.coalesce("authority_rank", F.lit(LAST)).asc(),
        F.col("first_seen_at").desc_nulls_last(), F.col("chunk_id").asc(),
    ]
    s = inputs.withColumn("_shared", shared)
    keys = [F.col(g) for g in group] or [F.lit(0)]
    n, place = F.count(F.lit(1)).over(Window.partitionBy(*keys)), F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return s.select(*group, "chunk_id", (n - place + 1).cast("double").alias("score"))


def check_scores(inputs: DataFrame, scores: DataFrame, group: list[str]) -> DataFrame:
    """(group, chunk_id, fault) of a provider's answer: missing, extra or repeated ids, and scores that are no finite numbers."""
    keys = [*group, "chunk_id"]
    want = inputs.select(*keys).withColumn("_want", F.lit(1))
    got = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("_got"), F.bool_and(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))).alias("_ok"))
    fault = (
        F.when(F.col("_want").isNull(), "extra").when(F.col("_got").isNull(), "missing").when(F.col("_got") > 1, "repeated").when(~F.col("_ok"), "not_finite")
    )
    return want.join(got, keys, "full_outer").select(*keys, fault.alias("fault")).where("fault is not null")


def reranked(inputs: DataFrame, scores: DataFrame, group: list[str]) -> DataFrame:
    """Inputs with rerank_score and reranked_rank: score descending, then id."""
    keys = [*group, "chunk_id"]
    by = [F.col(g) for g in group] or [F.lit(0)]
    j = inputs.join(scores.select(*keys, F.col("score").alias("rerank_score")), keys)
    return j.withColumn("reranked_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("rerank_score").desc(), F.col("chunk_id").asc())))


def rerank(inputs: DataFrame, provider: Callable[[DataFrame], DataFrame], group: list[str], fallback: bool = False) -> DataFrame:
    """Provider scores, checked and ranked; a faulty answer raises, or with ``fallback`` leaves the fused order."""
    scores = provider(inputs)
    faulty = check_scores(inputs, scores, group).limit(1).count() > 0
    if not faulty:
        return reranked(inputs, scores, group)
    if not fallback:
        raise ValueError("reranker returned an invalid candidate set")
    return inputs.withColumn("rerank_score", F.lit(None).cast("double")).withColumn("reranked_rank", F.col("fused_rank"))
