"""Quality of rankings against expected results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranking_metrics(expected: DataFrame, ranked: DataFrame, k: int = 5, depth: int = 10) -> DataFrame:
    """One row per query: recall_at_k, hit, reciprocal_rank, ndcg and citation_coverage.

    ``expected``: query_id, item_id (relevant items, once each); ``ranked``: query_id, item_id, rank (from 1) and
    cited. Queries without expected items have no row; an unranked expected item counts as missed. Gains are
    binary, over the first ``depth`` ranks.
    """
    best = ranked.groupBy("query_id", "item_id").agg(F.min("rank").alias("rank"), F.bool_or("cited").alias("cited"))
    j = expected.distinct().join(best, ["query_id", "item_id"], "left")
    gain = F.when(F.col("rank") <= depth, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    g = j.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("rank") <= k).alias("in_k"), F.min("rank").alias("first"), F.sum(gain).alias("dcg"),
        F.count_if(F.col("rank").isNotNull() & F.coalesce("cited", F.lit(False))).alias("with_citation"), F.count_if(F.col("rank").isNotNull()).alias("found"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(depth)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return g.select(
        "query_id", F.round(F.col("in_k") / F.col("n"), 9).alias("recall_at_k"), (F.col("in_k") > 0).cast("int").alias("hit"),
        F.round(F.coalesce(F.when(F.col("first") <= depth, 1 / F.col("first")), F.lit(0.0)), 9).alias("reciprocal_rank"),
        F.round(F.col("dcg") / ideal, 9).alias("ndcg"),
        F.round(F.coalesce(F.try_divide(F.col("with_citation"), F.col("found")), F.lit(0.0)), 9).alias("citation_coverage"),
    )


def mean_metrics(per_query: DataFrame) -> DataFrame:
    """Means over all queries: one row."""
    names = [c for c in per_query.columns if c != "query_id"]
    return per_query.agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 9).alias(c) for c in names])
