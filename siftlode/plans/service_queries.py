"""Queries that run whole plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlode.operators.embedding import hash_embedding
from siftlode.plans import service
from siftlode.plans.retrieval_queries import INDEXES, _scope, _shown
from siftlode.plans.runtime import load

#: The shape of a query profile with all stages on.
PROFILE = {
    "profile_id": "release_change_search", "exact_fields": ["artifact_path", "version_label", "sanitized_text"], "bm25_fields": ["sanitized_text", "artifact_path"],
    "limits": {"exact": 15, "bm25": 80, "vector": 60, "fused": 60, "rerank": 15}, "weights": {"exact": 1.0, "bm25": 1.0, "vector": 0.8, "relationship": 0.5},
    "traversal": {"enabled": True, "relationship_types": ["version_lineage"], "max_depth": 2, "max_fanout_per_seed": 6, "max_relationship_candidates": 40, "direction": "both"},
    "token_budget": 1800,
}


#: Index table of the plan's corpus.
INDEX = [("index-1", "hybrid", "active", [], None, PROFILE["profile_id"], None, "hash-1"), ("index-0", "hybrid", "retired", [], None, PROFILE["profile_id"], None, "hash-1")]


def _stages(spark: SparkSession, d: str, index: str = "index-1") -> dict[str, DataFrame]:
    s = _scope(spark, d)
    vectors = s.select("chunk_id", hash_embedding(F.col("sanitized_content_hash"), "local", "hash-1", 64).alias("vector"))
    # documents of one path are versions of one another: each refers to the next by id
    v = s.where("artifact_path is not null").select("source_id", "artifact_path", "chunk_id")
    nxt = v.groupBy("source_id", "artifact_path").agg(F.array_sort(F.collect_list("chunk_id")).alias("c")).where("size(c) > 1")
    pairs = nxt.select(F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("a"), F.slice("c", F.lit(2), F.size("c") - 1).alias("b"))).alias("p"))
    edges = pairs.select(
        F.concat_ws(">", "p.a", "p.b").alias("edge_id"), F.lit("version_lineage").alias("relationship_type"), F.lit("chunk").alias("from_entity_type"),
        F.col("p.a").alias("from_entity_id"), F.lit("chunk").alias("to_entity_type"), F.col("p.b").alias("to_entity_id"),
    )
    vectors = vectors.withColumns({"embedding_model_id": F.lit("hash-1"), "is_active": F.lit(True)})
    models = spark.createDataFrame([("hash-1", "active", 64)], "id string, promotion_status string, dimensions int")
    indexes = spark.createDataFrame(INDEX, f"{INDEXES}, embedding_model_id string")
    text = "recent log of the pending archive in docs/tutorial/plan-token.md"
    return service.retrieve(text, PROFILE, s, vectors, _shown(spark, d), edges, fuzzy=True, index=index, indexes=indexes, models=models)


def hybrid_retrieval(spark: SparkSession, d: str) -> DataFrame:
    return _stages(spark, d)["reranked"].select("chunk_id", "reranked_rank", "fused_rank", F.array_join("paths", ",").alias("paths"))


def hybrid_retired_index(spark: SparkSession, d: str) -> DataFrame:
    """The same query through a retired index: every path is empty."""
    st = _stages(spark, d, "index-0")
    return st["reranked"].select("chunk_id").unionByName(st["bm25"].select("chunk_id")).unionByName(st["vector"].select("chunk_id"))


def hybrid_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _stages(spark, d)["bundle"]


def ingest_pipeline(spark: SparkSession, d: str) -> DataFrame:
    f = load(spark, d, "artifact_files")
    one = f.groupBy("file_id").agg(F.max(F.struct("fetched_at", "source_id", "path", "artifact_role", "language", "text", "license_policy_label")).alias("m")).select("file_id", "m.*")
    s = load(spark, d, "sources").select("source_id", "sensitivity_class")
    a = one.join(F.broadcast(s), "source_id").withColumns({"content": F.col("text"), "license_label": F.col("license_policy_label")})  # sources is a fixed table
    c = service.ingest(a)["chunks"]
    return c.groupBy("chunker", "chunk_kind", "sensitivity_class", "license_policy_status").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"), F.countDistinct("chunk_key").alias("keys")
    )


QUERIES = {"hybrid_retrieval": hybrid_retrieval, "hybrid_retired_index": hybrid_retired_index, "hybrid_evidence": hybrid_evidence, "ingest_pipeline": ingest_pipeline}
ORACLE: dict[str, str] = {"hybrid_retired_index": "select ''::varchar as chunk_id where false"}
