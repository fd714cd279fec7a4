"""The test tables seen as the engine's own relations, once as frames and once as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlode.functions.identity import content_hash
from siftlode.plans.runtime import load


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """extraction_candidates, one row per candidate_id: repeated rows differ at most in their time."""
    e = load(spark, d, "extraction_candidates")
    cols = [c for c in e.columns if c not in ("candidate_id", "extracted_at")]
    return e.groupBy("candidate_id").agg(F.max(F.struct("extracted_at", *cols)).alias("m")).select("candidate_id", *[f"m.{c}" for c in cols])


CANDIDATES = """cand as (
  select * exclude (rn) from (select *, row_number() over (partition by candidate_id order by extracted_at desc) as rn from extraction_candidates)
  where rn = 1)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks with the policy labels of their source.

    A document without version label belongs to no source version; the first licence of a source stands for it.
    """
    s = load(spark, d, "sources").select(
        "source_id", "source_type", "visibility_label", "sensitivity_class", F.col("license_policy").alias("license_policy_status"),
        F.when(F.size("license_ids") > 0, F.element_at("license_ids", 1)).alias("license_id"),
        F.col("corpus_eligibility").alias("corpus_eligibility_label"), F.col("enabled").alias("source_allowlisted"),
        F.col("source_priority").alias("authority_rank"),
    )
    docs = load(spark, d, "documents").select(
        F.concat(F.lit("chunk:"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("chunk_id"), "doc_id", "source_id",
        F.concat_ws("@", "source_id", F.col("version_label")).alias("source_version_id"), "version_label", "artifact_path",
        F.col("source").alias("artifact_role"), F.col("lang").alias("language"), F.col("text").alias("sanitized_text"),
        F.col("fetched_at").alias("first_seen_at"),
    )
    docs = docs.withColumn("source_version_id", F.when(F.col("version_label").isNotNull(), F.col("source_version_id")))
    # sources is a fixed table of some dozens of rows
    return docs.join(F.broadcast(s), "source_id").withColumns(
        {"sanitized_content_hash": content_hash(F.col("sanitized_text")), "redaction_status": F.lit("redacted")}
    )


CHUNKS = """chunks as (
  select 'chunk:' || lpad(doc_id::varchar, 9, '0') as chunk_id, doc_id, d.source_id,
    case when version_label is not null then d.source_id || '@' || version_label end as source_version_id, version_label, artifact_path,
    source as artifact_role, lang as language, text as sanitized_text, fetched_at as first_seen_at, source_type, visibility_label,
    sensitivity_class, license_policy as license_policy_status, license_ids[1] as license_id, corpus_eligibility as corpus_eligibility_label,
    enabled as source_allowlisted, source_priority as authority_rank, 'sha256:' || sha256(text) as sanitized_content_hash, 'redacted' as redaction_status
  from documents d join sources s on d.source_id = s.source_id)"""


def chunk_versions(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_id, source_version_id, is_current, tombstoned_at): versions of release 0 are retired, the others current."""
    c = chunks(spark, d).where("source_version_id is not null")
    old = F.col("version_label").startswith("v0.")
    return c.select("chunk_id", "source_version_id", (~old).alias("is_current"), F.when(old, F.col("first_seen_at")).alias("tombstoned_at"))


def chunk_citations(spark: SparkSession, d: str) -> DataFrame:
    """(citation_id, chunk_id, ...labels): glossaries have no citation."""
    c = chunks(spark, d).where("artifact_role <> 'glossary' and source_version_id is not null")
    return c.select(
        F.regexp_replace("chunk_id", "^chunk:", "citation:").alias("citation_id"), "chunk_id", "source_id", "source_version_id", "source_type",
        "source_allowlisted", "visibility_label", "sensitivity_class", "license_policy_status", "license_id", "redaction_status",
        "corpus_eligibility_label", "sanitized_content_hash",
    )


VERSIONS = """chunk_versions as (
  select chunk_id, source_version_id, not starts_with(version_label, 'v0.') as is_current,
    case when starts_with(version_label, 'v0.') then first_seen_at end as tombstoned_at from chunks where source_version_id is not null),
citations as (select 'citation:' || substr(chunk_id, 7) as citation_id, * from chunks where artifact_role <> 'glossary' and source_version_id is not null)"""
