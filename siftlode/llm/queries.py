"""Queries of the training data operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlode.llm import credentials, fusion, licences, markup, mixing, neighbours, packing, reading, source_files, tokens
from siftlode.operators.ranking import has_wide_group
from siftlode.plans.runtime import load


def _fused(spark: SparkSession, d: str) -> tuple[DataFrame, bool]:
    ranked = load(spark, d, "ranked_candidates")
    wide = has_wide_group(ranked, "query_id")
    scores = fusion.candidate_scores(ranked if wide else ranked.repartition("query_id"))
    return fusion.reciprocal_rank_fusion(scores, "query_id", "chunk_id", wide=wide), wide


def _winners(spark: SparkSession, d: str) -> DataFrame:
    fused, wide = _fused(spark, d)
    return fusion.majority_first(fused, "query_id", "chunk_id", fusion.MEASURES, 3, wide=wide)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _winners(spark, d).select("query_id", "chunk_id")


def p2_decided(spark: SparkSession, d: str) -> DataFrame:
    """How many queries the leader of the fused order wins, and how many a challenger."""
    return _winners(spark, d).groupBy("decided").agg(F.count(F.lit(1)).alias("queries"))


def p2_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d)[0].select("query_id", "chunk_id", "fused_rank", F.round("rrf", 9).alias("rrf"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(neighbours.nearest_vectors(load(spark, d, "chunk_embeddings")))


def p3_nearest(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest_vectors(load(spark, d, "chunk_embeddings")).withColumn("similarity", F.round("similarity", 6))


def p3_recall(spark: SparkSession, d: str) -> DataFrame:
    """The index against brute force: every hundredth vector asks, all can be found; the index with parts of 256 rows, so that it prunes at any size."""
    return neighbours.recall(load(spark, d, "chunk_embeddings"), part_rows=256)


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return source_files.not_hand_written(load(spark, d, "artifact_files"))


def p4_phrases(spark: SparkSession, d: str) -> DataFrame:
    return source_files.phrases_report(load(spark, d, "artifact_files"))


def p4_unlisted(spark: SparkSession, d: str) -> DataFrame:
    """What the grammars find alone, without the lists of banners, names and places."""
    return source_files.not_hand_written(load(spark, d, "artifact_files"), lists=False).select("file_id", "reason")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_report(spark, d).select("file_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.find_credentials(load(spark, d, "extraction_candidates"))[0].select("candidate_id", "line_no")


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.find_credentials(load(spark, d, "extraction_candidates"))[1]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_markup(load(spark, d, "extraction_candidates"))


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_documents(load(spark, d, "extraction_candidates"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return licences.licences(load(spark, d, "artifact_files"), load(spark, d, "license_texts")).select("subject", "subject_id", "license_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return licences.licences(load(spark, d, "artifact_files"), load(spark, d, "license_texts"), load(spark, d, "sources"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_bands(load(spark, d, "documents"), load(spark, d, "reading_labels"))


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return p10_found(spark, d).join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "band").agg(F.count(F.lit(1)).alias("documents"))


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.token_counts(load(spark, d, "documents"), []), load(spark, d, "pack_sizes"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_packing(spark, d), load(spark, d, "pack_sizes"))


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mixture(tokens.token_counts(load(spark, d, "documents"), ["source"]), load(spark, d, "mix_targets"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[1]


_P2 = """
with long as (
  select query_id, chunk_id, path as measure, case when path = 'bm25' then -path_score else path_score end as score, rank as tie
  from ranked_candidates where path in ('exact', 'bm25', 'vector')
  union all select query_id, chunk_id, 'fused', -fused_score, null from ranked_candidates
  union all select query_id, chunk_id, 'rerank', -rerank_score, null from ranked_candidates),
best as (select query_id, chunk_id, measure, min(score) as score,
           arg_min(coalesce(tie, 4611686018427387904), (score, coalesce(tie, 4611686018427387904))) as tie
         from long where score is not null group by 1, 2, 3),
placed as (select *, rank() over (partition by query_id, measure order by score, tie) as place from best)
"""

QUERIES = {"p2_found": p2_found, "p2_ranking": p2_ranking, "p2_decided": p2_decided, "p3_found": p3_found, "p3_nearest": p3_nearest, "p3_recall": p3_recall, "p4_found": p4_found, "p4_report": p4_report, "p4_phrases": p4_phrases, "p4_unlisted": p4_unlisted, "p5_found": p5_found, "p5_redacted": p5_redacted, "p6_found": p6_found, "p6_clean": p6_clean, "p7_found": p7_found, "p7_report": p7_report, "p8_packing": p8_packing, "p8_fill": p8_fill, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found, "p10_profile": p10_profile}

_RANKING = """, s as (select c.query_id, c.chunk_id, coalesce(sum(round(1e15 / (60 + place))::hugeint), 0) / 1e15 as r
  from (select distinct query_id, chunk_id from ranked_candidates) c left join placed using (query_id, chunk_id) group by 1, 2),
ranking as (select query_id, chunk_id, row_number() over (partition by query_id order by r desc, chunk_id) as fused_rank, round(r, 9) as rrf from s)"""
_WINNER = """, wide as (
  select c.query_id, c.chunk_id, max(place) filter (measure = 'exact') as m1, max(place) filter (measure = 'bm25') as m2,
    max(place) filter (measure = 'vector') as m3, max(place) filter (measure = 'fused') as m4, max(place) filter (measure = 'rerank') as m5
  from (select distinct query_id, chunk_id from ranked_candidates) c left join placed using (query_id, chunk_id) group by 1, 2),
winner as (select query_id, chunk_id from wide x where not exists (
  select 1 from wide y where y.query_id = x.query_id and y.chunk_id <> x.chunk_id and
    (coalesce(x.m1, 1000000000) < coalesce(y.m1, 1000000000))::int + (coalesce(x.m2, 1000000000) < coalesce(y.m2, 1000000000))::int
    + (coalesce(x.m3, 1000000000) < coalesce(y.m3, 1000000000))::int + (coalesce(x.m4, 1000000000) < coalesce(y.m4, 1000000000))::int
    + (coalesce(x.m5, 1000000000) < coalesce(y.m5, 1000000000))::int < 3))"""

#: Brute force. Up to some thousand vectors a model the index has one part, and the rows are the same; beyond, see p3_recall.
_P3 = """
with good as (select vec_id, embedding_model_id as m, vector::double[] as v, created_at from chunk_embeddings where is_active and embedding_model_id is not null and len(vector) = dimensions
    and len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0),
u as (select vec_id, m, v, sqrt(list_dot_product(v, v)) as n from good qualify row_number() over (partition by vec_id order by created_at desc, m desc, v desc) = 1),
s as (select a.vec_id, b.vec_id as other_id, round(list_dot_product(a.v, b.v) / (a.n * b.n), 12) as similarity from u a join u b on a.m = b.m and a.vec_id <> b.vec_id and len(a.v) = len(b.v)),
near as (select * from s qualify row_number() over (partition by vec_id order by similarity desc, other_id) <= 5)
"""

ORACLE = {
    "p3_nearest": f"{_P3} select vec_id, other_id, round(similarity, 6) + 0.0 as similarity from near",
    "p3_found": f"{_P3} select distinct least(vec_id, other_id) as vec_id_a, greatest(vec_id, other_id) as vec_id_b from near where similarity >= 0.9",
    "p2_found": f"{_P2}{_WINNER} select query_id, chunk_id from winner",
    "p2_ranking": f"{_P2}{_RANKING} select * from ranking",
    "p2_decided": f"{_P2}{_RANKING}{_WINNER} select case fused_rank when 1 then 'leader' else 'challenger' end as decided, count(*) as queries from winner join ranking using (query_id, chunk_id) group by 1",
}
