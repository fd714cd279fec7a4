"""Queries over scopes, retrievers, the graph, fusion, reranking, evidence, embeddings and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlode.operators import embedding as E
from siftlode.operators import evaluation as V
from siftlode.operators import evidence as W
from siftlode.operators import fusion as U
from siftlode.operators import graph as G
from siftlode.operators import intent as Q
from siftlode.operators import retrieval as T
from siftlode.operators import scope as S
from siftlode.plans.corpus import CANDIDATES, CHUNKS, VERSIONS, candidates, chunk_citations, chunk_versions, chunks
from siftlode.plans.runtime import load, stored

TRUSTED = S.Trusted(
    visibility_labels=("public", "internal", "invited_users"), sensitivity_classes=("public", "internal", "confidential"),
    license_ids=("MIT", "Apache-2.0", "BSD-3-Clause"),
)
_POLICY = """source_allowlisted and visibility_label in ('public','internal','invited_users') and sensitivity_class in ('public','internal','confidential')
  and license_policy_status = 'allowed' and license_id in ('MIT','Apache-2.0','BSD-3-Clause') and redaction_status in ('redacted','not_required')
  and corpus_eligibility_label in ('allowed','default_retrievable','eligible')"""
_SCOPE = f"""{CHUNKS}, {VERSIONS}, scope as (select c.* from chunks c where {_POLICY} and source_version_id is not null and sanitized_text <> ''
  and exists (select 1 from chunk_versions v where v.chunk_id = c.chunk_id and is_current and tombstoned_at is null)
  and exists (select 1 from citations t where t.chunk_id = c.chunk_id and {_POLICY.replace('source_allowlisted', 't.source_allowlisted', 1)}))"""
QUERY_TEXT = "find \"remote log\" in docs/tutorial/plan-token.md at v4.11 or api_reference"
WORDS = ["archive", "token", "pending", "nested", "reviewer"]


def _scope(spark: SparkSession, d: str, asked: S.Filters | None = None) -> DataFrame:
    return S.chunk_scope(chunks(spark, d), chunk_versions(spark, d), chunk_citations(spark, d), TRUSTED, asked or S.Filters())


def scope_filtered_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _scope(spark, d).select("chunk_id", "source_id", "version_label")


def scope_narrowed(spark: SparkSession, d: str) -> DataFrame:
    return _scope(spark, d, S.Filters(visibility_labels=("public", "secret"), source_types=("git_repository",))).select("chunk_id", "source_type")


def scope_version_range(spark: SparkSession, d: str) -> DataFrame:
    return _scope(spark, d, S.Filters(version_from="v1.2", version_to="v4.1", time_from="2024-01-01 06:00:00")).select("chunk_id", "version_label")


def scope_fail_closed_empty(spark: SparkSession, d: str) -> DataFrame:
    return _scope(spark, d, S.Filters(visibility_labels=("secret",))).select("chunk_id")


INDEXES = "id string, index_kind string, status string, source_ids array<string>, exact_index_profile string, bm25_profile string, vector_profile string"


def _indexes(spark: SparkSession) -> DataFrame:
    """The index table of the corpus: an active one over three sources, a retired one, and one of another kind without named sources."""
    rows = [
        ("index-1", "hybrid", "active", ["src-lantern-core", "src-tempri-cli", "src-pritas-svc"], "docs_qa", "docs_qa", "docs_qa"),
        ("index-0", "hybrid", "retired", [], "docs_qa", "docs_qa", "docs_qa"),
        ("index-v", "vector", "active", [], None, None, "docs_qa"),
    ]
    return spark.createDataFrame(rows, INDEXES)


def scope_active_index(spark: SparkSession, d: str) -> DataFrame:
    """Chunks per source in reach of each index as it is asked for: fit, retired, of another kind, of another profile, without named sources."""
    i = _indexes(spark)
    asked = [("fit", "index-1", "bm25", "docs_qa"), ("retired", "index-0", "bm25", "docs_qa"), ("kind", "index-v", "bm25", None), ("profile", "index-1", "exact", "code_qa"), ("all", "index-v", "vector", "docs_qa")]
    out = None
    for name, *args in asked:
        part = S.chunk_scope(chunks(spark, d), chunk_versions(spark, d), chunk_citations(spark, d), TRUSTED, S.Filters(), S.covered_by(i, *args))
        part = part.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("asked"), "source_id", "n")
        out = part if out is None else out.unionByName(part)
    return out


def scope_post_filter_count(spark: SparkSession, d: str) -> DataFrame:
    return _scope(spark, d).agg(F.count(F.lit(1)).alias("n"))


def citation_semi_join(spark: SparkSession, d: str) -> DataFrame:
    return S.citation_scope(chunks(spark, d), chunk_citations(spark, d), S.narrow(TRUSTED, S.Filters())).select("citation_id", "chunk_id")


def _claims(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).where("source_version_id is not null")
    return c.select(
        F.regexp_replace("chunk_id", "^chunk:", "claim:").alias("claim_id"), "source_id", "source_version_id", "source_allowlisted", "visibility_label",
        "sensitivity_class", "license_policy_status", "license_id", "redaction_status", "corpus_eligibility_label",
        F.regexp_replace("chunk_id", "^chunk:", "citation:").alias("primary_citation_id"),
    )


def claim_scope(spark: SparkSession, d: str) -> DataFrame:
    f = S.narrow(TRUSTED, S.Filters())
    live = chunk_versions(spark, d).withColumn("claim_id", F.regexp_replace("chunk_id", "^chunk:", "claim:"))
    return S.record_scope(_claims(spark, d), live, S.citation_scope(chunks(spark, d), chunk_citations(spark, d), f), f, "claim_id").select("claim_id", "citation_item_id")


def fact_scope(spark: SparkSession, d: str) -> DataFrame:
    """Facts, one per claim of an even number, in scope by the same rules as claims; and how many are retired or lack an allowed citation."""
    f = S.narrow(TRUSTED, S.Filters())
    facts = _claims(spark, d).where("cast(substring(claim_id, 7, 9) as long) % 2 = 0").withColumn("fact_id", F.regexp_replace("claim_id", "^claim:", "fact:"))
    live = chunk_versions(spark, d).withColumn("fact_id", F.regexp_replace("chunk_id", "^chunk:", "fact:"))
    cites = S.citation_scope(chunks(spark, d), chunk_citations(spark, d), f)
    return S.record_scope(facts, live, cites, f, "fact_id").select("fact_id", "source_id", "citation_item_id")


def entity_union(spark: SparkSession, d: str) -> DataFrame:
    e = S.entity_scope(chunk=_scope(spark, d).select("chunk_id"), claim=claim_scope(spark, d).select("claim_id"))
    return e.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("least"), F.max("entity_id").alias("greatest"))


def relationship_both_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Each document refers to the next one of its source; both must be in scope."""
    c = _claims(spark, d)
    nxt = F.regexp_replace("claim_id", "^claim:", "chunk:")
    edges = c.withColumns(
        {
            "relationship_id": F.regexp_replace("claim_id", "^claim:", "rel:"), "relationship_type": F.lit("references"), "from_entity_type": F.lit("chunk"),
            "from_entity_id": nxt, "to_entity_type": F.lit("chunk"),
            "to_entity_id": F.concat(F.lit("chunk:"), F.lpad((F.substring("claim_id", 7, 9).cast("long") + 1).cast("string"), 9, "0")),
        }
    )
    f = S.narrow(TRUSTED, S.Filters())
    live = chunk_versions(spark, d).withColumn("relationship_id", F.regexp_replace("chunk_id", "^chunk:", "rel:"))
    ents = S.entity_scope(chunk=_scope(spark, d).select("chunk_id"))
    cites = S.citation_scope(chunks(spark, d), chunk_citations(spark, d), f)
    return S.relationship_scope(edges, live, cites, ents, f, ["references"]).select("relationship_id", "from_entity_id", "to_entity_id")


def authority_scalar_lookup(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).groupBy("source_id").agg(F.min(F.coalesce("authority_rank", F.lit(1000))).alias("authority_rank"), F.count(F.lit(1)).alias("n"))


def eligibility_violations(spark: SparkSession, d: str) -> DataFrame:
    labels = {"visibility_label": ["public", "invited_users"], "sensitivity_class": ["public", "internal", "confidential"], "corpus_eligibility_label": ["default_retrievable"]}
    v = S.eligibility_violations(chunks(spark, d), "chunk_id", labels)
    return v.groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


def query_intent(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d).where("signature_text is not null or locator is not null")
    q = c.select("candidate_id", F.concat_ws(" ", F.lit("'exact words'"), "signature_text", "locator", F.lit("v1.2.3 --flag_name ValueError")).alias("query_text"))
    p = Q.parse_intents(q)
    return p.select("candidate_id", *[F.array_join(k, "|").alias(k) for k in Q.KINDS])


def exact_lookup(spark: SparkSession, d: str) -> DataFrame:
    terms = T.terms_by_field(Q.field_terms(Q.parse_intent(QUERY_TEXT)), ["artifact_path", "version_label", "sanitized_text", "citation_id"])
    return T.exact_lookup(_scope(spark, d), terms, 40).select("chunk_id", "rank", "matched_field", "field_priority", "authority_rank")


def fuzzy_substring(spark: SparkSession, d: str) -> DataFrame:
    s = _scope(spark, d)
    exact = T.exact_lookup(s, {"sanitized_text": ["no such words anywhere"]}, 10)
    return T.fuzzy_lookup(s, ["archive", "reviewer"], 30, unless=exact).select("chunk_id", "rank", "matched_field")


def fuzzy_suppressed(spark: SparkSession, d: str) -> DataFrame:
    s = _scope(spark, d)
    return T.fuzzy_lookup(s, ["archive"], 30, unless=T.exact_lookup(s, {"sanitized_text": ["the"]}, 10)).select("chunk_id", "rank")


def fuzzy_trigram(spark: SparkSession, d: str) -> DataFrame:
    s = _scope(spark, d).withColumn("similarity", F.round(T.similarity(F.col("artifact_path"), F.lit("tutorial load archive")), 6))
    return s.where("similarity >= 0.3").select("chunk_id", "similarity")


def json_field_access(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    return e.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count(F.lit(1)).alias("n"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return T.bm25(_scope(spark, d), WORDS, limit=100)


def bm25_batch(spark: SparkSession, d: str) -> DataFrame:
    """Headings of every hundredth candidate against all documents in scope."""
    s = _scope(spark, d)
    n = s.select(F.count(F.lit(1)).alias("n"), F.avg(F.size(T.tokens(F.col("sanitized_text")))).alias("l")).first()
    q = candidates(spark, d).where("candidate_id % 100 = 0 and size(heading_path) > 0").select(
        F.col("candidate_id").alias("query_id"), F.array_join("heading_path", " ").alias("query_text")
    )
    return T.bm25_batch(T.postings(s), q, n["n"], float(n["l"] or 1), limit=10)


FIELDS = ["sanitized_text", "artifact_path", "artifact_role"]


def bm25_fields(spark: SparkSession, d: str) -> DataFrame:
    """Words in any of three fields, through the written inverted file."""
    index, sizes = T.field_index(_scope(spark, d), FIELDS)
    r = T.search_index(stored(index), stored(sizes), WORDS, FIELDS, 120)
    return r.select("chunk_id", "rank", F.round("score", 7).alias("score"), F.array_join("matched_fields", ",").alias("matched_fields"))


def bm25_fallback(spark: SparkSession, d: str) -> DataFrame:
    r = T.substring_search(_scope(spark, d), "The Token", ["sanitized_text", "artifact_path"], 50)
    return r.select("chunk_id", "rank", "score", F.array_join("matched_fields", ",").alias("matched_fields"))


def _probe(spark: SparkSession, d: str) -> list[float]:
    return load(spark, d, "embeddings").orderBy("vec_id").first()["embedding"]


def vector_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    return T.vector_search(e, _probe(spark, d), 50, "vec_id", "embedding")


def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").where("label % 2 = 1")
    return T.vector_search(e, _probe(spark, d), 50, "vec_id", "embedding")


def vector_guarded(spark: SparkSession, d: str) -> DataFrame:
    """The active vectors of one model behind the model's and the index's guards; a retired model and a foreign index give nothing."""
    v = load(spark, d, "chunk_embeddings").where(~F.exists("vector", lambda x: F.isnan(x)) & F.exists("vector", lambda x: x != 0))
    own = v.where("is_active and dimensions = 64 and size(vector) = 64").select("embedding_model_id", "vector", "vec_id").orderBy("vec_id").first()
    name = own["embedding_model_id"]
    models = spark.createDataFrame([(name, "active", 64), ("old", "retired", 64)], "id string, promotion_status string, dimensions int")
    indexes = spark.createDataFrame([("i1", "active", name), ("i2", "building", name), ("i3", "active", "old")], "id string, status string, embedding_model_id string")
    out = None
    for model, index in ((name, "i1"), (name, "i2"), (name, "i3"), ("old", "i3"), ("none", "i1")):
        part = T.guarded_vector_search(v, models, indexes, model, index, own["vector"], None, 60).select("chunk_id", "rank", "strategy", F.round("distance", 6).alias("distance"), F.lit(index).alias("index_id"))
        out = part if out is None else out.unionByName(part)
    return out


def hybrid_alpha(spark: SparkSession, d: str) -> DataFrame:
    lex = T.bm25(_scope(spark, d), WORDS, limit=100)
    e = load(spark, d, "embeddings").withColumn("chunk_id", F.concat(F.lit("chunk:"), F.lpad(F.col("vec_id").cast("string"), 9, "0")))
    near = T.vector_search(e, _probe(spark, d), 100, "chunk_id", "embedding")
    return T.hybrid_search(lex, near, 0.6, 30).select("chunk_id", "rank", "score")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, k, f, to, g: load(spark, d, t).select(
        F.concat(F.lit(f"{t}-"), F.col(k).cast("string")).alias("edge_id"), F.lit(f"{t}_of").alias("relationship_type"), F.lit(f).alias("from_entity_type"),
        F.concat(F.lit(f[0]), F.col(k).cast("string")).alias("from_entity_id"), F.lit(to).alias("to_entity_type"),
        F.concat(F.lit(to[0]), F.col(g).cast("string")).alias("to_entity_id"),
    )
    return (
        one("nation", "n_nationkey", "nation", "region", "n_regionkey")
        .unionByName(one("supplier", "s_suppkey", "supplier", "nation", "s_nationkey"))
        .unionByName(one("customer", "c_custkey", "customer", "nation", "c_nationkey"))
        .unionByName(one("orders", "o_orderkey", "order", "customer", "o_custkey"))
    )


_TYPES = ["nation_of", "supplier_of", "customer_of", "orders_of"]


def graph_bounded_traversal(spark: SparkSession, d: str) -> DataFrame:
    t = G.traverse(_edges(spark, d), [("region", "r1"), ("region", "r3")], _TYPES, 3, 4, 70, "inbound")
    return t.select("entity_type", "entity_id", "depth", "edge_id", "seed_id", F.array_join(F.transform("path", lambda p: p["edge_id"]), ">").alias("path"))


#: The fault written into each path, by the customer's number in a round of thirteen.
_BROKEN = ["", "too_deep", "depth_order", "direction", "uncited", "gap", "cycle", "endpoint", "edge_ineligible", "kind", "type", "empty", "identifier"]


def graph_path_check(spark: SparkSession, d: str) -> DataFrame:
    """Paths from customers over their nation to an end of their own, each broken in the way its number says, and the faults found."""
    c = load(spark, d, "customer").join(F.broadcast(load(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    k = F.col("c_custkey") % len(_BROKEN)
    is_ = lambda name: k == _BROKEN.index(name)
    me, nation = F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "n_nationkey")
    end = F.when(is_("cycle"), me).when(is_("identifier"), F.lit("")).otherwise(F.concat(F.lit("r"), "n_regionkey", F.lit("-"), "c_custkey"))
    far = F.concat(F.lit("w"), "c_custkey")

    def step(kind, a, b, depth, direction="outbound", cited=True, fit=True):  # noqa: ANN001, ANN202
        ids = F.when(F.lit(cited) if isinstance(cited, bool) else cited, F.array(F.lit("k"))).otherwise(F.array().cast("array<string>"))
        col = lambda x: F.lit(x) if isinstance(x, str | int | bool) else x
        return F.struct(
            col(kind).alias("relationship_type"), col(direction).alias("direction"), col(depth).cast("int").alias("depth"), a.alias("from_id"), b.alias("to_id"),
            ids.alias("citation_ids"), col(fit).alias("endpoint_eligible"),
        )

    one = step("customer_of", me, nation, 1)
    two = step(
        F.when(is_("type"), "other_of").otherwise("nation_of"), F.when(is_("gap"), F.lit("elsewhere")).otherwise(nation), end, F.when(is_("depth_order"), 7).otherwise(2),
        F.when(is_("direction"), "sideways").otherwise("outbound"), ~is_("uncited"), ~is_("edge_ineligible"),
    )
    path = F.when(is_("too_deep"), F.array(one, two, step("nation_of", end, far, 3))).when(is_("empty"), F.slice(F.array(one), 1, 0)).otherwise(F.array(one, two))
    item = F.when(is_("too_deep"), far).when(is_("endpoint"), F.lit("nowhere")).otherwise(end)
    p = c.select(item.alias("item_id"), path.alias("path"), F.when(is_("kind"), "vector").otherwise("relationship").alias("retrieval_path"), F.lit(True).alias("endpoint_eligible"))
    return G.path_faults(p, ["customer_of", "nation_of"], 2, "outbound", fanout=60).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


def traversal_seeds(spark: SparkSession, d: str) -> DataFrame:
    return G.seed_candidates(load(spark, d, "ranked_candidates").where("rank is not null"), ["exact", "bm25"], 25)


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "ranked_candidates")
    return r.withColumn("excerpt", F.concat_ws(" ", "path", F.when(F.size("matched_fields") > 0, F.array_join("matched_fields", " "))))


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return U.weighted_rrf(_ranked(spark, d), {"exact": 1.0, "bm25": 0.9, "vector": 0.8, "relationship": 0.4}, 60, ["query_id"])


def rrf_weighted_ties(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("query_id", "chunk_id", "fused_rank", F.round("fused_score", 9).alias("fused_score"), "excerpt")


def mock_rerank(spark: SparkSession, d: str) -> DataFrame:
    ok = load(spark, d, "ranked_candidates").groupBy("query_id", "chunk_id").agg(
        F.bool_or("excerpt_trusted").alias("excerpt_trusted"), F.max("eligibility").alias("eligibility")
    )
    f = _fused(spark, d).join(ok, ["query_id", "chunk_id"])
    f = f.where(F.col("excerpt_trusted") & F.col("eligibility").isin(U.RETRIEVABLE) & F.col("excerpt").isNotNull())
    i = U.rerank_inputs(f, 15, 24)
    r = U.reranked(i, U.overlap_scores(i, F.lit("heading_path exact symbol_path"), ["query_id"]), ["query_id"])
    return r.select("query_id", "chunk_id", "rerank_score", "reranked_rank", "truncated")


def token_budget_pack(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").where("source_id is not null")
    p = W.pack_budget(docs, 20000, ["source_id"], "doc_id", "text")
    return p.select("source_id", "doc_id", "estimated_tokens", "truncated", F.length("excerpt").alias("chars"))


def _shown(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "sources").select("source_id", "url")
    return chunk_citations(spark, d).join(F.broadcast(s), "source_id").select(  # a fixed table
        "*", F.col("chunk_id").alias("item_id"), F.concat_ws("/", F.regexp_replace("url", "/$", ""), F.lit("docs")).alias("source_url"), F.concat_ws(":", F.lit("L"), "chunk_id").alias("locator")
    ).where("url is not null")


def citation_validation(spark: SparkSession, d: str) -> DataFrame:
    return W.valid_citations(_shown(spark, d)).select("citation_id", "source_url")


def evidence_records(spark: SparkSession, d: str) -> DataFrame:
    cites = _shown(spark, d)
    rec = _scope(spark, d).select(F.col("chunk_id").alias("item_id"), "sanitized_text", "sanitized_content_hash", "source_id", "source_version_id", "corpus_eligibility_label")
    rec = rec.withColumn("citation_ids", F.array(F.regexp_replace("item_id", "^chunk:", "citation:")))
    return W.usable_records(rec, cites).select("item_id", "source_id")


def conflict_markers(spark: SparkSession, d: str) -> DataFrame:
    """Documents of one text under different sources contradict each other about where it comes from."""
    c = chunks(spark, d).where("length(sanitized_text) > 0").groupBy("sanitized_content_hash").agg(F.min("chunk_id").alias("a"), F.max("chunk_id").alias("b")).where("a < b")
    conf = c.select(F.col("sanitized_content_hash").alias("conflict_id"), F.lit("open").alias("status"), F.regexp_replace("a", "chunk:", "claim:").alias("left_claim_id"), F.regexp_replace("b", "chunk:", "claim:").alias("right_claim_id"))
    claims = _claims(spark, d).select(F.col("claim_id").alias("id"), "primary_citation_id")
    cites = chunk_citations(spark, d).select("citation_id", F.col("chunk_id").alias("item_id"))
    m = W.conflict_markers(conf, claims, cites, cites.select("item_id"), strict=False)
    return m.select("conflict_id", "status", F.array_join("competing_item_ids", "|").alias("items"), F.array_join("competing_citation_ids", "|").alias("cites"))


def evidence_bundle(spark: SparkSession, d: str) -> DataFrame:
    s = _scope(spark, d)
    top = T.bm25(s, WORDS, limit=20).join(s, "chunk_id")
    p = W.pack_budget(top.withColumn("item_id", F.col("chunk_id")), 1600).withColumn("citation_ids", F.array(F.regexp_replace("item_id", "^chunk:", "citation:")))
    return W.bundle(p, _shown(spark, d), QUERY_TEXT, 1600, "docs_qa", "index-1")


def evidence_packed(spark: SparkSession, d: str) -> DataFrame:
    """What of the best chunks fits into the budget, in rank order."""
    s = _scope(spark, d)
    top = T.bm25(s, WORDS, limit=20).join(s, "chunk_id")
    p = W.pack_budget(top, 1600)
    return p.select("chunk_id", "rank", "estimated_tokens", "truncated", F.length("excerpt").alias("chars"), F.md5("excerpt").alias("digest"))


def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).withColumn("v", E.hash_embedding(F.col("sanitized_content_hash"), "local", "hash-1", 20))
    return c.select("chunk_id", *[F.round(F.col("v")[i], 9).alias(f"v{i}") for i in (0, 7, 8, 19)], F.size("v").alias("dimensions"))


def _jobs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = chunks(spark, d).where("source_version_id is not null")
    base = c.select("chunk_id", "doc_id", "sanitized_content_hash", F.lit("m").alias("embedding_model_id"), F.lit("i").alias("index_version_id"))
    stale = F.when(F.col("doc_id") % 3 == 1, F.lit("sha256:old")).otherwise(F.col("sanitized_content_hash"))
    vectors = base.withColumn("sanitized_content_hash", stale).withColumn("is_active", F.col("doc_id") % 3 != 2)
    jobs = base.withColumn("status", F.element_at(F.array(*map(F.lit, ["pending", "failed", "succeeded", "cancelled", "retrying"])), (F.col("doc_id") % 5 + 1).cast("int")))
    return vectors, jobs


def embedding_job_plan(spark: SparkSession, d: str) -> DataFrame:
    vectors, jobs = _jobs(spark, d)
    return E.plan_jobs(chunks(spark, d), chunk_versions(spark, d), vectors, jobs, "m", "i").select("chunk_id", "action", "job_id")


def embedding_job_pass(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    jobs = e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("chunk_id"), F.col("ts").alias("created_at"),
        F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "retrying").otherwise("succeeded").alias("status"),
        (F.col("event_id") % 3).cast("int").alias("attempt_count"), F.when(F.col("event_type") == "click", F.col("ts")).alias("next_retry_at"),
        F.when(F.col("value") < 5, "ok").when(F.col("value") < 10, "changed").otherwise("error").alias("outcome"),
    )
    now = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    f = E.finish(E.claim(jobs, 500, now), now)
    return f.groupBy("status", "attempt_count").agg(F.count(F.lit(1)).alias("n"))


def vector_deactivation(spark: SparkSession, d: str) -> DataFrame:
    v = E.active_vectors(_jobs(spark, d)[0], chunks(spark, d))
    return v.groupBy("is_active").agg(F.count(F.lit(1)).alias("n"))


def eval_recall_mrr_ndcg(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "ranked_candidates")
    expected = r.where("path = 'exact' and rank <= 3").select("query_id", F.col("chunk_id").alias("item_id"))
    ranked = r.where("path = 'bm25' and rank is not null").select("query_id", F.col("chunk_id").alias("item_id"), "rank", F.col("excerpt_trusted").alias("cited"))
    return V.ranking_metrics(expected, ranked)


def eval_means(spark: SparkSession, d: str) -> DataFrame:
    return V.mean_metrics(eval_recall_mrr_ndcg(spark, d))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

_CLAIMS = f"""claims as (select 'claim:' || substr(chunk_id, 7) as claim_id, 'citation:' || substr(chunk_id, 7) as primary_citation_id, * from chunks where source_version_id is not null),
okclaims as (select c.claim_id, t.chunk_id as citation_item_id from claims c join citations t on t.citation_id = c.primary_citation_id and t.source_id = c.source_id
   join chunk_versions v on v.chunk_id = c.chunk_id where v.is_current and {_POLICY.replace('source_allowlisted', 'c.source_allowlisted', 1).replace('visibility_label', 'c.visibility_label').replace('sensitivity_class', 'c.sensitivity_class').replace('license_policy_status', 'c.license_policy_status').replace('license_id in', 'c.license_id in').replace('redaction_status', 'c.redaction_status').replace('corpus_eligibility_label', 'c.corpus_eligibility_label')})"""
_TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9_]+')"


def _bm25_sql(limit: int) -> str:
    cnt = ", ".join(f"len(list_filter(w, lambda x: x = '{w}')) as f{i}" for i, w in enumerate(WORDS))
    df = ", ".join(f"count(*) filter (f{i} > 0) as d{i}" for i in range(len(WORDS)))
    score = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / a))" for i in range(len(WORDS)))
    some = " or ".join(f"f{i} > 0" for i in range(len(WORDS)))
    return f"""tk as (select chunk_id, {_TOKENS.format('sanitized_text')} as w from scope), ct as (select chunk_id, len(w) as dl, {cnt} from tk),
st as (select count(*) as n, avg(dl) as a, {df} from ct), sc as (select chunk_id, round({score}, 9) as score from ct, st where {some}),
lex as (select *, row_number() over (order by score desc, chunk_id)::int as rank from sc qualify rank <= {limit})"""


_NEAR = """q as (select embedding::double[] as q from embeddings order by vec_id limit 1),
near as (select vec_id, label, round(1 - list_dot_product(embedding::double[], q) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q, q))), 9) + 0.0 as distance from embeddings, q)"""
_EDGES = """edges as (select 'nation-' || n_nationkey as edge_id, 'nation_of' as rt, 'nation' as ft, 'n' || n_nationkey as f, 'region' as tt, 'r' || n_regionkey as t from nation
 union all select 'supplier-' || s_suppkey, 'supplier_of', 'supplier', 's' || s_suppkey, 'nation', 'n' || s_nationkey from supplier
 union all select 'customer-' || c_custkey, 'customer_of', 'customer', 'c' || c_custkey, 'nation', 'n' || c_nationkey from customer
 union all select 'orders-' || o_orderkey, 'orders_of', 'order', 'o' || o_orderkey, 'customer', 'c' || o_custkey from orders)"""


def _walk_sql(fanout: int, cap: int, seeds: list[str], depth: int) -> str:
    sql = f"""{_EDGES}, w as (select edge_id, rt, tt as at, t as aid, ft as bt, f as bid, row_number() over (partition by tt, t order by edge_id, ft, f) as fr from edges qualify fr <= {fanout}),
s0 as (select * from (values {', '.join(f"('region', '{s}', {i}, '{s}')" for i, s in enumerate(seeds, 1))}) v(et, eid, o, seed)), l0 as (select *, [et || ':' || eid] as seen, []::varchar[] as path, [] ::varchar[] as types, '' as edge_id, 0 as depth from s0)"""
    for k in range(1, depth + 1):
        sql += f""", l{k} as (select w.bt as et, w.bid as eid, {len(seeds)} + o * {fanout} + fr as o, seed, seen || [w.bt || ':' || w.bid] as seen, path || [w.edge_id] as path, types || [w.rt] as types, w.edge_id, {k} as depth
  from l{k - 1} l join w on w.at = l.et and w.aid = l.eid where not list_contains(seen, w.bt || ':' || w.bid) and {len(seeds)} + o * {fanout} + fr <= {cap})"""
    return sql + ", found as (" + " union all ".join(f"select * from l{k}" for k in range(1, depth + 1)) + f" order by depth, edge_id, eid, seed limit {cap})"


_RRF = """b as (select query_id, chunk_id, min(rank) filter (path = 'bm25') as bm, min(rank) filter (path = 'exact') as ex, min(rank) filter (path = 'relationship') as re, min(rank) filter (path = 'vector') as ve,
  min(authority_rank) as au, max(first_seen_at) as fs,
  min((coalesce(rank, 2147483647), path || case when len(matched_fields) > 0 then ' ' || array_to_string(matched_fields, ' ') else '' end)) filter (path = 'bm25' and excerpt_trusted) as xb,
  min((coalesce(rank, 2147483647), path || case when len(matched_fields) > 0 then ' ' || array_to_string(matched_fields, ' ') else '' end)) filter (path = 'exact' and excerpt_trusted) as xe,
  min((coalesce(rank, 2147483647), path || case when len(matched_fields) > 0 then ' ' || array_to_string(matched_fields, ' ') else '' end)) filter (path = 'relationship' and excerpt_trusted) as xr,
  min((coalesce(rank, 2147483647), path || case when len(matched_fields) > 0 then ' ' || array_to_string(matched_fields, ' ') else '' end)) filter (path = 'vector' and excerpt_trusted) as xv
  from ranked_candidates group by 1, 2),
s as (select *, 0.0::double + coalesce(0.9::double / (60.0::double + bm), 0) + coalesce(1.0::double / (60.0::double + ex), 0) + coalesce(0.4::double / (60.0::double + re), 0) + coalesce(0.8::double / (60.0::double + ve), 0) as score from b),
fused as (select *, row_number() over (partition by query_id order by score desc, coalesce(ex, 2147483647), coalesce(bm, 2147483647), coalesce(ve, 2147483647), au nulls last, fs desc nulls last, chunk_id)::int as fused_rank,
  coalesce(xb[2], xe[2], xr[2], xv[2]) as excerpt from s)"""

ORACLE = {
    "scope_filtered_chunks": f"with {_SCOPE} select chunk_id, source_id, version_label from scope",
    "scope_narrowed": f"with {_SCOPE} select chunk_id, source_type from scope where visibility_label = 'public' and source_type = 'git_repository'",
    "scope_version_range": f"with {_SCOPE} select chunk_id, version_label from scope where version_label >= 'v1.2' and version_label <= 'v4.1' and first_seen_at >= timestamp '2024-01-01 06:00:00'",
    "scope_fail_closed_empty": f"with {_SCOPE} select chunk_id from scope where false",
    "scope_active_index": f"""with {_SCOPE} select 'fit' as asked, source_id, count(*) as n from scope where source_id in ('src-lantern-core', 'src-tempri-cli', 'src-pritas-svc') group by 2
 union all select 'all', source_id, count(*) from scope group by 2""",
    "scope_post_filter_count": f"with {_SCOPE} select count(*) as n from scope",
    "citation_semi_join": f"with {_SCOPE} select citation_id, chunk_id from citations where {_POLICY}",
    "claim_scope": f"with {_SCOPE}, {_CLAIMS} select claim_id, citation_item_id from okclaims",
    "fact_scope": f"""with {_SCOPE}, {_CLAIMS} select 'fact:' || substr(o.claim_id, 7) as fact_id, c.source_id, citation_item_id from okclaims o join claims c using (claim_id) where substr(o.claim_id, 7)::bigint % 2 = 0""",
    "entity_union": f"""with {_SCOPE}, {_CLAIMS} select 'chunk' as entity_type, count(*) as n, min(chunk_id) as least, max(chunk_id) as greatest from scope having count(*) > 0
 union all select 'claim', count(*), min(claim_id), max(claim_id) from okclaims having count(*) > 0""",
    "relationship_both_endpoints": f"""with {_SCOPE}, {_CLAIMS}, r as (select 'rel:' || substr(claim_id, 7) as relationship_id, 'chunk:' || substr(claim_id, 7) as a, 'chunk:' || lpad((substr(claim_id, 7)::bigint + 1)::varchar, 9, '0') as b from okclaims)
select relationship_id, a as from_entity_id, b as to_entity_id from r where a in (select chunk_id from scope) and b in (select chunk_id from scope)""",
    "authority_scalar_lookup": f"with {CHUNKS} select source_id, min(coalesce(authority_rank, 1000)) as authority_rank, count(*) as n from chunks group by 1",
    "eligibility_violations": f"""with {CHUNKS} select 'visibility_label_not_allowed' as violation, count(*) as n from chunks where coalesce(visibility_label not in ('public', 'invited_users'), true) having count(*) > 0
 union all select 'sensitivity_class_not_allowed', count(*) from chunks where coalesce(sensitivity_class not in ('public','internal','confidential'), true) having count(*) > 0
 union all select 'corpus_eligibility_label_not_allowed', count(*) from chunks where coalesce(corpus_eligibility_label not in ('default_retrievable'), true) having count(*) > 0
 union all select 'allowed_without_allowed_license', count(*) from chunks where license_policy_status = 'allowed' and coalesce(license_id not in ('MIT','Apache-2.0'), true) having count(*) > 0
 union all select 'license_missing', count(*) from chunks where license_id is null and coalesce(license_policy_status not in ('unknown','review_required'), true) having count(*) > 0""",
    "exact_lookup": f"""with {_SCOPE}, m as (select *, lower(artifact_path) in ('docs/tutorial/plan-token.md') as p, lower(version_label) in ('v4.11') as v, contains(lower(sanitized_text), 'remote log') as t from scope),
x as (select chunk_id, case when p then 'artifact_path' when v then 'version_label' when t then 'sanitized_text' end as matched_field, case when p then 20 when v then 60 when t then 70 end as field_priority,
  coalesce(authority_rank, 1000) as authority_rank, version_label, length(coalesce(artifact_path, '')) as ps from m where p or v or t)
select chunk_id, row_number() over (order by field_priority, authority_rank, version_label desc nulls last, ps desc, chunk_id)::int as rank, matched_field, field_priority, authority_rank from x qualify rank <= 40""",
    "fuzzy_substring": f"""with {_SCOPE} select chunk_id, row_number() over (order by coalesce(authority_rank, 1000), version_label desc nulls last, length(coalesce(artifact_path, '')) desc, chunk_id)::int as rank, 'metadata_fuzzy' as matched_field
from scope where contains(lower(artifact_path), 'archive') or contains(lower(artifact_path), 'reviewer') qualify rank <= 30""",
    "fuzzy_suppressed": f"with {_SCOPE} select chunk_id, 1::int as rank from scope where false",
    "fuzzy_trigram": f"""with {_SCOPE}, w as (select chunk_id, list_filter(string_split_regex(lower(coalesce(artifact_path, '')), '[^a-z0-9]+'), lambda x: length(x) > 0) as a, ['tutorial', 'load', 'archive'] as b from scope),
g as (select chunk_id, list_distinct(flatten(list_transform(a, lambda x: list_transform(range(1, length(x) + 2), lambda i: substr('  ' || x || ' ', i, 3))))) as a,
  list_distinct(flatten(list_transform(b, lambda x: list_transform(range(1, length(x) + 2), lambda i: substr('  ' || x || ' ', i, 3))))) as b from w),
s as (select chunk_id, len(list_intersect(a, b)) as c, len(a) as na, len(b) as nb from g)
select chunk_id, round(c / (na + nb - c)::double, 6) as similarity from s where round(c / (na + nb - c)::double, 6) >= 0.3""",
    "json_field_access": "select event_type, sum(json_extract_string(props, '$.k')::bigint)::bigint as k, count(*) as n from events group by 1",
    "bm25_topk": f"with {_SCOPE}, {_bm25_sql(100)} select chunk_id, score, rank from lex",
    "bm25_batch": f"""with {_SCOPE}, {CANDIDATES}, tk as (select chunk_id, {_TOKENS.format('sanitized_text')} as w from scope), st as (select count(*) as n, avg(len(w)) as a from tk),
post as (select term, chunk_id, dl, count(*) as tf from (select chunk_id, len(w) as dl, unnest(w) as term from tk) group by 1, 2, 3),
q as (select distinct candidate_id as query_id, unnest({_TOKENS.format("array_to_string(heading_path, ' ')")}) as term from cand where candidate_id % 100 = 0 and len(heading_path) > 0),
df as (select term, count(*) as df from post group by 1),
s as (select query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) as score from q join post using (term) join df using (term), st group by 1, 2)
select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from s qualify rank <= 10""",
    "bm25_fallback": f"""with {_SCOPE} select chunk_id, row_number() over (order by chunk_id)::int as rank, 1.0::double as score,
 array_to_string(list_filter([case when contains(lower(sanitized_text), 'the token') then 'sanitized_text' end, case when contains(lower(artifact_path), 'the token') then 'artifact_path' end], lambda x: x is not null), ',') as matched_fields
from scope where contains(lower(sanitized_text), 'the token') or contains(lower(artifact_path), 'the token') qualify rank <= 50""",
    "bm25_fields": f"""with {_SCOPE}, f as (select chunk_id, unnest(['sanitized_text', 'artifact_path', 'artifact_role']) as field, unnest([{_TOKENS.format('sanitized_text')}, {_TOKENS.format('artifact_path')}, {_TOKENS.format('artifact_role')}]) as w from scope),
st as (select field, count(*) as n, avg(len(w)) as a from f group by 1), post as (select field, chunk_id, len(w) as dl, unnest(list_filter(w, lambda x: x in {tuple(WORDS)})) as term from f),
tf as (select field, term, chunk_id, dl, count(*) as tf from post group by 1, 2, 3, 4), df as (select field, term, count(*) as df from tf group by 1, 2),
s as (select chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 9) as score, list_distinct(list(field)) as fs from tf join df using (field, term) join st using (field) group by 1)
select chunk_id, row_number() over (order by score desc, chunk_id)::int as rank, round(score, 7) as score, array_to_string(list_filter(['sanitized_text', 'artifact_path', 'artifact_role'], lambda x: list_contains(fs, x)), ',') as matched_fields from s qualify rank <= 120""",
    "vector_guarded": """with v as (select * from chunk_embeddings where len(list_filter(vector, lambda x: isnan(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0),
q as (select embedding_model_id as m, vector::double[] as q from v where is_active and dimensions = 64 and len(vector) = 64 order by vec_id limit 1),
own as (select chunk_id, max(vector) as vector from v, q where is_active and embedding_model_id = m and len(vector) = 64 group by 1),
s as (select chunk_id, round(1 - list_dot_product(vector::double[], q) / (sqrt(list_dot_product(vector::double[], vector::double[])) * sqrt(list_dot_product(q, q))), 9) + 0.0 as d from own, q)
select chunk_id, row_number() over (order by d, chunk_id)::int as rank, case when (select count(*) from own) <= 200 then 'exact' else 'scan' end as strategy, round(d, 6) + 0.0 as distance, 'i1' as index_id from s qualify rank <= 60""",
    "vector_topk_cosine": f"with {_NEAR} select vec_id, distance, row_number() over (order by distance, vec_id)::int as rank from near qualify rank <= 50",
    "vector_topk_filtered": f"with {_NEAR} select vec_id, distance, row_number() over (order by distance, vec_id)::int as rank from near where label % 2 = 1 qualify rank <= 50",
    "hybrid_alpha": f"""with {_SCOPE}, {_bm25_sql(100)}, {_NEAR}, v as (select 'chunk:' || lpad(vec_id::varchar, 9, '0') as chunk_id, -distance as d from near order by distance, vec_id limit 100),
a as (select chunk_id, case when max(score) over () > min(score) over () then (score - min(score) over ()) / (max(score) over () - min(score) over ()) else 1.0 end as ls from lex),
b as (select chunk_id, case when max(d) over () > min(d) over () then (d - min(d) over ()) / (max(d) over () - min(d) over ()) else 1.0 end as vs from v),
s as (select chunk_id, round(0.6::double * coalesce(vs, 0) + (1 - 0.6::double) * coalesce(ls, 0), 9) as score from a full join b using (chunk_id))
select chunk_id, row_number() over (order by score desc, chunk_id)::int as rank, score from s qualify rank <= 30""",
    "graph_bounded_traversal": f"with {_walk_sql(4, 70, ['r1', 'r3'], 3)} select et as entity_type, eid as entity_id, depth, edge_id, seed as seed_id, array_to_string(path, '>') as path from found",
    "graph_path_check": f"""with c as (select c_custkey as c, c_custkey % 13 as k, 'n' || c_nationkey as f from customer),
e as (select case k when 7 then 'nowhere' when 12 then '' else c::varchar end as item, case when k = 5 then 'elsewhere' else f end as f, case when k = 2 then 7 else 2 end as d, case when k = 12 then '' else c::varchar end as t from c where k <> 11),
w as (select f, d from e group by 1, 2 having count(distinct t) > 60)
select {_BROKEN[1:]!r}[k] as fault, count(*) as n from c where k > 0 group by 1 union all select 'fanout', count(distinct item) from e join w using (f, d) having count(*) > 0""",
    "traversal_seeds": """with m as (select chunk_id, min((case path when 'exact' then 0 else 1 end, rank)) as m from ranked_candidates where path in ('exact', 'bm25') and rank is not null group by 1)
select chunk_id, row_number() over (order by m[1], m[2], chunk_id)::int as seed_rank from m qualify seed_rank <= 25""",
    "rrf_weighted_ties": f"with {_RRF} select query_id, chunk_id, fused_rank, round(score, 9) as fused_score, excerpt from fused",
    "mock_rerank": f"""with {_RRF}, ok as (select query_id, chunk_id, bool_or(excerpt_trusted) as tr, max(eligibility) as el from ranked_candidates group by 1, 2),
i as (select f.*, substr(excerpt, 1, 24) as t, length(excerpt) > 24 as truncated from fused f join ok using (query_id, chunk_id) where tr and el in ('allowed','default_retrievable','eligible') and excerpt is not null and fused_rank <= 15),
o as (select *, row_number() over (partition by query_id order by len(list_intersect(list_distinct({_TOKENS.format('t')}), ['heading_path','exact','symbol_path'])) desc, fused_rank, coalesce(au, 2147483647), fs desc nulls last, chunk_id) as p, count(*) over (partition by query_id) as n from i)
select query_id, chunk_id, (n - p + 1)::double as rerank_score, p::int as reranked_rank, truncated from o""",
    "evidence_packed": f"""with {_SCOPE}, {_bm25_sql(20)}, l as (select chunk_id, rank, sanitized_text as t, 6400 - coalesce(sum(length(sanitized_text)) over (order by rank rows between unbounded preceding and 1 preceding), 0) as left_ from lex join scope using (chunk_id)),
x as (select *, least(length(t), greatest(left_, 0))::int as chars from l) select chunk_id, rank, ceil(chars / 4.0)::int as estimated_tokens, chars < length(t) as truncated, chars, md5(substr(t, 1, chars)) as digest from x where chars > 0""",
    "token_budget_pack": """with l as (select source_id, doc_id, length(text) as len, 80000 - coalesce(sum(length(text)) over (partition by source_id order by doc_id rows between unbounded preceding and 1 preceding), 0) as left_ from documents where source_id is not null),
x as (select *, least(len, greatest(left_, 0)) as chars from l) select source_id, doc_id, ceil(chars / 4.0)::int as estimated_tokens, chars < len as truncated, chars::int as chars from x where chars > 0""",
    "citation_validation": rf"""with {_SCOPE}, t as (select c.*, regexp_replace(url, '/$', '') || '/docs' as u from citations c join sources s using (source_id) where url is not null)
select citation_id, u as source_url from t where regexp_matches(u, '^https?://[^/?#@\s]+(/[^?#\s]*)?$') and not regexp_matches(source_id || ' ' || source_version_id || ' ' || source_type || ' ' || chunk_id, '(?i)\b(token|secret|password|credential|api[_-]?key)\b')""",
    "evidence_records": rf"""with {_SCOPE}, t as (select c.*, regexp_replace(url, '/$', '') || '/docs' as u from citations c join sources s using (source_id) where url is not null)
select chunk_id as item_id, source_id from scope where chunk_id in (select chunk_id from t where regexp_matches(u, '^https?://[^/?#@\s]+(/[^?#\s]*)?$') and not regexp_matches(source_id || ' ' || source_version_id || ' ' || source_type, '(?i)\b(token|secret|password|credential|api[_-]?key)\b'))""",
    "conflict_markers": f"""with {CHUNKS}, {VERSIONS}, g as (select sanitized_content_hash as conflict_id, min(chunk_id) as a, max(chunk_id) as b from chunks where length(sanitized_text) > 0 group by 1 having min(chunk_id) < max(chunk_id))
select conflict_id, 'open' as status, a || '|' || b as items, 'citation:' || substr(a, 7) || '|citation:' || substr(b, 7) as cites from g where a in (select chunk_id from citations) and b in (select chunk_id from citations)""",
    "hash_embedding": f"""with {CHUNKS}, h as (select chunk_id, list_transform([0, 1, 2], lambda n: sha256('local|hash-1|20|' || sanitized_content_hash || '|' || n)) as h from chunks),
n as (select chunk_id, list_slice(flatten(list_transform(h, lambda x: list_transform([0,1,2,3,4,5,6,7], lambda i: list_sum(list_transform([1,2,3,4,5,6,7,8], lambda j: (strpos('0123456789abcdef', substr(x, i * 8 + j, 1)) - 1) * (16 ** (8 - j))))::double / 4294967295.0::double * 2.0 - 1.0))), 1, 20) as v from h),
u as (select chunk_id, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 9)) as v from n)
select chunk_id, v[1] as v0, v[8] as v7, v[9] as v8, v[20] as v19, 20::int as dimensions from u""",
    "embedding_job_plan": f"""with {CHUNKS}, {VERSIONS}, c as (select * from chunks where source_version_id is not null and chunk_id in (select chunk_id from chunk_versions where is_current and tombstoned_at is null))
select chunk_id, case when not (length(coalesce(sanitized_text, '')) > 0 and coalesce(license_policy_status = 'allowed', false) and coalesce(corpus_eligibility_label in ('allowed','default_retrievable','eligible'), false)) then 'skip'
  when doc_id % 3 = 0 then 'none' when doc_id % 5 in (0, 4) then 'none' when doc_id % 5 = 1 then 'reset' else 'create' end as action,
  'embedding-job:' || sha256(concat_ws(chr(31), chunk_id, 'm', 'i', sanitized_content_hash)) as job_id from c""",
    "embedding_job_pass": """with j as (select *, case event_type when 'view' then 'pending' when 'click' then 'retrying' else 'succeeded' end as st from events),
c as (select * from j where st in ('pending', 'retrying') and (event_type <> 'click' or ts <= timestamp '2024-01-10') order by ts, user_id limit 500)
select case when value < 5 then 'succeeded' when value < 10 then 'cancelled' when event_id % 3 + 1 >= 3 then 'failed' else 'retrying' end as status, (event_id % 3 + 1)::int as attempt_count, count(*) as n from c group by 1, 2""",
    "vector_deactivation": f"with {CHUNKS} select doc_id % 3 = 0 as is_active, count(*) as n from chunks where source_version_id is not null group by 1",
    "eval_recall_mrr_ndcg": """with e as (select distinct query_id, chunk_id from ranked_candidates where path = 'exact' and rank <= 3), r as (select query_id, chunk_id, min(rank) as rank, bool_or(excerpt_trusted) as cited from ranked_candidates where path = 'bm25' and rank is not null group by 1, 2),
g as (select query_id, count(*) as n, count(*) filter (rank <= 5) as k, min(rank) as first, sum(case when rank <= 10 then 1 / log2(rank + 1.0) else 0.0 end) as dcg, count(*) filter (rank is not null and coalesce(cited, false)) as wc, count(*) filter (rank is not null) as f from e left join r using (query_id, chunk_id) group by 1)
select query_id, round(k / n::double, 9) as recall_at_k, (k > 0)::int as hit, round(case when first <= 10 then 1 / first::double else 0.0 end, 9) as reciprocal_rank,
 round(dcg / list_sum(list_transform(range(1, least(n, 10)::int + 1), lambda i: 1 / log2(i + 1.0))), 9) as ndcg, round(case when f > 0 then wc / f::double else 0.0 end, 9) as citation_coverage from g""",
}
ORACLE["eval_means"] = (
    "with p as (" + ORACLE["eval_recall_mrr_ndcg"] + ") select count(*) as queries, round(avg(recall_at_k), 9) as recall_at_k, round(avg(hit), 9) as hit, round(avg(reciprocal_rank), 9) as reciprocal_rank, round(avg(ndcg), 9) as ndcg, round(avg(citation_coverage), 9) as citation_coverage from p"
)
_FILE = r"\.(md|txt|ya?ml|json|toml|py|ts|js|html)$"


def _once(x: str) -> str:
    return f"coalesce(list_reduce(list_transform({x}, lambda x: [x]), lambda a, x: case when list_contains(a, x[1]) then a else a || x end), [])"


_PATH = f"(contains(x, '/') or regexp_matches(x, '{_FILE}'))"
_STRIPPED = r"list_filter(list_transform(regexp_extract_all(q, '[A-Za-z0-9_./:{}/?-]+'), lambda x: regexp_replace(x, '^[.,;()\[\]]+|[.,;()\[\]]+$', '', 'g')), lambda x: length(x) > 0)"
_QUOTED = "list_transform(regexp_extract_all(q, '\"[^\"]+\"|''[^'']+'''), lambda x: trim(substr(x, 2, length(x) - 2)))"
_KEYS = "list_filter(list_transform(list_filter(t, lambda x: starts_with(x, '--') or contains(x, '_') or starts_with(x, '$')), lambda x: regexp_replace(x, '^[-$]+', '')), lambda x: length(x) > 0)"
_KIND_SQL = {
    "symbols": f"list_filter(t, lambda x: contains(x, '::') or (contains(x, '.') and not {_PATH}))",
    "artifact_paths": f"list_filter(t, lambda x: {_PATH})",
    "endpoint_paths": "list_filter(t, lambda x: starts_with(x, '/') and length(x) > 1)",
    "schema_keys": _once(_KEYS),
    "version_strings": "list_filter(t, lambda x: regexp_matches(x, '^[vV]?[0-9]+([.][0-9]+){1,3}([-+][A-Za-z0-9_.-]+)?$'))",
    "error_strings": "list_filter(t, lambda x: regexp_matches(x, '^([A-Z][A-Z0-9_]{2,}|[A-Za-z]+(Error|Exception))$'))",
    "quoted_strings": "quoted",
    "fuzzy_terms": "list_filter(t, lambda x: length(x) >= 4 and regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_]*$'))",
}
ORACLE["query_intent"] = (
    f"with {CANDIDATES}, q as (select candidate_id, concat_ws(' ', '''exact words''', signature_text, locator, 'v1.2.3 --flag_name ValueError') as q from cand where signature_text is not null or locator is not null),"
    f" d as (select candidate_id, {_once(_STRIPPED)} as t, {_once(_QUOTED)} as quoted from q) select candidate_id, "
    + ", ".join(f"array_to_string({v}, '|') as {k}" for k, v in _KIND_SQL.items())
    + " from d"
)
