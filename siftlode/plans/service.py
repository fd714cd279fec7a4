"""Whole plans: artifacts to stored chunks, and a query text to a cited evidence bundle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlode.operators import chunking, evidence, extract, fusion, graph, intent, redaction, retrieval
from siftlode.operators.embedding import query_vector
from siftlode.operators.scope import covered_by
from siftlode.plans.runtime import cut, stored


def ingest(artifacts: DataFrame, sizes: dict[str, tuple[int, int]] | None = None, rules: list[redaction.Rule] | None = None) -> dict[str, DataFrame]:
    """Artifacts to candidates, redacted candidates, chunks and citations.

    ``artifacts``: file_id, source_id, path, artifact_role, language, content, sensitivity_class and license_label.
    Only redacted rows reach the chunks; a row that did not pass is an error. All frames are lazy and share one lineage.
    """
    kept = ["file_id", "source_id", "path", "sensitivity_class", "license_label"]
    found = extract.extract(artifacts, kept).where("ordinal is not null")
    clean = redaction.redact(found, "text", "sensitivity_class", rules)
    clean = clean.withColumn("sensitivity_class", redaction.raise_sensitivity(F.col("sensitivity_class"), F.col("findings")))
    clean = redaction.require_redacted(redaction.classify_license(clean, "sanitized_text", "license_label"))
    chunks = chunking.chunk_candidates(clean.drop("text").withColumnRenamed("ordinal", "candidate_ordinal"), sizes)
    keep = ["source_id", "path", "locator", "line_start", "line_end", "sensitivity_class", "license_policy_status"]
    return {"candidates": found, "sanitized": clean, "chunks": chunks, "citations": chunking.citations(chunks, keep)}


def retrieve(
    query: str,
    profile: dict,
    scope: DataFrame,
    vectors: DataFrame,
    citations: DataFrame,
    edges: DataFrame | None = None,
    embedding: tuple[str, str, int] = ("local", "hash-1", 64),
    fuzzy: bool = False,
    index: str | None = None,
    indexes: DataFrame | None = None,
    models: DataFrame | None = None,
    conflicts: tuple[DataFrame, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Every stage of one query: exact, bm25, vector, relationship, fused, reranked, packed, conflicts and bundle.

    ``profile``: see :func:`siftlode.sources.config.resolve_profile`. ``scope``: allowed chunks with chunk_id,
    sanitized_text and labels; ``vectors``: chunk_id and vector of the profile's embedding; ``citations``: of the
    chunks; ``edges``: the allowed relations between chunks (with citation_ids, or each its own citation), used if the profile
    enables the traversal. ``indexes``: the index table; each path then sees only what the active index ``index`` covers
    for it. ``models`` with ``indexes``: the vectors (with embedding_model_id and is_active) are searched behind the guards of
    model and index. ``conflicts``: (conflicts, claims), marked where both sides are packed. The scope is
    written once, since every path reads it; the lists that follow hold at most some hundred rows.
    """
    limit, weights = profile["limits"], profile["weights"]
    scope = cut(scope)

    def within(kind: str, name: str | None) -> DataFrame:
        return scope if indexes is None else scope.where(covered_by(indexes, index, kind, name))

    parsed = intent.parse_intent(query)
    terms = retrieval.terms_by_field(intent.field_terms(parsed), profile.get("exact_fields") or list(retrieval.PRIORITY))
    known = within("exact", None)
    exact = retrieval.exact_lookup(known, terms, limit["exact"] or 20)
    if fuzzy:
        like = retrieval.fuzzy_lookup(known, parsed["fuzzy_terms"], limit["exact"] or 20, unless=exact)
        exact = exact.unionByName(like.select(*exact.columns))
    fields = [f for f in profile.get("bm25_fields") or ["sanitized_text"] if f in scope.columns]
    post, sizes = retrieval.field_index(within("bm25", profile["profile_id"]), fields)
    lexical = retrieval.search_index(stored(post), stored(sizes), re.findall(r"[a-z0-9_]+", query.lower()), fields, limit["bm25"] or 50)
    probe = query_vector(query, *embedding)
    reach = within("vector", profile.get("embedding_profile_id")).select("chunk_id")
    if models is not None:
        near = retrieval.guarded_vector_search(vectors, models, indexes, embedding[1], index, probe, reach, limit["vector"] or 50)
    else:
        near = retrieval.vector_search(vectors.join(reach, "chunk_id", "left_semi"), probe, limit["vector"] or 50)
    # a text is trusted if the scope says so, or else if its redaction has been done or was not needed
    trusted = F.col("excerpt_trusted") if "excerpt_trusted" in scope.columns else F.col("redaction_status").isin("redacted", "not_required")
    base = scope.select("chunk_id", "authority_rank", "first_seen_at", F.col("sanitized_text").alias("excerpt"), trusted.alias("excerpt_trusted"))
    lists = {"exact": exact.select("chunk_id", "rank"), "bm25": lexical.select("chunk_id", "rank"), "vector": near.select("chunk_id", "rank")}
    walk = profile.get("traversal") or {}
    if edges is not None and walk.get("enabled"):
        lists["relationship"] = _related(_together(lists), edges, walk, scope)
    fused = fusion.weighted_rrf(_together(lists).join(base, "chunk_id"), weights).where(F.col("fused_rank") <= (limit["fused"] or 60))
    labels = scope.select("chunk_id", F.col("corpus_eligibility_label").alias("eligibility"), "source_id", "sanitized_content_hash", trusted.alias("excerpt_trusted"))
    inputs = cut(fusion.rerank_inputs(fused.join(labels, "chunk_id"), limit["rerank"] or 10, 2048))
    ordered = fusion.rerank(inputs, lambda i: fusion.overlap_scores(i, F.lit(query), []), [], fallback=True)
    ids = evidence.grouped_citations(citations).withColumnRenamed("item_id", "chunk_id")
    cited = ordered.join(ids, "chunk_id").withColumns({"rank": F.col("reranked_rank"), "item_id": F.col("chunk_id"), "sanitized_text": F.col("excerpt")})
    packed = evidence.pack_budget(cited.drop("excerpt"), profile.get("token_budget") or 1600)
    bundle = evidence.bundle(packed, evidence.valid_citations(citations), query, profile.get("token_budget") or 1600, profile["profile_id"], index)
    out = {**lists, "fused": fused, "reranked": ordered, "packed": packed, "bundle": bundle}
    if conflicts is not None:
        out["conflicts"] = evidence.conflict_markers(*conflicts, citations.select("citation_id", "item_id"), packed.select("item_id"), strict=False)
    return out


def _related(ranked: DataFrame, edges: DataFrame, walk: dict, scope: DataFrame) -> DataFrame:
    """(chunk_id, rank): what relations reach from the best candidates, without paths that break the profile's rules."""
    cap, direction = walk["max_relationship_candidates"], walk.get("direction", "outbound")
    seeds = cut(graph.seed_candidates(ranked, walk.get("seed_sources") or ["exact", "bm25", "vector"], cap))
    start = [("chunk", r["chunk_id"]) for r in seeds.orderBy("seed_rank").collect()]  # at most the profile's candidates
    reached = graph.traverse(edges, start, walk["relationship_types"], walk["max_depth"], walk["max_fanout_per_seed"], cap, direction)
    numbered = reached.select("entity_id", "depth", "edge_id", "path", F.xxhash64("seed_id", "path").alias("_p"))
    steps = numbered.select("_p", F.posexplode("path").alias("n", "s")).select("_p", "n", "s", F.col("s.edge_id").alias("edge_id"))
    cites = edges.select("edge_id", "citation_ids") if "citation_ids" in edges.columns else None
    own = steps.withColumn("citation_ids", F.array("edge_id")) if cites is None else cites.join(F.broadcast(steps), "edge_id", "right")  # some hundred steps
    full = own.groupBy("_p").agg(F.array_sort(F.collect_list(F.struct("n", "s", "citation_ids"))).alias("x"))
    path = F.transform("x", lambda x: F.struct(*[x["s"][c].alias(c) for c in ("relationship_type", "direction", "depth", "from_id", "to_id")], x["citation_ids"].alias("citation_ids")))
    fit = scope.select(F.col("chunk_id").alias("entity_id"), F.lit(True).alias("_fit")).join(F.broadcast(numbered.select("entity_id").distinct()), "entity_id", "left_semi")
    order = Window.partitionBy(F.lit(0)).orderBy("depth", "edge_id", "entity_id", "_p")  # at most the profile's candidates
    paths = cut(
        numbered.drop("path").join(full, "_p").join(fit, "entity_id", "left").select(
            F.col("entity_id").alias("item_id"), path.alias("path"), F.lit("relationship").alias("retrieval_path"), F.coalesce("_fit", F.lit(False)).alias("endpoint_eligible"),
            F.row_number().over(order).alias("rank"),
        )
    )
    good = graph.sound_candidates(paths, walk["relationship_types"], walk["max_depth"], direction, cap, seeds.select(F.col("chunk_id").alias("seed_id")), walk["max_fanout_per_seed"])
    return good.select(F.col("item_id").alias("chunk_id"), "rank")


def _together(lists: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in sorted(lists.items()):
        part = df.select("chunk_id", F.lit(name).alias("path"), F.col("rank").cast("int").alias("rank"))
        out = part if out is None else out.unionByName(part)
    return out
