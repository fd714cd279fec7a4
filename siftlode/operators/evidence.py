"""From ranked chunks to a bundle of cited excerpts within a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlode.operators.ranking import spread_sum

_UNSAFE = r"(?i)\b(token|secret|password|credential|api[_-]?key)\b"
PROVENANCE = ["source_id", "source_version_id", "item_id", "source_type", "locator", "redaction_status", "visibility_label", "corpus_eligibility_label"]


def safe_provenance(value: Column) -> Column:
    """A string that names no secret, holds no control character and is no local path; null is fine."""
    bad = value.rlike(r"[\p{C}]") | value.rlike(_UNSAFE) | value.rlike(r"^[/~\\]") | value.rlike(r"^.:\\")
    return value.isNull() | ~bad


def safe_url(url: Column) -> Column:
    """A remote http(s) address without credentials, query or fragment."""
    return F.coalesce(url.rlike(r"^https?://[^/?#@\s]+(/[^?#\s]*)?$"), F.lit(False))


def valid_citations(citations: DataFrame) -> DataFrame:
    """Citations whose address and provenance are safe to show, and whose line range is in order."""
    ok = safe_url(F.col("source_url"))
    for c in PROVENANCE:
        if c in citations.columns:
            ok = ok & safe_provenance(F.col(c))
    if "line_start" in citations.columns:
        ok = ok & F.coalesce(F.col("line_end") >= F.col("line_start"), F.lit(True))
    return citations.where(ok)


def usable_records(records: DataFrame, citations: DataFrame) -> DataFrame:
    """Records with text, a hash and citations that all agree with them on item, source, version, eligibility and hash.

    ``records``: item_id, sanitized_text, sanitized_content_hash, source_id, source_version_id,
    corpus_eligibility_label, citation_ids. One citation that is missing or disagrees makes a record unusable.
    """
    c = valid_citations(citations).select(
        "citation_id", F.struct("item_id", "source_id", "source_version_id", "corpus_eligibility_label", "sanitized_content_hash").alias("_c")
    )
    own = F.struct("item_id", "source_id", "source_version_id", "corpus_eligibility_label", "sanitized_content_hash")
    each = records.select("item_id", own.alias("_r"), F.explode("citation_ids").alias("citation_id")).join(c, "citation_id", "left")
    agreed = each.groupBy("item_id").agg(F.bool_and(F.coalesce(F.col("_r") == F.col("_c"), F.lit(False))).alias("_ok")).where("_ok")
    good = (F.length(F.coalesce("sanitized_text", F.lit(""))) > 0) & F.coalesce(F.length("sanitized_content_hash") > 0, F.lit(False))
    return records.where(good).join(agreed.select("item_id"), "item_id", "left_semi")


def grouped_citations(citations: DataFrame) -> DataFrame:
    """(item_id, citation_ids sorted) of the safe citations."""
    return valid_citations(citations).groupBy("item_id").agg(F.array_sort(F.collect_set("citation_id")).alias("citation_ids"))


def pack_budget(ranked: DataFrame, tokens: int, group: list[str] | None = None, rank: str = "rank", text: str = "sanitized_text") -> DataFrame:
    """Add excerpt, estimated_tokens and truncated: texts in rank order until four characters a token are used up.

    The text that meets the end is cut; those behind it are left out. Estimated tokens are a quarter of the
    characters, rounded up. Without ``group`` the rows are one query's list, some hundred at most. With it a group
    may hold any number of rows, ``rank`` is unique within it, and only ranks and lengths are put in order: the
    texts are joined to the rows that fit.
    """
    if not group:
        before = Window.partitionBy(F.lit(0)).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
        out = ranked.withColumn("_used", F.coalesce(F.sum(F.length(text)).over(before), F.lit(0)))
    else:
        keys = [*group, rank]
        sizes = ranked.select(*keys, F.length(text).cast("long").alias("_len")).where("_len > 0")
        used = spread_sum(sizes, group, [F.col(rank).asc()], "_len", "_used").where(F.col("_used") < tokens * 4)
        out = ranked.join(used.select(*keys, "_used"), keys)
    out = out.withColumn("_left", F.greatest(F.lit(tokens * 4) - F.col("_used"), F.lit(0)).cast("int"))
    out = out.withColumn("excerpt", F.substring(F.col(text), F.lit(1), F.col("_left")))
    out = out.withColumns({"estimated_tokens": F.ceil(F.length("excerpt") / 4).cast("int"), "truncated": F.length("excerpt") < F.length(text)})
    return out.where(F.length("excerpt") > 0).drop("_left", "_used")


def conflict_markers(conflicts: DataFrame, claims: DataFrame, citations: DataFrame, items: DataFrame, strict: bool = True) -> DataFrame:
    """Conflicts between claims of which a citation was selected: conflict_id, status, both item and citation ids.

    ``claims``: id, primary_citation_id. If only one side's citation is at hand, the evidence is incomplete:
    an error, or with ``strict=False`` no marker. A marker stays only if both items are among ``items``.
    """
    cite = citations.select("citation_id", "item_id")
    side = lambda s: (
        claims.select(F.col("id").alias(f"{s}_claim_id"), F.col("primary_citation_id").alias(f"{s}_citation_id"))
        .join(cite.select(F.col("citation_id").alias(f"{s}_citation_id"), F.col("item_id").alias(f"{s}_item_id")), f"{s}_citation_id", "left")
    )
    j = conflicts.join(side("left"), "left_claim_id").join(side("right"), "right_claim_id")
    l, r = F.col("left_item_id").isNotNull(), F.col("right_item_id").isNotNull()
    j = j.where(l | r)
    if strict and j.where(~(l & r)).limit(1).count():
        raise ValueError("conflict evidence is incomplete after filtering")
    j = j.where(l & r)
    for s in ("left", "right"):
        j = j.join(items.select(F.col("item_id").alias(f"{s}_item_id")), f"{s}_item_id", "left_semi")
    return j.select(
        "conflict_id", "status", F.array("left_item_id", "right_item_id").alias("competing_item_ids"),
        F.array("left_citation_id", "right_citation_id").alias("competing_citation_ids"),
    )


def bundle(packed: DataFrame, citations: DataFrame, query: str, budget: int, profile: str, index: str | None = None) -> DataFrame:
    """One row with the bundle as JSON: items in rank order, the citations they use, estimate and diagnostics."""
    from siftlode.operators.redaction import safe_text

    used = packed.select(F.explode("citation_ids").alias("citation_id")).distinct()
    cites = citations.join(used, "citation_id", "left_semi").agg(F.array_sort(F.collect_list(F.struct("citation_id", "item_id", "source_id", "source_url"))).alias("citations"))
    items = packed.agg(
        F.array_sort(F.collect_list(F.struct("rank", "item_id", F.col("excerpt").alias("sanitized_excerpt"), "citation_ids", "sanitized_content_hash"))).alias("evidence_items"),
        F.sum(F.length("excerpt")).alias("chars"), F.count_if("truncated").alias("cut"),
    )
    whole = items.withColumn("_one", F.lit(1)).join(cites.withColumn("_one", F.lit(1)), "_one")
    estimate = F.struct(
        F.lit(budget).alias("budget_tokens"), F.ceil(F.coalesce("chars", F.lit(0)) / 4).cast("int").alias("estimated_tokens"), F.col("cut").alias("truncated_item_count")
    )
    body = F.struct(
        safe_text(F.lit(query)).alias("query"), F.transform("evidence_items", lambda x: x["item_id"]).alias("selected_chunk_ids"), "evidence_items",
        "citations", estimate.alias("token_budget"),
        F.struct(F.lit(profile).alias("query_profile_id"), F.lit(index).alias("active_index_version_id"), F.size("evidence_items").alias("selected_candidate_count")).alias("diagnostics"),
    )
    return whole.select(F.to_json(body).alias("bundle"))
