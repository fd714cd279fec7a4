"""Candidate retrievers over a scope of chunks: exact and fuzzy lookup, BM25, vectors, and both in one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlode.plans.runtime import parallelism, stored

#: Fields by priority (small first), fields of the metadata, fields matched as a whole.
PRIORITY = {
    "symbol_path": 10, "artifact_path": 20, "structure_path": 30, "heading_path": 40, "signature_text": 50, "version_label": 60, "sanitized_text": 70,
}
METADATA_PRIORITY = {
    "endpoint_path": 15, "schema_key": 25, "schema_path": 26, "field_name": 27, "flag_name": 28, "method_name": 29, "function_name": 30,
    "error_string": 31, "import_path": 32, "commit_sha": 33, "release_tag": 34, "first_seen_version": 35, "last_seen_version": 36,
    "claim_subject": 37, "claim_predicate": 38, "citation_id": 39, "tracked_ref": 41, "change_summary": 65,
}
WHOLE = ["symbol_path", "artifact_path", "version_label"]
FUZZY_FIELDS = ["symbol_path", "artifact_path", "heading_path"]
K1, B = 1.2, 0.75


def _text(scope: DataFrame, name: str) -> Column:
    kind = scope.schema[name].dataType.simpleString()
    return F.to_json(name) if kind.startswith("array") else F.col(name)


def _numbered(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows by a total order, with their rank; the top-k is taken per task before one task numbers it."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def _lookup_order() -> list[Column]:
    return [
        F.col("field_priority").asc(), F.col("authority_rank").asc(), F.col("version_label").desc_nulls_last(),
        F.col("path_specificity").desc(), F.col("chunk_id").asc(),
    ]


def terms_by_field(parsed: dict[str, list[str]], fields: list[str]) -> dict[str, list[str]]:
    """Terms of the profile's fields: parsed ones by field, and all terms for a metadata field."""
    every = [t for terms in parsed.values() for t in terms]
    out = {f: parsed[f] if f in parsed else (every if f in METADATA_PRIORITY else []) for f in fields}
    return {f: list(dict.fromkeys(t)) for f, t in out.items() if t}


def exact_lookup(scope: DataFrame, terms: dict[str, list[str]], limit: int) -> DataFrame:
    """Chunks with any term in its field, best field first, with matched_field, field_priority and rank.

    Case does not matter. Symbol, path and version must equal a term, other fields contain it, as plain text
    (no wildcards). Order: field priority, authority (null = 1000), version descending with null last, longer
    path, id. Fields the scope lacks are ignored; no terms give no rows.
    """
    clauses = []
    for name, values in terms.items():
        if name not in scope.columns:
            continue
        c = F.lower(_text(scope, name))
        cond = F.lit(False)
        for v in values:
            cond = cond | (c == v.lower() if name in WHOLE else c.contains(v.lower()))
        clauses.append((name, F.coalesce(cond, F.lit(False))))
    label, first = F.lit("none"), F.lit(999)
    hit = F.lit(False)
    for name, cond in reversed(clauses):
        label = F.when(cond, name).otherwise(label)
        first = F.when(cond, PRIORITY.get(name, METADATA_PRIORITY.get(name, 80))).otherwise(first)
        hit = hit | cond
    found = scope.where(hit).withColumns(
        {
            "matched_field": label, "field_priority": first, "path_specificity": F.length(F.coalesce("artifact_path", F.lit(""))),
            "authority_rank": F.coalesce("authority_rank", F.lit(1000)),
        }
    )
    return _numbered(found, _lookup_order(), limit)


def trigrams(text: Column) -> Column:
    """The set of three-letter pieces of the words of a text, each word with two blanks before and one behind."""
    words = F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: F.length(w) > 0)
    piece = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, piece)))


def similarity(a: Column, b: Column) -> Column:
    """Share of common trigrams among all of both texts."""
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(both, F.size(x) + F.size(y) - both), F.lit(0.0))


def fuzzy_lookup(scope: DataFrame, terms: list[str], limit: int, least: float | None = None, unless: DataFrame | None = None) -> DataFrame:
    """Chunks whose symbol, path or heading is like a term: contains it, or with ``least`` shares that much of the trigrams.

    ``unless``: exact results; if it has any row, there are no fuzzy ones.
    """
    fields = [f for f in FUZZY_FIELDS if f in scope.columns]
    cond = F.lit(False)
    for f in fields:
        for t in terms:
            c = _text(scope, f)
            cond = cond | F.coalesce(F.lower(c).contains(t.lower()) if least is None else similarity(c, F.lit(t)) >= least, F.lit(False))
    found = scope.where(cond).withColumns(
        {
            "matched_field": F.lit("metadata_fuzzy"), "field_priority": F.lit(900), "path_specificity": F.length(F.coalesce("artifact_path", F.lit(""))),
            "authority_rank": F.coalesce("authority_rank", F.lit(1000)),
        }
    )
    if unless is not None:
        none = unless.agg(F.count(F.lit(1)).alias("_n")).where("_n = 0")  # one row or none
        found = found.join(F.broadcast(none), F.lit(True), "left_semi")
    return _numbered(found, _lookup_order(), limit)


def tokens(text: Column) -> Column:
    """Lower-case words of ASCII letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))


def bm25(scope: DataFrame, query: list[str], text: str = "sanitized_text", limit: int = 50, k1: float = K1, b: float = B) -> DataFrame:
    """(chunk_id, score, rank): the best chunks by BM25 over the words of ``text``.

    Only the query's words are counted: one pass gives each chunk its length and its counts of them, so
    nothing is exploded; the corpus size, mean length and document frequencies are one aggregate row, which
    this function fetches before it returns.
    Scores are rounded to 9 digits; ties go to the smaller id; chunks without any word have no row.
    """
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    words = list(dict.fromkeys(w.lower() for w in query))
    t = scope.select("chunk_id", tokens(F.col(text)).alias("_w"))

    def count_of(w: str) -> Column:
        return F.size(F.filter("_w", lambda x: x == w))

    tf = [count_of(w).alias(f"_f{i}") for i, w in enumerate(words)]
    counted = t.select("chunk_id", F.size("_w").alias("_dl"), *tf)
    counted = stored(counted)  # a few numbers a chunk: texts are cut into words once
    stats = counted.agg(
        F.count(F.lit(1)).alias("n"), F.avg("_dl").alias("avg"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"d{i}") for i in range(len(words))]
    ).first()  # one row
    score, some = F.lit(0.0), F.lit(False)
    for i in range(len(words)):
        f, df = F.col(f"_f{i}"), stats[f"d{i}"]
        idf = F.log(F.lit(1 + (stats["n"] - df + 0.5) / (df + 0.5)))
        score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("_dl") / F.lit(float(stats["avg"] or 1))))
        some = some | (f > 0)
    scored = counted.where(some).select("chunk_id", F.round(score, 9).alias("score"))
    return _numbered(scored, [F.col("score").desc(), F.col("chunk_id").asc()], limit)


def postings(scope: DataFrame, text: str = "sanitized_text") -> DataFrame:
    """(term, chunk_id, tf, dl): the inverted file of a scope, to be written once, clustered by term, and read by many queries."""
    t = scope.select("chunk_id", tokens(F.col(text)).alias("_w"))
    return t.select("chunk_id", F.size("_w").alias("dl"), F.explode("_w").alias("term")).groupBy("term", "chunk_id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def bm25_batch(post: DataFrame, queries: DataFrame, corpus_size: int, mean_length: float, limit: int = 50, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, chunk_id, score, rank) for many queries (query_id, query_text) over an inverted file.

    Each term's frequency is counted once and joined to its postings; the join is on the term, where adaptive
    execution splits frequent terms; the best rows per query are a window over (query, score).
    """
    q = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query_text")))).alias("term"))
    freq = post.join(q.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    hits = post.join(q.join(freq, "term"), "term")
    idf = F.log(1 + (F.lit(corpus_size) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(mean_length)))
    s = hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id").asc())
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def field_index(scope: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """The inverted file over several fields (field, term, chunk_id, tf, dl) and the field sizes (field, chunks, words).

    To be written once and read by every query: rows lie in order of their term, so that a query for a few terms
    skips the other files and row groups by their bounds. A frequent term spreads over several files.
    """
    parts = [F.struct(F.lit(f).alias("field"), tokens(F.array_join(f, " ") if _is_list(scope, f) else F.col(f)).alias("w")) for f in fields]
    each = scope.select("chunk_id", F.explode(F.array(*parts)).alias("x")).select("chunk_id", "x.field", "x.w")
    sizes = each.groupBy("field").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.size("w")).alias("words"))
    rows = each.select("field", "chunk_id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("field", "term", "chunk_id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    ordered = rows.repartitionByRange(parallelism(scope.sparkSession), "term", "chunk_id").sortWithinPartitions("term", "field", "chunk_id")
    return ordered.select("field", "term", "chunk_id", "tf", "dl"), sizes


def _is_list(scope: DataFrame, field: str) -> bool:
    return scope.schema[field].dataType.simpleString().startswith("array")


def candidate_limit(n: int) -> int:
    """The number of candidates a profile may ask a path for: 50 to 200."""
    if not 50 <= n <= 200:
        raise ValueError("candidate limit must be between 50 and 200")
    return n


def search_index(index: DataFrame, sizes: DataFrame, query: list[str], fields: list[str], limit: int = 50, k1: float = K1, b: float = B) -> DataFrame:
    """(chunk_id, score, matched_fields, rank) of a :func:`field_index`: any word in any field, scores of the fields added up.

    matched_fields are in the order of ``fields``. The words and fields are pushed to the scan; the frequencies of
    the query's words are one aggregate of at most words x fields rows.
    """
    limit = candidate_limit(limit)
    words = list(dict.fromkeys(w.lower() for w in query))
    hits = index.where(F.col("term").isin(words) & F.col("field").isin(fields))
    freq = hits.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    known = freq.join(F.broadcast(sizes), "field")  # a row per field
    j = hits.join(F.broadcast(known), ["field", "term"])
    idf = F.log(1 + (F.col("chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = F.col("dl") * F.col("chunks") / F.greatest(F.col("words"), F.lit(1))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * length))
    found = j.groupBy("chunk_id").agg(F.round(F.sum(part), 9).alias("score"), F.collect_set("field").alias("_f"))
    names = F.filter(F.array(*[F.lit(f) for f in fields]), lambda x: F.array_contains("_f", x))
    return _numbered(found.select("chunk_id", "score", names.alias("matched_fields")), [F.col("score").desc(), F.col("chunk_id").asc()], limit)


def substring_search(scope: DataFrame, query: str, fields: list[str], limit: int) -> DataFrame:
    """The plain stand-in for BM25: chunks whose fields hold the whole query, score 1, with matched_fields."""
    q = query.lower()
    hits = [F.when(F.lower(_text(scope, f)).contains(q), F.lit(f)) for f in fields]
    found = scope.withColumn("matched_fields", F.filter(F.array(*hits), lambda x: x.isNotNull())).where(F.size("matched_fields") > 0)
    return _numbered(found.withColumn("score", F.lit(1.0)), [F.col("score").desc(), F.col("chunk_id").asc()], limit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 if either vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, 1 - dot(a, b) / norm).otherwise(1.0)


def vector_search(vectors: DataFrame, query: list[float], limit: int = 50, key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """(key, distance, rank): the nearest vectors by cosine distance, exactly; only equal dimensions are compared.

    Distances are rounded to 9 digits, ties go to the smaller key. One pass and a top-k: no shuffle of vectors.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    d = vectors.where(F.size(vector) == len(query)).select(key, F.round(cosine_distance(F.col(vector), q), 9).alias("distance"))
    return _numbered(d, [F.col("distance").asc(), F.col(key).asc()], limit)


def guarded_vector_search(
    vectors: DataFrame, models: DataFrame, indexes: DataFrame, model_id: str, index_id: str, query: list[float], scope: DataFrame | None = None, limit: int = 50, threshold: int = 200
) -> DataFrame:
    """:func:`vector_search` behind its guards, with the strategy: (chunk_id, distance, rank, strategy).

    ``models``: id, promotion_status, dimensions; ``indexes``: id, status, embedding_model_id; ``vectors``: chunk_id,
    embedding_model_id, is_active, vector. A missing, inactive or retired model and an index that is missing, not
    active or bound to another model give no rows; a query of other dimensions than the model is an error. Only active
    vectors of the model, of its length, and of chunks in ``scope`` are searched. Strategy is ``exact`` up to
    ``threshold`` searched vectors, else ``scan``: also exact, spread over all tasks.
    """
    limit = candidate_limit(limit)
    model = models.where(F.col("id") == model_id).first()
    index = indexes.where((F.col("id") == index_id) & (F.col("status") == "active") & (F.col("embedding_model_id") == model_id)).first()
    usable = model is not None and model["promotion_status"] not in ("inactive", "retired") and index is not None
    if usable and model["dimensions"] != len(query):
        raise ValueError("query and model dimensions differ")
    chosen = vectors.where(F.lit(usable) & F.col("is_active") & (F.col("embedding_model_id") == model_id) & (F.size("vector") == len(query)))
    if scope is not None:
        chosen = chosen.join(scope.select("chunk_id"), "chunk_id", "left_semi")
    best = chosen.groupBy("chunk_id").agg(F.max(F.struct("vector")).alias("m")).select("chunk_id", "m.vector")
    few = best.select("chunk_id").limit(threshold + 1).count() <= threshold
    return vector_search(best, query, limit).withColumn("strategy", F.lit("exact" if few else "scan"))


def check_vector_index(model: dict | None, index: dict | None, dimensions: int) -> None:
    """Raises unless the model is usable, the index is active and bound to it, and the dimensions agree."""
    if model is None or model.get("status") in ("inactive", "retired"):
        raise ValueError("embedding model is missing or not active")
    if index is None or index.get("status") != "active" or index.get("embedding_model_id") != model.get("id"):
        raise ValueError("vector index is missing, not active or bound to another model")
    if model.get("dimensions") != dimensions:
        raise ValueError("query and index dimensions differ")


def search_strategy(filtered: int, threshold: int = 200) -> str:
    """``exact`` for a small scope, else ``ann`` (the partition index)."""
    return "exact" if filtered <= threshold else "ann"


def hybrid_search(lexical: DataFrame, near: DataFrame, alpha: float, limit: int, key: str = "chunk_id") -> DataFrame:
    """One ranking of both: scores scaled to 0..1 per side, ``alpha`` for the vectors and the rest for the words.

    A chunk that one side lacks has 0 there; if all scores of a side are equal, they count as 1.
    """
    edge = lambda c: (F.min(c).over(Window.partitionBy(F.lit(0))), F.max(c).over(Window.partitionBy(F.lit(0))))

    def scaled(df: DataFrame, value: Column, name: str) -> DataFrame:
        v = df.select(key, value.alias("_v"))  # a top-k list, at most some hundred rows
        low, high = edge(F.col("_v"))
        return v.select(key, F.when(high > low, (F.col("_v") - low) / (high - low)).otherwise(1.0).alias(name))

    both = scaled(lexical, F.col("score"), "lexical_score").join(scaled(near, -F.col("distance"), "vector_score"), key, "full_outer")
    both = both.withColumns({"lexical_score": F.coalesce("lexical_score", F.lit(0.0)), "vector_score": F.coalesce("vector_score", F.lit(0.0))})
    both = both.withColumn("score", F.round(alpha * F.col("vector_score") + (1 - alpha) * F.col("lexical_score"), 9))
    return _numbered(both, [F.col("score").desc(), F.col(key).asc()], limit)
