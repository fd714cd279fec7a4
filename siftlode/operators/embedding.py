"""Embeddings without a model, and the jobs that keep vectors in step with their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.functions.identity import embedding_id

EMBEDDABLE = {"redaction_status": ["redacted"], "license_policy_status": ["allowed"], "corpus_eligibility_label": ["allowed", "default_retrievable", "eligible"]}
MAX_ATTEMPTS, RETRY_SECONDS = 3, 30


def hash_embedding(text_hash: Column, profile: str, model: str, dimensions: int) -> Column:
    """A deterministic vector of unit length from a content hash: digests of the seed and a counter, 4 bytes a number.

    Numbers are scaled to -1..1, divided by the length of the vector and rounded to 12 digits. All JVM-side.
    """
    rounds = -(-dimensions // 8)
    seed = F.concat(F.lit(f"{profile}|{model}|{dimensions}|"), text_hash, F.lit("|"))
    digest = lambda n: F.sha2(F.concat(seed, n.cast("string")), 256)
    number = lambda h, i: F.conv(F.substring(h, i * 8 + 1, F.lit(8)), 16, 10).cast("double") / F.lit(4294967295.0) * 2.0 - 1.0
    one = lambda n: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: number(digest(n), i))
    raw = F.slice(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), one)), 1, dimensions)
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    held = F.transform(F.array(raw), lambda v: F.transform(v, lambda x: F.round(x / length(v), 12)))
    return held[0]


def embeddable() -> Column:
    """Text, hash and version are there and the labels allow embedding."""
    ok = (F.length(F.coalesce("sanitized_text", F.lit(""))) > 0) & F.col("sanitized_content_hash").isNotNull() & F.col("source_version_id").isNotNull()
    for c, v in EMBEDDABLE.items():
        ok = ok & F.coalesce(F.col(c).isin(v), F.lit(False))
    return ok


def plan_jobs(chunks: DataFrame, versions: DataFrame, vectors: DataFrame, jobs: DataFrame, model: str, index: str, sources: list[str] | None = None) -> DataFrame:
    """(chunk_id, sanitized_content_hash, job_id, action) for the chunks of an index.

    Actions: skip (not embeddable; its vectors go), none (an active vector or an open job has this hash), reset
    (its job failed for good), create. ``sources``: the index's scope; an empty list plans nothing, None is no
    limit. ``vectors``: chunk_id, embedding_model_id, index_version_id, sanitized_content_hash, is_active;
    ``jobs``: the same with status. Chunks without a current version are left out.
    """
    c = chunks if sources is None else chunks.where(F.col("source_id").isin(sources) if sources else F.lit(False))
    current = versions.where(F.col("is_current") & F.col("tombstoned_at").isNull()).select("chunk_id")
    c = c.where("source_version_id is not null").join(current, "chunk_id", "left_semi")
    same = (F.col("embedding_model_id") == model) & (F.col("index_version_id") == index)
    keys = ["chunk_id", "sanitized_content_hash"]
    have = vectors.where(same & F.col("is_active")).select(*keys).distinct().withColumn("_v", F.lit(True))
    j = jobs.where(same).groupBy(*keys).agg(
        F.bool_or(F.col("status").isin("pending", "running", "retrying")).alias("_open"), F.bool_or(F.col("status") == "failed").alias("_failed")
    )
    action = (
        F.when(~embeddable(), "skip").when(F.col("_v"), "none").when(F.col("_open"), "none").when(F.col("_failed"), "reset").otherwise("create")
    )
    job = F.regexp_replace(embedding_id(F.col("chunk_id"), F.lit(model), F.lit(index), F.col("sanitized_content_hash")), "^embedding:", "embedding-job:")
    return c.join(have, keys, "left").join(j, keys, "left").select(*keys, job.alias("job_id"), action.alias("action"))


def claim(jobs: DataFrame, batch: int, now: Column) -> DataFrame:
    """The next jobs that are due: pending ones and those whose retry time has come, oldest first, then by chunk."""
    due = F.col("status").isin("pending", "retrying") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))
    return jobs.where(due).orderBy("created_at", "chunk_id").limit(batch)


def finish(claimed: DataFrame, now: Column) -> DataFrame:
    """Claimed jobs after a pass: ``outcome`` is ok, changed or error.

    Ok is succeeded; a changed text cancels; an error is retried after RETRY_SECONDS until MAX_ATTEMPTS are used up.
    """
    tries = F.col("attempt_count") + 1
    status = (
        F.when(F.col("outcome") == "ok", "succeeded").when(F.col("outcome") == "changed", "cancelled").when(tries >= MAX_ATTEMPTS, "failed").otherwise("retrying")
    )
    wait = (now.cast("timestamp") + F.expr(f"interval {RETRY_SECONDS} seconds"))
    return claimed.withColumns({"_s": status, "_a": tries}).withColumns(
        {"status": F.col("_s"), "attempt_count": F.col("_a"), "next_retry_at": F.when(F.col("_s") == "retrying", wait)}
    ).drop("_s", "_a")


def run_pass(jobs: DataFrame, chunks: DataFrame, vectors: DataFrame, provider: tuple[str, str, int], batch: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """One pass of the worker: (all jobs after it, all vectors after it).

    ``jobs``: id, chunk_id, sanitized_content_hash, embedding_model_id, index_version_id, status, attempt_count,
    next_retry_at, created_at; ``vectors``: id, chunk_id, embedding_model_id, index_version_id, sanitized_content_hash, vector, is_active.
    The due jobs are claimed (at most ``batch``), the texts of those whose hash is still the chunk's are embedded by
    ``provider`` (profile, model, dimensions), and the vectors put in place of the chunk's older ones. A chunk that is
    gone or has another hash cancels its job; one without a usable text is an error and is retried.
    """
    due = claim(jobs, batch, now)
    own = chunks.select("chunk_id", F.col("sanitized_content_hash").alias("_now"), embeddable().alias("_fit"))
    same = F.col("_now").eqNullSafe(F.col("sanitized_content_hash"))
    outcome = F.when(~F.coalesce(same, F.lit(False)) | F.col("_now").isNull(), "changed").when(F.coalesce("_fit", F.lit(False)), "ok").otherwise("error")
    # a batch of jobs, so the chunks are joined to it by broadcast
    tried = own.join(F.broadcast(due), "chunk_id", "right").withColumn("outcome", outcome)
    done = finish(tried, now)
    made = tried.where("outcome = 'ok'").select(
        embedding_id(F.col("chunk_id"), F.col("embedding_model_id"), F.col("index_version_id"), F.col("sanitized_content_hash")).alias("id"), "chunk_id",
        "embedding_model_id", "index_version_id", "sanitized_content_hash", hash_embedding(F.col("sanitized_content_hash"), *provider).alias("vector"), F.lit(True).alias("is_active"),
    )
    rest = jobs.join(F.broadcast(due.select("id")), "id", "left_anti")
    return rest.unionByName(done.select(*jobs.columns)), upsert_vectors(vectors, made)


def active_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors with is_active set anew: only those whose hash is the present one of their chunk stay active."""
    now = chunks.select("chunk_id", F.col("sanitized_content_hash").alias("_now"))
    return vectors.join(now, "chunk_id", "left").withColumn(
        "is_active", F.col("is_active") & F.coalesce(F.col("sanitized_content_hash") == F.col("_now"), F.lit(False))
    ).drop("_now")


def upsert_vectors(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored vectors with the fresh ones put in by id; a chunk's other vectors of the same model and index become inactive."""
    key = ["chunk_id", "embedding_model_id", "index_version_id"]
    rest = stored.join(fresh.select("id"), "id", "left_anti")
    new = fresh.select(*key).distinct().withColumn("_new", F.lit(True))
    stale = rest.join(new, key, "left").withColumn("is_active", F.col("is_active") & F.col("_new").isNull()).drop("_new")
    return stale.select(*stored.columns).unionByName(fresh.select(*stored.columns))


def query_vector(text: str, profile: str, model: str, dimensions: int, metadata: dict | None = None) -> list[float]:
    """The vector of a query on the driver: the hash of its text and sorted metadata, embedded as in :func:`hash_embedding`."""
    import hashlib
    import json
    import math

    body = text if not metadata else text + "\n" + json.dumps(metadata, sort_keys=True, separators=(",", ":"))
    seed = f"{profile}|{model}|{dimensions}|sha256:{hashlib.sha256(body.encode()).hexdigest()}|"
    raw: list[float] = []
    for n in range(-(-dimensions // 8)):
        d = hashlib.sha256(f"{seed}{n}".encode()).digest()
        raw += [int.from_bytes(d[i : i + 4], "big") / 0xFFFFFFFF * 2 - 1 for i in range(0, 32, 4)]
    raw = raw[:dimensions]
    length = math.sqrt(sum(x * x for x in raw)) or 1.0
    return [round(x / length, 12) for x in raw]
