"""Incremental ingestion: what a new snapshot means for stored rows, and how stored rows change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlode.operators.ranking import spread_rank


def plan_snapshot(previous: DataFrame, current: DataFrame, key: list[str], same: list[str]) -> DataFrame:
    """(key, status, and both sides' columns of ``same``): added, unchanged, changed or tombstoned per key.

    ``previous`` also has ``live`` (false once retired): a key without a live previous row is added; a live
    previous key that is missing now is tombstoned; a retired one that stays away has no row. Two values of
    ``same`` are equal also if both are null. Keys must be unique per side.
    """
    p = previous.select(*key, F.lit(True).alias("_p"), F.col("live").alias("_live"), *[F.col(c).alias(f"previous_{c}") for c in same])
    c = current.select(*key, F.lit(True).alias("_c"), *same)
    equal = F.lit(True)
    for x in same:
        equal = equal & F.col(x).eqNullSafe(F.col(f"previous_{x}"))
    live = F.coalesce("_live", F.lit(False))
    status = (
        F.when(F.col("_c").isNotNull() & ~live, "added")
        .when(F.col("_c").isNotNull() & equal, "unchanged")
        .when(F.col("_c").isNotNull(), "changed")
        .when(live, "tombstoned")
    )
    return p.join(c, key, "full_outer").withColumn("status", status).where("status is not null").drop("_p", "_c", "_live")


def _neighbours(files: DataFrame, key: list[str]) -> tuple[DataFrame, Column]:
    """``files`` with _live (the snapshot before has the key) and _stays (the next one has it), and the window of a key's snapshots in order."""
    w = Window.partitionBy(*key).orderBy("snapshot_seq")  # streams in order: one row per snapshot that holds the key
    live, stays = F.lag("next_seq").over(w) == F.col("snapshot_seq"), F.lead("snapshot_seq").over(w) == F.col("next_seq")
    return files.withColumns({"_live": F.coalesce(live, F.lit(False)), "_stays": F.coalesce(stays, F.lit(False))}), w


def plan_sequence(files: DataFrame, key: list[str], same: list[str]) -> DataFrame:
    """:func:`plan_snapshot` of each snapshot against the one before it: (key, snapshot_seq, status, both sides' ``same``).

    ``files`` has one row per key and snapshot_seq, with next_seq, the number of the snapshot that follows (null for the
    last). All keys of a first snapshot are added. Each row is shuffled once, by its key.
    """
    n, w = _neighbours(files, key)
    n = n.withColumns({f"previous_{c}": F.when(F.col("_live"), F.lag(c).over(w)) for c in same})
    equal = F.lit(True)
    for x in same:
        equal = equal & F.col(x).eqNullSafe(F.col(f"previous_{x}"))
    status = F.when(~F.col("_live"), "added").when(equal, "unchanged").otherwise("changed")
    here = F.struct("snapshot_seq", status.alias("status"), *same, *[f"previous_{c}" for c in same])
    gone = F.struct(
        F.col("next_seq").alias("snapshot_seq"), F.lit("tombstoned").alias("status"), *[F.lit(None).cast(files.schema[c].dataType).alias(c) for c in same],
        *[F.col(c).alias(f"previous_{c}") for c in same],
    )
    leaves = F.col("next_seq").isNotNull() & ~F.col("_stays")
    return n.select(*key, F.inline(F.when(leaves, F.array(here, gone)).otherwise(F.array(here))))


def tombstone_sequence(files: DataFrame, key: list[str], reason: str) -> DataFrame:
    """:func:`tombstone_absent` of each snapshot that has a successor: (key, snapshot_seq of the successor, is_current, tombstone_reason)."""
    n, _ = _neighbours(files, key)
    return n.where("next_seq is not null").select(
        *key, F.col("next_seq").alias("snapshot_seq"), F.col("_stays").alias("is_current"), F.when(~F.col("_stays"), reason).alias("tombstone_reason")
    )


def plan_counts(plan: DataFrame, group: list[str]) -> DataFrame:
    """Number of added, changed, unchanged and tombstoned keys per group."""
    n = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_artifacts")
    return plan.groupBy(*group).agg(*[n(s) for s in ("added", "changed", "unchanged", "tombstoned")])


def tombstone_absent(stored: DataFrame, present: DataFrame, key: list[str], at: Column, reason: str) -> DataFrame:
    """``stored`` versions with those current ones retired whose key is not in ``present``; history stays.

    ``stored`` has is_current, tombstoned_at and tombstone_reason. Null keys match null keys.
    """
    there = present.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).distinct().withColumn("_here", F.lit(True))
    on = F.lit(True)
    for i, k in enumerate(key):
        on = on & stored[k].eqNullSafe(there[f"_k{i}"])
    gone = F.col("is_current") & F.col("_here").isNull()
    return (
        stored.join(there, on, "left")
        .withColumns(
            {
                "tombstoned_at": F.when(gone, at).otherwise(F.col("tombstoned_at")),
                "tombstone_reason": F.when(gone, reason).otherwise(F.col("tombstone_reason")),
                "is_current": F.col("is_current") & ~gone,
            }
        )
        .select(*stored.columns)
    )


def flip_current(versions: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Add is_current: true for the last version of each key by ``order`` (ascending), false for the others.

    ``order`` must tell all versions of a key apart. A key may have any number of versions.
    """
    turned = [F.col("_o")[f"f{i}"] for i in range(len(order))]
    last = versions.groupBy(*key).agg(F.max(F.struct(*[o.alias(f"f{i}") for i, o in enumerate(order)])).alias("_o"))
    last = last.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], "_o")
    on = F.lit(True)
    for i, k in enumerate(key):
        on = on & versions[k].eqNullSafe(last[f"_k{i}"])
    same = F.lit(True)
    for o, t in zip(order, turned):
        same = same & o.eqNullSafe(t)
    return versions.join(last, on).withColumn("is_current", same).select(*versions.columns, "is_current")


def containment(versions: DataFrame, key: list[str], label: str, order: list[Column], advance: Column) -> DataFrame:
    """(key, first_version, last_version): the version that first held a key and, where ``advance`` is true, the last one."""
    o = F.struct(*[x.alias(f"f{i}") for i, x in enumerate(order)])
    return versions.groupBy(*key).agg(
        F.min_by(label, o).alias("first_version"), F.when(F.bool_or(advance), F.max_by(label, o)).alias("last_version")
    )


def run_status(runs: DataFrame, run_id: str | None = None, source_id: str | None = None, limit: int = 1) -> DataFrame:
    """The newest runs, by start descending and id; optionally of one id or source; 1 to 100 rows."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    if run_id is not None:
        runs = runs.where(F.col("id") == run_id)
    if source_id is not None:
        runs = runs.where(F.col("source_id") == source_id)
    return runs.orderBy(F.col("started_at").desc(), F.col("id").asc()).limit(limit)


def latest_deliveries(headers: DataFrame) -> DataFrame:
    """Snapshot headers with their place in the root's sequence of arrivals (``ordinal``, from 1)."""
    order = [F.col("snapshot_seq"), F.col("received_at"), F.col("snapshot_id")]
    return spread_rank(headers.dropDuplicates(["snapshot_id"]), ["root_identifier"], order, "ordinal", ties=False)
