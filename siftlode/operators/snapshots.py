"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlode.functions.paths import plain_checksum, plain_path
from siftlode.operators.ranking import has_wide_group, spread_rank
from siftlode.plans.runtime import cut, stored, widen


def snapshot_sequence(headers: DataFrame, counts: DataFrame, wide: bool = True) -> DataFrame:
    """(snapshot_id, root, seq, next_seq, first) of the complete snapshots, one delivery per sequence number.

    ``headers`` has snapshot_id, root, seq, expected; ``counts`` has snapshot_id, n (distinct files that
    arrived). A snapshot with fewer files than expected is left out; of several complete deliveries the
    one with the smallest id stands for all (they agree). Headers without root, seq or id are left out; a
    null expectation counts as 0.

    ``wide``: a root may have any number of snapshots, and they are numbered by :func:`spread_rank`. Where
    :func:`has_wide_group` says no, ``wide=False`` gives the same rows by a window over each root's headers.
    """
    h = (
        headers.where("snapshot_id is not null and root is not null and seq is not null")
        .repartition("snapshot_id")  # for the aggregation and the join alike
        .groupBy("snapshot_id", "root", "seq")
        .agg(F.max("expected").alias("expected"))
        .join(counts, "snapshot_id", "left")
        .where(F.coalesce("n", F.lit(0)) >= F.coalesce("expected", F.lit(0)))
    )
    if not wide:
        one = h.repartition("root").groupBy("root", "seq").agg(F.min("snapshot_id").alias("snapshot_id"))
        w = Window.partitionBy("root").orderBy("seq")
        return one.select("snapshot_id", "root", "seq", F.lead("seq").over(w).alias("next_seq"), F.lag("seq").over(w).isNull().alias("first"))
    h = h.groupBy("root", "seq").agg(F.min("snapshot_id").alias("snapshot_id"))
    # numbered per root without one task per root; then each is tied to its successor
    numbered = cut(spread_rank(h, ["root"], [F.col("seq")], "_rn", ties=False))
    later = numbered.select("root", (F.col("_rn") - 1).alias("_rn"), F.col("seq").alias("next_seq"))
    return numbered.join(later, ["root", "_rn"], "left").select(
        "snapshot_id", "root", "seq", "next_seq", (F.col("_rn") == 1).alias("first")
    )


def file_counts(records: DataFrame) -> DataFrame:
    """(snapshot_id, n): distinct keys of each snapshot, by their hashes; a snapshot without any has no row."""
    return (
        records.select("snapshot_id", F.xxhash64("key").alias("k"))
        .groupBy("snapshot_id", "k")
        .agg(F.lit(1).alias("one"))
        .groupBy("snapshot_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def snapshot_changes(records: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows (root, seq, key, change_kind) that differ between consecutive complete snapshots.

    ``records``: snapshot_id, key, row_hash (long, null = unknown), at (arrival; the last one of a key in
    a snapshot holds, on ties the larger hash). ``headers``: see :func:`snapshot_sequence`.

    Every record is tagged as the later side of its own pair and as the earlier side of the next pair;
    one aggregation per (root, seq, key) then has both sides' last row hashes and classifies: only later =
    added, only earlier = removed, different hashes = changed; an unknown hash is no change. Keys are
    spread over (root, seq, key), so neither a hot root nor a hot snapshot gathers in one task.
    Empty input gives no rows; null keys are no records.
    """
    records = records.where("key is not null and snapshot_id is not null")
    sequence = snapshot_sequence(headers, file_counts(records), has_wide_group(headers, "root"))
    sides = F.array(
        F.struct(F.when(~F.col("first"), F.col("seq")).alias("pair"), F.lit(True).alias("later")),
        F.struct(F.col("next_seq").alias("pair"), F.lit(False).alias("later")),
    )
    tagged = (
        records.join(sequence, "snapshot_id")
        .select("root", "key", "row_hash", "at", F.explode(sides).alias("s"))
        .where("s.pair is not null")
    )
    last = F.struct("at", "row_hash")
    both = tagged.groupBy("root", F.col("s.pair").alias("seq"), "key").agg(
        F.max(F.when(F.col("s.later"), last)).alias("b"),
        F.max(F.when(~F.col("s.later"), last)).alias("a"),
    )
    kind = (
        F.when(F.col("a").isNull(), "added")
        .when(F.col("b").isNull(), "removed")
        .when(F.col("a.row_hash") != F.col("b.row_hash"), "changed")
    )
    return both.select("root", "seq", "key", kind.alias("change_kind")).where("change_kind is not null")


def artifact_changes(artifacts: DataFrame, headers: DataFrame) -> DataFrame:
    """:func:`snapshot_changes` over artifact_candidates and source_snapshots.

    Locators and checksums are compared by their plain spelling, which is worked out once: the records are
    written as a table, of which the completeness test reads two columns and the comparison all.
    """
    records = widen(artifacts.select("snapshot_id", "logical_locator", "checksum", "received_at")).select(
        "snapshot_id",
        plain_path(F.col("logical_locator")).alias("key"),
        plain_checksum(F.col("checksum")).alias("sum"),
        F.col("received_at").alias("at"),
    ).select("snapshot_id", "key", F.when(F.col("sum").isNotNull(), F.xxhash64("sum")).alias("row_hash"), "at")
    records = stored(records)
    heads = headers.select(
        "snapshot_id",
        F.col("root_identifier").alias("root"),
        F.col("snapshot_seq").alias("seq"),
        F.col("artifact_count").alias("expected"),
    )
    return snapshot_changes(records, heads).select(
        F.col("root").alias("root_identifier"),
        F.col("seq").alias("snapshot_seq"),
        F.col("key").alias("logical_locator"),
        "change_kind",
    )
