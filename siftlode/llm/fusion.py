"""One ranking from several differently scaled scores: reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlode.operators.ranking import spread_rank
from siftlode.plans.runtime import cut

#: Constant of the published method (Cormack, Clarke, Buettcher 2009).
RRF_K = 60
#: Challengers of one group that are held together while the last possible winner is sought.
BLOCK = 1024


def _place(df: DataFrame, group: list[str], order: list[Column], out: str, ties: bool, wide: bool) -> DataFrame:
    if wide:
        return spread_rank(df, group, order, out, ties=ties)
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, (F.rank() if ties else F.row_number()).over(w).cast("long"))


def reciprocal_rank_fusion(
    scores: DataFrame, group: str, item: str, k: int = RRF_K, weights: dict[str, float] | None = None, wide: bool = True
) -> DataFrame:
    """(group, item, places, rrf, fused_rank) from long rows (group, item, measure, score, tie).

    ``score`` is the smaller the better, ``tie`` decides between equal scores; rows equal in both share a
    place. Of several rows of an item in one measure the best counts. Rows with a null or NaN score and a
    null tie are no evidence: the item then lacks the measure; an item without any place still appears,
    last. ``places`` maps measure to place. Items of a group are numbered by (rrf desc, item); a null
    group or item is left out.

    ``wide``: groups may be of any size, and places come from :func:`spread_rank`. Where :func:`siftlode.operators.ranking.has_wide_group` says
    no, ``wide=False`` gives the same rows from one shuffle by group, which serves every step.
    """
    clean = scores.where(F.col(group).isNotNull() & F.col(item).isNotNull()).withColumn(
        "score", F.when(~F.isnan("score"), F.col("score"))
    )
    best = clean.groupBy(group, item, "measure").agg(
        F.min(F.struct(F.col("score").isNull().alias("none"), "score", F.coalesce("tie", F.lit(2**62)).alias("tie"))).alias("b")
    )
    best = best.select(
        group, item, "measure", "b.score", "b.tie", (F.col("b.none") & (F.col("b.tie") == 2**62)).alias("none")
    )
    # rows without evidence are ordered behind all others, so they do not shift a place, and get none
    order = [F.col("none").asc(), F.col("score").asc_nulls_last(), F.col("tie").asc()]
    placed = _place(best, [group, "measure"], order, "place", True, wide)
    placed = placed.withColumn("place", F.when(~F.col("none"), F.col("place")))
    weight = F.lit(1.0)
    if weights is not None:
        weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("measure")], F.lit(0.0))
    entry = F.when(F.col("place").isNotNull(), F.struct("measure", "place"))
    items = placed.groupBy(group, item).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("places"),
        # whole numbers make the sum free of the order of addition
        F.sum(F.coalesce(F.round(weight * 1e15 / (k + F.col("place"))).cast("long"), F.lit(0))).alias("units"),
    )
    items = items.withColumn("rrf", F.col("units") / F.lit(1e15)).drop("units")
    return _place(items, [group], [F.col("rrf").desc(), F.col(item).asc()], "fused_rank", False, wide)


def _ahead(x: Column, y: Column, measures: list[str]) -> Column:
    """In how many measures x stands ahead of y; a missing place is behind any place."""
    one = [
        F.when(x[m].isNotNull() & (y[m].isNull() | (x[m] < y[m])), 1).otherwise(0) for m in measures
    ]
    total = one[0]
    for o in one[1:]:
        total = total + o
    return total


def majority_first(fused: DataFrame, group: str, item: str, measures: list[str], need: int, wide: bool = True) -> DataFrame:
    """(group, item, decided): the item ahead of every other item of its group in at least ``need`` measures.

    ``fused`` is the output of :func:`reciprocal_rank_fusion`, whose order names the candidates. The leader of the
    fused order is held against every item of its group; if it is ahead of all, it has won (decided = ``leader``).
    Otherwise only the items that are ahead of the leader can still win. The next candidate is sought among
    those alone, down the fused order: one that is not ahead of the next of them gives way to it. The last one
    is held against every item too (decided = ``challenger``). ``need`` must be more than half of the
    measures, so there is one winner at most; a group may have none. A group of one item is won by it.

    ``wide`` as in :func:`reciprocal_rank_fusion`. Challengers are folded in blocks of bounded size.
    """
    p = F.struct(*[F.col("places")[m].alias(m) for m in measures]).alias("p")
    f = fused.select(group, item, "fused_rank", p)
    if wide:
        f = cut(f)
        lead = f.where("fused_rank = 1").select(group, F.col("p").alias("lp"))
        held = f.join(lead, group)
    else:
        # groups lie within a task already, so this adds no shuffle
        held = f.withColumn("lp", F.min_by("p", "fused_rank").over(Window.partitionBy(group)))
    held = held.withColumn("led", (F.col("fused_rank") == 1) | (_ahead(F.col("lp"), F.col("p"), measures) >= need))
    rival = (_ahead(F.col("p"), F.col("lp"), measures) >= need) & (F.col("fused_rank") > 1)
    blocks = held.where(rival).withColumn("_b", F.floor(F.col("fused_rank") / BLOCK))
    typed = f"struct<fused_rank:bigint,{item}:string,p:struct<{','.join(m + ':bigint' for m in measures)}>>"
    # three levels hold a group of 2**30 items, each task at most BLOCK of them at a time
    for level in range(3):
        fold = F.reduce(
            F.array_sort(F.collect_list(F.struct("fused_rank", item, "p"))),
            F.lit(None).cast(typed),
            lambda acc, x: F.when(acc.isNotNull() & (_ahead(acc["p"], x["p"], measures) >= need), acc).otherwise(x),
        )
        blocks = (
            blocks.groupBy(group, "_b")
            .agg(fold.alias("w"))
            .select(group, F.col("_b").alias("_r"), "w.*")
            .withColumn("_b", F.floor(F.col("_r") / BLOCK) if level < 1 else F.lit(0).cast("long"))
        )
    last = blocks.select(group, F.col(item).alias("_c"), F.col("p").alias("_cp"))
    both = held.select(group, item, "fused_rank", "p", "led").join(last, group, "left")
    beaten = F.col("_c").isNotNull() & ((F.col(item) == F.col("_c")) | (_ahead(F.col("_cp"), F.col("p"), measures) >= need))
    won = both.groupBy(group).agg(
        F.min("led").alias("led"), F.min(F.coalesce(beaten, F.lit(False))).alias("beaten"), F.min_by(item, "fused_rank").alias("_l"), F.first("_c", True).alias("_c")
    )
    return won.where("led or beaten").select(
        group, F.when(F.col("led"), F.col("_l")).otherwise(F.col("_c")).alias(item), F.when(F.col("led"), "leader").otherwise("challenger").alias("decided")
    )


#: Measures of ranked_candidates: three paths and two scores.
MEASURES = ["exact", "bm25", "vector", "fused", "rerank"]


def candidate_scores(ranked: DataFrame) -> DataFrame:
    """Long measure rows (query_id, chunk_id, measure, score, tie) of ranked_candidates, smaller is better.

    In a path the score gives the place (bm25: large is good) and the rank decides ties; fused_score and
    rerank_score are large-is-good. Chunks without any measure keep one row without evidence.
    """
    paths = F.when(F.col("path").isin("exact", "vector"), F.col("path_score")).when(F.col("path") == "bm25", -F.col("path_score"))
    parts = F.array(
        F.struct(
            F.when(F.col("path").isin("exact", "bm25", "vector"), F.col("path")).alias("measure"),
            paths.alias("score"),
            F.col("rank").cast("long").alias("tie"),
        ),
        F.struct(F.lit("fused").alias("measure"), (-F.col("fused_score")).alias("score"), F.lit(None).cast("long").alias("tie")),
        F.struct(F.lit("rerank").alias("measure"), (-F.col("rerank_score")).alias("score"), F.lit(None).cast("long").alias("tie")),
    )
    return (
        ranked.select("query_id", "chunk_id", F.explode(parts).alias("m"))
        .select("query_id", "chunk_id", "m.*")
        .withColumn("tie", F.when(F.col("measure").isNotNull(), F.col("tie")))
        .withColumn("measure", F.coalesce("measure", F.lit("none")))
    )
