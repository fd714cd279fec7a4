"""Mixing sources to target weights: certain whole copies, then Pareto order sampling for the rest."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlode.plans.runtime import cut

#: A text's chance to be drawn grows with this power of its size: 0 gives equal chances, 1 chances in proportion to size.
SIZE_POWER = 0.5
#: Size classes per doubling of size, in which the texts of a source are counted to scale the chances.
CLASSES = 8
#: Steps of the order statistic in which tokens are first added up; the step that holds the quota's end
#: is then resolved row by row, so the number affects only speed.
STEPS = 4096


def allocate(targets: list[dict], tokens: dict[str, int]) -> list[dict]:
    """One row per (mix, source): the share asked for, the share possible and the expected copies.

    A mix is as large as it can be while every present source keeps its share within its repeats. Sources
    that are absent or have no positive weight get nothing, and the others share their weight. A null
    number of repeats means 1, one below 1 means none.
    """
    out = []
    for mix in sorted({t["mix_id"] for t in targets if t["mix_id"] is not None}):
        rows = {}
        for t in targets:
            w = t["target_weight"]
            if t["mix_id"] == mix and t["source"] is not None:
                good = w is not None and math.isfinite(w) and w > 0
                rows[t["source"]] = (w if good else 0.0, 1 if t["max_repeats"] is None else int(t["max_repeats"]))
        asked = sum(w for w, _ in rows.values())
        able = {s: (w, m) for s, (w, m) in rows.items() if w > 0 and m >= 1 and tokens.get(s, 0) > 0}
        weight = sum(w for w, _ in able.values())
        size = min((m * tokens[s] * weight / w for s, (w, m) in able.items()), default=0.0)
        for s in sorted(rows):
            w, m = rows[s]
            share = w / weight if s in able else 0.0
            copies = min(float(m), share * size / tokens[s]) if s in able else 0.0
            copies = round(copies) if abs(copies - round(copies)) < 1e-9 else copies
            out.append(
                {
                    "mix_id": mix,
                    "source": s,
                    "target_share": w / asked if asked else 0.0,
                    "possible_share": share,
                    "max_repeats": m,
                    "whole": int(copies),
                    "odds": float(copies - int(copies)),
                    "quota": float((copies - int(copies)) * tokens.get(s, 0)),
                }
            )
    return out


def scale_chances(classes: list[tuple[float, float]], quota: float, power: float) -> float:
    """The factor c for which texts with chances min(1, c * size**power) hold ``quota`` tokens on average.

    ``classes``: (mean size, tokens) of each size class of a source. Where all texts together hold no more than the
    quota, every chance is 1 (c is infinite).
    """
    if quota <= 0 or not classes:
        return 0.0
    if sum(t for _, t in classes) <= quota:
        return math.inf
    expected = lambda c: sum(min(1.0, c * m**power) * t for m, t in classes)
    low, high = 0.0, max(1.0 / m**power for m, _ in classes)
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if expected(mid) < quota else (low, mid)
    return high


def mixture(sized: DataFrame, targets: DataFrame, seed: int = 1, power: float = SIZE_POWER) -> tuple[DataFrame, DataFrame]:
    """The mixture (mix_id, source, doc_id, tokens, copies) and its report per (mix_id, source).

    ``sized``: doc_id (unique), source, tokens. ``targets``: a small fixed table of mix_id, source,
    target_weight, max_repeats. Every text of a source gets its certain whole copies; the rest of the
    source's quota is an unequal-probability sample of fixed size: a text's inclusion probability grows with a
    power of its size, scaled so that the source's texts hold the quota on average (certain texts, with
    probability 1, come first, in random order). Texts are ordered by the odds of a random number over their inclusion odds, and
    taken until the
    quota's tokens are reached, the last one if that is nearer. So the size misses its target by at most
    half a text. A text of more than twice the quota could only miss it by more than no text does, so it has no chance. Texts without copies, without source or of sources outside the mix have no row. The
    order is cut by a histogram, never by sorting a source in one task.
    """
    spark = sized.sparkSession
    sized = cut(sized.where("source is not null and doc_id is not null"))
    wanted = [r.asDict() for r in targets.select("mix_id", "source", "target_weight", "max_repeats").distinct().collect()]
    named = targets.select("source").distinct()
    totals = sized.join(F.broadcast(named), "source").groupBy("source").agg(F.sum("tokens").alias("t")).collect()
    plan_rows = allocate(wanted, {r["source"]: int(r["t"] or 0) for r in totals})
    # some hundred size classes of the few sources named
    step = F.floor(F.log2("tokens") * CLASSES)
    held = sized.where("tokens > 0").join(F.broadcast(named), "source").groupBy("source", step.alias("c")).agg(F.avg("tokens").alias("m"), F.sum("tokens").alias("t")).collect()
    for r in plan_rows:
        own = [(float(h["m"]), float(h["t"])) for h in held if h["source"] == r["source"] and h["m"] <= 2 * r["quota"]]
        r["scale"] = scale_chances(own, r["quota"], power)
    schema = "mix_id string, source string, target_share double, possible_share double, max_repeats int, whole int, odds double, quota double, scale double"
    plan = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in plan_rows], schema)
    small = F.broadcast(plan)  # one row per row of the fixed target table

    u = (F.abs(F.xxhash64("doc_id", "mix_id", F.lit(seed)).cast("double")) + 0.5) / F.lit(2.0**63)
    u = F.least(u, F.lit(1 - 2.0**-53))
    p = F.least(F.col("scale") * F.pow("tokens", F.lit(power)), F.lit(1.0))
    ratio = (u / (1 - u)) / (p / (1 - p))
    fit = (F.col("odds") > 0) & (F.col("tokens") > 0) & (F.col("tokens") <= 2 * F.col("quota"))
    drawn = sized.join(small, "source").withColumn("_q", F.when(fit & (p >= 1), u - 1).when(fit, ratio / (1 + ratio)))
    drawn = drawn.withColumn("_step", F.floor(F.col("_q") * STEPS))
    sums = drawn.where("_q is not null").groupBy("mix_id", "source", "_step").agg(F.sum("tokens").alias("t"), F.max("quota").alias("quota"))
    upto = Window.partitionBy("mix_id", "source").orderBy("_step")  # at most STEPS rows each
    run = sums.withColumn("_sum", F.sum("t").over(upto))
    edge = (
        run.where(F.col("_sum") > F.col("quota"))
        .groupBy("mix_id", "source")
        .agg(F.min("_step").alias("_edge"), F.min_by(F.col("_sum") - F.col("t"), "_step").alias("_base"))
    )
    d = cut(drawn.join(F.broadcast(edge), ["mix_id", "source"], "left"))
    inside = F.col("_q").isNotNull() & (F.col("_edge").isNull() | (F.col("_step") < F.col("_edge")))
    at_edge = F.col("_q").isNotNull() & (F.col("_step") == F.col("_edge"))
    order = Window.partitionBy("mix_id", "source").orderBy("_q", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        d.where(at_edge)
        .withColumn("_cum", F.col("_base") + F.sum("tokens").over(order))
        .withColumn("copies", F.col("whole") + (F.col("_cum") - F.col("tokens") / 2 <= F.col("quota")).cast("int"))
    )
    rest = d.where(~F.coalesce(at_edge, F.lit(False))).withColumn("copies", F.col("whole") + F.coalesce(inside, F.lit(False)).cast("int"))
    cols = ["mix_id", "source", "doc_id", "tokens", "copies"]
    mixed = rest.select(*cols).unionByName(last.select(*cols)).where("copies > 0")
    got = mixed.groupBy("mix_id", "source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies")
    )
    whole = Window.partitionBy("mix_id")  # one row per source of a mix
    report = (
        small.join(got, ["mix_id", "source"], "left")
        .withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        .withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(whole)), F.lit(0.0)))
        .select(
            "mix_id", "source", "target_share", "possible_share", "actual_share", "tokens",
            F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats",
        )
    )
    return mixed, report
