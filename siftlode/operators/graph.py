"""Bounded traversal of a relation graph, its paths and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlode.plans.runtime import cut


def orient(edges: DataFrame, direction: str) -> DataFrame:
    """(edge_id, relationship_type, direction, a_type, a_id, b_type, b_id) in walking direction; ``both`` has each edge twice."""
    kept = ["edge_id", "relationship_type"]
    ends = ["from_entity_type", "from_entity_id", "to_entity_type", "to_entity_id"]

    def one(name: str, order: list[str]) -> DataFrame:
        return edges.select(*kept, F.lit(name).alias("direction"), *[F.col(c).alias(n) for c, n in zip(order, ["a_type", "a_id", "b_type", "b_id"])])

    out, back = one("outbound", ends), one("inbound", ends[2:] + ends[:2])
    return {"outbound": lambda: out, "inbound": lambda: back, "both": lambda: out.unionByName(back)}[direction]()


def first_edges(walk: DataFrame, fanout: int) -> DataFrame:
    """The first ``fanout`` edges of each node by edge id and target, with their place.

    Edges are cut per node and salt first and then per node; the limit on the rank is applied before the shuffle
    too, so a node with very many edges is never sorted as a whole in one task.
    """
    order = [F.col("edge_id").asc(), F.col("b_type").asc(), F.col("b_id").asc(), F.col("direction").asc()]
    salted = walk.withColumn("_salt", F.pmod(F.xxhash64("edge_id"), F.lit(64)))
    near = Window.partitionBy("a_type", "a_id", "_salt").orderBy(*order)
    kept = salted.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= fanout).drop("_r", "_salt")
    return kept.withColumn("fanout_rank", F.row_number().over(Window.partitionBy("a_type", "a_id").orderBy(*order))).where(F.col("fanout_rank") <= fanout)


def traverse(edges: DataFrame, seeds: list[tuple[str, str]], types: list[str], depth: int, fanout: int, cap: int, direction: str = "outbound") -> DataFrame:
    """Entities within reach of the seeds: (entity_type, entity_id, depth, edge_id, seed_id, path).

    Walks at most ``depth`` steps (1 to 3) along edges of the given types, at most ``fanout`` edges of a node,
    never twice to an entity of its own path. Seeds count 1..N; a step gets the number
    N + number of its start x fanout + place of its edge and is taken only up to ``cap``. At most ``cap`` rows, by depth, edge
    and entity. Each step first keeps the edges of the frontier's nodes, so only those are ever ranked; the frontier
    has at most ``cap`` rows (the seeds, in the first step) and is fixed after its step.
    """
    if not 0 <= depth <= 3:
        raise ValueError("depth must be between 0 and 3")
    spark = edges.sparkSession
    every = orient(edges.where(F.col("relationship_type").isin(types)), direction)
    step_type = "struct<relationship_type:string,direction:string,depth:int,from_id:string,to_id:string,edge_id:string>"
    rows = [(t, i, n) for n, (t, i) in enumerate(dict.fromkeys(seeds), 1)]
    front = spark.createDataFrame(rows, "entity_type string, entity_id string, ordinal long").select(
        "entity_type", "entity_id", "ordinal", F.col("entity_id").alias("seed_id"),
        F.array(F.concat_ws(":", "entity_type", "entity_id")).alias("seen"), F.array().cast(f"array<{step_type}>").alias("path"),
    )
    found = None
    for level in range(1, depth + 1):
        nodes = F.broadcast(front.select(F.col("entity_type").alias("a_type"), F.col("entity_id").alias("a_id")).distinct())
        walk = first_edges(every.join(nodes, ["a_type", "a_id"], "left_semi"), fanout)
        j = F.broadcast(front).join(walk, (F.col("entity_type") == F.col("a_type")) & (F.col("entity_id") == F.col("a_id")))
        target = F.concat_ws(":", "b_type", "b_id")
        number = F.lit(len(rows)) + F.col("ordinal") * fanout + F.col("fanout_rank")
        step = F.struct(
            F.col("relationship_type"), F.col("direction"), F.lit(level).alias("depth"), F.col("entity_id").alias("from_id"),
            F.col("b_id").alias("to_id"), F.col("edge_id"),
        )
        here = cut(
            j.where(~F.array_contains("seen", target) & (number <= cap)).select(
                F.col("b_type").alias("entity_type"), F.col("b_id").alias("entity_id"), number.alias("ordinal"), "seed_id",
                F.concat("seen", F.array(target)).alias("seen"), F.concat("path", F.array(step)).alias("path"), "edge_id", F.lit(level).alias("depth"),
            )
        )
        found = here if found is None else found.unionByName(here)
        front = here.drop("edge_id", "depth")
    if found is None:
        found = front.withColumn("edge_id", F.lit("")).withColumn("depth", F.lit(0)).where(F.lit(False))
    order = [F.col("depth").asc(), F.col("edge_id").asc(), F.col("entity_id").asc(), F.col("seed_id").asc()]
    return found.select("entity_type", "entity_id", "depth", "edge_id", "seed_id", "path").orderBy(*order).limit(cap)


def path_faults(paths: DataFrame, types: list[str], depth: int, direction: str, seeds: DataFrame | None = None, fanout: int | None = None) -> DataFrame:
    """(item_id, fault): what is wrong with relation paths; a sound path has no row.

    ``paths``: item_id, path (array of struct relationship_type, direction, depth, from_id, to_id, citation_ids and,
    if eligibility is known, endpoint_eligible), and optionally retrieval_path (must be ``relationship``) and
    endpoint_eligible. ``fanout``: the most targets of one start at one depth, over all paths together.
    """
    p = F.col("path")
    allowed = ["outbound", "inbound"] if direction == "both" else [direction]
    n = F.size(p)
    ids = F.concat(F.array(p[0]["from_id"]), F.transform(p, lambda e: e["to_id"]))
    pairs = F.when(n > 1, F.arrays_zip(F.slice(F.transform(p, lambda e: e["to_id"]), F.lit(1), n - 1).alias("x"), F.slice(F.transform(p, lambda e: e["from_id"]), F.lit(2), n - 1).alias("y")))
    checks = {
        "empty": F.coalesce(n, F.lit(0)) <= 0,
        "too_deep": n > depth,
        "depth_order": F.exists(F.zip_with(F.transform(p, lambda e: e["depth"]), F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda a, b: ~a.eqNullSafe(b)), lambda x: x),
        "type": F.exists(p, lambda e: ~F.coalesce(e["relationship_type"].isin(types), F.lit(False))),
        "direction": F.exists(p, lambda e: ~F.coalesce(e["direction"].isin(allowed), F.lit(False))),
        "uncited": F.exists(p, lambda e: F.coalesce(F.size(e["citation_ids"]), F.lit(0)) <= 0),
        "gap": F.coalesce(F.exists(pairs, lambda z: ~z["x"].eqNullSafe(z["y"])), F.lit(False)),
        "cycle": F.size(F.array_distinct(ids)) < F.size(ids),
        "endpoint": ~F.element_at(p, -1)["to_id"].eqNullSafe(F.col("item_id")),
        "identifier": F.exists(p, lambda e: e["from_id"].isNull() | e["to_id"].isNull() | (e["from_id"] == "") | (e["to_id"] == "")),
    }
    inner = paths.schema["path"].dataType.elementType.names
    if "endpoint_eligible" in inner:
        checks["edge_ineligible"] = F.exists(p, lambda e: ~F.coalesce(e["endpoint_eligible"], F.lit(False)))
    if "endpoint_eligible" in paths.columns:
        checks["ineligible"] = ~F.coalesce("endpoint_eligible", F.lit(False))
    if "retrieval_path" in paths.columns:
        checks["kind"] = ~F.col("retrieval_path").eqNullSafe(F.lit("relationship"))
    whole = F.coalesce(n, F.lit(0)) > 0
    faults = [F.when(checks["empty"], "empty")] + [F.when(whole & c, name) for name, c in checks.items() if name != "empty"]
    out = paths.select("item_id", F.explode(F.filter(F.array(*faults), lambda x: x.isNotNull())).alias("fault"))
    if seeds is not None:
        start = paths.where(whole).select("item_id", p[0]["from_id"].alias("seed_id"))
        out = out.unionByName(start.join(seeds.select("seed_id"), "seed_id", "left_anti").select("item_id", F.lit("seed").alias("fault")))
    if fanout is not None:
        steps = paths.where(whole).select("item_id", F.explode("path").alias("e")).select("item_id", F.col("e.from_id").alias("f"), F.col("e.depth").alias("d"), F.col("e.to_id").alias("t"))
        wide = steps.groupBy("f", "d").agg(F.count_distinct("t").alias("n")).where(F.col("n") > fanout).select("f", "d")
        out = out.unionByName(steps.join(wide, ["f", "d"], "left_semi").select("item_id", F.lit("fanout").alias("fault")).distinct())
    return out


def sound_candidates(paths: DataFrame, types: list[str], depth: int, direction: str, limit: int, seeds: DataFrame | None = None, fanout: int | None = None) -> DataFrame:
    """The paths without fault, the first of each item by rank, ranked anew from 1 and at most ``limit`` of them.

    ``paths`` as in :func:`path_faults`, with ``rank``: one query's candidates.
    """
    bad = path_faults(paths, types, depth, direction, seeds, fanout).select("item_id").distinct()
    good = paths.join(bad, "item_id", "left_anti")
    first = good.withColumn("_n", F.row_number().over(Window.partitionBy("item_id").orderBy("rank"))).where("_n = 1").drop("_n")
    top = first.orderBy("rank", "item_id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rank", "item_id")))


def seed_candidates(ranked: DataFrame, paths: list[str], limit: int) -> DataFrame:
    """(chunk_id, seed_rank): ids of the chosen paths, by rank and path order, each once."""
    place = F.coalesce(*[F.when(F.col("path") == p, F.lit(i)) for i, p in enumerate(paths)])
    s = ranked.where(F.col("path").isin(paths)).groupBy("chunk_id").agg(F.min(F.struct(place.alias("p"), F.col("rank").alias("r"))).alias("m"))
    top = s.orderBy("m.p", "m.r", "chunk_id").limit(limit)
    return top.select("chunk_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("m.p", "m.r", "chunk_id")).alias("seed_rank"))
