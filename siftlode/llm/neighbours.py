"""The k most similar vectors of every vector, by learned partitions and exact reranking."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.llm.partition_index import Index, Router, fit_router, unit
from siftlode.operators.ranking import spread_rank
from siftlode.plans.runtime import cut, stored

#: Documented bounds of the fit: rows that one router is fitted on, rows a part shall have, and the parts that one
#: router tells apart. Beyond MAX_PARTS parts a second level of routers cuts each part of the first again, so
#: parts keep their size up to MAX_PARTS x MAX_PARTS of them (some 33 million vectors a model; more makes parts
#: larger, which are then searched in more blocks). The index holds every row; only the fits see a sample.
SAMPLE = 8192
PART_ROWS = 2048
MAX_PARTS = 128
#: Rows of base vectors and of queries that meet in one task.
BASE_BLOCK = 4096
QUERY_BLOCK = 8192
#: A query visits the most probable parts until they hold this probability, and at least MIN_PROBES.
MASS = 0.99
MIN_PROBES = 2


def usable_vectors(e: DataFrame) -> DataFrame:
    """(vec_id, model, vector): active rows with a finite non-zero vector of the stated length, one per vec_id.

    Of several rows with one vec_id the last created holds, then the larger model id and vector.
    """
    v = F.col("vector")
    good = (
        F.col("is_active")
        & F.col("vec_id").isNotNull()
        & F.col("embedding_model_id").isNotNull()
        & (F.size(v) == F.col("dimensions"))
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    last = F.max(F.struct("created_at", F.col("embedding_model_id").alias("model"), "vector"))
    return e.where(good).groupBy("vec_id").agg(last.alias("m")).select("vec_id", "m.model", "m.vector")


def _train(picked: DataFrame, names: list[str], most: int) -> dict[tuple, Router]:
    """A router per group of ``names``, each fitted in a task; ``picked``: the groups' sampled rows with _parts, the parts to make.

    Size on the driver: a router's weights are (dimensions + parts) x 128 numbers of four bytes, some 100 KB.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", "rep"]).head(SAMPLE)
        parts = int(np.clip(pdf["_parts"].iloc[0], 1, min(most, max(1, len(pdf) // 16))))
        # rows of another length than most cannot be compared with them; they form no part of the fit
        arrays = [np.asarray(a, dtype=np.float64) for a in pdf["vector"]]
        d = max(sorted({len(a) for a in arrays}), key=lambda n: sum(len(a) == n for a in arrays))
        router = fit_router(np.stack([a for a in arrays if len(a) == d]), parts)
        return pd.DataFrame({**{n: [pdf[n].iloc[0]] for n in names}, "router": [pickle.dumps(router)]})

    schema = ", ".join(f"{n} {picked.schema[n].dataType.simpleString()}" for n in names)
    rows = picked.groupBy(*names).applyInPandas(one, f"{schema}, router binary").collect()
    return {tuple(r[n] for n in names): pickle.loads(bytes(r["router"])) for r in rows}


def _fit(reps: DataFrame, part_rows: int, max_parts: int) -> Index:
    """The index of all models: one level of routers, and a second one for models of more than ``max_parts`` parts."""
    sizes = {r["model"]: r["n"] for r in reps.groupBy("model").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per model
    wanted = {m: -(-n // part_rows) for m, n in sizes.items()}
    first = {m: p if p <= max_parts else min(max_parts, int(np.ceil(np.sqrt(p)))) for m, p in wanted.items()}
    chance = {m: min(1.0, 1.05 * SAMPLE / n) for m, n in sizes.items()}
    spark = reps.sparkSession
    small = spark.createDataFrame([(m, first[m], chance[m]) for m in sizes], "model string, _parts int, _chance double")
    hashed = reps.withColumn("_h", F.abs(F.xxhash64(F.col("rep"), F.lit(11))).cast("double") / F.lit(2.0**63))
    top = _train(hashed.join(F.broadcast(small), "model").where("_h <= _chance"), ["model"], max_parts)
    index = Index({m: r for (m,), r in top.items()}, {}, max_parts)
    deep = [m for m, p in wanted.items() if p > max_parts]
    if not deep:
        return index
    shared = spark.sparkContext.broadcast(index)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            part = np.zeros(len(b), dtype=np.int32)
            for model in b["model"].unique():
                at = np.flatnonzero(b["model"].to_numpy() == model)
                part[at] = shared.value.homes(model, [b["vector"].iloc[i] for i in at])
            yield b.assign(part=part)

    cols = "model string, rep long, vector array<float>, _h double, part int"
    within = hashed.where(F.col("model").isin(deep)).select("model", "rep", "vector", "_h").mapInPandas(placed, cols)
    n = within.groupBy("model", "part").agg(F.count(F.lit(1)).alias("n")).collect()  # at most max_parts rows a model
    plan = spark.createDataFrame([(r["model"], r["part"], -(-r["n"] // part_rows), min(1.0, 1.05 * SAMPLE / r["n"])) for r in n], "model string, part int, _parts int, _chance double")
    index.below = _train(within.join(F.broadcast(plan), ["model", "part"]).where("_h <= _chance"), ["model", "part"], max_parts)
    return index


def _route(reps: DataFrame, index: Index, mass: float) -> DataFrame:
    """(model, rep, v, parts): the vector as float32 bytes and the parts to visit, the own part first."""
    shared = reps.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            b = b.assign(_d=b["vector"].map(len))
            for (model, d), g in b.groupby(["model", "_d"]):
                raw = np.stack([np.asarray(a, dtype=np.float32) for a in g["vector"]])
                parts = shared.value.visits(model, raw, mass, MIN_PROBES)
                out.append(pd.DataFrame({"model": model + f"#{d}", "rep": g["rep"].to_numpy(), "v": [x.tobytes() for x in raw], "parts": parts}))
            if out:
                yield pd.concat(out)

    return reps.select("model", "rep", "vector").mapInPandas(run, "model string, rep long, v binary, parts array<int>")


def _meet(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base, query = pdf[pdf["role"] == 0], pdf[pdf["role"] == 1]
        empty = pd.DataFrame({"rep": [], "other": [], "sim": []}).astype({"rep": "int64", "other": "int64", "sim": "float64"})
        if base.empty or query.empty:
            return empty
        base = base.sort_values("rep")
        d = len(base["v"].iloc[0]) // 4

        def rows(s: pd.Series) -> np.ndarray:
            return unit(np.frombuffer(b"".join(s), dtype=np.float32).reshape(-1, d).astype(np.float64))

        b, bid = rows(base["v"]), base["rep"].to_numpy()
        out = []
        for i in range(0, len(query), 1024):
            q = query.iloc[i : i + 1024]
            qid = q["rep"].to_numpy()
            sim = np.round(rows(q["v"]) @ b.T, 12)
            sim[qid[:, None] == bid[None, :]] = -9
            n = min(k, sim.shape[1])
            cut_at = -np.partition(-sim, n - 1, axis=1)[:, n - 1]
            # all rows above the k-th similarity and the smallest ids among its ties
            near = sim >= cut_at[:, None]
            tied = near.sum(1) > n
            r, c = np.nonzero(near & ~tied[:, None])
            out.append((qid[r], bid[c], sim[r, c]))
            for r in np.flatnonzero(tied):
                c = np.flatnonzero(near[r])
                c = c[np.argsort(-sim[r, c], kind="stable")][:n]
                out.append((np.repeat(qid[r], len(c)), bid[c], sim[r, c]))
        if not out:
            return empty
        rep, other, sim = (np.concatenate([o[i] for o in out]) for i in range(3))
        real = sim > -2  # a row is none of its own neighbours
        return pd.DataFrame({"rep": rep[real], "other": other[real], "sim": sim[real]})

    return run


def _search(routed: DataFrame, k: int, asking: DataFrame | None) -> DataFrame:
    """(rep, near array<struct<far, other>>): the k most similar other representatives in the visited parts; ``asking``: reps that search, all by default."""
    ask = routed if asking is None else routed.join(asking, "rep", "left_semi")
    home = routed.groupBy("model", F.col("parts")[0].alias("part")).agg(F.count(F.lit(1)).alias("nb"))
    asked = ask.select("model", F.explode("parts").alias("part")).groupBy("model", "part").agg(F.count(F.lit(1)).alias("nq"))
    # one row per part, at most MAX_PARTS x MAX_PARTS a model (16,384): small enough for a broadcast at any size of the data
    plan = F.broadcast(
        home.join(asked, ["model", "part"]).select(
            "model",
            "part",
            F.ceil(F.col("nb") / BASE_BLOCK).cast("int").alias("nb"),
            F.ceil(F.col("nq") / QUERY_BLOCK).cast("int").alias("nq"),
        )
    )
    spread = F.abs(F.xxhash64("rep", F.lit(5)))
    base = (
        routed.withColumn("part", F.col("parts")[0])
        .join(plan, ["model", "part"])
        .select("model", "part", (spread % F.col("nb")).cast("int").alias("bb"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"), F.lit(0).alias("role"), "rep", "v")
    )
    query = (
        ask.withColumn("part", F.explode("parts"))
        .join(plan, ["model", "part"])
        .select("model", "part", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("bb"), (spread % F.col("nq")).cast("int").alias("qb"), F.lit(1).alias("role"), "rep", "v")
    )
    met = (
        base.unionByName(query)
        .groupBy("model", "part", "bb", "qb")
        .applyInPandas(_meet(k), "rep long, other long, sim double")
    )
    return met.groupBy("rep").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("sim")).alias("far"), "other"))), 1, k).alias("near"))


def nearest_vectors(
    e: DataFrame, k: int = 5, exact: bool = False, every: int = 1, part_rows: int = PART_ROWS, max_parts: int = MAX_PARTS, mass: float = MASS
) -> DataFrame:
    """(vec_id, other_id, similarity): the ``k`` most similar usable vectors of the same model, per vector.

    Equal vectors are searched once, by a representative, and expanded again: of a group of copies only
    the ``k`` + 1 smallest ids can be among anyone's nearest, since ties go to the smaller id. Models
    with one vector give no rows. See :func:`usable_vectors` for what takes part.

    ``exact`` holds every vector against all of its model, in blocks: the measure for the index. ``every``: only
    vectors whose id it divides ask; all can be found. ``mass``: the probability of the parts that a vector visits.
    """
    u = stored(usable_vectors(e).withColumn("key", F.xxhash64("model", "vector")))
    numbered = spread_rank(u.select("model", "key", "vec_id"), ["model", "key"], [F.col("vec_id")], "n", ties=False)
    groups = cut(
        numbered.where(F.col("n") <= k + 1)
        .groupBy("model", "key")
        .agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        .withColumn("rep", F.col("ids")[0])
    )
    reps = stored(u.join(groups.select(F.col("rep").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("rep"), "model", "vector"))
    index = Index({}, {}, max_parts) if exact else _fit(reps, part_rows, max_parts)
    routed = stored(_route(reps, index, mass))
    chosen = u.where(F.col("vec_id") % every == 0) if every > 1 else u
    asking = chosen.select("model", "key").distinct().join(groups, ["model", "key"]).select("rep") if every > 1 else None
    near = _search(routed, k, asking)
    # the neighbours' copies, at most k of each
    ids = groups.select(F.col("rep").alias("other"), F.slice("ids", 1, k).alias("ids"))
    wide = (
        near.select("rep", F.explode("near").alias("x"))
        .select("rep", "x.far", "x.other")
        .join(ids, "other")
        .groupBy("rep")
        .agg(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("far").alias("far"), i.alias("id"))))).alias("others"))
    )
    none = F.array().cast("array<struct<far:double,id:bigint>>")
    lists = groups.join(wide, "rep", "left").select(
        "model", "key", F.concat(F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("far"), i.alias("id"))), F.coalesce("others", none)).alias("all")
    )
    return (
        chosen.select("vec_id", "model", "key")
        .join(lists, ["model", "key"])
        .select("vec_id", F.slice(F.array_sort(F.filter("all", lambda x: x["id"] != F.col("vec_id"))), 1, k).alias("best"))
        .select("vec_id", F.explode("best").alias("b"))
        .select("vec_id", F.col("b.id").alias("other_id"), (-F.col("b.far")).alias("similarity"))
    )


def recall(e: DataFrame, k: int = 5, every: int = 100, **index: float) -> DataFrame:
    """(neighbours, found, recall): one row, of the true ``k`` nearest of every vector whose id ``every`` divides, how many the index gives.

    A neighbour of equal similarity counts as found, whichever of equal ones is named.
    """
    truth = nearest_vectors(e, k, exact=True, every=every).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.round("similarity", 9))).alias("want"))
    got = nearest_vectors(e, k, every=every, **index).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.round("similarity", 9))).alias("have"))
    least = F.try_element_at("want", F.lit(1))
    both = truth.join(got, "vec_id", "left").select(F.size("want").alias("n"), F.coalesce(F.size(F.filter("have", lambda x: x >= least)), F.lit(0)).alias("m"))
    s = both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("neighbours"), F.coalesce(F.sum("m"), F.lit(0)).alias("found"))
    return s.withColumn("recall", F.try_divide("found", "neighbours"))


def similar_pairs(nearest: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id_a, vec_id_b), a < b: pairs of :func:`nearest_vectors` with at least this similarity."""
    return (
        nearest.where(F.col("similarity") >= least)
        .select(F.least("vec_id", "other_id").alias("vec_id_a"), F.greatest("vec_id", "other_id").alias("vec_id_b"))
        .distinct()
    )
