"""Filling containers of fixed capacity with items: first-fit decreasing in randomised groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.plans.runtime import cut

#: Items of a group, on average; groups are drawn by a hash, so this also bounds the work of one task.
GROUP_ITEMS = 8192


class BinTree:
    """A tournament of the remaining capacities: each node holds the largest of its leaves."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (max(bins, 1) - 1).bit_length())
        self.capacity = capacity
        # an unopened bin has the whole capacity, so the first fit opens it without a special case
        self.best = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for ``size``, which is then taken from it."""
        best, i = self.best, 1
        while i < self.leaves:
            i *= 2
            if best[i] < size:
                i += 1
        found = i - self.leaves
        best[i] -= size
        i //= 2
        while i:
            left, right = best[2 * i], best[2 * i + 1]
            top = left if left > right else right
            if best[i] == top:
                break
            best[i] = top
            i //= 2
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """A bin number per item; ``sizes`` must not exceed ``capacity``. Equal sizes keep their order."""
    tree = BinTree(len(sizes), capacity)
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda j: -sizes[j]):
        out[i] = tree.place(sizes[i])
    return out


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("doc_id")
    capacity = int(pdf["capacity"].iloc[0])
    name = f"{pdf['container'].iloc[0]}-{int(pdf['part'].iloc[0])}-"
    doc, tokens = pdf["doc_id"].to_numpy(), pdf["tokens"].to_numpy()
    # a text above the capacity is cut into full pieces, each a container of its own, and a rest
    full = np.maximum(np.ceil(tokens / capacity).astype(np.int64) - 1, 0)
    rest = tokens - full * capacity
    at = first_fit_decreasing(rest.tolist(), capacity)
    opened = max(at, default=-1) + 1
    piece_doc = np.repeat(doc, full)
    piece_no = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)
    out = pd.DataFrame(
        {
            "bin_no": np.concatenate([np.asarray(at, dtype=np.int64), opened + np.arange(full.sum())]),
            "doc_id": np.concatenate([doc, piece_doc]),
            "piece_no": np.concatenate([full, piece_no]) + 1,
            "token_start": np.concatenate([full * capacity, piece_no * capacity]),
            "tokens": np.concatenate([rest, np.full(full.sum(), capacity)]),
        }
    )
    out.insert(0, "container", pdf["container"].iloc[0])
    out.insert(1, "bin_id", [f"{name}{n}" for n in out.pop("bin_no")])
    return out


def pack(items: DataFrame, containers: DataFrame, seed: int = 1, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(container, bin_id, doc_id, piece_no, token_start, tokens): where each piece of each item lies.

    ``items`` has doc_id (unique) and tokens; ``containers`` is a small fixed table of container and
    capacity_tokens (rows without positive capacity are left out). Every item is placed once per
    container kind; only an item above the capacity is cut, into full pieces and one rest. Items of 0
    tokens take no room and lie in a group's first bin. Items are drawn into groups by a hash of their
    id, so a group is bounded however the sizes or sources are distributed.
    """
    kinds = [
        (r["container"], int(r["capacity_tokens"]))
        for r in containers.where("container is not null and capacity_tokens > 0").distinct().collect()
    ]
    items = cut(items)
    groups = max(1, -(-items.count() // group_items))
    kind = F.explode(F.array(*[F.struct(F.lit(n).alias("container"), F.lit(c).alias("capacity")) for n, c in kinds])) if kinds else None
    if kind is None:
        kind = F.explode(F.array().cast("array<struct<container:string,capacity:int>>"))
    drawn = items.select(
        "doc_id", "tokens", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(groups)).alias("part"), kind.alias("k")
    ).select("doc_id", "tokens", "part", "k.*")
    return drawn.groupBy("container", "part").applyInPandas(
        _pack, "container string, bin_id string, doc_id long, piece_no long, token_start long, tokens long"
    )


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container, bins, tokens, filled): number of bins, tokens in them and their share of the capacity."""
    used = packed.groupBy("container", "bin_id").agg(F.sum("tokens").alias("tokens"))
    return (
        used.groupBy("container")
        .agg(F.count(F.lit(1)).alias("bins"), F.sum("tokens").alias("tokens"))
        .join(F.broadcast(containers.select("container", "capacity_tokens")), "container")  # a few fixed rows
        .select("container", "bins", "tokens", (F.col("tokens") / (F.col("bins") * F.col("capacity_tokens"))).alias("filled"))
    )
