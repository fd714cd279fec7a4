"""Bounded samples of keys for the fits, without ordering a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` keys (one column): those of the smallest hashes; all if there are no more.

    Keys are kept by a threshold on their hash that lets through a twentieth more than wanted, whatever the size
    of the data, and only those few are ordered for the exact cut. ``key`` is unique and non-null; nothing but the key is read.
    """
    keys = df.select(key)
    n = keys.count()
    share = min(1.0, 1.05 * most / n + 1e-9) if n > most else 1.0
    near = keys.where(F.abs(F.xxhash64(key)).cast("double") <= F.lit(share * 2.0**63))
    return near.orderBy(F.xxhash64(key), key).limit(most)
