"""Tables as Parquet folders with versioned lists of their parts: keyed upserts, appends and run records without row updates.

A version of a table is a list of folders, written whole; one new, empty marker file whose name holds the
version's number and the list's name makes it valid. Creating a file is one step on every file system, so a
reader sees the old or the new rows, never a mixture or nothing, and a writer that dies leaves the old version.
There is one writer at a time.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_NAME = re.compile(r"^[A-Za-z][A-Za-z0-9_]{0,63}$")
_MARKER = re.compile(r"^VERSION-(\d{12})-([0-9a-f]{32})$")


class Store:
    """Named tables below one folder, on any file system that Spark can write to.

    Upserted tables lie in ``buckets`` parts by a hash of their key, and an upsert rewrites only the parts that its
    keys fall into. The number is fixed when a table is first upserted; a part should stay below some gigabytes.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str, folders: bool) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() == folders) if fs.exists(p) else []

    def _get(self, path: str) -> str | None:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        rows = self.spark.read.text(path, wholetext=True).collect()
        return rows[0][0] if rows else None

    def _put(self, path: str, text: str) -> None:
        """A new file; it is an error if there is one already."""
        fs, p = self._fs(path)
        out = fs.create(p, False)
        out.write(text.encode())
        out.close()

    def _version(self, table: str) -> tuple[int, dict | None]:
        """(number, list) of the valid version; (0, None) where there is none."""
        found = [m for m in map(_MARKER.match, self._names(f"{self.root}/{table}", False)) if m]
        if not found:
            return 0, None
        last = max(found, key=lambda m: (m[1], m[2]))
        return int(last[1]), json.loads(self._get(f"{self.root}/{table}/list-{last[2]}.json"))

    def _publish(self, table: str, number: int, listing: dict) -> None:
        name = uuid.uuid4().hex
        self._put(f"{self.root}/{table}/list-{name}.json", json.dumps(listing, sort_keys=True))
        fs, p = self._fs(f"{self.root}/{table}/VERSION-{number + 1:012d}-{name}")
        if not fs.createNewFile(p):
            raise RuntimeError("version exists")

    def _write(self, table: str, df: DataFrame, key: list[str] | None = None, buckets: int = 0) -> dict[str, list[str]]:
        """Write the rows; folders by bucket, or under ``""`` without a key."""
        if not _NAME.match(table):
            raise ValueError("table names are letters, digits and underscores")
        name = f"data-{uuid.uuid4().hex}"
        path = f"{self.root}/{table}/{name}"
        if not key:
            df.write.parquet(path)
            return {"": [name]}
        b = df.withColumn("_bucket", _bucket(key, buckets))
        # adaptive execution joins small parts and splits large ones
        b.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(path)
        return {x.removeprefix("_bucket="): [f"{name}/{x}"] for x in self._names(path, True) if x.startswith("_bucket=")}

    def tables(self) -> list[str]:
        return self._names(self.root, True)

    def missing(self, expected: list[str]) -> list[str]:
        """Expected tables that are not there."""
        return sorted(set(expected) - set(self.tables()))

    def _load(self, table: str, listing: dict, buckets: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(listing["schema"])
        paths = [f"{self.root}/{table}/{x}" for b, parts in listing["parts"].items() if buckets is None or b in buckets for x in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, table: str) -> DataFrame | None:
        """The rows of the valid version, or None; columns that older parts lack are null there."""
        _, now = self._version(table)
        return self._load(table, now) if now else None

    def replace(self, table: str, df: DataFrame) -> None:
        """Write all rows anew; the older parts stay until :meth:`purge`."""
        parts = self._write(table, df)
        self._publish(table, self._version(table)[0], {"parts": parts, "schema": df.schema.jsonValue()})

    def append(self, table: str, df: DataFrame) -> None:
        """Add rows to the table, or begin it; they are visible together or not at all."""
        parts = self._write(table, df)[""]
        number, now = self._version(table)
        old = now or {"parts": {}, "schema": df.schema.jsonValue()}
        merged = {**old["parts"], "": [*old["parts"].get("", []), *parts]}
        self._publish(table, number, {**old, "parts": merged, "schema": _both(StructType.fromJson(old["schema"]), df.schema)})

    def upsert(self, table: str, fresh: DataFrame, key: list[str], keep: list[str] | None = None, newest: str | None = None) -> DataFrame:
        """Rows of ``fresh`` replace those with the same key, others stay; returns the new table.

        Keys must be unique in ``fresh`` and non-null. ``keep``: columns whose stored value goes before the fresh
        one (a first sight, an id). ``newest``: a column by which a fresh row that is older than the stored one does not
        replace it. One anti-join on the key within the buckets that ``fresh`` touches. A table that
        was appended to, or upserted by another key, is brought into buckets by this call, which rewrites it once.
        """
        number, now = self._version(table)
        ordered = now is not None and now.get("key") == key and not now["parts"].get("")
        buckets = now["buckets"] if ordered else self.buckets
        touched, schema = None, fresh.schema.jsonValue()
        if now is not None:
            if ordered:
                # at most one row per bucket
                touched = [str(r[0]) for r in fresh.select(_bucket(key, buckets).alias("b")).distinct().collect()]
            old = self._load(table, now, touched)
            if newest:
                t = old.select(*key, F.col(newest).alias("_old_at"))
                fresh = fresh.join(t, key, "left").where(F.col("_old_at").isNull() | (F.col(newest) >= F.col("_old_at"))).drop("_old_at")
            if keep:
                k = old.select(*key, *[F.col(c).alias(f"_old_{c}") for c in keep])
                fresh = fresh.join(k, key, "left")
                fresh = fresh.withColumns({c: F.coalesce(f"_old_{c}", F.col(c)) for c in keep}).drop(*[f"_old_{c}" for c in keep])
            schema = _both(old.schema, fresh.schema)
            fresh = old.join(fresh.select(*key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)
        parts = self._write(table, fresh, key, buckets)
        if touched is not None:
            parts = {**{b: x for b, x in now["parts"].items() if b not in touched}, **parts}
        self._publish(table, number, {"parts": parts, "schema": schema, "key": key, "buckets": buckets})
        return self.read(table)

    def purge(self, table: str) -> int:
        """Delete older versions and the parts that no version names any more; returns the number of folders.

        Readers of older versions must have ended.
        """
        number, now = self._version(table)
        where = f"{self.root}/{table}"
        live = {x for parts in (now or {"parts": {}})["parts"].values() for x in parts}
        for x in self._names(where, False):
            m = _MARKER.match(x)
            if m and int(m[1]) < number:
                for gone in (x, f"list-{m[2]}.json"):
                    fs, p = self._fs(f"{where}/{gone}")
                    fs.delete(p, False)
        n = 0
        for folder in self._names(where, True):
            if folder in live:
                continue
            inner = [f"{folder}/{x}" for x in self._names(f"{where}/{folder}", True)]
            gone = [x for x in inner if x not in live] if any(x in live for x in inner) else [folder]
            for x in gone:
                fs, p = self._fs(f"{where}/{x}")
                n += int(fs.delete(p, True))
        return n


def _bucket(key: list[str], buckets: int):
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in key]), F.lit(buckets)).cast("int")


def _both(a: StructType, b: StructType) -> dict:
    """The fields of both, those of ``a`` first."""
    return StructType([*a.fields, *[f for f in b.fields if f.name not in a.names]]).jsonValue()


class Runs:
    """Ingestion runs as appended status rows; the last row of a run holds."""

    STATES = ["started", "fetching", "discovering", "extracting", "redacting", "chunking", "persisting", "completed", "failed"]

    def __init__(self, store: Store):
        self.store = store

    def record(self, run_id: str, source_id: str, status: str, stats: dict | None = None, diagnostic: dict | None = None) -> None:
        if status not in self.STATES:
            raise ValueError("unknown run status")
        schema = "id string, source_id string, status string, stats string, diagnostic string"
        row = (run_id, source_id, status, json.dumps(stats or {}, sort_keys=True), json.dumps(diagnostic, sort_keys=True) if diagnostic else None)
        df = self.store.spark.createDataFrame([row], schema).withColumn("at", F.current_timestamp()).withColumn("step", F.lit(self.STATES.index(status)))
        self.store.append("ingestion_runs", df)

    def latest(self) -> DataFrame:
        """(id, source_id, status, stats, diagnostic, started_at, at): each run in its last state."""
        r = self.store.read("ingestion_runs")
        if r is None:
            r = self.store.spark.createDataFrame([], "id string, source_id string, status string, stats string, diagnostic string, at timestamp, step int")
        last = F.max(F.struct("at", "step", "source_id", "status", "stats", "diagnostic"))
        return r.groupBy("id").agg(F.min("at").alias("started_at"), last.alias("m")).select("id", "m.source_id", "m.status", "m.stats", "m.diagnostic", "started_at", "m.at")


class Collection:
    """An immutable versioned collection of evidence objects, ``<base>_<generation>``, upserted by uuid."""

    TEXT = ["uuid", "chunk_key", "source_id", "artifact_path", "sanitized_text", "language", "version_label"]

    def __init__(self, store: Store, base: str, generation: str):
        if not re.fullmatch(r"[A-Z][A-Za-z0-9]*", base) or not re.fullmatch(r"[a-z0-9][a-z0-9_]{0,31}", generation):
            raise ValueError("collection names are a capitalised word and a lower-case generation")
        self.store, self.name = store, f"{base}_{generation}"

    def bootstrap(self, columns: dict[str, str]) -> None:
        """Fix the schema of the collection, or fail if it already has another one."""
        path, want = f"{self.store.root}/{self.name}/SCHEMA.json", json.dumps(columns, sort_keys=True)
        have = self.store._get(path)
        if have is None:
            self.store._put(path, want)
        elif have.strip() != want:
            raise ValueError("collection exists with another schema")

    def upsert(self, objects: DataFrame) -> DataFrame:
        """Objects by uuid; missing texts become empty and missing numbers 0."""
        fill = {f.name: ("" if f.dataType.simpleString() == "string" else 0) for f in objects.schema.fields if f.dataType.simpleString() in ("string", "int", "bigint", "double", "float")}
        return self.store.upsert(self.name, objects.fillna(fill), ["uuid"])
