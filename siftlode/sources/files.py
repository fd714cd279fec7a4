"""Local folders as artifact snapshots."""

from __future__ import annotations

import mimetypes
import os
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlode.functions.identity import content_hash
from siftlode.operators.discovery import LANGUAGES, suffix_of

#: Environment variable with the folders, separated as in PATH, below which sources may lie.
ALLOWED = "SIFTLODE_ALLOWED_ROOTS"


def allowed_root(base: str, root: str) -> Path:
    """The folder of a source: a relative, normalised path below ``base``, inside an allowed folder if any are named."""
    p = PurePosixPath(root)
    if p.is_absolute() or not root or p.as_posix() != root or any(x in ("..", ".") for x in p.parts):
        raise ValueError("a source's root must be a normalised relative path")
    full = (Path(base) / root).resolve()
    limits = [Path(x).resolve() for x in os.environ.get(ALLOWED, "").split(os.pathsep) if x] or [Path(base).resolve()]
    if not any(full == x or x in full.parents for x in limits):
        raise ValueError("a source's root must lie below an allowed folder")
    return full


def scan_folder(spark: SparkSession, base: str, root: str) -> DataFrame:
    """One row per file below the folder: path (relative), checksum, size_bytes, mtime, mime_type, language, content.

    Files are read as binaryFile, so a column that is not selected is not kept; the content is read for its checksum.
    """
    full = allowed_root(base, root)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(full))
    kinds = {k: v for k, v in ((e, mimetypes.guess_type(f"x.{e}")[0]) for e in LANGUAGES) if v}
    mime = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    language = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    prefix = full.as_uri()
    df = raw.withColumn("path", F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "^" + _quoted(prefix.replace("file://", "file:/{0,2}")) + "/", ""))
    sfx = suffix_of(F.col("path"))
    return df.select(
        "path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("checksum"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"),
        mime[sfx].alias("mime_type"), language[sfx].alias("language"), "content",
    )


def _quoted(uri: str) -> str:
    import re

    head, tail = uri.split("{0,2}", 1) if "{0,2}" in uri else ("", uri)
    return head + "{0,2}" + re.escape(tail) if head else re.escape(tail)


def snapshot_hash(artifacts: DataFrame, source_id: str, root: str, include: list[str], exclude: list[str]) -> str:
    """Digest of a snapshot: canonical JSON of its settings and of every file's path, checksum and size, in path order.

    The files of one snapshot are streamed to the driver in order, a digest at a time.
    """
    import hashlib
    import json

    h = hashlib.sha256()
    dump = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"))
    h.update(b'{"artifacts":[')
    rows = artifacts.select("path", "checksum", "size_bytes").orderBy("path").toLocalIterator()
    for n, r in enumerate(rows):
        h.update((("," if n else "") + dump(r.asDict())).encode())
    rest = dump({"exclude_paths": exclude, "include_paths": include, "root_identifier": root, "source_id": source_id})
    h.update(("]," + rest[1:]).encode())
    return h.hexdigest()


def text_hashes(artifacts: DataFrame) -> DataFrame:
    """(path, content_hash) of the files read as UTF-8."""
    return artifacts.select("path", content_hash(F.decode("content", "UTF-8")).alias("content_hash"))
