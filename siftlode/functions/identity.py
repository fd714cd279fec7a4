"""Stable identifiers and content hashes as column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: the separator between the parts of a hashed key.
UNIT = "\u001f"


def _joined(*parts: Column) -> Column:
    # concat_ws would drop nulls and so shift the parts
    return F.concat_ws(UNIT, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def content_hash(text: Column) -> Column:
    """``sha256:`` and the hex digest of the UTF-8 text; null stays null."""
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def chunk_key(source: Column, locator: Column, text_hash: Column, profile: Column, structure: Column, ordinal: Column) -> Column:
    """Key of a chunk from its six parts; ``structure`` is an array, joined by slashes."""
    return F.concat(F.lit("chunk:"), F.sha2(_joined(source, locator, text_hash, profile, F.array_join(structure, "/"), ordinal), 256))


def citation_key(key: Column) -> Column:
    """The citation key that belongs to a chunk key."""
    return F.concat(F.lit("citation:"), F.regexp_replace(key, "^chunk:", ""))


def artifact_id(config_key: Column, path: Column) -> Column:
    return F.concat(F.lit("artifact:"), config_key, F.lit(":"), F.substring(F.sha2(path, 256), 1, 32))


def source_version_id(source: Column, version_hash: Column) -> Column:
    return F.concat(F.lit("source-version:"), source, F.lit(":"), F.substring(version_hash, 1, 16))


def embedding_id(chunk: Column, model: Column, index: Column, text_hash: Column) -> Column:
    return F.concat(F.lit("embedding:"), F.sha2(_joined(chunk, model, index, text_hash), 256))


def combined_hash(position: Column, text_hash: Column) -> Column:
    """Aggregate: digest of the hashes of a group in order of position, one a line."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(position.alias("p"), text_hash.alias("h")))), lambda x: x["h"])
    return F.sha2(F.array_join(ordered, "\n"), 256)


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Name-based UUID (version 5) without leaving the JVM; ``namespace_hex`` has 32 hex digits."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex((nibble % 4) + 8))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def git_version_label(kind: Column, ref: Column, commit: Column) -> Column:
    """``tag|branch|commit:<ref>@<first 12 of the commit>``; a ref's namespace is left out."""
    name = F.regexp_replace(F.regexp_replace(ref, "refs/heads/", ""), "refs/tags/", "")
    prefix = F.when(kind.isin("tag", "branch"), kind).otherwise("commit")
    return F.concat(prefix, F.lit(":"), name, F.lit("@"), F.substring(commit, 1, 12))


@F.pandas_udf(StringType())
def canonical_json_hash(doc: pd.Series) -> pd.Series:
    """Digest of a JSON text after sorting keys, dropping spaces and escaping beyond ASCII; not JSON gives null."""
    import hashlib

    def one(s: str | None) -> str | None:
        try:
            plain = json.dumps(json.loads(s), sort_keys=True, separators=(",", ":"))
        except (TypeError, ValueError):
            return None
        return hashlib.sha256(plain.encode()).hexdigest()

    return doc.map(one)
