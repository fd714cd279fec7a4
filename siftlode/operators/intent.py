"""What a query text asks for: exact identifiers by kind, for one query on the driver or for many in a frame."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The shapes of tokens.
TOKEN = r"[A-Za-z0-9_./:{}/?-]+"
VERSION = r"^(?:v|V)?\d+(?:\.\d+){1,3}(?:[-+][A-Za-z0-9_.-]+)?$"
ERROR = r"^(?:[A-Z][A-Z0-9_]{2,}|[A-Za-z]+(?:Error|Exception))$"
FILE = r"\.(?:md|txt|ya?ml|json|toml|py|ts|js|html)$"
KINDS = ["symbols", "artifact_paths", "endpoint_paths", "schema_keys", "version_strings", "error_strings", "quoted_strings", "fuzzy_terms"]


def _once(a: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: F.length(x) > 0))


def parse_intents(df: DataFrame, text: str = "query_text") -> DataFrame:
    """Add an array of terms per kind, each in order of first appearance.

    A null text has empty arrays. A token may belong to several kinds; one that is a path is no symbol
    unless it holds ``::``.
    """
    q = F.coalesce(F.col(text), F.lit(""))
    quoted = F.transform(F.regexp_extract_all(q, F.lit(r"\"[^\"]+\"|'[^']+'"), F.lit(0)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    raw = F.regexp_extract_all(q, F.lit(TOKEN), F.lit(0))
    df = df.withColumn("_t", _once(F.transform(raw, lambda x: F.regexp_replace(x, r"^[.,;()\[\]]+|[.,;()\[\]]+$", ""))))
    t = F.col("_t")
    is_path = lambda x: x.contains("/") | x.rlike(FILE)
    pick = lambda f: F.array_distinct(F.filter(t, f))
    keys = pick(lambda x: x.startswith("--") | x.contains("_") | x.startswith("$"))
    return df.withColumns(
        {
            "symbols": pick(lambda x: x.contains("::") | (x.contains(".") & ~is_path(x))),
            "artifact_paths": pick(is_path),
            "endpoint_paths": pick(lambda x: x.startswith("/") & (F.length(x) > 1)),
            "schema_keys": _once(F.transform(keys, lambda x: F.regexp_replace(x, r"^[-$]+", ""))),
            "version_strings": pick(lambda x: x.rlike(VERSION)),
            "error_strings": pick(lambda x: x.rlike(ERROR)),
            "quoted_strings": _once(quoted),
            "fuzzy_terms": pick(lambda x: (F.length(x) >= 4) & x.rlike(r"^[A-Za-z_]\w*$")),
        }
    ).drop("_t")


def parse_intent(text: str) -> dict[str, list[str]]:
    """The same for one query, on the driver."""
    quoted = [a or b for a, b in re.findall(r"\"([^\"]+)\"|'([^']+)'", text)]
    tokens = list(dict.fromkeys(x for x in (t.strip(".,;()[]").strip() for t in re.findall(TOKEN, text)) if x))
    is_path = lambda x: "/" in x or re.search(FILE, x) is not None
    chosen = {
        "symbols": [x for x in tokens if "::" in x or ("." in x and not is_path(x))],
        "artifact_paths": [x for x in tokens if is_path(x)],
        "endpoint_paths": [x for x in tokens if x.startswith("/") and len(x) > 1],
        "schema_keys": [x.lstrip("-$") for x in tokens if x.startswith("--") or "_" in x or x.startswith("$")],
        "version_strings": [x for x in tokens if re.match(VERSION, x)],
        "error_strings": [x for x in tokens if re.match(ERROR, x)],
        "quoted_strings": [x.strip() for x in quoted],
        "fuzzy_terms": [x for x in tokens if len(x) >= 4 and x.isascii() and x.isidentifier()],
    }
    return {k: list(dict.fromkeys(x for x in v if x)) for k, v in chosen.items()}


def field_terms(intent: dict[str, list[str]]) -> dict[str, list[str]]:
    """Lookup fields and the terms that are looked up in each."""
    i = intent
    return {
        "symbol_path": i["symbols"],
        "artifact_path": i["artifact_paths"],
        "structure_path": i["endpoint_paths"] + i["schema_keys"],
        "heading_path": i["quoted_strings"] + i["schema_keys"],
        "signature_text": i["symbols"] + i["error_strings"],
        "version_label": i["version_strings"],
        "sanitized_text": i["error_strings"] + i["quoted_strings"],
    }
