"""Candidates to chunks with citations: dispatch by structure, overlapping windows, stable keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.functions.identity import chunk_key, citation_key, content_hash

#: Candidate types without chunks of their own, and structured ones.
SILENT = ["object", "array", "import"]
STRUCTURED = ["scalar", "endpoint", "schema", "schema_path"]
DOCUMENT = ["heading", "section", "paragraph", "table", "code_block"]


def trimmed(text: Column) -> Column:
    """A text without white space at either end, of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def windows(text: Column, size: int, overlap: int) -> Column:
    """Array of the pieces of a text: the whole if short enough, else windows of ``size`` with ``overlap``.

    The last window ends with the text. Pieces are trimmed; the overlap is at most size - 1.
    """
    step = size - min(overlap, size - 1)
    t = trimmed(text)
    count = F.when(F.length(t) <= size, 1).otherwise(F.ceil((F.length(t) - size) / step).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: trimmed(F.substring(t, i * step + 1, F.lit(size))))


def has(paths: Column) -> Column:
    return F.coalesce(F.size(paths) > 0, F.lit(False))


def dispatch(candidate_type: Column, key_path: Column, symbol_path: Column, schema_path: Column | None = None, endpoint: Column | None = None) -> Column:
    """Which chunker takes a candidate: none, structured, code or document."""
    structured = has(key_path) | candidate_type.isin(STRUCTURED)
    if schema_path is not None:
        structured = structured | has(schema_path)
    if endpoint is not None:
        structured = structured | endpoint.isNotNull()
    return (
        F.when(candidate_type.isin(SILENT), "none")
        .when(structured, "structured")
        .when(has(symbol_path) | (candidate_type == "symbol"), "code")
        .otherwise("document")
    )


def json_pointer(path: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(F.transform(path, lambda p: F.replace(F.replace(p, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))), "/"))


def chunk_candidates(c: DataFrame, sizes: dict[str, tuple[int, int]] | None = None, profile: str = "structure-aware") -> DataFrame:
    """Chunks of redacted candidates.

    ``c``: source_id, locator, candidate_type, sanitized_text, heading_path, key_path, symbol_path, language and
    what else shall stay. ``sizes``: (size, overlap) per chunker, in characters. Adds chunker, chunk_kind,
    structure_path, ordinal, chunk_text, content hash, chunk_key, citation_key, token_count, heading and
    symbol texts, json_pointer and dotted_key. Null or blank texts give no chunk.
    """
    sizes = {"document": (1200, 120), "code": (1000, 100), "structured": (900, 90)} | (sizes or {})
    c = c.withColumn("chunker", dispatch(F.col("candidate_type"), F.col("key_path"), F.col("symbol_path")))
    c = c.where((F.col("chunker") != "none") & (F.length(trimmed(F.coalesce("sanitized_text", F.lit("")))) > 0))
    none = F.array().cast("array<string>")
    heads = F.coalesce("heading_path", none)
    symbols = F.coalesce("symbol_path", none)
    keys = F.coalesce("key_path", none)
    one = lambda x: F.array(F.coalesce(x, F.lit("")))
    kind = F.col("candidate_type")
    structure = (
        F.when(F.col("chunker") == "document", F.concat(F.array(F.lit("document")), heads, one(kind), one(F.col("locator"))))
        .when(
            F.col("chunker") == "code",
            F.concat(
                F.array(F.lit("source_code")), one(F.coalesce("language", F.lit("unknown"))),
                F.when(F.size(symbols) > 0, symbols).otherwise(one(F.col("locator"))), one(kind),
            ),
        )
        .when(F.size(keys) > 0, F.concat(F.array(F.lit("structured")), keys, one(kind)))
        .otherwise(F.concat(F.array(F.lit("structured")), one(kind), one(F.col("locator"))))
    )
    c = c.withColumns(
        {
            "structure_path": structure,
            "chunk_kind": F.when(F.col("chunker") == "document", F.when(kind.isin(DOCUMENT), kind).otherwise("document_block"))
            .when(F.col("chunker") == "code", F.when(kind == "symbol", "source_symbol").otherwise("source_block"))
            .otherwise(kind),
            "heading_text": F.when((F.col("chunker") == "document") & (F.size(heads) > 0), F.array_join(heads, " > ")),
            "symbol_text": F.when((F.col("chunker") == "code") & (F.size(symbols) > 0), F.array_join(symbols, ".")),
            "json_pointer": F.when((F.col("chunker") == "structured") & (F.size(keys) > 0), json_pointer(keys)),
            "dotted_key": F.when((F.col("chunker") == "structured") & (F.size(keys) > 0), F.array_join(keys, ".")),
            "parent_symbol_path": F.when((F.col("chunker") == "code") & (F.size(symbols) > 1), F.slice(symbols, F.lit(1), F.size(symbols) - 1)),
        }
    )
    pieces = F.lit(None)
    for name, (size, overlap) in sizes.items():
        pieces = F.when(F.col("chunker") == name, windows(F.col("sanitized_text"), size, overlap)).otherwise(pieces)
    c = c.select("*", F.posexplode(pieces).alias("ordinal", "chunk_text"))
    c = c.withColumn("sanitized_content_hash", content_hash(F.col("chunk_text")))
    key = chunk_key(F.col("source_id"), F.col("locator"), F.col("sanitized_content_hash"), F.lit(profile), F.col("structure_path"), F.col("ordinal"))
    c = c.withColumn("chunk_key", key)
    words = F.split(trimmed(F.col("chunk_text")), r"(?U)\s+")
    return c.withColumns({"citation_key": citation_key(F.col("chunk_key")), "token_count": F.when(F.length("chunk_text") > 0, F.size(words)).otherwise(0)})


def citations(chunks: DataFrame, keep: list[str]) -> DataFrame:
    """One citation per chunk: its key, the chunk's key, content hash, redaction status and the kept columns."""
    return chunks.select("citation_key", "chunk_key", "sanitized_content_hash", F.lit("redacted").alias("redaction_status"), *keep)
