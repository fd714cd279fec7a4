"""Artifacts to extraction candidates: one row per part of a file, with where it stands."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.operators.parsers import FIELDS, PARSERS, VALIDATORS, choose

SCHEMA = (
    "candidate_type string, text string, locator string, line_start int, line_end int, heading_path array<string>, key_path array<string>, "
    "schema_path array<string>, symbol_path array<string>, endpoint_path string, signature_text string, language string, metadata string"
)
_LISTS = {"heading_path", "key_path", "schema_path", "symbol_path"}


def decode(content: object) -> tuple[str, bool]:
    """(text, whether bytes had to be replaced) of UTF-8 bytes or a text."""
    if content is None:
        return "", False
    if isinstance(content, str):
        return content, False
    raw = bytes(content)
    try:
        return raw.decode("utf-8"), False
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace"), True


def extract(artifacts: DataFrame, keep: list[str], content: str = "content", path: str = "path", role: str = "artifact_role", language: str = "language") -> DataFrame:
    """(keep..., parser, status, diagnostic, ordinal, candidate columns): the candidates of every artifact, in order.

    ``content`` is binary or string. status: completed; skipped (no parser for it: diagnostic
    unsupported_language); failed (not of its format: the parser's error code). What parses but breaks the rules of
    its format is completed with the validator's code as diagnostic. Artifacts without candidates
    have one row without ordinal, so none is lost. Broken UTF-8 is replaced and said so in the diagnostic.
    Arrow batches carry whole files; a parser sees one file at a time.
    """
    kinds = {f.name: f.dataType.simpleString() for f in artifacts.schema.fields}
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keep], "parser string, status string, diagnostic string, ordinal int", SCHEMA])
    names = [*keep, "parser", "status", "diagnostic", "ordinal", *FIELDS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rec in b.itertuples(index=False):
                head = [getattr(rec, f"k{i}") for i in range(len(keep))]
                parser = choose(rec.p, rec.r, rec.g)
                text, broken = decode(rec.c)
                note = "decode_replaced" if broken else None
                if parser == "none":
                    rows.append([*head, parser, "skipped", "unsupported_language", None, *[None] * len(FIELDS)])
                    continue
                try:
                    found = list(PARSERS[parser](text, rec.p or ""))
                except ValueError as e:
                    rows.append([*head, parser, "failed", str(e), None, *[None] * len(FIELDS)])
                    continue
                if parser in VALIDATORS:
                    check, code = VALIDATORS[parser]
                    note = code if check(text, rec.p or "") else note
                if not found:
                    rows.append([*head, parser, "completed", note, None, *[None] * len(FIELDS)])
                for n, f in enumerate(found):
                    values = [f.get(k) if k not in _LISTS else f.get(k) or [] for k in FIELDS]
                    values[-1] = json.dumps(f.get("metadata") or {}, sort_keys=True)
                    rows.append([*head, parser, "completed", note, n, *values])
            out = pd.DataFrame(rows, columns=names)
            for c in ("ordinal", "line_start", "line_end"):
                out[c] = out[c].astype("Int32")
            yield out

    chosen = artifacts.select(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], F.col(path).alias("p"), F.col(role).alias("r"), F.col(language).alias("g"), F.col(content).alias("c")
    )
    return chosen.mapInPandas(run, schema)


def paragraphs_native(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, ordinal, text, line_start, line_end) of the runs of non-blank lines, by array functions on each text, without a shuffle."""
    lines = df.select(key, F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n").alias("_l"))
    flags = lines.withColumn("_f", F.transform("_l", lambda x: x.rlike(r"(?U)\S")))
    full = lambda i: F.coalesce(F.get("_f", i), F.lit(False))
    # the last line before each run, and the last line of it, counted from 1
    at = F.sequence(F.lit(0), F.size("_l") - 1)
    edges = flags.select(
        key, "_l", F.filter(at, lambda i: full(i) & ~full(i - 1)).alias("a"), F.transform(F.filter(at, lambda i: full(i) & ~full(i + 1)), lambda i: i + 1).alias("b")
    )
    runs = edges.select(key, "_l", F.posexplode(F.arrays_zip("a", "b")).alias("ordinal", "r"))
    return runs.select(
        key, F.array_join(F.slice("_l", F.col("r.a") + 1, F.col("r.b") - F.col("r.a")), "\n").alias("text"), (F.col("r.a") + 1).alias("line_start"),
        F.col("r.b").alias("line_end"), "ordinal",
    )


def extraction_summary(extracted: DataFrame, group: list[str]) -> DataFrame:
    """Per group: status counts of artifacts and counts of candidates by type, as maps."""
    per = extracted.groupBy(*group, "status", "candidate_type").agg(F.count("ordinal").alias("n"))
    kinds = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("candidate_type").isNotNull(), F.struct("candidate_type", "n")))))
    return per.groupBy(*group, "status").agg(kinds.alias("candidate_counts"), F.sum("n").alias("candidates"))


def safe_metadata(c: DataFrame) -> DataFrame:
    """What may be shown of candidates: no text and no signature, only their hashes, and cleaned paths."""
    from siftlode.functions.identity import content_hash
    from siftlode.operators.redaction import safe_text

    clean = lambda name: F.transform(name, safe_text)
    return c.select(
        "candidate_id", "candidate_type", safe_text(F.col("locator")).alias("locator"), content_hash(F.col("text")).alias("text_hash"),
        content_hash(F.col("signature_text")).alias("signature_hash"), clean("heading_path").alias("heading_path"), clean("key_path").alias("key_path"),
        clean("symbol_path").alias("symbol_path"), "line_start", "line_end", "language",
    )
