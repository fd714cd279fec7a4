"""Sizes of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.plans.runtime import widen

#: A file of token ranks that every executor can read; pass another path where it lies elsewhere.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-tokenization pattern of that vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a rank file; special tokens are ordinary text to it."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, keep: list[str], ranks: str = RANKS) -> DataFrame:
    """(doc_id, *keep, tokens): one row per doc_id, whole texts; a null text has 0 tokens, a null doc_id no row.

    Of several rows with one doc_id the longest counts, then the larger kept values.
    """
    fields = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    schema = ", ".join(["doc_id long", *[f"{k} {fields[k]}" for k in keep], "tokens long"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(ranks)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]]
            yield b.drop(columns="text").assign(tokens=n)

    counted = widen(documents.where("doc_id is not null").select("doc_id", *keep, "text")).mapInPandas(run, schema)
    best = F.max(F.struct("tokens", *keep))
    return counted.groupBy("doc_id").agg(best.alias("m")).select("doc_id", *[f"m.{k}" for k in keep], "m.tokens")
