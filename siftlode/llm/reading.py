"""The reading level of documents: smoothed unigram language models per level."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.llm.sampling import bounded_sample
from siftlode.plans.runtime import cut, widen

BANDS = 5
#: Pseudo-count of every unit in every level.
ALPHA = 0.5
#: Units (words and sentence shapes) seen less often in the labelled texts are no part of the models.
LEAST = 3
#: A sentence shape stands for the whole sentence, so it counts as this many units.
SHAPE_WEIGHT = 3
#: Bound of the fit: labelled documents used at most (the smallest hashes of doc_id beyond it).
MOST_LABELLED = 50_000

_FENCE = re.compile(r"(```|~~~).*?(?:\1|\Z)", re.S)
_BULLET = re.compile(r"^(?:[-*+>]|\d+[.)])\s+")
_CHANGE = re.compile(r"^(?:Added|Changed|Fixed|Removed|Deprecated|Security):\s+")
_CODE = re.compile(r"[{}=]|\w\(|\w/\w|\w_\w|^@|^<")
_WORD = re.compile(r"[a-z]+(?:['-][a-z]+)*")
_STOP = re.compile(r"(?<=[.!?:])\s+(?=[A-Z\"])|(?<=\w[.!?])\s+")


def sentences(text: str) -> list[list[str]]:
    """Lower-case words of each sentence of at least three words; code, tables and headings are left out."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    blocks, now = [], []
    for line in text.split("\n"):
        s = line.strip()
        if s:
            s = _CHANGE.sub("", _BULLET.sub("", s))
        letters = sum(map(str.isalpha, s))
        if not s or s[0] in "|#" or line.startswith("    ") or letters < 0.55 * len(s) or _CODE.search(s):
            if now:
                blocks.append(" ".join(now))
                now = []
            continue
        now.append(s)
    if now:
        blocks.append(" ".join(now))
    out = []
    for b in blocks:
        for s in _STOP.split(b):
            w = _WORD.findall(s.lower())
            if len(w) >= 3:
                out.append(w)
    return out


def units(text: str | None) -> Counter:
    """Counts of the words and of the sentence shapes (length, share of long words) of a text."""
    c: Counter = Counter()
    for w in sentences(text or ""):
        c.update(w)
        n = len(w)
        long = sum(len(x) >= 9 for x in w)
        c[f"#{min(16, n // 3)}_{round(10 * long / n)}"] += SHAPE_WEIGHT
    return c


def formula_band(c: Counter) -> int:
    """A level from average sentence length and word length alone, to seed models where no labels exist."""
    words = {w: n for w, n in c.items() if not w.startswith("#")}
    total = sum(words.values())
    stops = sum(n for w, n in c.items() if w.startswith("#")) / SHAPE_WEIGHT
    if not total or not stops:
        return 3
    grade = 0.39 * total / stops + 11.8 * sum(max(1, len(w) / 3.2) * n for w, n in words.items()) / total - 15.59
    return int(np.clip(1 + grade // 6, 1, BANDS))


class LevelModels:
    """Log-probabilities of the units per level."""

    def __init__(self, counts: dict[str, np.ndarray], documents: np.ndarray):
        kept = {u: v for u, v in counts.items() if v.sum() >= LEAST}
        self.index = {u: i for i, u in enumerate(sorted(kept))}
        table = np.array([kept[u] for u in sorted(kept)]).reshape(-1, BANDS)
        total = table.sum(0) + ALPHA * max(len(table), 1)
        self.log = np.log((table + ALPHA) / total)
        self.prior = np.log((documents + 1) / (documents.sum() + BANDS))

    def band(self, c: Counter) -> int:
        """The level of highest posterior; the easier one on a tie."""
        at = [(self.index[u], n) for u, n in c.items() if u in self.index]
        score = self.prior.copy()
        if at:
            i, n = zip(*at)
            score = score + np.array(n, dtype=float) @ self.log[list(i)]
        return int(np.argmax(score)) + 1


def english(lang: Column) -> Column:
    """Whether a language label says English in any spelling (en, eng, EN-gb, en_US, English)."""
    return F.coalesce(F.lower(F.trim(lang)).rlike(r"^(en|eng|english)([-_. ].*)?$"), F.lit(False))


def train(documents: DataFrame, labels: DataFrame) -> LevelModels:
    """Models from labelled English texts; every label counts, so readers who disagree share a text's words.

    Labels outside 1..5 and labels without a document are left out; repeated label rows count once. If no
    label remains, up to MOST_LABELLED texts seeded by :func:`formula_band` take their place. The counts are
    added up by Spark; what reaches the driver is bounded by the vocabulary of MOST_LABELLED texts.
    """
    said = labels.where(F.col("band").between(1, BANDS)).groupBy("doc_id", "reader", "band").agg(F.lit(1).alias("one"))
    per = cut(said.where("doc_id is not null").groupBy("doc_id").agg(F.collect_list("band").alias("bands")))
    per = per.join(bounded_sample(per, "doc_id", MOST_LABELLED), "doc_id", "left_semi")
    texts = documents.where(english(F.col("lang"))).select("doc_id", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: Counter = Counter()
            for text, bands in zip(b["text"], b["bands"]):
                c = units(text)
                for band in bands if bands is not None else [formula_band(c)]:
                    rows["", int(band)] += 1
                    for u, n in c.items():
                        rows[u, int(band)] += n
            yield pd.DataFrame([(u, b, n) for (u, b), n in rows.items()], columns=["unit", "band", "n"])

    def collected(frame: DataFrame) -> list:
        return frame.mapInPandas(count, "unit string, band int, n long").groupBy("unit", "band").agg(F.sum("n").alias("n")).collect()

    # at most MOST_LABELLED rows of an id and some levels, some megabytes
    rows = collected(texts.join(F.broadcast(per), "doc_id").select("text", "bands"))
    if not rows:
        some = texts.join(F.broadcast(bounded_sample(texts.where("doc_id is not null"), "doc_id", MOST_LABELLED)), "doc_id", "left_semi")
        rows = collected(some.select("text", F.lit(None).cast("array<int>").alias("bands")))
    counts: dict[str, np.ndarray] = {}
    docs = np.zeros(BANDS)
    for r in rows:
        if r["unit"] == "":
            docs[r["band"] - 1] += r["n"]
        else:
            counts.setdefault(r["unit"], np.zeros(BANDS))[r["band"] - 1] += r["n"]
    return LevelModels(counts, docs)


def reading_bands(documents: DataFrame, labels: DataFrame, least_words: int = 40) -> DataFrame:
    """(doc_id, band) of every document labelled English with at least ``least_words`` words.

    Words are runs without white space. Null or shorter texts have no row; a text without any sentence
    (only code or tables) gets the most frequent level; equal texts get equal levels.
    """
    models = documents.sparkSession.sparkContext.broadcast(train(documents, labels))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bands = [models.value.band(units(t)) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "band": np.array(bands, dtype=np.int32)})

    words = F.size(F.split(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), r"(?U)\s+"))
    chosen = documents.where(english(F.col("lang")) & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (words >= least_words))
    return widen(chosen.select("doc_id", "text")).mapInPandas(run, "doc_id long, band int")
