"""Credentials embedded in code and text: where they start, and texts without them."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.llm.sampling import bounded_sample
from siftlode.llm.secrets_model import STATES, Candidate, CharModel, Scorer, bigrams, candidates, features, hashed, no_credential, pem_span, weak_label
from siftlode.plans.runtime import parallelism, stored

#: Documented bound of the fit: texts (smallest hashes of candidate_id) whose weakly labelled values train
#: the classifier. Character counts come from all texts, and every text is scored.
FIT_TEXTS = 20_000
#: Calibrated probability from which a value counts as a credential.
LEAST = 0.5


def texts(table: DataFrame) -> DataFrame:
    """(candidate_id, text, path, kind, language): one row per candidate, the last extracted, then the larger text."""
    last = F.max(F.struct("extracted_at", "text", "artifact_path", "candidate_type", "language"))
    # a fixed width, so that adaptive execution does not join small partitions of costly texts into a few tasks
    return (
        table.where("candidate_id is not null and text is not null")
        .repartition(parallelism(table.sparkSession), "candidate_id")
        .groupBy("candidate_id")
        .agg(last.alias("m"))
        .select(
            "candidate_id",
            "m.text",
            F.coalesce("m.artifact_path", F.lit("")).alias("path"),
            F.coalesce("m.candidate_type", F.lit("")).alias("kind"),
            F.coalesce("m.language", F.lit("")).alias("language"),
        )
    )


def char_model(t: DataFrame) -> CharModel:
    """Character pairs of all texts; the table that reaches the driver has STATES x STATES numbers at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(STATES * STATES, dtype=np.int64)
        for b in batches:
            for x in b["text"]:
                total += bigrams(x)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"pair": at.astype(np.int32), "n": total[at]})

    rows = t.select("text").mapInPandas(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(STATES * STATES)
    for r in rows:
        total[r["pair"]] = r["n"]
    return CharModel(total)


def fit(t: DataFrame, chars: CharModel) -> Scorer:
    """The classifier, fitted in one task over the weak labels of at most FIT_TEXTS texts."""
    shared = t.sparkSession.sparkContext.broadcast(chars)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, path, kind, language in zip(b["text"], b["path"], b["kind"], b["language"]):
                for c in candidates(text):
                    s = shared.value.surprise(c.value)
                    y = weak_label(c, s)
                    # of the many sure negatives a quarter is enough to fit on; classes are weighted
                    if y == 1 or y == 0 and zlib.crc32(c.value.encode() + c.left[-20:].encode()) % 4 == 0:
                        rows.append((hashed(features(c, s, path, kind, language)).astype(np.int32), y))
            yield pd.DataFrame(rows, columns=["at", "y"])

    # FIT_TEXTS ids at most, some 160 KB
    some = t.join(F.broadcast(bounded_sample(t, "candidate_id", FIT_TEXTS)), "candidate_id", "left_semi")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_k=[x.tobytes() for x in pdf["at"]]).sort_values(["_k", "y"])
        s = Scorer.fit([np.asarray(x, dtype=np.int64) for x in pdf["at"]], pdf["y"].to_numpy())
        return pd.DataFrame({"w": [s.w.tobytes()], "scale": [s.scale], "shift": [s.shift]})

    rows = (
        some.repartition(parallelism(t.sparkSession), "candidate_id")
        .mapInPandas(label, "at array<int>, y int")
        .groupBy(F.lit(1).alias("one"))
        .applyInPandas(one, "w binary, scale double, shift double")
        .collect()
    )
    if not rows:
        return Scorer(np.zeros(1 << 16), 1.0, -20.0)
    return Scorer(np.frombuffer(bytes(rows[0]["w"])), rows[0]["scale"], rows[0]["shift"])


def hits(text: str, path: str, kind: str, language: str, chars: CharModel, scorer: Scorer) -> list[tuple[Candidate, float]]:
    """The values of a text that count as credentials, with their probabilities."""
    out = []
    for c in candidates(text):
        if no_credential(c):
            continue  # by definition; other weak negatives only train, and are scored
        s = chars.surprise(c.value)
        p = scorer.probability(hashed(features(c, s, path, kind, language)))
        if c.kind == "private_key" or p >= LEAST:
            out.append((c, max(p, 0.99) if c.kind == "private_key" else p))
    return out


def redacted(text: str, found: list[tuple[Candidate, float]]) -> str:
    """The text with each value replaced by ``[REDACTED:SECRET:n]``; quotes, names and line ends stay.

    The body of a private key block goes with it; the marker takes the place of the BEGIN line.
    """
    lines = text.split("\n")
    gone: set[int] = set()
    # from the end, so that places in lines hold until they are used
    for n, (c, _) in sorted(enumerate(found, 1), key=lambda x: (-x[1][0].line, -x[1][0].at)):
        i, mark = c.line - 1, f"[REDACTED:SECRET:{n}]"
        if c.kind == "private_key":
            end_at, closed = pem_span(lines[i], c.at + len(c.value))
            lines[i] = lines[i][: c.at] + mark + lines[i][end_at:]
            if closed:
                continue
            for j in range(i + 1, len(lines)):
                end = re.search(r"-----END [A-Z0-9 ]+-----", lines[j])
                if end:
                    lines[j] = lines[j][end.end() :]
                    if not lines[j].strip():
                        gone.add(j)
                    break
                if not re.match(r"^[\s>|#*/\"'+\\n]*[A-Za-z0-9+/=]{16,}[\s\"'+\\n;,]*$", lines[j]):
                    break
                gone.add(j)
        else:
            lines[i] = lines[i][: c.at] + mark + lines[i][c.at + len(c.value) :]
    return "\n".join(x for j, x in enumerate(lines) if j not in gone)


def find_credentials(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, clean texts) of extraction candidates.

    Findings: (candidate_id, line_no, probability), one row per line on which a credential starts, of the
    last extracted row of each candidate. Clean texts: (candidate_id, text, values) for the candidates with
    findings. Null texts have none; repeated rows count once; all candidate types are searched.
    """
    t = stored(texts(table))
    chars = char_model(t)
    model = t.sparkSession.sparkContext.broadcast((chars, fit(t, chars)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for cid, text, path, kind, language in zip(b["candidate_id"], b["text"], b["path"], b["kind"], b["language"]):
                found = hits(text, path, kind, language, *model.value)
                if found:
                    best: dict[int, float] = {}
                    for c, p in found:
                        best[c.line] = max(best.get(c.line, 0.0), p)
                    rows.append((cid, redacted(text, found), len(found), list(best), list(best.values())))
            yield pd.DataFrame(rows, columns=["candidate_id", "text", "values", "lines", "probabilities"])

    schema = "candidate_id long, text string, values int, lines array<int>, probabilities array<double>"
    scanned = t.mapInPandas(run, schema)
    found = scanned.select("candidate_id", F.explode(F.arrays_zip("lines", "probabilities")).alias("x")).select(
        "candidate_id", F.col("x.lines").alias("line_no"), F.col("x.probabilities").alias("probability")
    )
    return found, scanned.select("candidate_id", "text", "values")
