"""The licence of each code file and repository, from several kinds of evidence."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.plans.runtime import cut, widen

#: How often evidence of a kind names the licence that really applies.
RELIABILITY = {"own": 0.98, "licence_file": 0.98, "manifest": 0.98, "near_licence_file": 0.60, "readme": 0.25, "configured": 0.20}
#: Kinds that declare a licence, those first that speak for their subject itself; the others only shift the probability.
OWN, DECLARING = ("own", "licence_file", "manifest"), ("own", "licence_file", "manifest", "near_licence_file")
#: Prior probabilities that no licence applies and that contradictory ones do; the rest is spread over all licences.
NONE, CONTRADICTION = 0.05, 0.05
#: A posterior below this is no decision.
DECIDED = 0.50
#: Share of a licence's own word 4-grams that a licence file must hold, and the number a file header must.
FILE_SHARE = 0.15
HEADER_GRAMS = 8

_COMMENT = re.compile(r"^[ \t]*(?://+!?|#+!?|/\*+!?|\*+/|\*+|--+|;+|<!--|%+|\"\"\"|''')?[ \t]*")
_LINE_FORMS = re.compile(
    r"(?i)^(?:spdx-licen[cs]e-identifier\s*:?\s*|@licen[cs]e\s*:?\s+|__licen[cs]e__\s*=\s*|licen[cs]es?\s*[:=]\s*"
    r"|terms of use\s*[-:]\s*|rights\s*:\s*)(?P<x>[^\n]+)$"
)
_PROSE_FORMS = re.compile(
    r"(?i)\b(?:(?:licen[cs]ed|released|distributed|published|redistributed|provided|available|allowed|offered|use this (?:file|work|program)"
    r"|by its makers)\b[^.;,¶]*?\bunder|covered by|subject to)\s+(?:the\s+terms\s+of\s+)?(?P<either>either\s+)?(?:the\s+)?"
)
_GENERIC = re.compile(r"(?:[A-Z0-9][\w.+-]*|of|and|for)(?:\s+(?:[A-Z0-9][\w.+-]*|of|and|for|version|v?\d[\w.]*)){0,7}")
_OR = re.compile(r"(?i)\s*,?\s+or\s+(?:the\s+|under\s+(?:the\s+)?)?")
_LEGAL = re.compile(r"(?i)\b(?:licen[cs]e|terms|notice|agreement|conditions|eula)\b")


def is_readme(path: str | None) -> bool:
    return (path or "").rsplit("/", 1)[-1].lower().startswith("readme")


def _plain(name: str) -> str:
    s = re.sub(r"(?i)\b(the|licen[cs]e|version|v)\b|[^a-z0-9.+]+", " ", name.lower())
    return " ".join(s.split()).strip(". ")


class LicenceBook:
    """Names and texts of the known licences; small and fixed, so it travels with the tasks."""

    def __init__(self, rows: list[tuple[str, str, list[str] | None, str | None]]):
        self.names: dict[str, str] = {}
        self.plain: dict[str, str] = {}
        grams: dict[str, set] = {}
        for lid, title, aliases, body in rows:
            if not lid:
                continue
            for n in [lid, title, *(aliases or [])]:
                if n:
                    self.names[" ".join(n.lower().split())] = lid
                    self.plain.setdefault(_plain(n), lid)
            grams[lid] = set(self._grams(body or ""))
        self.titles = {" ".join(t.lower().split()): lid for lid, t, _, _ in rows if lid and t}
        shared: dict[tuple, int] = {}
        for g in grams.values():
            for x in g:
                shared[x] = shared.get(x, 0) + 1
        self.by_gram = {x: lid for lid, g in grams.items() for x in g if shared[x] == 1}
        self.sizes: dict[str, int] = {}
        for lid in self.by_gram.values():
            self.sizes[lid] = self.sizes.get(lid, 0) + 1
        alt = "|".join(re.escape(n).replace(r"\ ", r"\s+") for n in sorted(self.names, key=len, reverse=True))
        self.name = re.compile(rf"(?i)(?:{alt or 'a^'})(?![A-Za-z0-9]|-[A-Za-z0-9]|\.\d)")

    @staticmethod
    def _grams(text: str) -> list[tuple]:
        w = re.findall(r"[a-z0-9]+", text.lower())
        return list(zip(w, w[1:], w[2:], w[3:]))

    def one(self, name: str) -> str | None:
        """The id of a single name; other names come back as ``other:<name>``, nothing as None."""
        s = name.strip().strip("\"'`(){}[]<>,;").strip()
        s = re.sub(r"\s*(?:\*/|-->|\"\"\")\s*$", "", s).rstrip(".,; )").lstrip("( ")
        if not s or s.lower() in ("none", "null", "n/a", "see license", "see licence", "license", "licence"):
            return None
        low = " ".join(s.lower().split())
        if low in self.names:
            return self.names[low]
        p = _plain(s)
        return self.plain.get(p) or f"other:{p or low}"

    def expression(self, text: str) -> str | None:
        """``A``, or ``A OR B`` (alphabetical) for a choice; an AND of two is a list of duties, kept as ``A AND B``."""
        text = text.strip().strip("\"'` ")
        parts = re.split(r"(?i)\s+or\s+|\s*\|\|?\s*|\s*/\s*(?=[A-Z])", re.sub(r"[()]", " ", text))
        ids = sorted({i for i in (self.one(re.sub(r"(?i)^\s*(either|the)\s+", "", p)) for p in parts) if i})
        return " OR ".join(ids) if ids else None

    def declared(self, role: str | None, path: str | None, text: str | None) -> list[str]:
        """Every licence that the text itself declares, each once, in order of the alphabet."""
        if not text:
            return []
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        if is_readme(path) or role == "documentation":
            return []
        if role == "manifest":
            return self._manifest(text)
        lines = [_COMMENT.sub("", x, count=1).strip() for x in text.split("\n")]
        out = set()
        for x in lines:
            m = _LINE_FORMS.match(x)
            if m and role != "license":
                e = self.expression(re.sub(r"\s*(?:\*/|-->)\s*$", "", m["x"]))
                if e:
                    out.add(e)
        flat = " ".join(x if x else "¶" for x in lines)
        for m in _PROSE_FORMS.finditer(flat):
            first = self.name.match(flat, m.end())
            if first:
                ids = {self.names[" ".join(first.group(0).lower().split())]}
                second = _OR.match(flat, first.end())
                if second:
                    more = self.name.match(flat, second.end())
                    if more:
                        ids.add(self.names[" ".join(more.group(0).lower().split())])
                out.add(" OR ".join(sorted(ids)))
            elif role != "license":
                g = _GENERIC.match(flat, m.end())
                if g and _LEGAL.search(g.group(0)) and len(g.group(0).split()) > 1:
                    out.add(f"other:{_plain(g.group(0))}")
        hits: dict[str, set] = {}
        for g in self._grams(flat):
            lid = self.by_gram.get(g)
            if lid:
                hits.setdefault(lid, set()).add(g)
        if role == "license":
            whole = {lid for lid, g in hits.items() if len(g) >= FILE_SHARE * self.sizes[lid]}
            if not whole:
                named = (" ".join(x.lower().split()) for x in lines)
                whole = {self.titles[x] for x in named if x in self.titles}
            if not whole and not out:
                first = next((x for x in lines if x and not set(x) <= set("=-~ ") and x.lower() not in ("licence", "license")), "")
                whole = {f"other:{_plain(first)}"} if first else set()
            out |= whole
        else:
            out |= {lid for lid, g in hits.items() if len(g) >= HEADER_GRAMS}
        choice = [x for x in out if " OR " in x]
        out -= {x for c in choice for x in c.split(" OR ")}  # a part named again beside the choice
        return sorted(out)

    def _manifest(self, text: str) -> list[str]:
        out = set()
        for m in re.finditer(
            r"(?im)(?:^|[,{\s])[\"']?licen[cs]e[\"']?\s*[:=]\s*(?:\{[^{}]*?[\"']?(?:type|text|name)[\"']?\s*[:=]\s*)?(?:\"(?P<a>[^\"\n]*)\"|'(?P<b>[^'\n]*)'|(?P<c>[^\"'{\[\s][^\n]*))",
            text,
        ):
            e = self.expression(m["a"] or m["b"] or m["c"] or "")
            if e and not re.match(r"other:(see|file)\b", e):
                out.add(e)
        return sorted(out)


def _beliefs(pieces: list[tuple[str, str]], states: int, contradictory: list[str], scope: list[str]) -> tuple[dict[str, float], float]:
    """Joint weights of the named states (licences, ``none`` and ``conflict``), and of all licences that nobody named together."""
    n = max(states, 2)
    each = (1 - NONE - (CONTRADICTION if contradictory else 0)) / n
    named = sorted({v for _, v in pieces} | set(scope))

    def leaf(kind: str, value: str, truth: list[str]) -> float:
        r = RELIABILITY[kind]
        return r / len(truth) if value in truth else (1 - r) / max(n - len(truth), 1)

    def held(truth: list[str]) -> float:
        # a configured scope names one of its licences at its reliability, evenly
        if not scope:
            return 1.0
        r = RELIABILITY["configured"]
        inside = sum(t in scope for t in truth)
        return r * inside / (len(scope) * len(truth)) if inside else (1 - r) / max(n - len(scope), 1)

    def weight(prior: float, truth: list[str]) -> float:
        w = prior * (held(truth) if truth else (1 - RELIABILITY["configured"]) / n if scope else 1.0)
        for kind, value in pieces:
            w *= leaf(kind, value, truth) if truth else (1 - RELIABILITY[kind]) / n
        return w

    out = {v: weight(each, [v]) for v in named}
    out["none"] = weight(NONE, [])
    if contradictory:
        out["conflict"] = weight(CONTRADICTION, contradictory)
    return out, max(n - len(named), 0) * weight(each, ["\0 nobody's"])


def posterior(evidence: list[tuple[str, str]], states: int) -> tuple[str, float, bool]:
    """(licence, probability, contradiction) from (kind, licence) evidence.

    A Bayesian network of one hidden node, what applies: one of all ``states`` licences (known ones and unlisted
    ones), none, or several that contradict each other; and one leaf per piece of evidence, which names
    the true licence with its kind's reliability, one of the contradictory ones evenly, and any other with the rest.
    Equal pieces of one kind count once. What can contradict is what the subject says of itself, or where it says
    nothing, what the licence file above it says. The declarations decide: the best state of at least DECIDED
    probability; with less, ``conflict`` where several licences are stated, else ``unknown``. A licence outside the
    book, and none, are ``unknown``. The probability given is that of the decided state after all evidence,
    readme and configuration too, so one weak piece alone stays weak, and an ``unknown`` without evidence is near its prior.
    """
    pieces = sorted({p for p in evidence if p[0] in DECLARING})
    said = sorted({v for _, v in pieces})
    own = sorted({v for kind, v in pieces if kind in OWN}) or said
    contradictory = own if len(own) > 1 else []
    first, rest = _beliefs(pieces, states, contradictory, [])
    total = sum(first.values()) + rest
    best = max(sorted(first), key=lambda s: first[s])
    if not pieces:
        best = "none"
    elif first[best] < DECIDED * total:
        best = "conflict" if len(said) > 1 else "none"
    soft = sorted({p for p in evidence if p[0] not in DECLARING and p[0] != "configured"})
    scope = sorted({v for kind, v in evidence if kind == "configured"})
    full, rest = _beliefs(sorted({*pieces, *soft}), states, contradictory, scope)
    p = full.get(best, 0.0) / (sum(full.values()) + rest)
    if best == "conflict":
        return "conflict", p, True
    return ("unknown" if best == "none" or best.startswith("other:") else best), p, len(said) > 1


def _configured(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(subject, subject_id, configured_ids, configured_policies) of every file and root: licences and policies of its sources, and the files' policy labels."""
    last = F.max(F.struct("fetched_at", F.col("root_identifier").alias("root"), "source_id", "license_policy_label"))
    one = files.where("file_id is not null").groupBy("file_id").agg(last.alias("m")).select("file_id", "m.*")
    newest = F.max_by(F.struct(F.coalesce("license_ids", F.array().cast("array<string>")).alias("ids"), "license_policy"), "updated_at")
    s = sources.groupBy("source_id").agg(newest.alias("s")).select("source_id", "s.*")
    # sources is a fixed table of some dozens of rows
    c = one.join(F.broadcast(s), "source_id", "left").select(
        "root", F.col("file_id").cast("string").alias("file_id"), "ids", F.array_compact(F.array("license_policy", "license_policy_label")).alias("policies")
    )
    flat = lambda x: F.array_sort(F.array_distinct(F.flatten(F.collect_set(x))))
    each = lambda name, key: c.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("subject_id")).agg(
        flat("ids").alias("configured_ids"), flat("policies").alias("configured_policies")
    ).withColumn("subject", F.lit(name))
    return each("file", "file_id").unionByName(each("root", "root"))


def _contradicts():
    """outside_scope: known, but none of its names is among the configured licences; unknown_allowed: a policy allows what
    declares no known licence; denied_in_scope: a policy denies what declares a configured licence."""
    names, ids = F.split("license_id", " OR "), F.col("configured_ids")
    known, inside = ~F.col("license_id").isin("unknown", "conflict"), F.arrays_overlap(names, ids)
    has = lambda p: F.array_contains("configured_policies", p)
    tests = {"outside_scope": known & (F.size(ids) > 0) & ~inside, "unknown_allowed": ~known & has("allowed"), "denied_in_scope": known & inside & has("denied")}
    return F.array_compact(F.array(*[F.when(t, k) for k, t in tests.items()]))


def licence_book(license_texts: DataFrame) -> LicenceBook:
    """The book from license_texts, a fixed table of known licences (some dozens of rows)."""
    return LicenceBook([(r["license_id"], r["title"], list(r["aliases"] or []), r["body"]) for r in license_texts.collect()])


def file_declarations(files: DataFrame, book: LicenceBook) -> DataFrame:
    """(file_id, root, path, dir, role, declared array, mentioned array): one row per file; repeated rows count once, the last fetched holds."""
    shared = files.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["declared"] = [shared.value.declared(r, p, t) for r, p, t in zip(b["role"], b["path"], b["text"])]
            # what a readme says is no declaration, but evidence
            b["mentioned"] = [shared.value.declared("source", None, t) if is_readme(p) else [] for p, t in zip(b["path"], b["text"])]
            yield b[["file_id", "root", "path", "role", "fetched_at", "declared", "mentioned"]]

    rows = files.where("file_id is not null").select(
        "file_id", F.col("root_identifier").alias("root"), "path", F.col("artifact_role").alias("role"), "text", "fetched_at"
    )
    kind = files.schema["fetched_at"].dataType.simpleString()
    found = widen(rows).mapInPandas(run, f"file_id long, root string, path string, role string, fetched_at {kind}, declared array<string>, mentioned array<string>")
    last = F.max(F.struct("fetched_at", "path", "root", "role", "declared", "mentioned"))
    one = found.groupBy("file_id").agg(last.alias("m")).select("file_id", "m.root", "m.path", "m.role", "m.declared", "m.mentioned")
    return one.withColumn("dir", F.regexp_replace(F.coalesce("path", F.lit("")), "/?[^/]*$", ""))


def _decide(states: int):
    @F.pandas_udf("struct<license_id:string,probability:double,contradiction:boolean>")
    def f(e: pd.Series) -> pd.DataFrame:
        keys = [tuple(sorted((x["kind"], x["value"]) for x in (v if v is not None else []))) for v in e]
        known = {k: posterior(list(k), states) for k in set(keys)}
        return pd.DataFrame([known[k] for k in keys], columns=["license_id", "probability", "contradiction"])

    return f


def _pieces(kind: str, values: str):
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def licences(files: DataFrame, license_texts: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(subject, subject_id, license_id, probability, contradiction, low_confidence, evidence) for every file and every root.

    File: what its own text declares, beside the licence files of the nearest directory at or above it,
    which hold less evidence and so decide only where the file is silent. Root: its top-level licence
    files and manifests. A null root is a root of its own without files above; a null or empty text
    declares nothing; readme and documentation files declare nothing, though a root's readme is evidence for the
    probability. ``low_confidence`` is a probability below DECIDED. With ``sources`` also configured_ids,
    configured_policies and configured_contradictions; the configured licences are evidence for the probability only.
    """
    book = licence_book(license_texts)
    states = len(set(book.names.values())) + 2
    d = cut(file_declarations(files, book))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    # licence files by directory; then the nearest one for each distinct directory
    shelf = (
        d.where("role = 'license'")
        .select("root", "dir", F.explode("declared").alias("value"))
        .groupBy("root", "dir")
        .agg(F.array_sort(F.collect_set("value")).alias("values"))
    )
    parts = F.split("dir", "/")
    above = F.when(
        F.col("dir") == "", F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("up")))
    ).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.size(parts)),
            lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("up")),
        )
    )
    dirs = d.select("root", "dir").distinct().select("root", "dir", F.explode(above).alias("a")).select("root", "dir", "a.*")
    s = shelf.select(F.col("root").alias("_r"), F.col("dir").alias("up"), "values")
    near = (
        dirs.join(s, (dirs["root"].eqNullSafe(s["_r"])) & (dirs["up"] == s["up"]))
        .groupBy("root", "dir")
        .agg(F.max_by("values", "depth").alias("near"))
    )
    n = near.select(F.col("root").alias("_r"), F.col("dir").alias("_d"), "near")
    f = d.join(n, d["root"].eqNullSafe(n["_r"]) & (d["dir"] == n["_d"]), "left")
    by_file = f.select(
        F.lit("file").alias("subject"),
        F.col("file_id").cast("string").alias("subject_id"),
        F.concat(_pieces("own", "declared"), F.coalesce(_pieces("near_licence_file", "near"), none)).alias("evidence"),
    )
    top = d.where((F.col("dir") == "") & F.col("role").isin("license", "manifest"))
    kind = F.when(F.col("role") == "license", "licence_file").otherwise("manifest")
    said = top.select("root", kind.alias("kind"), F.explode("declared").alias("value"))
    said = said.unionByName(d.where("dir = ''").select("root", F.lit("readme").alias("kind"), F.explode("mentioned").alias("value"))).distinct()
    by_root = (
        d.select("root").distinct().where("root is not null")
        .join(said, "root", "left")
        .groupBy("root")
        .agg(F.collect_set(F.when(F.col("value").isNotNull(), F.struct("kind", "value"))).alias("evidence"))
        .select(F.lit("root").alias("subject"), F.col("root").alias("subject_id"), "evidence")
    )
    both = by_file.unionByName(by_root)
    if sources is not None:
        both = both.join(_configured(files, sources), ["subject", "subject_id"], "left").withColumn("evidence", F.concat("evidence", F.coalesce(_pieces("configured", "configured_ids"), none)))
    low = (F.col("r.probability") < DECIDED).alias("low_confidence")
    both = both.withColumn("r", _decide(states)("evidence"))
    if sources is not None:
        return both.select("subject", "subject_id", "r.*", low, "evidence", "configured_ids", "configured_policies").withColumn("configured_contradictions", _contradicts())
    return both.select("subject", "subject_id", "r.*", low, "evidence")
