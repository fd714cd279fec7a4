"""Source files that nobody wrote by hand: tool output, compressed scripts, copies of other projects, data.

Four signs come from Re-Pair grammars. Within a file: high rule reuse over literals marks generated tables, and literals
that the grammar cannot compress mark data. Across roots: pairs of lines, the rules of a first round over all
files' lines, mark copies where rare ones are shared. And the phrases of comments and paths: the rules of one
grammar over them, of which those count whose files carry the table's flags as often as files known by the other signs do.
Lists of banners and places, and line lengths, complement these.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.llm.grammar import KEYWORDS, PhraseGrammar, Sequences, abstract, lex, reuse, round_floor, round_pairs, rounds
from siftlode.plans.runtime import discard, parallelism, stored

#: Directories and name endings by which build tools and package managers mark their output.
GENERATED_DIRS = frozenset("generated __generated__ generated-sources generated_sources autogen auto_generated gen dist build out target".split())
VENDORED_DIRS = frozenset(
    "vendor vendors vendored third_party third-party thirdparty 3rdparty 3rd_party external externals extern node_modules bower_components "
    "jspm_packages deps godeps _workspace pods carthage site-packages upstream".split()
)
GENERATED_NAME = re.compile(r"(?i)(?:_pb2|_grpc|_gen|\.g|\.pb|\.gen|\.generated|\.designer)\.\w+$")
_GENERATED_BANNER = re.compile(
    r"(?i)^(?:@generated\b|<auto-?generated\b|auto-?generated\b(?!.*\bsays\b)|(?:this (?:file|code) (?:is|was) |code |file |this is )?(?:automatically |auto-?)?generated (?:by|from|with|using)\b"
    r"|this (?:file|code) (?:is|was|has been) (?:produced|created|built|written|auto-?generated|generated) (?:automatically|by)\b"
    r"|(?:this (?:file|code) (?:is|was|has been) )?automatically (?:produced|created|generated)\b"
    r"|source\s*:\s*\S+\.(?:proto|idl|thrift|fbs)$|output of (?:the )?\S+ (?:compiler|generator|tool|assembler)\b|(?:warning|note|caution)?[:!]?\s*do not (?:edit|modify|change)\b)"
)
_VENDORED_BANNER = re.compile(r"(?i)^(?:upstream\s*:\s*\S+|bundled copy of \S+|(?:imported|taken|copied|vendored) (?:unchanged |verbatim )?from (?:the )?\S+)")
_RELEASE = re.compile(r"(?i)^[*!\s]*([a-z][\w.\-]*) v?\d+\.\d+[\w.\-]*$")

#: Thresholds of the signs: reuse of rules and share of literals among tokens of generated tables; share of keywords among
#: tokens, incompressible share of the characters (with that share of literals among tokens, or alone) and their number for data;
#: characters in very long lines.
REUSE, REUSE_LITERALS = 6.0, 0.18
DATA_KEYWORDS, DATA_MASS, DATA_LITERALS, DATA_MOST, DATA_CHARS = 0.03, 0.25, 0.25, 0.6, 64
LONG_LINE, LONG_SHARE = 300, 0.5
#: A pair of lines that more roots share than this number, or this part of all roots, is an idiom and tells nothing; of the
#: others, this share must be shared with another root; one line in common by chance makes two pairs, which are counted against it.
IDIOM_ROOTS, IDIOM_PART, SHARED_SHARE, CHANCE_PAIRS = 20, 0.01, 0.6, 2
#: A word keeps its identity in phrases if so many roots have it, a phrase is made if it has so many uses, and it counts if so many roots have it.
WORD_ROOTS, PHRASE_USES, PHRASE_ROOTS = 8, 6, 4
#: Symbols of the distinct comment lines and paths up to which one task does the rounds of the phrase grammar; above, all tasks do, with the same rules.
TASK_SYMBOLS = 4_000_000

_BLOCK = re.compile(r"(?:^|(?<=[\s;{}(),]))/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z)|^[ \t]*(?P<q>\"\"\"|''').*?(?:(?P=q)|\Z)", re.S | re.M)
_LINE = re.compile(r"(?m)^[ \t]*(?://|#(?=[ \t!/]|$)|--(?=[ \t])|;;).*$")
_WORDS = re.compile(r"[A-Za-z]+|\d+|[^\sA-Za-z\d]")


def split_comments(text: str) -> tuple[list[str], str]:
    """(lines of comments without their marks, code without whole-line comments, block comments and doc strings)."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    said: list[str] = []

    def keep(m: re.Match) -> str:
        for line in m.group(0).split("\n"):
            s = re.sub(r"^[\s/*#!;\-]+|\s*(?:\*/|-->)\s*$", "", line).strip().strip("\"'")
            if s:
                said.append(s)
        return "\n"

    return said, _LINE.sub(keep, _BLOCK.sub(keep, text))


def words(text: str) -> list[str]:
    """Lower-case words, single signs, and one symbol for any number."""
    return ["0" if x.isdigit() else x.lower() for x in _WORDS.findall(text)]


def path_words(path: str | None) -> list[str]:
    """A path as words, with its beginning and end."""
    parts = (path or "").replace("\\", "/").split("/")
    out = ["/"]
    for p in parts[:-1]:
        out += [*words(p), "/"]
    return [*out, *words(parts[-1]), "$"]


def facts(path: str | None, text: str | None) -> tuple:
    """(banner, where, reuse, literals, keywords, mass, blob, long_share, tokens, pairs, comments) of one file."""
    said, code = split_comments(text or "")
    banner = ""
    for n, s in enumerate(said):
        if _GENERATED_BANNER.search(s):
            banner = "generated"
            break
        if _VENDORED_BANNER.search(s):
            banner = "vendored"
            break
        m = _RELEASE.match(s)
        if m and any(re.search(rf"(?i)^(?:copyright|\(c\)).*\b{re.escape(m[1])}\b", t) for t in said[n + 1 : n + 4]):
            banner = "vendored"
            break
    parts = (path or "").lower().replace("\\", "/").split("/")
    where = ""
    if VENDORED_DIRS & set(parts[:-1]):
        where = "vendored"
    elif GENERATED_DIRS & set(parts[:-1]) or GENERATED_NAME.search(parts[-1]):
        where = "generated"
    lines = [x for x in code.split("\n") if x.strip()]
    chars = sum(map(len, lines))
    long = sum(len(x) for x in lines if len(x) >= LONG_LINE)
    by_line = [lex(x) for x in lines]
    tokens = [t for x in by_line for t in x]
    short = abstract(tokens)
    n = max(1, len(short))
    literal = [t for t, a in zip(tokens, short) if a in ("N", "S")]
    keywords = sum(a in KEYWORDS for a in short) / n
    # what the grammar leaves of the literals' characters; among keywords they are no data, and it is not asked
    blob = sum(map(len, literal)) / (reuse(literal) if keywords <= DATA_KEYWORDS else 1.0)
    plain = ["^", *map(" ".join, by_line), "$"] if by_line else []
    pairs = sorted({hashlib.blake2b(f"{a}\n{b}".encode("utf-8", "replace"), digest_size=16).digest() for a, b in zip(plain, plain[1:])})
    return (
        banner, where, float(reuse(short)), len(literal) / n, keywords,
        blob / max(1, sum(map(len, tokens))), float(blob), long / max(1, chars), len(short), pairs, said,
    )


_NAMES = ["banner", "place", "reuse", "literals", "keywords", "mass", "blob", "long_share", "tokens", "pairs", "comments"]
_FACTS = (
    "banner string, place string, reuse double, literals double, keywords double, mass double, blob double, long_share double, tokens int, "
    "pairs array<binary>, comments array<string>"
)


def file_facts(files: DataFrame) -> DataFrame:
    """One row per source file with the signs of :func:`facts`; of repeated rows the last fetched holds.

    ``flagged``: either of the table's flags says that the file was not written by hand.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([facts(p, t) for p, t in zip(b["path"], b["text"])], columns=_NAMES)
            out["tokens"] = out["tokens"].astype(np.int32)
            for i, c in enumerate(["file_id", "root", "path", "flagged"]):
                out.insert(i, c, b[c].to_numpy())
            yield out

    last = F.max(F.struct("fetched_at", "path", "root_identifier", "text", "generated", "vendored"))
    chosen = files.where("file_id is not null and artifact_role = 'source'").repartition(parallelism(files.sparkSession), "file_id")
    one = chosen.groupBy("file_id").agg(last.alias("m"))
    flag = F.coalesce("m.generated", F.lit(False)) | F.coalesce("m.vendored", F.lit(False))
    return one.select("file_id", F.col("m.root_identifier").alias("root"), "m.path", "m.text", flag.alias("flagged")).mapInPandas(
        run, f"file_id long, root string, path string, flagged boolean, {_FACTS}"
    )


def shared_pairs(f: DataFrame) -> DataFrame:
    """(file_id, shared): of a file's pairs of lines that are no idioms (and CHANCE_PAIRS more), the share that files of other roots have too.

    The pairs' roots are counted exactly, combined before either shuffle. A file without such pairs has no row.
    """
    root = F.xxhash64(F.coalesce("root", F.lit("")))
    each = f.select("file_id", root.alias("root"), F.explode("pairs").alias("pair"))
    roots = each.groupBy("pair", "root").agg(F.lit(1).alias("one")).groupBy("pair").agg(F.count(F.lit(1)).alias("roots"))
    some = max(IDIOM_ROOTS, IDIOM_PART * f.select("root").distinct().count())
    rare = each.join(roots.where(F.col("roots") <= some), "pair")
    return rare.groupBy("file_id").agg((F.count_if(F.col("roots") > 1) / (F.count(F.lit(1)) + CHANCE_PAIRS)).alias("shared"))


def phrase_grammar(f: DataFrame, task_symbols: int = TASK_SYMBOLS) -> PhraseGrammar:
    """The grammar of the comment lines and paths of all files.

    Equal lines are worked on once, with their number. The driver holds the words and the rules, which are what the phrases are made of.
    """
    spark = f.sparkSession

    def root_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            roots: dict[str, set] = {}
            for root, path, said in zip(b["root"], b["path"], b["comments"]):
                for s in [*map(words, said), path_words(path)]:
                    for w in s:
                        r = roots.setdefault(w, set())
                        # a word with so many roots here needs no others to be known
                        if len(r) < WORD_ROOTS:
                            r.add(root)
            yield pd.DataFrame([(w, x) for w, r in roots.items() for x in r], columns=["word", "root"])

    each = f.select("root", "path", "comments").mapInPandas(root_words, "word string, root string").groupBy("word", "root").agg(F.lit(1).alias("one"))
    often = each.groupBy("word").agg(F.count(F.lit(1)).alias("roots")).where(F.col("roots") >= WORD_ROOTS)
    bare = PhraseGrammar([], {x["word"] for x in often.select("word").collect()})
    shared = spark.sparkContext.broadcast(bare)

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = Counter(shared.value.pack(s) for path, said in zip(b["path"], b["comments"]) for s in [*map(words, said), path_words(path)])
            yield pd.DataFrame({"s": list(n), "n": list(n.values())})

    work = f.select("path", "comments").mapInPandas(lines, "s binary, n long").where(F.length("s") > 4)
    work = stored(work.groupBy("s").agg(F.sum("n").alias("n")))
    return PhraseGrammar([], bare.known, rules=phrase_rules(work, bare.alphabet, task_symbols))


def phrase_rules(work: DataFrame, first: int, task_symbols: int) -> np.ndarray:
    """The rules over sequences (s, n: number), in the order of :func:`rounds`; ``work`` is stored and is deleted.

    While there are more symbols than one task takes, a round is a count of all pairs, of which those that may be replaced reach the
    driver, packed, and a pass that replaces them.
    """
    spark, made, floor = work.sparkSession, [np.empty(0, np.int64)], PHRASE_USES

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"r": [x.tobytes() for x in rounds(Sequences(list(pdf["s"]), list(pdf["n"])), first, PHRASE_USES)]})

    while (work.agg(F.sum(F.length("s"))).first()[0] or 0) > 4 * task_symbols:
        top, pairs, counts = _frequent_pairs(work, floor)
        if top < PHRASE_USES:
            discard(work)
            return np.concatenate(made)
        if round_floor(top, PHRASE_USES) < floor:
            floor = round_floor(top, PHRASE_USES)
            continue
        floor = round_floor(top, PHRASE_USES)
        chosen = round_pairs(pairs[counts >= floor], counts[counts >= floor])
        shared = spark.sparkContext.broadcast((chosen, first))

        def replaced(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                s = Sequences(list(b["s"]), list(b["n"]))
                s.replace(*shared.value)
                yield pd.DataFrame({"s": s.packed(), "n": b["n"].to_numpy()})

        before, work = work, stored(work.mapInPandas(replaced, "s binary, n long").where(F.length("s") > 4))
        discard(before)
        shared.unpersist()
        made.append(chosen)
        # of the next round, that its list is complete at the first try
        first, floor = first + len(chosen), max(PHRASE_USES, floor // 2)
    made += [np.frombuffer(bytes(x["r"]), np.int64) for x in work.groupBy(F.lit(1).alias("one")).applyInPandas(finish, "r binary").collect()]
    discard(work)
    return np.concatenate(made)


def _frequent_pairs(work: DataFrame, floor: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The highest count of a pair, and the pairs of at least ``floor`` occurrences with their counts."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found, counts, _, _ = Sequences(list(b["s"]), list(b["n"])).pairs()
            yield pd.DataFrame({"pair": found, "n": counts})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            some = b[b["n"] >= floor]
            if len(b):
                yield pd.DataFrame({"top": [b["n"].max()], "pairs": [some["pair"].to_numpy(np.int64).tobytes()], "counts": [some["n"].to_numpy(np.int64).tobytes()]})

    n = work.mapInPandas(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    rows = n.mapInPandas(pack, "top long, pairs binary, counts binary").collect()
    join = lambda c: np.frombuffer(b"".join(bytes(x[c]) for x in rows), np.int64)
    return max((x["top"] for x in rows), default=0), join("pairs"), join("counts")


def file_phrases(f: DataFrame, grammar: PhraseGrammar) -> DataFrame:
    """(file_id, root, flagged, known, phrases): each comment line's largest phrases, and all phrases of the path (negative numbers)."""
    shared = f.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        for b in batches:
            rows = []
            for path, said in zip(b["path"], b["comments"]):
                u = {x for s in said for x in g.parse(words(s)) if x >= g.alphabet}
                # signs and wildcards alone name nothing
                rows.append(sorted((u & g.named) | {-x for x in g.nested(g.parse(path_words(path))) & g.named}))
            yield b[["file_id", "root", "flagged", "known"]].assign(phrases=rows)

    return f.select("file_id", "root", "flagged", "known", "path", "comments").mapInPandas(
        run, "file_id long, root string, flagged boolean, known boolean, phrases array<int>"
    )


def telling_phrases(p: DataFrame) -> list[tuple[int, int, int, float]]:
    """(phrase, files, flagged files, log-odds) of the phrases that tell files not written by hand.

    The flags are wrong for many files, but not alike: among the files that the other signs know they are set at one
    rate, among all others at a lower one. A phrase's unknown files are held against both: it tells if its log-likelihood ratio
    is above the logarithm of the number of phrases tried, and if its files are likelier all of the first kind than half
    of them. The strongest phrases are taken first, and the files that they tell count no more for the weaker
    ones, so that what merely stands beside a telling phrase tells nothing itself. All files are counted; what reaches the driver
    is a row per phrase, and their number is bounded by the grammar.
    """
    r = p.groupBy("known").agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("k")).collect()
    kinds = {x["known"]: (x["n"], x["k"]) for x in r}
    if not {True, False} <= set(kinds):
        return []
    high = (kinds[True][1] + 0.5) / (kinds[True][0] + 1)
    (n0, k0), rest, told, tried = kinds[False], p.where("not known").select("root", "flagged", "phrases"), [], 0
    while True:
        low = (k0 + 0.5) / (n0 + 1)
        if high <= low:
            return told
        each = rest.select("root", "flagged", F.explode("phrases").alias("phrase")).groupBy("phrase", "root")
        per = each.agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("k")).groupBy("phrase")
        rows = per.agg(F.count(F.lit(1)).alias("roots"), F.sum("n").alias("n"), F.sum("k").alias("k")).where(F.col("roots") >= PHRASE_ROOTS).collect()
        tried = tried or len(rows)

        def odds(k: int, n: int, other: float) -> float:
            return k * math.log(high / other) + (n - k) * math.log((1 - high) / (1 - other))

        scored = [(x["phrase"], x["n"], x["k"], odds(x["k"], x["n"], low), odds(x["k"], x["n"], (high + low) / 2)) for x in rows]
        good = sorted((x for x in scored if x[3] > math.log(max(2, tried))), key=lambda x: (-x[3], x[0]))
        pure = [x for x in good if x[4] > 0]
        if not pure:
            return told
        best = [x for x in pure if x[3] >= pure[0][3] / 3]
        told += [x[:4] for x in best]
        names = F.array(*[F.lit(x[0]) for x in best])
        gone = rest.where(F.arrays_overlap("phrases", names)).agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("k")).first()
        n0, k0 = n0 - gone["n"], k0 - gone["k"]
        # the scores of phrases only fall from here, so none but these can still tell
        still = F.array(*[F.lit(x[0]) for x in good])
        rest = rest.where(~F.arrays_overlap("phrases", names)).withColumn("phrases", F.array_intersect("phrases", still)).where(F.size("phrases") > 0)


def _own_signs() -> tuple[Column, Column, Column]:
    """Whether a file's own grammar and lines say data, minified, generated table."""
    much = ((F.col("mass") >= DATA_MASS) & (F.col("literals") >= DATA_LITERALS)) | (F.col("mass") >= DATA_MOST)
    data = (F.col("keywords") <= DATA_KEYWORDS) & much & (F.col("blob") >= DATA_CHARS)
    return data, F.col("long_share") >= LONG_SHARE, (F.col("reuse") >= REUSE) & (F.col("literals") >= REUSE_LITERALS)


def _phrases(files: DataFrame) -> tuple[DataFrame, DataFrame, PhraseGrammar]:
    """The facts with ``shared``, the phrases with ``known`` (another sign holds), and the phrases' grammar."""
    own = stored(file_facts(files))
    data, minified, table = _own_signs()
    known = data | minified | table | (F.coalesce("shared", F.lit(0.0)) >= SHARED_SHARE)
    narrow = ["file_id", "root", "path", "flagged", "comments"]
    # small, and read for the phrases and for the result
    f = own.drop("pairs", "path", "comments", "flagged", "root").join(stored(shared_pairs(own)), "file_id", "left")
    g = phrase_grammar(own)
    p = own.select(*narrow).join(f.select("file_id", known.alias("known")), "file_id")
    return f, stored(file_phrases(p, g)), g


def not_hand_written(files: DataFrame, lists: bool = True) -> DataFrame:
    """(file_id, reason, reuse, mass, shared) of every source file that was not written by hand in its root.

    Reasons, the first that holds: data (almost no keywords, and much that the grammar of the literals cannot
    compress), minified (mostly very long lines), generated (a grammar with high rule reuse over literals, or a listed banner, place or
    name of a tool), vendored (rare pairs of lines that other roots share, or a listed banner or place), marked (a
    comment or path with a telling phrase). A comment that only mentions a banner is another phrase, and no sign. The
    flags of single files are not used: they are wrong too often; they only weigh phrases. A null text, path or flag
    gives no sign from it; repeated rows count once. ``lists=False`` leaves the lists out.
    """
    data, minified, table = _own_signs()
    f, p, _ = _phrases(files)
    told = [x[0] for x in telling_phrases(p)]
    marks = p.where(F.arrays_overlap("phrases", F.array(*map(F.lit, told)))).select("file_id", F.lit(True).alias("marked")) if told else p.where("false").select("file_id", F.lit(True).alias("marked"))
    s = f.join(marks, "file_id", "left")
    listed = lambda kind: F.lit(lists) & ((F.col("banner") == kind) | (F.col("place") == kind))
    reason = (
        F.when(data, "data").when(minified, "minified").when(table | listed("generated"), "generated")
        .when((F.col("shared") >= SHARED_SHARE) | listed("vendored"), "vendored").when(F.col("marked"), "marked")
    )
    return s.select("file_id", reason.alias("reason"), "reuse", "mass", "shared").where("reason is not null")


def phrases_report(files: DataFrame) -> DataFrame:
    """(part, phrase, files, flagged, log_odds): the telling phrases in words, of comments and of paths."""
    _, p, g = _phrases(files)
    rows = [("path" if x < 0 else "comment", " ".join(g.words(abs(x))), n, k, s) for x, n, k, s in telling_phrases(p)]
    return files.sparkSession.createDataFrame(rows, "part string, phrase string, files long, flagged long, log_odds double")
