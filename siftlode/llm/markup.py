"""Markup residue: clean text with its headings, list items, code blocks and formulas.

A page is a tree: a root with a hidden format, its blocks with hidden kinds, and their lines with hidden kinds, of
which two signs are observed: what the line's beginning may be, and the first markup in it. Potentials connect
root and block, block and line, line and signs; they are estimated from pages whose own strong signs label them. Sum-product messages
run up (signs, lines, blocks, root) and down again and give the marginals of the format and of every line's kind.
They decide whether a page holds markup at all and what its lines are: a leading ``#`` is a heading in one
format and a list item in another, a lone ``*`` may be text. What has delimiters of its own is then read by these.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.llm.markup_parse import MEANING, Page, clean_blocks, clean_path_entry, elements
from siftlode.plans.runtime import parallelism, stored

FORMATS = ["plain", "markdown", "html", "wiki", "latex"]
#: Kinds of blocks and of lines.
KINDS = ["heading", "list", "code", "prose"]
LINES = ["heading", "list", "code", "text"]
#: Signs that label a page on their own.
STRONG = {"html_block": "html", "wiki_head": "wiki", "wiki_inline": "wiki", "tex": "latex", "md_fence": "markdown", "md_head_strong": "markdown", "setext": "markdown", "md_inline": "markdown"}
SMOOTH = 0.2


def weak_format(page: Page) -> str | None:
    """The format that the page's strong signs agree on; plain if no line has a sign; None if they disagree."""
    signs = [page.lines[n][1] for b in page.blocks for n in b]
    votes = Counter(STRONG[s] for s in signs if s in STRONG)
    if not votes:
        return "plain" if all(s == "text" for s in signs) else None
    if len(votes) == 1:
        return next(iter(votes))
    if "html" in votes and votes["html"] >= sum(votes.values()) - votes["html"]:
        return "html"
    top, second = votes.most_common(2)
    return top[0] if top[1] >= 3 * second[1] else None


def page_counts(page: Page) -> Counter:
    """What a page that labels itself adds to the potentials: root, block by format, line by block, and signs by line."""
    c: Counter = Counter()
    f = weak_format(page)
    if f is None:
        return c
    c["root", f, "", "", ""] += 1
    for block in page.blocks:
        kinds = [MEANING[f].get(page.lines[n][0], "text") for n in block]
        k = kinds[0] if kinds[0] != "text" else "prose"
        c["block", f, k, "", ""] += 1
        for n, kind in zip(block, kinds):
            c["line", f, k, kind, ""] += 1
            c["structure", f, "", kind, page.lines[n][0]] += 1
            c["sign", f, "", "", page.lines[n][1]] += 1
    return c


class PageModel:
    """Potentials of the tree and the message passing over one page."""

    def __init__(self, counts: dict[tuple, float]):
        named = {"structure": {x for f in MEANING.values() for x in f} | {"text"}, "sign": {"text"}}
        self.index = {w: {x: i for i, x in enumerate(sorted({k[4] for k in counts if k[0] == w} | named[w]))} for w in ("structure", "sign")}
        fmt, kind, line = ({x: i for i, x in enumerate(names)} for names in (FORMATS, KINDS, LINES))
        nf, nk, nl = len(FORMATS), len(KINDS), len(LINES)
        root, mid, low = np.full(nf, SMOOTH), np.full((nf, nk), SMOOTH), np.full((nf, nk, nl), SMOOTH)
        # a line's beginning depends on its kind; what markup it holds only on the format
        leaf = {"structure": np.full((nf, nl, len(self.index["structure"]) + 1), SMOOTH), "sign": np.full((nf, 1, len(self.index["sign"]) + 1), SMOOTH)}
        for (what, f, k, li, s), n in counts.items():
            if what == "root":
                root[fmt[f]] += n
            elif what == "block":
                mid[fmt[f], kind[k]] += n
            elif what == "line":
                low[fmt[f], kind[k], line[li]] += n
            else:
                leaf[what][fmt[f], line.get(li, 0), self.index[what][s]] += n
        # each format's meanings count as seen once, so that they hold where no page shows them
        for f, meaning in MEANING.items():
            for x, li in meaning.items():
                leaf["structure"][fmt[f], line[li], self.index["structure"][x]] += 1
        # what a format gives no meaning stays text there
        for f, name in enumerate(FORMATS):
            for li in range(nl):
                if LINES[li] != "text" and LINES[li] not in MEANING[name].values():
                    low[f, :, li] = 1e-9
        self.root = root / root.sum()
        self.mid = mid / mid.sum(1, keepdims=True)
        self.low = low / low.sum(2, keepdims=True)
        self.leaf = {w: x / x.sum(2, keepdims=True) for w, x in leaf.items()}
        self._seen: dict[tuple, tuple] = {}

    def _at(self, what: str, name: str) -> np.ndarray:
        i = self.index[what]
        return self.leaf[what][:, :, i.get(name, len(i))]

    def marginals(self, tree: list[list[tuple[str, str]]], messages: bool = True) -> tuple[np.ndarray, list[np.ndarray]]:
        """(format probabilities, per block the kind probabilities of its lines) from the lines' (structure, sign) by block.

        Without ``messages`` each line is judged by its own signs and the priors alone, and the format by its prior: what the tree adds is the difference.
        """
        # signs to lines: formats x line kinds
        seen = [[self._at("structure", s) * self._at("sign", g) for s, g in b] for b in tree]
        if not messages:
            alone = np.einsum("f,fk,fkl->fl", self.root, self.mid, self.low)
            kinds = [np.array([(alone * x).sum(0) / (alone * x).sum() for x in b]) for b in seen]
            return self.root, kinds
        # lines to blocks: formats x block kinds, in logarithms
        up = [np.array([np.log((self.low * x[:, None, :]).sum(2)) for x in b]) for b in seen]
        to_block = [u.sum(0) + np.log(self.mid) for u in up]
        # blocks to root
        to_root = [_logsum(t, 1) for t in to_block]
        belief = np.log(self.root) + sum(to_root, np.zeros(len(FORMATS)))
        f = np.exp(belief - belief.max())
        f /= f.sum()
        # and down: what the root says to a block, and a block to a line, leaves that one's own message out
        kinds = []
        for x, u, t, r in zip(seen, up, to_block, to_root):
            both = t + (belief - r)[:, None]
            rows = []
            for own, m in zip(x, u):
                outer = both - m
                w = np.exp(outer - outer.max())
                p = np.einsum("fk,fkl,fl->l", w, self.low, own)
                rows.append(p / p.sum())
            kinds.append(np.array(rows))
        return f, kinds

    def decide(self, page: Page, messages: bool = True) -> tuple[str, list[str]]:
        """The most probable format, and the most probable kind of every line."""
        tree = tuple(tuple(page.lines[n] for n in b) for b in page.blocks)
        known = self._seen.get((messages, tree))
        if known is None:
            f, k = self.marginals([list(b) for b in tree], messages)
            known = FORMATS[int(f.argmax())], [[LINES[int(i)] for i in x.argmax(1)] for x in k]
            if len(self._seen) < 50_000:
                self._seen[messages, tree] = known
        kinds = ["text"] * len(page.lines)
        for b, x in zip(page.blocks, known[1]):
            for n, kind in zip(b, x):
                kinds[n] = kind
        return known[0], kinds


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(pages: DataFrame) -> PageModel:
    """Potentials from all pages (column ``text``) that label themselves; counts are added up by Spark (a few hundred rows)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c: Counter = Counter()
            for t in b["text"]:
                c.update(page_counts(Page(t)))
            yield pd.DataFrame([(*k, n) for k, n in c.items()], columns=["a", "f", "k", "l", "s", "n"])

    rows = pages.select("text").mapInPandas(count, "a string, f string, k string, l string, s string, n long")
    total = rows.groupBy("a", "f", "k", "l", "s").agg(F.sum("n").alias("n")).collect()
    return PageModel({(r["a"], r["f"], r["k"], r["l"], r["s"]): float(r["n"]) for r in total})


def read_page(text: str, model: PageModel, messages: bool = True) -> tuple[Page, list[tuple[str, int, int, str]], bool]:
    """(page, elements, whether it holds markup) by the marginals; a page whose format is most probably plain holds none."""
    page = Page(text)
    form, kinds = model.decide(page, messages)
    if form == "plain":
        return page, [], False
    found, marked = elements(page, kinds, form == "markdown")
    return page, found, marked


def page_rows(text: str | None, path: list[str] | None, model: PageModel, messages: bool = True) -> list[tuple[str, int, str]]:
    """(element, element_no, clean_text) of one page; see :func:`clean_markup`."""
    rows: list[tuple[str, int, str]] = []
    if text:
        _, found, marked = read_page(text, model, messages)
        no: Counter = Counter()
        for element, _, _, clean in found:
            no[element] += 1
            rows.append((element, no[element], clean))
        if marked:
            rows.append(("residue", 0, ""))
    for i, e in enumerate(path if path is not None else [], 1):
        clean = clean_path_entry(e) if e else None
        if clean is not None:
            rows.append(("path", i, clean))
    return rows


def clean_document(text: str | None, path: list[str] | None, model: PageModel) -> tuple[list[tuple[str, str]], list[str]]:
    """(blocks, heading path) of one page without markup; a page without any keeps its paragraphs as they are."""
    blocks: list[tuple[str, str]] = []
    if text:
        page, found, marked = read_page(text, model)
        if marked:
            blocks = clean_blocks(page, found)
        else:
            blocks = [("paragraph", x.strip()) for x in page.text.split("\n\n") if x.strip()]
    return blocks, [(clean_path_entry(e) or e) if e else "" for e in (path if path is not None else [])]


def _pages(candidates: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(candidate_id, text, heading_path): the last extracted row of each prose candidate."""
    last = F.max_by(F.struct("text", "heading_path"), F.struct("extracted_at", F.coalesce("text", F.lit(""))))
    return stored(
        candidates.where(F.col("candidate_type").isin(*kinds) & F.col("candidate_id").isNotNull())
        .repartition(parallelism(candidates.sparkSession), "candidate_id")
        .groupBy("candidate_id")
        .agg(last.alias("m"))
        .select("candidate_id", "m.text", "m.heading_path")
    )


def clean_markup(candidates: DataFrame, kinds: tuple[str, ...] = ("section", "paragraph"), messages: bool = True) -> DataFrame:
    """(candidate_id, element, element_no, clean_text) of the prose candidates.

    One row per heading, list_item, code block and formula of the text, numbered per element in reading
    order; one (residue, 0, '') per text that holds any markup; one (path, position, text) per heading_path
    entry with markup. Of several rows with one candidate_id the last extracted counts. Null or empty texts
    and paths have no rows; an unclosed block runs to the end of its text. ``messages=False`` judges each line alone.
    """
    pages = _pages(candidates, kinds)
    shared = pages.sparkSession.sparkContext.broadcast(train(pages.where("text is not null")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for cid, text, path in zip(b["candidate_id"], b["text"], b["heading_path"]):
                rows += [(cid, *r) for r in page_rows(text, path, shared.value, messages)]
            yield pd.DataFrame(rows, columns=["candidate_id", "element", "element_no", "clean_text"])

    return pages.mapInPandas(run, "candidate_id long, element string, element_no int, clean_text string")


def clean_documents(candidates: DataFrame, kinds: tuple[str, ...] = ("section", "paragraph")) -> DataFrame:
    """(candidate_id, clean_text, blocks, heading_path): every prose candidate as clean text, with its structure kept.

    ``blocks`` are (kind, text) in reading order: heading, list_item, code (with its line breaks) and paragraph, formulas in
    their inner notation within the text; ``clean_text`` joins them by line breaks. Null and empty texts give no blocks.
    """
    pages = _pages(candidates, kinds)
    shared = pages.sparkSession.sparkContext.broadcast(train(pages.where("text is not null")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for cid, text, path in zip(b["candidate_id"], b["text"], b["heading_path"]):
                blocks, heads = clean_document(text, path, shared.value)
                rows.append((cid, "\n".join(t for _, t in blocks), [{"kind": k, "text": t} for k, t in blocks], heads))
            yield pd.DataFrame(rows, columns=["candidate_id", "clean_text", "blocks", "heading_path"])

    return pages.mapInPandas(run, "candidate_id long, clean_text string, blocks array<struct<kind:string,text:string>>, heading_path array<string>")
