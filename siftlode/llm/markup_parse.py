"""Reading headings, list items, code blocks and formulas out of HTML, Markdown, wiki text and LaTeX."""

from __future__ import annotations

import html
import re

#: Element names of HTML and of wiki extensions that count as tags; others are plain text.
TAGS = (
    "p|h[1-6]|ul|ol|li|table|thead|tbody|tr|td|th|div|span|em|i|b|u|s|strong|code|pre|a|br|hr|img|script|style|math"
    "|syntaxhighlight|ref|nowiki|sub|sup|blockquote|dl|dt|dd|section|article|nav|header|footer|main|body|html|head|title"
    "|small|tt|kbd|var|del|ins|figure|figcaption|cite|q|font|center|caption|gallery|references"
)
#: ``<source>`` without attributes or end is a word in brackets.
TAG = re.compile(rf"(?is)</?(?:{TAGS})(?=[\s/>])[^<>]*>|<source\s+\w+\s*=[^<>]*>|</source\s*>")
_COMMENT = re.compile(r"(?s)<!--.*?(?:-->|\Z)")
ENTITY = re.compile(r"&(?:[a-zA-Z][a-zA-Z0-9]{1,30}|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});")
_BRACED = r"\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"

_FENCE = re.compile(r"(?m)^ {0,3}(?P<f>`{3,}|~{3,})[ \t]*(?P<info>[^`\n]*)$")
_CODE_OPEN = re.compile(r"(?i)<(pre|source|syntaxhighlight)(?=[\s>])[^<>]*>")
_CODE_CLOSE = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("pre", "source", "syntaxhighlight")}
_CODE_ENV = re.compile(r"(?s)\\begin\{(verbatim\*?|lstlisting|minted|Verbatim|alltt)\}(?:\[[^\]\n]*\])?(?:\{\w+\}(?=\n))?(.*?)(?:\\end\{\1\}|\Z)")
_FORMULAS = [
    re.compile(r"(?is)<script\b[^<>]*type\s*=\s*[\"']?math/tex[^<>]*>(.*?)</script\s*>"),
    re.compile(r"(?is)<math(?=[\s>])[^<>]*>(.*?)</math\s*>"),
    re.compile(r"(?s)\\begin\{((?:equation|align|gather|multline|displaymath|math|eqnarray)\*?)\}(?P<x>.*?)\\end\{\1\}"),
    re.compile(r"(?s)\\\[(.+?)\\\]"),
    re.compile(r"(?s)\\\((.+?)\\\)"),
    re.compile(r"(?s)(?<![\\$])\$\$(?!\$)(.+?)(?<!\\)\$\$"),
    re.compile(r"(?<![\\$\w])\$(?![\s${(])((?:[^$\n\\]|\\.)+?)(?<![\s\\])\$(?![\w$])"),
]
_HTML_HEAD = re.compile(r"(?is)<h([1-6])(?=[\s>])[^<>]*>(.*?)</h\1\s*>")
_HTML_ITEM = re.compile(r"(?is)<li(?=[\s>])[^<>]*>(.*?)(?=<li[\s>]|</li\s*>|</?[uo]l(?=[\s>])|\n[ \t]*\n|\Z)")
_TEX_HEAD = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?\s*(?:\[[^\]\n]*\])?\s*" + _BRACED)
_TEX_ITEM = re.compile(r"(?s)\\item(?![A-Za-z])\s*(?:\[[^\]\n]*\])?(.*?)(?=\\item(?![A-Za-z])|\\(?:begin|end)\{|\n[ \t]*\n|\Z)")
_WIKI_HEAD = re.compile(r"(?m)^(={1,6})[ \t]*([^=\n](?:[^\n]*?[^=\n])?)[ \t]*\1[ \t]*$")
_ATX_HEAD = re.compile(r"(?m)^ {0,3}(#{1,6})[ \t]+(.+?)(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"(?m)^(?![ \t]*(?:[-*+#>|]|\d+[.)])[ \t])[ \t]{0,3}(\S[^\n]*)\n {0,3}(?:={3,}|-{3,})[ \t]*$")
_MD_ITEM = re.compile(r"^[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+(\S.*)$")
_WIKI_ITEM = re.compile(r"^[*#]+[ \t]*(\S.*)$")
_TEX_WORDS = "emph|textbf|textit|texttt|textsc|textsf|textrm|underline|mbox|text|url|enquote"
_TEX_MARK = re.compile(
    rf"\\(?:{_TEX_WORDS}|href|label|ref|cite|footnote|(?:sub){{0,2}}section|(?:sub)?paragraph|chapter|begin|end)\*?\s*[\[{{]|\\item(?![A-Za-z])"
    r"|\{\\(?:it|bf|tt|em|sc|sl|rm|itshape|bfseries|ttfamily)\b|\\[&%#_$](?=[\s\w])|(?m:(?<![\\\w])%[ \t]+\S[^\n]*$)"
)
_MD_MARK = re.compile(
    r"\*\*(?=\S)[^*\n]+?(?<=\S)\*\*|(?<![\w_])__(?=[^\s_])[^\n]+?(?<=[^\s_])__(?![\w_])|(?<![\w*])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?![\w*])"
    r"|~~(?=\S)[^~\n]+?(?<=\S)~~|(?<!`)`(?!`)[^`\n]+`(?!`)|!?\[[^\[\]\n]*\]\([^()\s]*\)|(?<=\S)[ \t]?\[\^[^\]\s]+\]|\[[^\[\]\n]+\]\[[^\[\]\n]*\]|\{#[\w:.-]+\}"
)
_WIKI_MARK = re.compile(r"'''?(?=[^'\s])[^'\n]+?(?<=[^'\s])'''?|\[\[[^\[\]\n]+\]\]|\[(?:https?|ftp)://[^\s\]]+[^\]\n]*\]|\{\{[^{}\n]*\}\}|__(?:NO|FORCE|TOC|INDEX)[A-Z]*__")
_TABLE_ROW = re.compile(r"(?m)^[ \t]*\|.*\|[ \t]*$|^\{\||\\begin\{tabular\}")


def squeeze(s: str) -> str:
    """White space runs as one space, trimmed; a no-break space is a space."""
    return " ".join(s.replace("\u00a0", " ").split())


def inline(s: str) -> str:
    """The text of a piece without inline markup; formulas keep their inner notation."""
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(html.unescape(m["x"] if "x" in m.re.groupindex else m[1]).strip())
        return f"\x00{len(kept) - 1}\x01"

    s = _COMMENT.sub(" ", s)
    for p in _FORMULAS:
        s = p.sub(keep, s)
    s = re.sub(r"(?is)<(ref|style|script)(?=[\s>])[^<>/]*>.*?</\1\s*>|<ref[^<>]*/>", "", s)
    s = re.sub(r"(?i)<(?:br|hr)\s*/?>", " ", s)
    s = TAG.sub("", s)
    s = re.sub(r"__(?:NO|FORCE|TOC|INDEX)[A-Z]*__", "", s)
    s = re.sub(r"\[\[(?:Category|File|Image)\s*:[^\[\]]*\]\]", "", s)
    s = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", s)
    s = re.sub(r"\[(?:https?|ftp)://[^\s\]]+[ \t]*([^\]\n]*)\]", r"\1", s)
    s = re.sub(r"\{\{[^{}]*\}\}", "", s)
    s = re.sub(r"[ \t]?\[\^[^\]\s]+\]", "", s)
    s = re.sub(r"!\[([^\[\]]*)\]\([^()]*\)", r"\1", s)
    s = re.sub(r"\[([^\[\]]*)\]\([^()]*\)", r"\1", s)
    s = re.sub(r"\[([^\[\]]+)\]\[[^\[\]]*\]", r"\1", s)
    s = re.sub(r"[ \t]*\{#[\w:.-]+\}", "", s)
    s = re.sub(r"\\(?:label|ref|cite|footnote)\s*\{[^{}]*\}", "", s)
    s = re.sub(r"(?m)(?<![\\\w])%[ \t]+\S[^\n]*$", "", s)
    while True:
        t = re.sub(r"\\href\s*\{[^{}]*\}\s*" + _BRACED, r"\1", s)
        t = re.sub(rf"\\(?:{_TEX_WORDS})\*?\s*" + _BRACED, r"\1", t)
        t = re.sub(r"\{\\(?:itshape|bfseries|ttfamily|it|bf|tt|em|sc|sl|rm)\b[ \t]*((?:[^{}]|\{[^{}]*\})*)\}", r"\1", t)
        t = re.sub(r"(?<!`)(`+)(?!`)[ ]?(.+?)[ ]?(?<!`)\1(?!`)", r"\2", t)
        t = re.sub(r"\*\*(?=\S)(.+?)(?<=\S)\*\*", r"\1", t)
        t = re.sub(r"(?<![\w_])__(?=[^\s_])(.+?)(?<=[^\s_])__(?![\w_])", r"\1", t)
        t = re.sub(r"(?<![\w*])\*(?=[^\s*])(.+?)(?<=[^\s*])\*(?![\w*])", r"\1", t)
        t = re.sub(r"~~(?=\S)(.+?)(?<=\S)~~", r"\1", t)
        t = re.sub(r"'''(?=[^'\s])(.+?)(?<=[^'\s])'''", r"\1", t)
        t = re.sub(r"''(?=[^'\s])(.+?)(?<=[^'\s])''", r"\1", t)
        if t == s:
            break
        s = t
    s = re.sub(r"\\([&%#_${}])", r"\1", s)
    s = html.unescape(s)
    s = re.sub(r"\x00(\d+)\x01", lambda m: kept[int(m[1])], s)
    return squeeze(s)


def _mask(text: str, spans: list[tuple[int, int]], to: str) -> str:
    out = list(text)
    for a, b in spans:
        for i in range(a, b):
            if out[i] != "\n":
                out[i] = to
    return "".join(out)


def _fences(text: str) -> list[tuple[int, int, str]]:
    found, at = [], 0
    while m := _FENCE.search(text, at):
        close = re.compile(rf"(?m)^ {{0,3}}{m['f'][0]}{{{len(m['f'])},}}[ \t]*$").search(text, m.end())
        end, stop = (close.start(), close.end()) if close else (len(text), len(text))
        found.append((m.start(), stop, text[m.end() : end]))
        at = max(stop, m.end() + 1)
        if at > len(text):
            break
    return found


def _code_tags(text: str) -> list[tuple[int, int, str]]:
    """(start, end, body) of code elements. One that is never closed must begin its line, and runs to the end; others are words in brackets."""
    found: list[tuple[int, int, str]] = []
    at, never = 0, set()
    while m := _CODE_OPEN.search(text, at):
        name = m[1].lower()
        close = None if name in never else _CODE_CLOSE[name].search(text, m.end())
        if close:
            found.append((m.start(), close.end(), text[m.end() : close.start()]))
            at = close.end()
        elif not text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip():
            found.append((m.start(), len(text), text[m.end() :]))
            break
        else:
            never.add(name)
            at = m.end()
    return found


#: A text without any of these holds no sign of any format.
_ANY = re.compile(r"[#*_`~\[\]{}<>=$\\|&%]|''|(?m:^[ \t]*(?:[-+]|\d{1,9}[.)])[ \t])|(?m:^(?: {4}|\t)\S)|(?m:^ {0,3}-{3,}[ \t]*$)")


class Page:
    """A text with its code spans found, and its lines with their signs: what the page model looks at and what is read by its decisions.

    ``lines``: (structure, sign) per line: what the line's beginning may be, and the first sign of markup in it. Lines of
    code spans have the sign of the span's delimiter in their first line only. ``blocks``: the line numbers between blank lines.
    """

    def __init__(self, text: str):
        self.text = text = text.replace("\r\n", "\n").replace("\r", "\n")
        self.plain = not _ANY.search(text)
        if self.plain:
            self.code, self.free = [], text
            lines = text.split("\n")
            self.lines = [("text", "text")] * len(lines)
            self.blocks = _runs([bool(x.strip()) for x in lines])
            return
        #: (start, end, body, whether it is tagged)
        self.code: list[tuple[int, int, str, bool]] = [(a, b, c, False) for a, b, c in _fences(text)]
        free = _mask(text, [(a, b) for a, b, *_ in self.code], "\x02")
        self.code += [(m.start(), m.end(), m[2], False) for m in _CODE_ENV.finditer(free)]
        free = _mask(free, [(a, b) for a, b, *_ in self.code], "\x02") if self.code else free
        self.code += [(*x, True) for x in _code_tags(free)]
        free = _mask(free, [(a, b) for a, b, *_ in self.code], "\x02") if self.code else free
        self.free = free
        raw, open_, first = text.split("\n"), free.split("\n"), set()
        if self.code:
            starts, at = {a for a, *_ in self.code}, 0
            for n, x in enumerate(raw):
                if any(at <= a <= at + len(x) for a in starts):
                    first.add(n)
                at += len(x) + 1
        self.lines: list[tuple[str, str]] = []
        full: list[bool] = []
        for n, (x, y) in enumerate(zip(raw, open_)):
            masked = bool(self.code) and "\x02" in y and not y.replace("\x02", "").strip()
            if masked:
                self.lines.append(("code", signature(x) if n in first else "code"))
            else:
                self.lines.append((structure(y, open_[n + 1] if n + 1 < len(open_) else ""), signature(x)))
            full.append(bool(x.strip()) or masked)
        self.blocks = _runs(full)
        for block in self.blocks:
            # several such lines in one block are no strong sign of headings
            if sum(self.lines[n][0] in ("hash", "hashes") for n in block) > 1:
                for n in block:
                    if self.lines[n][0] in ("hash", "hashes"):
                        sign = self.lines[n][1]
                        self.lines[n] = ("hash_run", "hash_run" if sign in ("hash", "md_head_strong") else sign)


def _runs(full: list[bool]) -> list[list[int]]:
    """The runs of true places."""
    out: list[list[int]] = []
    for n, x in enumerate(full):
        if x and n and full[n - 1]:
            out[-1].append(n)
        elif x:
            out.append([n])
    return out


_STRUCTURES = [
    ("wiki_head", _WIKI_HEAD), ("hash", re.compile(r"^ {0,3}#[ \t]+\S")), ("hashes", re.compile(r"^ {0,3}#{2,6}[ \t]+\S")), ("hash_tight", re.compile(r"^#+[^\s#]|^#{7,}|^[*#]*#[*#]*[ \t]*\S")),
    ("star", re.compile(r"^\*[ \t]+\S")), ("star_in", re.compile(r"^[ \t]+\*[ \t]+\S")), ("stars", re.compile(r"^\*{2,}[ \t]+\S|^\*+[^\s*]")), ("dash", re.compile(r"^[ \t]*[-+][ \t]+\S")), ("number", re.compile(r"^[ \t]*\d{1,9}[.)][ \t]+\S")),
    ("table", re.compile(r"^\s*\|.*\|\s*$")), ("indent", re.compile(r"^(?: {4}|\t)\S")),
]


def structure(line: str, following: str = "") -> str:
    """What the beginning of a line may be in some format; ``underlined`` if the next line is a rule, ``text`` for nothing."""
    if following and line.strip() and _SETEXT.match(f"{line}\n{following}"):
        return "underlined"
    if not _ANY.search(line):
        return "text"
    for name, p in _STRUCTURES:
        if p.match(line):
            return name
    return "text"


#: What a line of a structure is in the formats that know it; elsewhere it is text.
MEANING = {
    "markdown": {"hash": "heading", "hash_run": "heading", "hashes": "heading", "underlined": "heading", "star": "list", "star_in": "list", "dash": "list", "number": "list", "code": "code"},
    "wiki": {"wiki_head": "heading", "hash": "list", "hash_run": "list", "hashes": "list", "hash_tight": "list", "star": "list", "stars": "list", "code": "code"},
    "html": {"code": "code"}, "latex": {"code": "code"}, "plain": {},
}


def elements(page: Page, kinds: list[str], continued: bool) -> tuple[list[tuple[str, int, int, str]], bool]:
    """((element, start, end, clean text) in reading order, whether any markup was seen).

    ``kinds``: what each line is: heading, list or another. It decides about the lines whose beginning has several
    meanings; elements with delimiters of their own are read by these. ``continued``: indented lines belong to the list item before them.
    """
    text, free, code = page.text, page.free, page.code
    out: list[tuple[str, int, int, str]] = []
    marked = False
    for a, b, body, tagged in code:
        body = html.unescape(TAG.sub("", body)) if tagged else body
        out.append(("code", a, b, squeeze(body)))
    masked = free
    for m in _COMMENT.finditer(masked):
        marked = True
        masked = _mask(masked, [m.span()], " ")
    rest = masked
    for p in _FORMULAS:
        for m in p.finditer(rest):
            body = m["x"] if "x" in p.groupindex else m[1]
            out.append(("formula", m.start(), m.end(), squeeze(html.unescape(body))))
            rest = _mask(rest, [m.span()], "\x03")

    def piece(a: int, b: int) -> str:
        return inline(masked[a:b].replace("\x02", " "))

    taken: list[tuple[int, int]] = []
    for element, pattern, group in (("heading", _HTML_HEAD, 2), ("heading", _TEX_HEAD, 1), ("list_item", _HTML_ITEM, 1), ("list_item", _TEX_ITEM, 1)):
        for m in pattern.finditer(rest):
            out.append((element, m.start(), m.end(), piece(*m.span(group))))
            taken.append(m.span())
    lines = _mask(rest, taken, "\x04") if taken else rest
    at, item = 0, None
    under = False
    for n, line in enumerate(lines.split("\n")):
        end, kind, shape = at + len(line), kinds[n], page.lines[n][0]
        m = None
        if under:
            under = False
            at = end + 1
            continue
        if kind == "heading":
            if shape == "underlined":
                m = re.match(r"[ \t]{0,3}(\S.*)", line)
                under = m is not None
            else:
                m = (_WIKI_HEAD if shape == "wiki_head" else _ATX_HEAD).match(line)
            if m:
                out.append(("heading", at, end, piece(*(at + x for x in m.span(m.lastindex if shape != "wiki_head" else 2)))))
        elif kind == "list":
            m = (_WIKI_ITEM if line[:1] in "*#" else _MD_ITEM).match(line)
        if item and (m or not (line[:1] in (" ", "\t") and line.strip(" \t\x02\x04") and continued)):
            out.append(("list_item", item[0], item[2], piece(*item[1:])))
            item = None
        if m and kind == "list":
            item = (at, at + m.start(1), at + m.end(1))
        elif item:
            item = (item[0], item[1], end)
        at = end + 1
    if item:
        out.append(("list_item", item[0], item[2], piece(*item[1:])))
    marked = marked or bool(out) or has_inline(masked)
    return sorted(out, key=lambda x: x[1]), marked


def clean_blocks(page: Page, found: list[tuple[str, int, int, str]]) -> list[tuple[str, str]]:
    """(kind, clean text) of the whole page in reading order: headings, list items, code blocks with their lines, and paragraphs.

    Formulas stay in the text around them, in their inner notation.
    """
    bodies = {a: (html.unescape(TAG.sub("", body)) if tagged else body) for a, _, body, tagged in page.code}
    out: list[tuple[str, str]] = []

    def prose(a: int, b: int) -> None:
        part = page.text[a:b]
        for p in _FORMULAS[2:3] + _FORMULAS[5:6]:  # a formula's blank lines end no paragraph
            part = p.sub(lambda m: re.sub(r"\n[ \t]*(?=\n)", "", m[0]), part)
        for x in re.split(r"\n[ \t]*\n|(?i:</p\s*>|</?[uo]l(?=[\s>])[^<>]*>|</tr\s*>)", part):
            clean = inline(_LAYOUT.sub(" ", x))
            if clean:
                out.append(("paragraph", clean))

    at = 0
    for element, a, b, clean in found:
        if element == "formula" or a < at:
            continue
        prose(at, a)
        if element == "code":
            out.append(("code", "\n".join(x.rstrip() for x in bodies[a].strip("\n").split("\n")).strip("\n")))
        elif clean:
            out.append((element, clean))
        at = b
        if element == "heading":
            rule = re.match(r"\n {0,3}(?:={3,}|-{3,})[ \t]*(?=\n|\Z)", page.text[at:])
            at += rule.end() if rule else 0
    prose(at, len(page.text))
    return out


_LAYOUT = re.compile(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]\n]*\])?|(?m:^ {0,3}(?:[-*_] ?){3,}$)|(?m:^\{\|.*$|^\|\}.*$|^\|-.*$)")


def has_inline(text: str) -> bool:
    """Whether a text holds inline markup of any of the formats."""
    return bool(
        TAG.search(text) or ENTITY.search(text) or _COMMENT.search(text) or _MD_MARK.search(text) or _WIKI_MARK.search(text)
        or _TEX_MARK.search(text) or _TABLE_ROW.search(text) or any(p.search(text) for p in _FORMULAS)
    )


def clean_path_entry(entry: str) -> str | None:
    """A heading path entry without markup, or None if it holds none."""
    s = entry.strip()
    m = re.fullmatch(r"#{1,6}[ \t]+(.+?)(?:[ \t]+#+)?", s)
    if m:
        return inline(m[1])
    m = re.fullmatch(r"(={1,6})[ \t]*([^=].*?)[ \t]*\1", s)
    if m:
        return inline(m[2])
    m = _TEX_HEAD.fullmatch(s)
    if m:
        return inline(m[1])
    return inline(s) if has_inline(s) else None


_SIGNS = [
    ("html_block", re.compile(rf"(?i)</?(?:p|h[1-6]|ul|ol|li|table|div|span|em|i|b|strong|a|img)(?=[\s/>])|<script\b|<pre[\s>]<code|<pre class|<h[1-6]$")),
    ("wiki_head", re.compile(r"^(={2,6})[^=].*\1\s*$")),
    ("wiki_inline", re.compile(r"'''?[^'\s]|\[\[|\{\{[^{}]*\}\}|\[https?://\S+|__(?:NO|FORCE|TOC)|<(?:ref|math)(?=[\s>/])|^\s*<(?:source|syntaxhighlight)(?=[\s>])|</(?:source|syntaxhighlight)\s*>")),
    ("tex", _TEX_MARK),
    ("md_fence", re.compile(r"^ {0,3}(?:`{3,}|~{3,})")),
    ("setext", re.compile(r"^ {0,3}(?:={3,}|-{3,})[ \t]*$")),
    ("md_head_strong", re.compile(r"^#{2,6} |^# .*(?:#|\{#[\w-]+\})$")),
    ("md_inline", _MD_MARK),
    ("hash_run", re.compile(r"^#\+")),
    ("hash", re.compile(r"^#+ ")),
    ("bullet_star", re.compile(r"^[ \t]*\*+ ")),
    ("bullet_deep", re.compile(r"^[*#]{2,} ")),
    ("bullet_md", re.compile(r"^[ \t]*(?:[-+]|\d{1,9}[.)]) ")),
    ("formula", re.compile(r"\$\$|\\[(\[]|(?<![\\$\w])\$(?![\s${(])(?:[^$\n\\]|\\.)+?(?<![\s\\])\$(?![\w$])")),
    ("entity", ENTITY),
    ("tag", TAG),
    ("comment", re.compile(r"<!--")),
    ("table", re.compile(r"^\s*\|.*\|\s*$")),
    ("blank_code", re.compile(r"^(?: {4}|\t)\S")),
]


def signature(line: str) -> str:
    """The kind of the first sign of markup in a line, ``text`` for none."""
    if not _ANY.search(line):
        return "text"
    for name, p in _SIGNS:
        if p.search(line):
            return name
    return "text"
