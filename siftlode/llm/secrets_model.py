"""Candidate values in code and text, their features, weak labels and a logistic regression over them."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np

#: States of the character model: printable ASCII and one for everything else.
STATES = 96
#: Size of the hashed feature space.
BUCKETS = 1 << 16

_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*?)(PRIVATE KEY|PUBLIC KEY|CERTIFICATE|[A-Z0-9 ]+?)( BLOCK)?-----")
#: A line without any of these holds words only.
_MAYBE = re.compile(r"[0-9\"'`=:/+]|[a-z][A-Z]|[A-Z]{2}[a-z]")
_PEM_END = re.compile(r"-----END [A-Z0-9 ]+-----")
_PEM_BODY = re.compile(r"^[\s>|#*/\"'+\\n]*[A-Za-z0-9+/=]+[\s\"'+\\n;,]*$")
#: What follows a BEGIN marker in its line as the block's body: escaped line ends, long pieces, a padded last piece.
_PEM_RUN = re.compile(r"(?:\\+[nr][A-Za-z0-9+/=]*|\s*[A-Za-z0-9+/=]{16,})*(?:\s[A-Za-z0-9+/]+={1,2})?")
_PEM_ESCAPED = re.compile(r"\\n[A-Za-z0-9+/=\\]")
_ATOM = re.compile(r"[^\s\"'`<>(){}\[\],;|]+")
_NAMED = re.compile(r"^[\"']?([A-Za-z_][\w.\-]*)(?::=|=>|[=:])(?=[^=])")
_USERINFO = re.compile(r"\b([a-z][a-z0-9+.\-]*)://([^\s/@:\"'`]*):([^\s/@\"'`]+)@")
_ODD_CASE = re.compile(r"[a-z][A-Z](?:.*[a-z][A-Z]|[A-Z])|^[A-Z]{2,}[a-z]")
_HUMPS = re.compile(r"^[A-Za-z][a-z]+(?:[A-Z][a-z]{2,})+$")
_SLASHED = re.compile(r"^(?=.*\d)(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]{20,}={0,2}$")
_ADDRESS = re.compile(r"^[\w.\-]+@[\w\-]+(?:\.[\w\-]+)+$")
_ALONE = re.compile(r"^\s+\S+\s*$")
_OPENS = re.compile(r"[:=]\s*[>|][+\-]?\d?\s*$")
#: A line whose value belongs to a name in the line before.
_GOES_ON = re.compile(r"^\s*(?:(?:value|\"value\"|default)\s*[:=]|[\"'`]|<value>)")
_NAME_ONLY = re.compile(r"^[A-Za-z][a-zA-Z_\-.]*[=:]$")
_VALUES = re.compile(r"^\.Values\b")
_HOOK = re.compile(r"https?://[^\s\"'`]*?/([A-Za-z0-9_\-]{20,})(?=[\s\"'`;,)]|$)")
#: An address's path, of which words in lower case lead to what may be a secret of any alphabet (in one pass, however long); and runs within it.
_ADDRESS_PATH = re.compile(r"https?://[^\s\"'`/]++/((?:[a-z][a-z_\-]*+/)*+)([A-Za-z0-9_\-+/=.]{20,}+)(?=[\s\"'`;,)]|$)")
_RUN = re.compile(r"[A-Za-z\d]{10,}+")
_VOWEL = re.compile(r"[aeiouyAEIOUY]")
_QUOTED_ONLY = re.compile(r"^\s*[fbru]*([\"'`])[^\"'`]*\1\s*[)\];,+\\]*\s*$")
_ENDS_OPEN = re.compile(r"[\"'`]\s*[+\\.]?\s*$")

#: Words that name credentials, words that name harmless random values, ways to write that a
#: value is absent, masked or kept elsewhere, and the beginnings of self-describing tokens.
SENSITIVE = re.compile(
    r"(?i)pass(?:word|wd|phrase|code)?s?\b|pass(?:word|wd|phrase)|pwd|\bpw\b|secret|token|api[_\- ]?key|\bkey\b|_key\b|credential|bearer|\bauth|authorization|access[_ ]?(?:key|code)|cookie|session|sign in|private|salt|identified by|sshpass|sudo -S|\bpat\b|hook"
)
HARMLESS = re.compile(
    r"(?i)(?:checksum|integrity|trace(?:_?id)?|commit|request_?id|digest|sha\d*|md5|etag|revision|span(?:_?id)?|build(?:_?id)?|uuid|guid|fingerprint|correlation_?id|signature|count|max_tokens|public[_ ]key|nonce|thumbprint|hash)\W*$"
)
ABSENT = re.compile(
    r"(?i)^(?:x{4,}|\*{3,}|\.{3,}|-{3,}|_{3,}|#{3,}|0{6,}|changeme|change[_-]?me|example|placeholder|dummy|none|null|nil|true|false|undefined|redacted|secret|password|token|todo|tbd|str|string|int|bool|optional)$"
    r"|your[-_ ]|[-_]here\b|\$\{|\$\(|\{\{|%\(|^\$[A-Z_a-z]|REDACTED|<[a-z\-_ ]+>|environ|getenv|process\.env|vault|\.Values|secretKeyRef|insert[-_ ]|example\.com$|^sk_test_x+$"
)
PREFIXED = re.compile(r"^(?:(?:AKIA|ASIA)[A-Z0-9]{12,}|[a-z]{2,5}_(?:live|pat|test|prod|sk|pk)_[A-Za-z0-9]{16,}|(?:ghp|gho|ghs|xox[abp])[_\-][A-Za-z0-9\-]{16,}|[a-z]{3}-(?=[A-Za-z0-9]*[A-Z0-9])[A-Za-z0-9]{24,}|eyJ[\w\-]{10,}\.[\w\-]{10,}\.[\w\-]{10,})$")
_NOT_VALUE = re.compile(
    r"^(?:[A-Za-z]+|[*_~]*[A-Za-z]+(?:-[a-z]+)*[.,?!:;]*[*_~]*|[a-z]*=+|[A-Z][a-z]*(?:-[A-Z][a-z]+)+|[\d.,:%\-+/]+|[a-z]+(?:_[a-z0-9]+)*|[A-Z]+(?:_[A-Z0-9]+)*|[a-z]+(?:[A-Z][a-z]+)*|(?:[A-Z][a-z]+)+|[A-Za-z_\-]+(?:\.[A-Za-z_]+)+|[\w\-]+\.[a-z]{1,4}|\.{0,2}/?[\w\-.]+(?:/[\w\-.*]+)+|--?[a-z][a-z\-]*|v?\d+(?:\.\w+)+|\W+)$"
)


@dataclass
class Candidate:
    """A value that may be a credential, with what stands around it."""

    line: int
    value: str
    left: str
    right: str
    kind: str
    at: int  # where the value starts in its line


def char_ids(text: str) -> np.ndarray:
    """States of the characters of a text."""
    a = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.where((a >= 32) & (a < 127), a - 32, STATES - 1).astype(np.int64)


def bigrams(text: str) -> np.ndarray:
    """Counts of the character pairs of a text, as a flat STATES x STATES table."""
    i = char_ids(text)
    return np.bincount(i[:-1] * STATES + i[1:], minlength=STATES * STATES) if len(i) > 1 else np.zeros(STATES * STATES, dtype=np.int64)


class CharModel:
    """A Markov chain over characters."""

    def __init__(self, counts: np.ndarray):
        t = counts.reshape(STATES, STATES).astype(float) + 0.5
        self.log = np.log(t / t.sum(1, keepdims=True))

    def surprise(self, value: str) -> float:
        """Mean negative log-likelihood of the steps of a value."""
        i = char_ids(value)
        return float(-self.log[i[:-1], i[1:]].mean()) if len(i) > 1 else 0.0


def _atoms(n: int, line: str, before: str, out: list[Candidate]) -> None:
    taken: list[tuple[int, int]] = []
    remote = "://" in line
    for m in _USERINFO.finditer(line) if remote else ():
        out.append(Candidate(n, m[3], before + line[: m.start(3)], line[m.end(3) :], "userinfo", m.start(3)))
        taken.append(m.span())
    for m in _HOOK.finditer(line) if remote else ():
        if not any(a <= m.start() < b for a, b in taken):
            out.append(Candidate(n, m[1], before + line[: m.start()] + " urlpath ", line[m.end(1) :], "hook", m.start(1)))
        taken.append(m.span())
    for m in _ADDRESS_PATH.finditer(line) if remote else ():
        if any(_mixed(x) for x in _RUN.findall(m[2])) and not any(a < m.end() and m.start() < b for a, b in taken):
            out.append(Candidate(n, m[2], before + line[: m.start()] + " urlpath ", line[m.end(2) :], "hook", m.start(2)))
            taken.append(m.span())
    for m in _ATOM.finditer(line):
        if taken and any(a < m.end() and m.start() < b for a, b in taken):
            continue
        s, a = m.group(0), m.start()
        if s.isalpha() and (s.islower() or s.istitle()):
            continue  # a plain word
        while ("=" in s or ":" in s) and (k := _NAMED.match(s)) and "://" not in s and not s[k.end() :].startswith("//"):
            s, a = s[k.end() :], a + k.end()
        e = a + len(s)
        t = s.rstrip(".:!?") if not s.endswith("==") else s
        e -= len(s) - len(t)
        t2 = t.lstrip("=:@")
        a += len(t) - len(t2)
        if len(t2) < 5 or "://" in t2 or "@" in t2 and _ADDRESS.match(t2) or t2[-1] in "=:" and _NAME_ONLY.match(t2) or t2[0] == "." and _VALUES.match(t2):
            continue
        plain = _NOT_VALUE.match(t2)
        core = t2.strip("*_~.,?!:;")
        if plain and PREFIXED.match(core):
            plain = None
        elif plain and core.isalpha():
            # letters alone are a value only in a credential's place and with an odd use of capitals
            quoted = line[a - 1 : a] in ("'", '"', "`") and a
            plain = not (
                len(core) >= 8 and _ODD_CASE.search(core) and not _HUMPS.match(core)
                and (quoted or SENSITIVE.search((before + line[:a])[-24:]) or SENSITIVE.search(line[e : e + 16])) and line[e : e + 1] != "("
            )
        elif plain and "/" in t2:
            plain = not (
                any(len(x) >= 10 and _ODD_CASE.search(x) and re.search(r"\d", x) for x in t2.split("/"))
                # base64 has slashes anywhere; in a credential's place it is scored
                or _SLASHED.match(t2) and _ODD_CASE.search(t2) and (SENSITIVE.search((before + line[:a])[-24:]) or SENSITIVE.search(line[e : e + 16]))
            )
        elif plain and re.fullmatch(r"[A-Za-z]{2,}\.[A-Za-z]{6,}", t2):
            plain = not (_no_words(t2.rsplit(".", 1)[1]) and (SENSITIVE.search((before + line[:a])[-24:]) or SENSITIVE.search(line[e : e + 16])))
        elif plain and re.search(r"[A-Z]\d+[A-Z]", t2) and t2.isupper():
            # capitals and digits are mostly the name of a constant, but not in quotes in a credential's place
            plain = not (line[a - 1 : a] in ("'", '"') and a and SENSITIVE.search((before + line[:a])[-24:]))
        elif plain:
            plain = not (len(t2) >= 24 and re.search(r"\d", t2) and re.search(r"[A-Za-z]", t2) and not re.search(r"[_/.]", t2))
        if not plain:
            out.append(Candidate(n, t2, before + line[:a], line[e:], "atom", a))


def _mixed(s: str) -> bool:
    """Whether a run of letters and digits has digits, small letters and capitals."""
    return not s.isalpha() and s.upper() != s and s.lower() != s


def _no_words(s: str) -> bool:
    """Whether letters with capitals among them are no words run together: oddly placed capitals, or a piece without vowel."""
    if _ODD_CASE.search(s):
        return True
    return bool(re.search(r"[a-z][A-Z]", s)) and any(not _VOWEL.search(x) for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", s))


def pem_span(line: str, at: int) -> tuple[int, bool]:
    """Where the block whose BEGIN marker ends at ``at`` ends in its line, and whether it is closed there by its END or the next BEGIN."""
    stop, then = _PEM_END.search(line, at), _PEM.search(line, at)
    if stop and not (then and then.start() < stop.start()):
        return stop.end(), True
    end = _PEM_RUN.match(line, at).end()
    if then or _PEM_ESCAPED.search(line[at : at + 12]) or re.search(r"[A-Za-z0-9]", line[end:]):
        return end, then is not None
    return len(line), False


def candidates(text: str) -> list[Candidate]:
    """All candidate values of a text, in order. Bodies of key blocks and continued strings are not values of their own."""
    out: list[Candidate] = []
    lines = text.split("\n")
    in_pem = False
    folded = False
    for i, line in enumerate(lines):
        n = i + 1
        blocks: list[tuple[int, int]] = []
        keys: list[Candidate] = []
        if in_pem:
            end = _PEM_END.search(line)
            if end:
                in_pem = False
                blocks.append((0, end.end()))
            elif _PEM_BODY.match(line):
                continue
            else:
                in_pem = False
        while "-----" in line and (m := _PEM.search(line, blocks[-1][1] if blocks else 0)):
            if "PRIVATE KEY" in (m[1] + m[2]).strip():
                keys.append(Candidate(n, m.group(0), line[: m.start()], "", "private_key", m.start()))
            end_at, closed = pem_span(line, m.end())
            in_pem = not closed and not _PEM_ESCAPED.search(line[m.end() : m.end() + 12])
            blocks.append((m.start(), end_at))
        if blocks:
            # the line's other values, at their places
            for start, stop in blocks:
                line = line[:start] + " " * (stop - start) + line[stop:]
            _atoms(n, line, "", keys)
            out += sorted(keys, key=lambda c: c.at)
            continue
        if not _MAYBE.search(line):
            folded = False
            continue
        prev = lines[i - 1] if i else ""
        if _QUOTED_ONLY.match(line) and _ENDS_OPEN.search(prev):
            continue
        alone = line[:1].isspace() and _ALONE.match(line) is not None
        opens = (">" in prev or "|" in prev) and _OPENS.search(prev) is not None
        if alone and folded and not opens and not re.search(r"[:=]", line.strip().rstrip("=")):
            continue  # a further line of a folded value
        folded = alone and opens
        before = ""
        if alone and opens or _GOES_ON.match(line):
            before = prev.strip()[-80:] + " ⏎ "
        _atoms(n, line, before, out)
    return out


def shape(v: str) -> str:
    """The class of a value by its characters."""
    if PREFIXED.match(v):
        return "prefixed"
    if re.fullmatch(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", v):
        return "uuid"
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", v):
        return f"hex{len(v)}" if len(v) in (32, 40, 64) else ("hex" if len(v) > 11 else "hexshort")
    if re.fullmatch(r"[A-Z][a-z]+-[A-Z][a-z]+-\d+", v):
        return "words-number"
    if re.fullmatch(r"[a-z]+\d{4,6}", v):
        return "wordnumber"
    if re.fullmatch(r"[a-z]+[^\w\s]{1,3}\d{2}[A-Z]+", v):
        return "word#9WORD"
    if re.fullmatch(r"[A-Za-z0-9+/]{20,}={0,2}", v):
        return "base64"
    if re.fullmatch(r"[A-Za-z0-9_\-]{20,}", v):
        return "urlsafe"
    if v.isalpha():
        return "letters"
    if re.search(r"[A-Za-z]", v) and re.search(r"\d", v):
        return "mixed" if re.search(r"[^\w]", v) else "alnum"
    return "other"


def _words(s: str) -> list[str]:
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", s)
    return [w for w in re.split(r"[^a-z0-9]+", s.lower()) if w]


def features(c: Candidate, surprise: float, path: str, kind: str, language: str) -> list[str]:
    """Names of the features of a candidate that hold."""
    v = c.value
    sh = shape(v)
    left, right = _words(c.left[-90:]), _words(c.right[:40])
    known = [w for w in left[-6:]]
    out = ["bias", f"shape={sh}", f"kind={c.kind}", f"len={min(12, int(math.log2(len(v) + 1) * 2))}", f"surprise={min(16, int(surprise * 2))}"]
    counts = Counter(v)
    entropy = -sum(n / len(v) * math.log2(n / len(v)) for n in counts.values())
    out.append(f"entropy={int(entropy * 2)}")
    out += [f"L={w}" for w in set(known)] + [f"R={w}" for w in set(right[:4])]
    if left:
        out += [f"L1={left[-1]}", f"L2={'_'.join(left[-2:])}"]
    if SENSITIVE.search(c.left[-60:]) or SENSITIVE.search(c.right[:30]):
        out += ["sensitive", f"sensitive&{sh}", f"sensitive&s{min(16, int(surprise * 2))}"]
    else:
        out += [f"nothing&{sh}"]
    if HARMLESS.search(c.left.rstrip(" :=\"'`(")[-40:]):
        out += ["harmless"]
    if ABSENT.search(v) or ABSENT.search(c.left[-12:].split("=")[-1]):
        out += ["absent"]
    if re.search(r"\d", v):
        out.append("digit")
    for t in ("$", "{", "/", "*", "<", ":", "_"):
        if t in v:
            out.append(f"has{t}")
    out.append(f"before={c.left[-1:]}")
    out.append(f"after={c.right[:1]}")
    out.append(f"type={kind}")
    suffix = path.rsplit(".", 1)[-1].lower()[:8] if "." in path else ""
    out += [f"suffix={suffix}", f"language={language}"]
    return out


def no_credential(c: Candidate) -> bool:
    """Whether a value is by definition none: a placeholder, a mask, an earlier marker, a reference to where it is kept, a checksum or an id."""
    if c.kind == "private_key":
        return False
    v, left = c.value, c.left
    if ABSENT.search(v) or "REDACTED" in left[-24:] or re.search(r"(?i)(?:vault|environ|getenv|read)\W*$", left[-16:]):
        return True
    tail = left.rstrip(" :=\"'`(")[-40:]
    if HARMLESS.search(tail) or re.search(r"(?i)data:[\w/+.\-]+;base64$|sha\d{1,3}[:\-]?$", left.rstrip(",")[-40:]) or re.match(r"(?i)sha\d{1,3}[:\-]", v):
        return True
    return shape(v) == "uuid"


def weak_label(c: Candidate, surprise: float) -> int | None:
    """1 for a value that a pattern makes surely a credential, 0 for surely none, None where patterns are silent."""
    v, left = c.value, c.left
    if c.kind == "private_key":
        return 1
    if no_credential(c) or re.match(r"/\*|\\[a-z]+|\$\$", v):
        return 0
    sh = shape(v)
    if sh == "prefixed":
        return 1
    near = re.search(r"(?i)(?:pass(?:word|wd|phrase)?|pwd|pw|secret(?:_?(?:key|access))?|(?:[a-z]+_)?token|api_?key|credentials?|auth)[\"']?\s*(?:[:=]|,)\s*[\"'`(]*$", left[-48:])
    random_like = sh in ("hex32", "hex40", "hex64", "words-number", "wordnumber", "word#9WORD", "base64", "urlsafe") or (sh in ("mixed", "alnum") and len(v) >= 8)
    random_like = random_like or (sh in ("other", "letters") and len(v) >= 8 and surprise > 4 and v.lower() != v and v.upper() != v)
    if c.kind == "userinfo":
        return 1
    if near and random_like:
        return 1
    clear = random_like and re.search(r"\d", v) and (sh not in ("mixed", "alnum", "base64", "urlsafe") or surprise > 3.5)
    if clear and (SENSITIVE.search(left[-40:]) or SENSITIVE.search(c.right[:16])):
        return 1
    if not SENSITIVE.search(left[-80:]) and not SENSITIVE.search(c.right[:40]) and sh in ("other", "hexshort", "mixed", "alnum") and surprise < 4.0:
        return 0
    return None


def hashed(names: list[str]) -> np.ndarray:
    """Positions of features in the hashed space."""
    return np.array([zlib.crc32(x.encode()) % BUCKETS for x in names], dtype=np.int64)


class Scorer:
    """Logistic regression with calibrated probabilities."""

    def __init__(self, w: np.ndarray, scale: float, shift: float):
        self.w, self.scale, self.shift = w, scale, shift

    def probability(self, at: np.ndarray) -> float:
        z = self.scale * float(self.w[at].sum()) + self.shift
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))

    @staticmethod
    def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 12, rate: float = 0.2, decay: float = 1e-5, seed: int = 3) -> "Scorer":
        """Adaptive gradient descent over four fifths of the rows, then Platt scaling on the rest."""
        w = np.zeros(BUCKETS)
        if not len(rows) or labels.min() == labels.max():
            return Scorer(w, 1.0, -20.0 if not len(rows) or labels.max() == 0 else 20.0)
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(rows))
        held, kept = order[: len(rows) // 5], order[len(rows) // 5 :]
        weight = np.where(labels == 1, len(labels) / (2 * labels.sum()), len(labels) / (2 * (len(labels) - labels.sum())))
        seen = np.full(BUCKETS, 1e-6)
        for _ in range(epochs):
            rng.shuffle(kept)
            for s in range(0, len(kept), 64):
                b = kept[s : s + 64]
                g: dict[int, float] = {}
                for i in b:
                    at = rows[i]
                    z = max(-35.0, min(35.0, float(w[at].sum())))
                    e = (1 / (1 + math.exp(-z)) - labels[i]) * weight[i]
                    for k in at:
                        g[k] = g.get(k, 0.0) + e
                idx = np.fromiter(g.keys(), dtype=np.int64)
                val = np.fromiter(g.values(), dtype=float) / len(b) + decay * w[idx]
                seen[idx] += val * val
                w[idx] -= rate * val / np.sqrt(seen[idx])
        z = np.array([w[rows[i]].sum() for i in held])
        y = labels[held].astype(float)
        a, c = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * z + c, -35, 35)))
            a -= 0.05 * float(((p - y) * z).mean() / (z.std() + 1e-9) ** 2)
            c -= 0.5 * float((p - y).mean())
        return Scorer(w, max(a, 0.05), c)
