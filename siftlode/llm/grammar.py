"""Re-Pair grammars over token sequences (Larsson and Moffat 1999), replaced in rounds."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np

_LEX = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|\S")
#: Words that keep their identity in the abstract token sequence; all other names become one token.
KEYWORDS = frozenset(
    "def class return if else elif for while in is not and or import from as with try except finally raise pass lambda yield function "
    "var let const new export default async await public private protected static final void package interface extends implements func "
    "type struct map range go defer nil fn pub mod use impl match self this let mut local set echo do done fi then case esac include "
    "int char long float double bool boolean string true false null None True False throw throws switch break continue typeof".split()
)


def lex(text: str) -> list[str]:
    """Source tokens: names, numbers, string literals, single other characters."""
    return _LEX.findall(text)


def abstract(tokens: list[str]) -> list[str]:
    """Tokens with names, numbers and strings each reduced to one symbol; keywords and signs stay."""
    out = []
    for t in tokens:
        c = t[0]
        if c.isalpha() or c in "_$":
            out.append(t if t in KEYWORDS else "I")
        elif c.isdigit():
            out.append("N")
        elif c in "\"'`" and len(t) > 1:
            out.append("S")
        else:
            out.append(t)
    return out


def repair(sequence: list) -> tuple[list[int], list[tuple[int, int]], int]:
    """(start sequence, rules, alphabet size): symbol ``alphabet + r`` stands for the pair ``rules[r]``.

    Each round replaces the most frequent pairs that share no symbol with one another, so a round is one
    pass and their number is about the logarithm of the length; it ends when no pair occurs twice.
    """
    ids: dict = {}
    seq = [ids.setdefault(t, len(ids)) for t in sequence]
    alphabet = len(ids)
    rules: list[tuple[int, int]] = []
    while len(seq) > 3:
        counts = Counter(zip(seq, seq[1:]))
        ranked = sorted((x for x in counts.items() if x[1] > 1 and x[0][0] != x[0][1]), key=lambda x: (-x[1], x[0]))
        same = sorted((x for x in counts.items() if x[1] > 3 and x[0][0] == x[0][1]), key=lambda x: (-x[1], x[0]))
        if not ranked and not same:
            break
        if not ranked or same and same[0][1] > 2 * ranked[0][1]:
            ranked = same[:1]
        floor, busy, chosen = max(2, ranked[0][1] // 2), set(), {}
        for (a, b), n in ranked:
            if n < floor:
                break
            if a in busy or b in busy:
                continue
            busy |= {a, b}
            chosen[a] = (b, alphabet + len(rules))
            rules.append((a, b))
        out, i, last = [], 0, len(seq) - 1
        while i <= last:
            s = seq[i]
            c = chosen.get(s)
            if c is not None and i < last and seq[i + 1] == c[0]:
                out.append(c[1])
                i += 2
            else:
                out.append(s)
                i += 1
        if len(out) == len(seq):
            break
        seq = out
    return seq, rules, alphabet


def reuse(sequence: list) -> float:
    """Length of a sequence over the size of its grammar (start sequence and two symbols a rule); 1 without any repeats."""
    if not sequence:
        return 1.0
    start, rules, _ = repair(sequence)
    return len(sequence) / max(1, len(start) + 2 * len(rules))


def symbol_classes(sequence: list[str], known: set[str]) -> list[str]:
    """The sequence with every symbol outside ``known`` replaced by one wildcard."""
    return [x if x in known else "~" for x in sequence]


class Sequences:
    """Sequences of symbols as flat arrays, each with the number of its occurrences: what the rounds of a grammar work on."""

    def __init__(self, packed: list[bytes], times: list[int]):
        lengths = np.fromiter((len(x) // 4 for x in packed), np.int64, len(packed))
        self.symbols = np.frombuffer(b"".join(packed), np.int32).astype(np.int64)
        self.times = np.repeat(np.asarray(times, np.int64), lengths)
        #: Whether a symbol and the next one may form a pair.
        self.linked = np.ones(len(self.symbols), bool)
        self.linked[np.cumsum(lengths)[lengths > 0] - 1] = False

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pairs, their counts, places, the pair at each place); a symbol and itself make no pair."""
        at = np.flatnonzero(self.linked)
        at = at[self.symbols[at] != self.symbols[at + 1]]
        found, which = np.unique(self.symbols[at] << 32 | self.symbols[at + 1], return_inverse=True)
        counts = np.zeros(len(found), np.int64)
        np.add.at(counts, which, self.times[at])
        return found, counts, at, which

    def cut(self, at: np.ndarray) -> None:
        """Part the sequences behind these places. A pair's count bounds those of all later pairs at its places, so this is exact for rare pairs."""
        self.linked[at] = False
        before = np.concatenate([[False], self.linked[:-1]])
        self._keep(self.linked | before)

    def replace(self, pairs: np.ndarray, first: int) -> None:
        """Symbol ``first + r`` for each occurrence of ``pairs[r]``; no symbol ends one of the pairs and begins another."""
        order = np.argsort(pairs)
        at = np.flatnonzero(self.linked)
        key = self.symbols[at] << 32 | self.symbols[at + 1]
        place = np.minimum(np.searchsorted(pairs[order], key), len(pairs) - 1)
        hit = pairs[order][place] == key
        at = at[hit]
        self.symbols[at] = first + order[place[hit]]
        self.linked[at] = self.linked[at + 1]
        keep = np.ones(len(self.symbols), bool)
        keep[at + 1] = False
        self._keep(keep)

    def packed(self) -> list[bytes]:
        """The sequences of two symbols at least, in their order."""
        ends = np.flatnonzero(~self.linked) + 1
        starts = np.concatenate([[0], ends[:-1]])
        raw = self.symbols.astype(np.int32).tobytes()
        return [raw[4 * a : 4 * b] if b > a + 1 else b"" for a, b in zip(starts.tolist(), ends.tolist())]

    def _keep(self, keep: np.ndarray) -> None:
        self.symbols, self.times, self.linked = self.symbols[keep], self.times[keep], self.linked[keep]


def round_floor(top: int, least: int) -> int:
    """The count from which pairs are replaced in the round whose most frequent pair has ``top`` occurrences."""
    return max(least, top // 2)


def round_pairs(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The pairs of one round, most frequent first: no symbol ends one and begins another, so none takes an occurrence from another."""
    begins, ends, chosen = set(), set(), []
    for pair in pairs[np.lexsort((pairs, -counts))].tolist():
        a, b = pair >> 32, pair & 0xFFFFFFFF
        if a not in ends and b not in begins:
            begins.add(a)
            ends.add(b)
            chosen.append(pair)
    return np.array(chosen, np.int64)


def rounds(work: Sequences, first: int, least: int) -> Iterator[np.ndarray]:
    """The pairs that each round replaces, until no pair has ``least`` occurrences; their symbols count from ``first``."""
    while True:
        pairs, counts, at, which = work.pairs()
        often = counts >= least
        if not often.any():
            return
        floor = counts >= round_floor(int(counts.max()), least)
        chosen = round_pairs(pairs[floor], counts[floor])
        yield chosen
        work.cut(at[~often[which]])
        work.replace(chosen, first)
        first += len(chosen)


class PhraseGrammar:
    """One Re-Pair grammar over many short sequences: its rules are the phrases that they share.

    ``known``: the symbols that keep their identity. Pairs never cross a sequence's end, and a rule has at least
    ``least`` uses when it is made. Each round replaces all pairs of at least half the highest count of which none begins with another's
    end. A sequence is parsed by joining its pairs in the order in which the rules were made. ``rules``: those of
    rounds that were done elsewhere.
    """

    def __init__(self, sequences: list[list[str]], known: set[str], least: int = 6, rules: np.ndarray | None = None):
        self.known = known
        self.ids: dict[str, int] = {x: i for i, x in enumerate(sorted(known | {"~"}))}
        self.alphabet = len(self.ids)
        if rules is None:
            weight = Counter(map(self.pack, sequences))
            made = [*rounds(Sequences(list(weight), list(weight.values())), self.alphabet, least)]
            rules = np.concatenate([np.empty(0, np.int64), *made])
        self.rules: list[tuple[int, int]] = [(x >> 32, x & 0xFFFFFFFF) for x in rules.tolist()]
        self.index = {pair: self.alphabet + r for r, pair in enumerate(self.rules)}
        #: Rules with a word of letters in their expansion.
        letters = {i for x, i in self.ids.items() if x.isalpha()}
        self.named: set[int] = set()
        for r, (a, b) in enumerate(self.rules):
            if a in letters or b in letters or a in self.named or b in self.named:
                self.named.add(self.alphabet + r)
        self._seen: dict[tuple, list[int]] = {}

    def pack(self, sequence: list[str]) -> bytes:
        """A sequence's symbols as :class:`Sequences` takes them."""
        return np.array([self.ids[x] for x in symbol_classes(sequence, self.known)], np.int32).tobytes()

    def parse(self, sequence: list[str]) -> list[int]:
        """The sequence as the largest phrases; symbols below ``alphabet`` are in none."""
        s = [self.ids[x] for x in symbol_classes(sequence, self.known)]
        key = tuple(s)
        if key in self._seen:
            return self._seen[key]
        while len(s) > 1:
            best = min((r for r in map(self.index.get, zip(s, s[1:])) if r is not None), default=None)
            if best is None:
                break
            a, b = self.rules[best - self.alphabet]
            s = _replace(s, {a: (b, best)})
        if len(self._seen) < 200_000:
            self._seen[key] = s
        return s

    def nested(self, symbols: list[int]) -> set[int]:
        """The rules in the expansions of the symbols, themselves included."""
        out: set[int] = set()
        todo = list(symbols)
        while todo:
            x = todo.pop()
            if x >= self.alphabet and x not in out:
                out.add(x)
                todo += self.rules[x - self.alphabet]
        return out

    def words(self, symbol: int) -> list[str]:
        """The expansion of a symbol."""
        names = sorted(self.ids, key=self.ids.get)
        out, todo = [], [symbol]
        while todo:
            x = todo.pop()
            if x < self.alphabet:
                out.append(names[x])
            else:
                todo += reversed(self.rules[x - self.alphabet])
        return out


def _replace(s: list[int], chosen: dict[int, tuple[int, int]]) -> list[int]:
    out, i, last = [], 0, len(s) - 1
    while i <= last:
        c = chosen.get(s[i])
        if c is not None and i < last and s[i + 1] == c[0]:
            out.append(c[1])
            i += 2
        else:
            out.append(s[i])
            i += 1
    return out
