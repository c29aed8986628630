"""Text of scanned pages made continuous and readable (problem 6).

An *averaged-perceptron character editor* reads every word that a lexicon does not know and chooses among
keep, replace, delete and insert operations, and behind a hyphen at a line end whether to join the lines to one word, to
a compound or not; its weights are trained on clean texts of the same collection, damaged by a noise table, cut words
and compounds.  Features are the operation, how often the word before and after the
operation occurs in clean text, and how common the character triples and quadruples around it are (so names,
which no lexicon has, can be read too).  A second averaged perceptron finds page furniture from the place and
shape of a line: page-number patterns, likeness to the book's headings, whether it breaks into a sentence, whether
the next word would still have fitted on it, letter case and its final mark.

Words, letter cases, compounds and character grams are counted over all clean texts (and words over all scanned
texts) in partial aggregates; a bounded sample of clean texts serves to train the weights only, with these counts.
Of the counts those travel that scanned texts, the sample or their candidate readings ask for, as sorted hashes with
one byte each (no count above ``MOST`` is told apart).  Headings of a book come from ``toc`` and from
lines that occur with a page number on several of its chunks.

Defined results for odd input: null and blank texts give no rows; a text without damage gives none;
repeated rows of one id count once; books without headings are judged by shape alone; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .samples import bounded_sample
from .sentences import clean_text, content_offset

PER_LABEL = 512
PAGES = 1500  # least number of pages that the line perceptron is trained on; a sample with more rows gives one page a row
MOST = 255
LEAST_SCANNED = 3
# Characters as misread and as printed.
LATIN = [
    ("c", "e"), ("0", "o"), ("1", "l"), ("f", "t"), ("5", "s"), ("o", "a"), ("l", "i"), ("cl", "d"), ("rn", "m"), ("ii", "u"),
    ("6", "b"), ("q", "g"), ("b", "h"), ("vv", "w"), ("m", "in"), ("li", "h"), ("I", "l"), ("0", "O"), ("5", "S"), ("8", "B"),
    ("1", "I"), ("F", "E"), ("O", "Q"), ("tl", "d"), ("ri", "n"), ("nn", "m"), ("u", "ii"), ("i", "l"), ("t", "f"), ("e", "c"), ("1", "i"),
    ("d", "cl"), ("m", "rn"), ("rm", "nn"), ("a", "o"),
]
DEVANAGARI = [
    ("ी", "ि"), ("थ", "य"), ("ष", "प"), ("ब", "व"), ("ू", "ु"), ("घ", "ध"), ("भ", "म"), ("व", "ब"), ("म", "भ"), ("य", "थ"), ("प", "ष"),
    ("ध", "घ"), ("ि", "ी"), ("ु", "ू"), ("ै", "े"), ("ौ", "ो"), ("ड", "ङ"), ("रव", "ख"), ("ं", "ँ"), ("", "ं"), ("", "ँ"),
]
DIGITS = {"O": "0", "o": "0", "S": "5", "s": "5", "B": "8", "I": "1", "l": "1", "i": "1", "Z": "2", "z": "2", "G": "6", "b": "6", "q": "9", "g": "9"}
# How often the rarer readings occur against the common ones when training.
_RARE = {("li", "h"), ("I", "l"), ("O", "Q"), ("tl", "d"), ("ri", "n"), ("nn", "m"), ("u", "ii"), ("i", "l"), ("t", "f"), ("e", "c"), ("1", "i"), ("8", "B"), ("ध", "घ"), ("ि", "ी"), ("ु", "ू"), ("ै", "े"), ("ौ", "ो"), ("ड", "ङ"), ("रव", "ख"), ("ं", "ँ"), ("", "ँ")}

# Ways to go on behind a line that ends in a hyphen: one word, a compound with its hyphen, two words.
JOINS = ("join", "hyphen", "apart")
EDGE = ".,;:!?()[]{}\"'«»“”„‘’¿¡…|।॥%*•/"
_PART = re.compile(r"['’\-‐‑/.]")
_HYPHEN = "-­‐"
_DIGITS_ONLY = re.compile(r"[0-9OoSBIlZ]+(?:[.,][0-9OoSBIlZ]+)*")
_NUMBERED = re.compile(r"^(?:[\[(]\s*(?:\d+|[ivxlcdm]+)\s*[\])]\s*|\d+\s*[|–—-]\s*)|(?:\s*[|–—-])?\s*[\[(]?\d+[\])]?$", re.I)
_PAGE_NUMBER = re.compile(r"^[\s\-–—\[(|]*(?:(?:page|seite|página|pagina|p\.|पृष्ठ|पान|หน้า|第)\s*)?(?:[\dOIlSB]{1,4}|[ivxlcdm]{1,9})(?:\s*页)?[\s\-–—\])|]*$", re.I)


class Perceptron:
    """Averaged perceptron over named features, ranking candidates."""

    def __init__(self):
        self.w: dict[str, float] = defaultdict(float)

    def score(self, features) -> float:
        get = self.w.get
        return sum(get(f, 0.0) for f in features)

    def train(self, cases: list[tuple[list[list[str]], int]], rounds: int = 4, seed: int = 5) -> None:
        """cases: (features of each candidate, number of the right one)."""
        total: dict[str, float] = defaultdict(float)
        w, step, rng = self.w, 1, random.Random(seed)
        for _ in range(rounds):
            rng.shuffle(cases)
            for cands, right in cases:
                best = max(range(len(cands)), key=lambda k: (self.score(cands[k]), -k))
                if best != right:
                    for f in cands[right]:
                        w[f] += 1
                        total[f] += step
                    for f in cands[best]:
                        w[f] -= 1
                        total[f] -= step
                step += 1
        self.w = {f: v - total[f] / step for f, v in w.items() if v - total[f] / step}


def _bucket(n: int) -> int:
    return 0 if n <= 0 else 1 if n == 1 else 2 if n < 5 else 3 if n < 20 else 4


def _key(kind: str, text: str) -> int:
    """Hash of a word (w), a lower-case word (l), a compound (c) or a character gram (g)."""
    return int.from_bytes(blake2b((kind + text).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _grams(low: str) -> list[str]:
    p = f"^^{low}$$"
    return [p[i : i + 3] for i in range(len(p) - 2)] + [p[i : i + 4] for i in range(len(p) - 3)]


class Counts:
    """Counts of one kind, read from sorted hashes."""

    def __init__(self, kind: str, keys: np.ndarray, counts: np.ndarray):
        self.kind, self.keys, self.counts, self._seen = kind, keys, counts, {}

    def __getitem__(self, text: str) -> int:
        n = self._seen.get(text)
        if n is None:
            if len(self._seen) > 200_000:
                self._seen.clear()
            h = _key(self.kind, text)
            k = int(np.searchsorted(self.keys, h))
            n = self._seen[text] = int(self.counts[k]) if k < len(self.keys) and self.keys[k] == h else 0
        return n

    def __contains__(self, text: str) -> bool:
        return self[text] > 0

    def __getstate__(self):
        return {**self.__dict__, "_seen": {}}


class Asked:
    """Stands for counts and notes what is asked; it says 1, so that every candidate is looked at."""

    def __init__(self, kind: str, noted: set[tuple[str, str]]):
        self.kind, self.noted = kind, noted

    def __getitem__(self, text: str) -> int:
        self.noted.add((self.kind, text))
        return 1

    def __contains__(self, text: str) -> bool:
        self.noted.add((self.kind, text))
        return True


class Editor:
    """Lexicon, character grams and the weights of both perceptrons."""

    def __init__(self, texts: list[str], scanned: list[str] = ()):
        self.lexicon: Counter = Counter()
        self.compounds: set[str] = set()
        for t in texts:
            for tok in t.split():
                tok = tok.strip(EDGE)
                parts = _PART.split(tok)
                self.lexicon.update(p for p in parts if p)
                if "-" in tok and len(parts) > 1:
                    self.compounds.add(tok.lower())
        low: Counter = Counter()
        for w, n in self.lexicon.items():
            low[w.lower()] += n
        self.low = low
        self._add_scanned(scanned)
        self.grams: Counter = Counter()
        for w in low:
            self.grams.update(_grams(w))
        self.words = Perceptron()
        self.lines = Perceptron()
        self.joins = Perceptron()
        self._seen: dict[str, str] = {}

    def counting(self, of) -> None:
        """Takes other counts: of(kind) for each kind."""
        self.lexicon, self.low, self.compounds, self.grams, self._seen = of("w"), of("l"), of("c"), of("g"), {}

    def _add_scanned(self, texts: list[str], least: int = LEAST_SCANNED) -> None:
        """Words that stand in several scanned texts count too (inflected forms that no clean text has), unless a
        reading of them is far more common: a misreading can occur several times."""
        df: Counter = Counter()
        for t in texts:
            df.update(_parts(t))
        for w, n in sorted(df.items()):
            if n < least or self.low[w.lower()] > 1 or any(c.isdigit() for c in w):
                continue
            if all(max(self.low[v.lower()], df[v]) < 8 * n for v in _others(w)):
                self.lexicon[w] += n
                self.low[w.lower()] += n

    def known(self, w: str) -> bool:
        return self.lexicon[w] > 1 or (self.low[w.lower()] > 1 and not any(c.isdigit() for c in w))

    def _shape(self, w: str, i: int, n: int, less: int = 0) -> str:
        """Buckets of the rarest triple and quadruple around characters i to i + n of w."""
        p = f"^^{w.lower()}$$"
        a, b = i + 2, i + 2 + n
        g = self.grams
        t3 = min((g[p[k : k + 3]] for k in range(max(0, a - 2), min(len(p) - 3, b) + 1)), default=0)
        t4 = min((g[p[k : k + 4]] for k in range(max(0, a - 3), min(len(p) - 4, b) + 1)), default=0)
        return f"{_bucket(t3 - less)}{_bucket(t4 - less)}"

    def _lex(self, w: str, less: int = 0) -> int:
        return max(_bucket(self.lexicon[w] - less), _bucket(self.low[w.lower()] - less))

    def candidates(self, w: str, true: str | None = None) -> list[tuple[str, list[str]]]:
        """(reading, features); the first is the word as it stands.  With *true*, counts leave that word out."""
        def less(v: str) -> int:
            return 1 if v == true else 0

        dev = any("ऀ" <= c <= "ॿ" for c in w)
        own = self._lex(w, less(w))
        tag = "D" if dev else "L"
        mixed = "x" if any(c.isdigit() for c in w) else ""
        out = [(w, [f"keep{tag}", f"keep{tag}{mixed}lex{own}", f"keep{tag}shape{self._shape(w, 0, len(w), less(w))}", f"keep{tag}cap{w[:1].isupper()}lex{own}"])]
        seen = {w}
        for a, b in DEVANAGARI if dev else LATIN:
            if a == "":
                places = range(1, len(w) + 1)
            else:
                places = [i for i in range(len(w) - len(a) + 1) if w.startswith(a, i)]
            for i in places:
                v = w[:i] + b + w[i + len(a) :]
                if v in seen or not v:
                    continue
                x = self._lex(v, less(v))
                if a == "" and not x:
                    continue
                seen.add(v)
                was, now = self._shape(w, i, len(a)), self._shape(v, i, len(b), less(v))
                if not x and v != true and not (now[0] >= was[0] and now[1] >= was[1] and now != was):
                    continue  # an unknown word needs more common characters than it has
                out.append((v, [f"op{a}>{b}", f"op{a}>{b}lex{min(x, 2)}", f"new{tag}lex{x}own{own}", f"new{tag}{was}>{now}lex{min(x, 2)}", f"new{tag}cap{w[:1].isupper()}lex{min(x, 2)}", f"new{mixed}shape{now}"]))
        return out

    def drawn(self, texts: list[str], cases: int = 24_000, seed: int = 3) -> list[tuple[str, str]]:
        """(word as met, word as printed) of the training cases."""
        rng = random.Random(seed)
        tokens = [p for t in texts for tok in t.split() for p in _PART.split(tok.strip(EDGE)) if len(p) > 2 and not any(c.isdigit() for c in p)]
        rare = [w for w in tokens if self.low[w.lower()] < 20]
        out = []
        for k in range(min(cases, 4 * len(tokens))):
            w = rng.choice(rare if rare and k % 2 else tokens)
            out.append((damaged(w, rng) if k % 3 == 0 else w, w))
        return out

    def train_words(self, drawn: list[tuple[str, str]]) -> None:
        data = []
        for noisy, w in drawn:
            if noisy != w and self.known(noisy):
                continue
            c = self.candidates(noisy, w)
            right = next((i for i, (v, _) in enumerate(c) if v == w), None)
            if right is not None and len(c) > 1:
                data.append(([f for _, f in c], right))
        self.words.train(data)

    def join_candidates(self, a: str, b: str, comp: int | None = None) -> list[list[str]]:
        """Features of the ways to go on from *a*, a word that a line ends with a hyphen behind, to *b*: one word, a
        compound with its hyphen, or two words (JOINS)."""
        wa, wb = a.split("-")[-1].strip(EDGE), b.strip(EDGE)
        whole, compound = (a + b).strip(EDGE), (a + "-" + b).strip(EDGE).lower()
        lex, parts = min(self._lex(_PART.split(whole)[-1] if "-" in a else whole), 2), f"{min(self._lex(wa), 2)}{min(self._lex(wb), 2)}"
        comp = int(compound in self.compounds) if comp is None else comp
        shape = f"{'u' if wb[:1].isupper() else 'l'}{'s' if len(wa) < 3 or len(wb) < 3 else 'l'}"
        seen = f"lex{lex}comp{comp}"
        return [[f"{op}", f"{op} {seen}", f"{op} {seen} parts{parts}", f"{op} {shape}", f"{op} parts{parts} {shape}"] for op in JOINS]

    def join(self, a: str, b: str) -> str:
        """The way of JOINS that the perceptron chooses (one word, where none is better)."""
        c = self.join_candidates(a, b)
        return JOINS[max(range(len(c)), key=lambda k: (self.joins.score(c[k]), -k))]

    def drawn_joins(self, texts: list[str], cases: int = 6_000, seed: int = 7) -> list[tuple[str, str, int]]:
        """(end of a line without its hyphen, begin of the next, number in JOINS) of the training cases: words cut
        anywhere, compounds cut at their hyphen, and words that stand before another with a hyphen as they are.
        Number -1 stands for two words that are taken for a compound of the corpus, so that some are met in any sample."""
        rng = random.Random(seed)
        whole, compounds, apart = [], [], []
        for t in texts:
            toks = t.split()
            for tok, nxt in zip(toks, [*toks[1:], ""]):
                w = tok.strip(EDGE)
                if tok[-1] == "-" and len(tok) > 1 and nxt:
                    apart.append((tok[:-1], nxt, 2))
                elif "-" in w and all(map(str.isalpha, w.split("-"))):
                    cut_at = rng.choice([i for i, c in enumerate(w) if c == "-"])
                    compounds.append((w[:cut_at], w[cut_at + 1 :], 1))
                elif len(w) > 4 and w.isalpha():
                    whole.append(w)
        out = [(w[:i], w[i:], 0) for w in rng.sample(whole, min(cases, len(whole))) for i in [rng.randint(2, len(w) - 2)]]
        for found in (compounds, apart):
            out += rng.sample(found, min(cases // 6, len(found)))
        return out + [(*rng.sample(whole, 2), -1) for _ in range(min(cases // 12, len(whole) // 2))]

    def train_joins(self, drawn: list[tuple[str, str, int]]) -> None:
        self.joins.train([(self.join_candidates(a, b, 1 if right < 0 else None), abs(right)) for a, b, right in drawn])

    def reading(self, w: str) -> str:
        """What a word without punctuation should read."""
        if len(w) < 2 or self.known(w):
            return w
        got = self._seen.get(w)
        if got is None:
            if len(self._seen) > 100_000:
                self._seen.clear()
            c = self.candidates(w)
            best = max(range(len(c)), key=lambda k: (self.words.score(c[k][1]), -k))
            got = c[best][0]
            if best and any(x.isdigit() for x in got):  # a second misread character
                c = self.candidates(got)
                got = max(c, key=lambda x: self.words.score(x[1]))[0]
            self._seen[w] = got
        return got

    def token(self, t: str) -> str:
        """Reading of a token: a number, or words parted by apostrophes, hyphens, full stops and slashes."""
        if any(c.isdigit() for c in t) and not t.isdigit() and _DIGITS_ONLY.fullmatch(t):
            digits = sum(map(str.isdigit, t))
            if digits * 2 >= len(t.replace(",", "").replace(".", "")):
                return "".join(DIGITS.get(c, c) for c in t)
        if any(c.isdigit() for c in t) and not any(c.isalpha() for c in t):
            return t
        if t.isalpha() or not _PART.search(t):
            return self.reading(t) if any(map(str.isalpha, t)) else t
        out, p = [], 0
        for m in [*_PART.finditer(t), None]:
            w = t[p : m.start()] if m else t[p:]
            digits = sum(map(str.isdigit, w))
            if digits and digits * 2 >= len(w):
                w = "".join(DIGITS.get(c, c) for c in w)
            elif any(map(str.isalpha, w)):
                w = self.reading(w)
            out.append(w)
            if m:
                out.append(m.group())
                p = m.end()
        return "".join(out)


def _parts(text: str) -> set[str]:
    """Words of a scanned text, without those cut at a line end."""
    return {p for tok in text.split() if tok[-1] not in _HYPHEN for p in _PART.split(tok.strip(EDGE)) if p}


def _others(w: str) -> set[str]:
    """Readings of w by the noise table."""
    table = DEVANAGARI if any("ऀ" <= c <= "ॿ" for c in w) else LATIN
    return {w[:i] + b + w[i + len(a) :] for a, b in table for i in range(1 - (a != ""), len(w)) if w.startswith(a, i)} - {w}


def damaged(w: str, rng: random.Random) -> str:
    """A word with one misread character by the noise table."""
    table = DEVANAGARI if any("ऀ" <= c <= "ॿ" for c in w) else LATIN
    fits = [(a, b) for a, b in table if b in w and ((a, b) not in _RARE or rng.random() < 0.12)]
    if not fits:
        return w
    a, b = rng.choice(fits)
    i = rng.choice([i for i in range(len(w)) if w.startswith(b, i)])
    return w[:i] + a + w[i + len(b) :]


def heading_key(line: str) -> str:
    """A line without its page number, for comparison with headings."""
    return " ".join(_NUMBERED.sub("", line.strip()).casefold().split())


def _alike(a: str, b: str) -> bool:
    """Equal up to a few misread characters."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 3 or not a or not b:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    s = 0
    while s < min(len(a), len(b)) - p and a[-1 - s] == b[-1 - s]:
        s += 1
    if max(len(a), len(b)) - p - s <= 2:
        return True
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        prev = row
    return prev[-1] <= max(2, len(a) // 8)


def line_features(lines: list[str], i: int, titles: list[str]) -> list[str]:
    """Place and shape of line i of a page."""
    t = lines[i].strip()
    width = max(map(len, lines))
    key = heading_key(t)
    head = "is" if key and key in titles else "like" if len(key) > 3 and any(_alike(key, x) for x in titles) else "no"
    number = bool(_PAGE_NUMBER.match(t)) and (t.strip("-–—[]()| ").lower() not in ("i", "y", "a", "à") or len(lines) == 1)
    decorated = key != " ".join(t.casefold().split())
    before = next((lines[k].rstrip() for k in range(i - 1, -1, -1) if lines[k].strip()), "")
    after = next((lines[k].lstrip() for k in range(i + 1, len(lines)) if lines[k].strip()), "")
    ends = t[-1:] in ".!?।|»\"”,;:-­"
    breaks = bool(before) and before[-1:] not in ".!?।|»\"”"
    fits = len(t) + 1 + len(after.split(" ")[0]) <= width - 2 if after else False
    place = "first" if not before else "last" if not after else "inner"
    beside = any(_PAGE_NUMBER.match(lines[k].strip()) for k in (i - 1, i + 1) if 0 <= k < len(lines))  # another line of furniture
    if number:  # its width and marks say nothing
        return ["number", f"number breaks:{breaks}", f"number alone:{len(lines) == 1}", f"number place:{place}"]
    shape = "up" if t.isupper() else "title" if t[:1].isupper() or t[:1].isdigit() else "other"
    return [f"head:{head}", f"head:{head} ends:{ends}", f"dec:{decorated} head:{head}", f"breaks:{breaks} ends:{ends}", f"fits:{fits} ends:{ends}", f"shape:{shape} ends:{ends}", f"short:{len(t) * 2 < width}", f"place:{place} head:{head}", f"place:{place} ends:{ends}", f"beside:{beside} head:{head}", "bias"]


def _wrapped(text: str, rng: random.Random, titles: list[str]) -> tuple[list[str], list[bool]]:
    """A clean text as a page with furniture: lines and whether each is furniture."""
    import textwrap

    width = rng.randint(44, 72)
    lines: list[str] = []
    for par in text.split("\n"):
        lines += textwrap.wrap(par, width) or [""]
    mark = [False] * len(lines)
    for _ in range(rng.randint(1, 2)):
        n = str(rng.randint(1, 320)) if rng.random() < 0.85 else rng.choice(["ii", "xiv", "xxvii", "lxi", "iv"])
        name = rng.choice(titles) if titles else ""
        name = name.upper() if rng.random() < 0.3 else name
        f = rng.choice([n, f"- {n} -", f"Page {n}", name or n, name or n, f"{n} | {name}", f"[{n}] {name}", f"{name} {n}"] if name else [n, f"- {n} -", f"Page {n}"])
        if rng.random() < 0.2:
            f = " ".join(damaged(w, rng) if rng.random() < 0.3 else w for w in f.split(" "))
        at = 0 if rng.random() < 0.2 else rng.randint(0, len(lines))  # a page or the text begins with it, or it stands between
        lines.insert(at, f)
        mark.insert(at, True)
    return lines, mark


def fit(rows: list[tuple[str, list[str]]], scanned: list[str] = ()) -> Editor:
    """An editor from (clean text, headings of its book) rows and scanned texts, of which only words are taken."""
    texts = [t for t, _ in rows]
    ed = Editor(texts, scanned)
    ed.train_words(ed.drawn(texts))
    ed.train_joins(ed.drawn_joins(texts))
    train_lines(ed, rows)
    return ed


def train_lines(ed: Editor, rows: list[tuple[str, list[str]]]) -> None:
    rng = random.Random(11)
    cases = []
    pages = (rows * (PAGES // max(1, len(rows)) + 1))[: max(PAGES, len(rows))]  # every row of the sample at least once
    for text, titles in pages:
        keys = [heading_key(x) for x in titles]
        lines, mark = _wrapped(text, rng, titles)
        for i, m in enumerate(mark):
            if lines[i].strip():
                f = line_features(lines, i, keys)
                cases.append(([["no " + x for x in f], ["yes " + x for x in f]], int(m)))
    ed.lines.train(cases)


def furniture(ed: Editor, lines: list[str], titles: list[str]) -> list[bool]:
    out = []
    for i, t in enumerate(lines):
        if not t.strip():
            out.append(False)
            continue
        f = line_features(lines, i, titles)
        out.append(ed.lines.score("yes " + x for x in f) > ed.lines.score("no " + x for x in f))
    return out


def repairs(ed: Editor, text: str, titles: list[str]) -> tuple[list[tuple[int, str]], str]:
    """((position, repaired) of each damage, the continuous text)."""
    lines = text.split("\n")
    starts = [0]
    for t in lines[:-1]:
        starts.append(starts[-1] + len(t) + 1)
    drop = furniture(ed, lines, titles)
    found: list[tuple[int, str]] = []
    paragraphs: list[list[str]] = [[]]
    held: tuple[int, str, str] | None = None  # position, token so far, opening marks: a word open at a line end
    for i, line in enumerate(lines):
        if drop[i]:
            found.append((starts[i] + len(line) - len(line.lstrip()), ""))
            continue
        toks = [(m.start(), m.group()) for m in re.finditer(r"\S+", line)]
        if not toks:
            if held is None and paragraphs[-1] and (i + 1 < len(lines)):
                paragraphs.append([])
            continue
        for k, (at, tok) in enumerate(toks):
            pos = starts[i] + at
            joined = False
            if k == 0 and held is not None:
                hpos, hword, raw = held
                held = None
                body = tok.lstrip(EDGE)
                way = ed.join(raw, body)
                if way == "hyphen":
                    paragraphs[-1].append(raw + "-" + body)
                    continue
                if way == "join":
                    pos, tok, joined = hpos, raw + body, True
                else:
                    paragraphs[-1].append(raw + "-")
            if k == len(toks) - 1 and len(tok) > 1 and tok[-1] in _HYPHEN and tok[-2].isalpha() | (tok[-2] > "ऀ") and any(lines[j].strip() and not drop[j] for j in range(i + 1, len(lines))):
                held = (pos, tok[:-1], tok[:-1])
                continue
            word = tok.strip(EDGE)
            if not word:
                paragraphs[-1].append(tok)
                continue
            good = ed.token(word)
            if joined or good != word:
                found.append((pos + len(tok) - len(tok.lstrip(EDGE)), good))
            paragraphs[-1].append(tok.replace(word, good, 1))
    if held is not None:
        paragraphs[-1].append(held[1] + "-")
    return found, "\n\n".join(" ".join(p) for p in paragraphs if p)


def _headings(scans: DataFrame, toc: DataFrame) -> DataFrame:
    """(filename, titles): headings of each book from its table of contents and from lines that stand with a page
    number on two chunks or more."""
    line = F.explode(F.split("page_content", "\n")).alias("line")
    number = r"^\s*[\[(]?\d+[\])]?\s*\|?\s+(?=\S)|\s+\d+\s*$"
    lines = scans.select("filename", "chunk_id", line).where(F.length("line").between(4, 90) & F.col("line").rlike(number) & ~F.col("line").rlike(r"[.!?।,;:»-]\s*$"))
    repeated = lines.withColumn("title", F.lower(F.trim(F.regexp_replace("line", number, "")))).where(F.length("title") > 3)
    repeated = repeated.groupBy("filename", "title").agg(F.countDistinct("chunk_id").alias("n")).where("n > 1").select("filename", "title")
    listed = toc.select(F.col("doc_id").alias("filename"), "title").where("title is not null")
    return listed.unionByName(repeated).groupBy("filename").agg(F.sort_array(F.collect_set("title")).alias("titles"))


def scan_repairs(chunks: DataFrame, toc: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """Columns chunk_id, pos, repaired: damages of scanned chunks."""
    return _scan(chunks, toc, per_label, False)


def scan_texts(chunks: DataFrame, toc: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """Columns chunk_id, text: scanned chunks as continuous paragraphs."""
    return _scan(chunks, toc, per_label, True)


def _word_rows(batches):
    """Words and compounds of clean texts with their numbers (n), words of scanned texts with their texts (d)."""
    import pyarrow as pa

    seen: set[tuple] = set()
    toks, df = Counter(), Counter()

    def rows():
        words: Counter = Counter()
        compounds: set[str] = set()
        for tok, n in toks.items():
            tok = tok.strip(EDGE)
            parts = _PART.split(tok)
            for p in parts:
                if p:
                    words[p] += n
            if "-" in tok and len(parts) > 1:
                compounds.add(tok.lower())
        both = list(words.keys() | df.keys())
        comp = list(compounds)
        arrays = [
            pa.array(["w"] * len(both) + ["c"] * len(comp), pa.string()), pa.array(both + comp, pa.string()), pa.array([w.lower() for w in both] + comp, pa.string()),
            pa.array([words[w] for w in both] + [1] * len(comp), pa.int64()), pa.array([df[w] for w in both] + [0] * len(comp), pa.int64()),
        ]
        toks.clear()
        df.clear()
        return pa.RecordBatch.from_arrays(arrays, names=["kind", "word", "low", "n", "d"])

    for b in batches:
        for cid, text, source, scanned in zip(*(b.column(i).to_pylist() for i in range(4))):
            if (cid, scanned) in seen:  # redelivered rows once
                continue
            seen.add((cid, scanned))
            if scanned:
                df.update(_parts(text))
            else:
                toks.update(text[content_offset(text, source) :].split())
        if len(toks) + len(df) > 300_000:
            yield rows()
    if toks or df:
        yield rows()


def _readings(batches):
    import pyarrow as pa

    for b in batches:
        got = [(w, v, v.lower(), 8 * n) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for v in _others(w)]
        cols = list(zip(*got)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["word", "v", "vlow", "least"])


def _hashed(batches):
    """Counts by hash; lower-case words give their grams too."""
    import pyarrow as pa

    out: Counter = Counter()
    grams: Counter = Counter()

    def rows():
        for g, n in grams.items():
            out[_key("g", g)] += n
        got = pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.int64())], names=["h", "n"])
        out.clear()
        grams.clear()
        return got

    for b in batches:
        for kind, text, n in zip(*(b.column(i).to_pylist() for i in range(3))):
            out[_key(kind, text)] += n
            if kind == "l":
                grams.update(_grams(text))
        if len(out) + len(grams) > 500_000:
            yield rows()
    if out or grams:
        yield rows()


def corpus_counts(chunks: DataFrame) -> DataFrame:
    """Columns h, n: counts of all words, lower-case words, compounds and grams of the corpus, by hash."""
    ocr = F.coalesce(F.col("ocr"), F.lit(False))
    text = chunks.where(F.col("page_content").isNotNull() & (ocr | (F.col("type") == "text"))).select("chunk_id", "page_content", "source", ocr.alias("scanned"))
    rows = text.repartition("chunk_id").mapInArrow(_word_rows, "kind string, word string, low string, n long, d long")
    all_words = cut(rows.groupBy("kind", "word", "low").agg(F.sum("n").alias("n"), F.sum("d").alias("d")))
    words = all_words.where("kind = 'w'").drop("kind")
    low = words.groupBy("low").agg(F.sum("n").alias("n")).where("n > 0")
    # words of several scanned texts, unless a reading of them is far more common (as in Editor._add_scanned)
    unsure = words.where((F.col("d") >= LEAST_SCANNED) & ~F.col("word").rlike("\\p{N}")).join(low.where("n > 1").select("low"), "low", "left_anti").select("word", "d", "low")
    unsure = cut(unsure)
    others = unsure.select("word", "d").mapInArrow(_readings, "word string, v string, vlow string, least long")
    common = others.join(low.select(F.col("low").alias("vlow"), "n"), "vlow").where("n >= least").select("word")
    common = common.unionByName(others.join(words.select(F.col("word").alias("v"), "d"), "v").where("d >= least").select("word")).distinct()
    added = unsure.join(common, "word", "left_anti")
    lexicon = words.where("n > 0").select(F.lit("w").alias("kind"), F.col("word").alias("text"), "n").unionByName(added.select(F.lit("w").alias("kind"), F.col("word").alias("text"), F.col("d").alias("n")))
    low = low.unionByName(added.select("low", F.col("d").alias("n"))).groupBy("low").agg(F.sum("n").alias("n"))
    every = lexicon.unionByName(low.select(F.lit("l").alias("kind"), F.col("low").alias("text"), "n")).unionByName(all_words.where("kind = 'c'").select("kind", F.col("word").alias("text"), "n"))
    return every.mapInArrow(_hashed, "h long, n long").groupBy("h").agg(F.least(F.sum("n"), F.lit(MOST)).alias("n"))


def _join_counts(a: str, b: str) -> list[tuple[str, str]]:
    """What Editor.join_candidates asks for; behind a join the words are read, whole or apart."""
    whole = (a + b).strip(EDGE)
    words = {a.split("-")[-1].strip(EDGE), b.strip(EDGE), whole, _PART.split(whole)[-1]}
    return [("c", (a + "-" + b).strip(EDGE).lower()), *(("r", w) for w in sorted(words) if w)]


def _asked_for(editor: Editor, scans: DataFrame, drawn: list[tuple[str, str]], joins: list[tuple[str, str, int]]) -> DataFrame:
    """Column h: hashes of all counts that reading the scanned texts and training on *drawn* may ask for."""
    spark = scans.sparkSession
    shared = spark.sparkContext.broadcast(editor)  # bounded by the sample

    def words(batches):
        import pyarrow as pa

        ed = shared.value
        noted: set[tuple[str, str]] = set()
        lines = Editor([])
        lines.lines = ed.lines
        lines.reading = lambda w: noted.add(("r", w)) or w
        lines.known = lambda w: noted.add(("k", w)) or True
        lines.join = lambda a, b: noted.update(_join_counts(a, b)) or JOINS[0]
        keys: dict[tuple, list[str]] = {}
        for b in batches:
            for text, heads in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text or not text.strip():
                    continue
                t = tuple(heads or ())
                if t not in keys:
                    keys[t] = sorted({heading_key(x) for x in t})
                repairs(lines, text, keys[t])
            if len(noted) > 300_000:
                yield pa.RecordBatch.from_pylist([{"kind": k, "text": w} for k, w in noted], schema=pa.schema([("kind", pa.string()), ("text", pa.string())]))
                noted.clear()
        yield pa.RecordBatch.from_pylist([{"kind": k, "text": w} for k, w in noted], schema=pa.schema([("kind", pa.string()), ("text", pa.string())]))

    def keys_of(batches):
        import pyarrow as pa

        ed = shared.value
        sure = Editor([])
        sure.lexicon, sure.low = ed.lexicon, ed.low  # what the sample knows, the corpus knows
        noted: set[tuple[str, str]] = set()
        ask = Editor([])
        ask.counting(lambda kind: Asked(kind, noted))
        for b in batches:
            for kind, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if kind == "c":
                    noted.add((kind, w))
                    continue
                noted.update((("w", w), ("l", w.lower())))
                if kind == "k" or kind == "r" and (len(w) < 2 or sure.known(w)):
                    continue
                for v, _ in ask.candidates(w)[1:]:
                    if any(c.isdigit() for c in v):  # a second misread character
                        ask.candidates(v)
            yield pa.RecordBatch.from_arrays([pa.array([_key(k, t) for k, t in noted], pa.int64())], names=["h"])
            noted.clear()

    asked = scans.select("page_content", "titles").mapInArrow(words, "kind string, text string")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few words are much work
    asked_joins = {("k" if k == "r" else k, t) for a, b, _ in joins for k, t in _join_counts(a, b)}
    cases = spark.createDataFrame(sorted({("t", w) for w, _ in drawn} | asked_joins), "kind string, text string")  # bounded by the sample
    return asked.unionByName(cases).distinct().repartition(parts, "text").mapInArrow(keys_of, "h long").distinct()


def _scan(chunks: DataFrame, toc: DataFrame, per_label: int, whole: bool) -> DataFrame:
    spark = chunks.sparkSession
    schema = "chunk_id long, text string" if whole else "chunk_id long, pos int, repaired string"
    clean = clean_text(chunks)
    sample = bounded_sample(clean, "chunk_id", _label_group(), ["page_content", "source", "filename"], per_label)
    names = sorted({r["filename"] for r in sample if r["filename"]})
    titles: dict[str, list[str]] = defaultdict(list)
    if names:
        chosen = F.broadcast(spark.createDataFrame([(n,) for n in names], "doc_id string"))  # bounded by the sample
        for r in toc.where("title is not null").join(chosen, "doc_id", "left_semi").orderBy("doc_id", "pos").collect():
            titles[r["doc_id"]].append(r["title"])
    rows = [(r["page_content"][content_offset(r["page_content"], r["source"]) :], titles.get(r["filename"], [])) for r in sample]
    scans = chunks.where(F.col("ocr") & F.col("page_content").isNotNull()).select("chunk_id", "page_content", "filename")
    with_heads = cut(scans.join(_headings(scans, toc), "filename", "left").select("chunk_id", "page_content", "titles"))
    editor = Editor([t for t, _ in rows])
    train_lines(editor, rows)
    drawn = editor.drawn([t for t, _ in rows])
    joins = editor.drawn_joins([t for t, _ in rows])
    counts = corpus_counts(chunks).join(_asked_for(editor, with_heads, drawn, joins), "h", "left_semi").toArrow()
    hashes, n = counts["h"].to_numpy(), counts["n"].to_numpy().astype(np.uint8)
    order = np.argsort(hashes)
    hashes, n = hashes[order], n[order]
    editor.counting(lambda kind: Counts(kind, hashes, n))
    editor.train_words(drawn)
    editor.train_joins(joins)
    shared = spark.sparkContext.broadcast(editor)  # nine bytes for every count that is asked for

    def run(batches):
        import pyarrow as pa

        ed = shared.value
        keys: dict[tuple, list[str]] = {}
        for b in batches:
            ids, pos, rep = [], [], []
            for cid, text, heads in zip(*(b.column(i).to_pylist() for i in range(3))):
                if cid is None or not text or not text.strip():
                    continue
                t = tuple(heads or ())
                if t not in keys:
                    keys[t] = sorted({heading_key(x) for x in t})
                found, out = repairs(ed, text, keys[t])
                if whole:
                    ids.append(cid)
                    rep.append(out)
                    continue
                for p, r in found:
                    ids.append(cid)
                    pos.append(p)
                    rep.append(r)
            if whole:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rep, pa.string())], names=["chunk_id", "text"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pos, pa.int32()), pa.array(rep, pa.string())], names=["chunk_id", "pos", "repaired"])

    return with_heads.mapInArrow(run, schema).dropDuplicates(["chunk_id"] if whole else ["chunk_id", "pos"])


def _label_group() -> F.Column:
    """Groups of the training sample: by script, so that each is represented."""
    return F.when(F.col("page_content").rlike("[\\u0900-\\u097F]"), F.lit("devanagari")).when(F.col("page_content").rlike("[\\u0E00-\\u0E7F]"), F.lit("thai")).when(F.col("page_content").rlike("[\\u4E00-\\u9FFF]"), F.lit("han")).when(F.col("page_content").rlike("[äöüßÄÖÜ]"), F.lit("german")).when(F.col("page_content").rlike("[¿¡ñ]"), F.lit("spanish")).when(F.col("page_content").rlike("[àâçèéêîôû]"), F.lit("french")).otherwise(F.lit("other"))
