"""Tokenizers, sentence split, fuzzy ratio and other text functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of two or more letters, marks, digits or underscores.
WORD = r"[\p{L}\p{M}\p{N}_]{2,}"
ALNUM = r"[\p{L}\p{M}\p{N}]+"

# Common English words that carry no topic.
ENGLISH_STOP_WORDS = frozenset(
    """a about above after again against all am an and any are as at be because been before being below between both
    but by can could did do does doing down during each few for from further had has have having he her here hers herself him
    himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other
    our ours ourselves out over own same she should so some such than that the their theirs them themselves then there
    these they this those through to too under until up very was we were what when where which while who whom why will with
    would you your yours yourself yourselves""".split()
)
# Common Hindi words that carry no topic (the default; a file of words may replace it).
HINDI_STOP_WORDS = frozenset(
    """का की के को में से है हैं था थी थे और या पर यह वह ये वे इस उस इन उन एक ने तो ही भी कि जो तक लिए साथ बाद पहले हो होता होती
    होते कर करता करती करते किया गया गई गए रहा रही रहे कुछ सब अपने अपनी अपना जब तब यदि क्या कैसे कहाँ जहाँ नहीं न मत""".split()
)


def normalized(c: Column) -> Column:
    """Trimmed lower case; null stays null."""
    return F.lower(F.trim(c))


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def whitespace_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda x: x != "")


def count_tokens(c: Column) -> Column:
    """Tokens of the offline tokenizer: runs of non-space."""
    return F.when(F.trim(c) == "", 0).otherwise(F.size(F.split(F.trim(c), r"\s+")))


def simple_sentences(c: Column) -> Column:
    """Sentences cut behind a terminator that white space follows."""
    marked = F.regexp_replace(c, r"([.!?।])\s+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: F.trim(s) != "")


def heading_level(c: Column) -> Column:
    """Number of leading hash marks."""
    return F.length(F.regexp_extract(c, "^#+", 0))


def heading_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "^#+", ""))


def heading_markup(level: Column, c: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), level), F.lit(" "), c)


# --- stemming: the algorithm published in 1980, as rules on the measure of a stem -------------------------

_V = "aeiou"


def _cons(w: str, i: int) -> bool:
    c = w[i]
    return c not in _V and not (c == "y" and i > 0 and _cons(w, i - 1))


def _shape(stem: str) -> str:
    return re.sub(r"(.)\1+", r"\1", "".join("c" if _cons(stem, i) else "v" for i in range(len(stem))))


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return any(not _cons(stem, i) for i in range(len(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    return len(w) > 2 and _cons(w, len(w) - 3) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 1) and w[-1] not in "wxy"


# Suffixes of steps 2, 3 and 4 and what takes their place.
_STEP2 = dict(zip("ational tional enci anci izer abli alli entli eli ousli ization ation ator alism iveness fulness ousness aliti iviti biliti".split(), "ate tion ence ance ize able al ent e ous ize ate ate al ive ful ous al ive ble".split()))
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _longest(w: str, suffixes) -> str:
    return max((s for s in suffixes if w.endswith(s)), key=len, default="")


@lru_cache(maxsize=50_000)
def stem(w: str) -> str:
    """Porter stem of an English word in lower case."""
    if len(w) < 3 or not w.isascii():
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and _has_vowel(w[: -len(s)])), "")
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        s = _longest(w, table)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = _longest(w, _STEP4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w


_ENGLISH = re.compile(r"[^\W_]+")


def english_tokens(text: str, stop_words: frozenset[str] = ENGLISH_STOP_WORDS) -> list[str]:
    return [stem(w) for w in _ENGLISH.findall(text.lower()) if w not in stop_words]


_HINDI = re.compile(r"[ऀ-ॣ०-ॿ]+|[A-Za-z0-9]+")


def hindi_tokens(text: str, stop_words: frozenset[str] = HINDI_STOP_WORDS) -> list[str]:
    """Normalized (composed form, nukta apart from its letter, no joiners) words without stop words; duplicates stay."""
    t = unicodedata.normalize("NFC", text).replace("‌", "").replace("‍", "")
    return [w for w in _HINDI.findall(t) if w not in stop_words]


def language_tokens(text: str | None, language: str | None, hindi_stop: frozenset[str] = HINDI_STOP_WORDS) -> list[str]:
    """Tokens for sparse search, by language; other languages are parted at white space."""
    if not text:
        return []
    name = (language or "").strip().lower()
    if name in ("english", "en"):
        return english_tokens(text)
    if name in ("hindi", "hi", "हिन्दी"):
        return hindi_tokens(text, hindi_stop)
    return text.lower().split()


def language_tokens_udf(hindi_stop: frozenset[str] = HINDI_STOP_WORDS):
    """Vectorized (text, language) -> tokens."""

    @F.pandas_udf("array<string>")
    def tokens(text: pd.Series, language: pd.Series) -> pd.Series:
        return pd.Series([language_tokens(t, n, hindi_stop) for t, n in zip(text, language)])

    return tokens


# --- fuzzy ratio ------------------------------------------------------------------------------------------


def _indel_ratio(a: str, b: str) -> float:
    """100 x twice the longest common subsequence over both lengths, by bit vectors."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & where.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    common = len(a) - s.bit_count()
    return 200.0 * common / (len(a) + len(b))


def partial_ratio(a: str | None, b: str | None) -> float:
    """Best ratio of the shorter text with any window of its length, or any shorter window at either end, of the longer."""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    if a in b:
        return 100.0
    n, chars, best = len(a), set(a), 0.0
    for i in range(1 - n, len(b)):
        lo, hi = max(0, i), min(len(b), i + n)
        if b[hi - 1] in chars or b[lo] in chars:
            best = max(best, _indel_ratio(a, b[lo:hi]))
    return best


def partial_ratio_udf(a: Column, b: Column) -> Column:
    """partial_ratio of two columns, in Arrow batches."""

    @F.pandas_udf("double")
    def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([partial_ratio(p, q) for p, q in zip(x, y)])

    return ratio(a, b)


def first_match_udf(least: float):
    """(text, titles) -> place, from 1, of the first title whose partial ratio with the text reaches *least*; 0 if none does."""

    @F.pandas_udf("int")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in batches:
            out = []
            for t, titles in zip(texts, lists):
                have = [] if titles is None else titles
                out.append(next((i for i, x in enumerate(have, 1) if partial_ratio(t, x) >= least), 0))
            yield pd.Series(out, dtype="int32")

    return place
