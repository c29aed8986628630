"""Evaluation texts inside training texts (problem 9).

*Template canonicalisation*: a word that holds a digit becomes a number placeholder, a unit becomes a unit
placeholder, and a word that is no template word of the items (it occurs in few of them) becomes a name
placeholder.  Windows of ten canonical words are hash-joined with the items' windows.  A window that
meets a template is then checked slot by slot:

* ``leaks``: the slots hold the very words of the item, so ten consecutive words of it are in the document;
* ``reparameterised``: the slots are filled consistently (one name of the item always by one name of
  the document, and back), but with other values.  Only windows of which at least the share ``LITERAL`` are template
  words count here: a window of placeholders alone meets any text.  ``reparameterised_items`` has every item that
  a document holds so, ``reparameterised`` the first item of every template.

Words are longest runs of letters, combining marks and digits in lower case; lower case is taken letter by letter, so
neither the place of a letter in its word nor a second letter it would become hides a word.

The template of an item is the sequence of its canonical words.  Which words are template words is counted over
all items, so blocks share one vocabulary and a template is the same in each.

Items are a stated query set: they are taken in blocks of ``ITEM_BLOCK``, each broadcast as sorted arrays
(at most ITEM_BLOCK x item length windows); all documents are read against each block, whole.

Defined results for odd input: null, blank or too short texts and items give no rows; repeated rows and
several occurrences of an item in a document give one row; an item id with several questions stands for each of them;
documents and items without an id give rows with a null id; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 10
MOST = 0.02  # share of the items from which a word is a template word
LITERAL = 0.4  # share of a window that must be template words before it tells a template
ITEM_BLOCK = 20_000
# Units of measure that count as slots of their own type.
UNITS = frozenset("mm cm m km mg g kg t ml l mol pa kpa hz khz w kw v a n j kj s min h å ω µm μm °c percent prozent kelvin किग्रा ग्राम लीटर मीटर सेमी प्रतिशत 千克 克 米 厘米 毫升".split())
_NUMBER, _UNIT, _NAME, _ELSEWHERE = 1, 2, 3, 4  # the last: a template word that no item of the block holds
_FIRST_WORD = 16  # ids below are placeholders
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SMALL_DIGITS = frozenset("⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉")


def _words():
    """Function from a text to its words in lower case."""
    import regex

    find = regex.compile(r"[\p{L}\p{M}\p{N}]+").findall
    # of all letters only these two do not go to one fixed letter in str.lower
    return lambda text: find(text.replace("İ", "i").replace("Σ", "σ").lower())


def _kind(w: str) -> int:
    """Placeholder of a word that is no template word."""
    return _NUMBER if not w.isalpha() and any(c.isdecimal() or c in _SMALL_DIGITS for c in w) else _UNIT if w in UNITS else _NAME


class Templates:
    """Template vocabulary and window hashes of a block of items, as sorted arrays (they are built once and broadcast).

    *common* are the template words of all items; without it they are those of the block.
    """

    def __init__(self, items: list[tuple[int | None, str]], window: int = WINDOW, most: float = MOST, common: frozenset[str] | None = None, literal: float = LITERAL):
        find = _words()
        self.window = window
        split = [(i, find(q)) for i, q in items if q]
        split = [(i, w) for i, w in split if len(w) >= window]
        df = Counter(w for _, ws in split for w in set(ws))
        if common is None:
            least = max(3, most * len(split))
            common = frozenset(w for w, n in df.items() if n >= least)
        self.kinds: dict[str, int] = {}
        self.exact_ids: dict[str, int] = {}
        for w in sorted(df):
            self.exact_ids[w] = _FIRST_WORD + len(self.exact_ids)
            self.kinds[w] = self.exact_ids[w] if w in common and _kind(w) == _NAME else _kind(w)
        for w in common - df.keys():
            self.kinds[w] = _ELSEWHERE if _kind(w) == _NAME else _kind(w)
        self.ids = [i for i, _ in split]
        self.words = [ws for _, ws in split]
        self.forms: list[bytes] = []
        hashes, owner, place, plain = [], [], [], []
        e_hashes, e_owner = [], []
        for k, ws in enumerate(self.words):
            t, e = self.codes(ws)
            self.forms.append(blake2b(" ".join(w if c >= _FIRST_WORD else f"<{c}>" for c, w in zip(t.tolist(), ws)).encode(), digest_size=16).digest())
            h = windows(t, window)
            own = np.cumsum(np.concatenate([[0], t >= _FIRST_WORD]))
            hashes.append(h)
            owner.append(np.full(len(h), k))
            place.append(np.arange(len(h)))
            plain.append(own[window:] - own[: len(own) - window])
            eh = np.unique(windows(e, window))
            e_hashes.append(eh)
            e_owner.append(np.full(len(eh), k))
        self.template = _Index(hashes, owner, place)
        told = [p >= literal * window for p in plain]  # windows with enough words of their own to tell a template
        self.telling = _Index([h[x] for h, x in zip(hashes, told)], [o[x] for o, x in zip(owner, told)], [p[x] for p, x in zip(place, told)])
        self.exact = _Index(e_hashes, e_owner, [np.zeros(len(o), int) for o in e_owner])

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Template codes and word codes; a word no item has is a number or a name to the first and 0 to the second."""
        kind, ident = self.kinds.get, self.exact_ids.get
        t = [kind(w) or _kind(w) for w in words]
        return np.array(t, dtype=np.uint64), np.array([ident(w, 0) for w in words], dtype=np.uint64)


class _Index:
    """Sorted hashes, each with its (item, place) entries."""

    def __init__(self, hashes: list[np.ndarray], owner: list[np.ndarray], place: list[np.ndarray]):
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.keys, first = np.unique(h[order], return_index=True)
        self.bounds = np.append(first, len(h))
        self.owner = (np.concatenate(owner) if owner else np.empty(0, int))[order]
        self.place = (np.concatenate(place) if place else np.empty(0, int))[order]

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in *h* that are keys, numbers of these keys)."""
        if not len(self.keys):
            return np.empty(0, int), np.empty(0, int)
        k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        at = np.flatnonzero(self.keys[k] == h)
        return at, k[at]

    def entries(self, k: int) -> list[tuple[int, int]]:
        a, b = self.bounds[k], self.bounds[k + 1]
        return list(zip(self.owner[a:b].tolist(), self.place[a:b].tolist()))


def windows(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n codes."""
    if len(codes) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        m = len(codes) - n + 1
        h = np.zeros(m, np.uint64)
        for k in range(n):
            x = (codes[k : k + m] + np.uint64(1)) * _MULT
            h = (h ^ (x ^ (x >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
        return h


def _questions(items: DataFrame) -> DataFrame:
    return items.select("item_id", "question").where("question is not null").dropDuplicates(["item_id", "question"])


def _in_order(rows: list) -> list[tuple[int | None, str]]:
    """By id; items without one come last."""
    return sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def _blocks(items: DataFrame) -> list[list[tuple[int | None, str]]]:
    """The query set in blocks of bounded size."""
    src = _questions(items)
    n = src.count()
    parts = max(1, -(-n // ITEM_BLOCK))
    if parts == 1:
        return [_in_order(src.collect())]
    slot = src.withColumn("_b", F.pmod(F.xxhash64("item_id", "question"), F.lit(parts * 2)))
    return [_in_order(slot.where(F.col("_b") == b).select("item_id", "question").collect()) for b in range(parts * 2)]


def _template_words(items: DataFrame, window: int = WINDOW, most: float = MOST) -> frozenset[str]:
    """Words that stand in at least the share *most* of all items (three at least): no more than the words of 1 / most items."""
    src = _questions(items)

    def run(batches):
        import pyarrow as pa

        find = _words()
        for b in batches:
            df: Counter = Counter()
            for q in b.column(1).to_pylist():
                ws = find(q)
                if len(ws) >= window:
                    df.update({"", *ws})  # "" counts the items
            yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], names=["word", "n"])

    counts = src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = counts.where("word = ''").first()
    least = max(3, most * total["n"]) if total else 3
    return frozenset(r["word"] for r in counts.where((F.col("word") != "") & (F.col("n") >= least)).collect())


def _scan(docs: DataFrame, items: DataFrame, check, common: frozenset[str] | None = None) -> DataFrame:
    """Columns doc_id, item_id, form: what *check* finds, with the item's template."""
    spark = docs.sparkSession
    out = None
    for block in _blocks(items):
        shared = spark.sparkContext.broadcast(Templates(block, common=common))  # bounded by ITEM_BLOCK

        def run(batches, shared=shared):
            import pyarrow as pa

            tpl, find = shared.value, _words()
            for b in batches:
                ids, found, forms = [], [], []
                for did, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if not text:
                        continue
                    for k in check(tpl, find(text)):
                        ids.append(did)
                        found.append(tpl.ids[k])
                        forms.append(tpl.forms[k])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64()), pa.array(forms, pa.binary())], names=["doc_id", "item_id", "form"])

        part = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, form binary")
        out = part if out is None else out.unionByName(part)
    return out


def _runs_of_known(known, words: list[str], n: int) -> bool:
    """Whether n words in a row are in the vocabulary: without that no window can be equal."""
    run = 0
    for w in words:
        run = run + 1 if w in known else 0
        if run >= n:
            return True
    return False


def _same_words(tpl: Templates, words: list[str]) -> set[int]:
    """Numbers of the items of which ten consecutive words are in the text: windows that meet a template and whose slots
    hold the item's words."""
    n = tpl.window
    if len(words) < n or not _runs_of_known(tpl.exact_ids, words, n):
        return set()
    t, e = tpl.codes(words)
    at, _ = tpl.template.hits(windows(t, n))
    same, keys = tpl.exact.hits(windows(e, n)[at])
    found: set[int] = set()
    for p, key in zip(at[same].tolist(), keys.tolist()):
        w = words[p : p + n]
        for k, _ in tpl.exact.entries(key):
            ws = tpl.words[k]
            if k not in found and any(ws[q : q + n] == w for q in range(len(ws) - n + 1)):  # exact check
                found.add(k)
    return found


def _same_template(tpl: Templates, words: list[str]) -> set[int]:
    """Numbers of the items that the text holds with other slot values, filled consistently."""
    n = tpl.window
    if len(words) < n:
        return set()
    at, keys = tpl.telling.hits(windows(tpl.codes(words)[0], n))
    found: set[int] = set()
    for p, key in zip(at.tolist(), keys.tolist()):
        w = words[p : p + n]
        for k, q in tpl.telling.entries(key):
            if k in found:
                continue
            there: dict[str, str] = {}
            back: dict[str, str] = {}
            for a, b in zip(tpl.words[k][q : q + n], w):
                if there.setdefault(a, b) != b or back.setdefault(b, a) != a:
                    break
            else:
                if tpl.words[k][q : q + n] != w:
                    found.add(k)
    return found


def _first_items(tpl: Templates, words: list[str]) -> list[int]:
    """The first item of every template the text holds with other slot values."""
    first: dict[bytes, int] = {}
    for k in sorted(_same_template(tpl, words)):
        first.setdefault(tpl.forms[k], k)
    return list(first.values())


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Columns doc_id, item_id: documents with a run of ten consecutive words of an item."""
    return _scan(docs, items, _same_words).select("doc_id", "item_id").dropDuplicates(["doc_id", "item_id"])


def reparameterised_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Columns doc_id, item_id: every item that a document holds with other slot values, also where it holds several of
    one template."""
    return _scan(docs, items, _same_template, _template_words(items)).select("doc_id", "item_id").dropDuplicates(["doc_id", "item_id"])


def reparameterised(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Columns doc_id, item_id: one row for each document and template that it holds with other slot values;
    the item named is the first of the template's items in id order that it holds so."""
    found = _scan(docs, items, _first_items, _template_words(items))
    return found.groupBy("doc_id", "form").agg(F.min("item_id").alias("item_id")).select("doc_id", "item_id")
