"""Subject areas of documents (problem 10).

Every sentence gets votes of labelling functions:

* several words: the area that most lexicon words of the sentence belong to, if they are several and agree,
* single words: the same, if it is one word or the words disagree,
* compound lexicon: pairs of neighbouring words that belong to an area,
* section: what the lexicon says of the other sentences of the paragraph,
* source: the area that most sentences of the document's source have,
* address: the area that most sentences of the document's collection have.

The lexicons are learned from a bounded sample of labelled documents: the labels of a document are spread
over its sentences, which are then assigned anew by the words found (expectation maximisation).  A *latent
model* with a class for each area and one for none learns from the votes alone, without the labels, how often a
function speaks on sentences of an area and of none, and how often it is right.  Its posterior gives the probability
of each area for each sentence, and a document has the areas that at least a quarter of its sentences treat by them.

Defined results for odd input: null and blank texts give no rows; repeated rows of one id count once; ties
between votes go to the first area by name; an empty table or one without
labels gives an empty result; labels that are no area of ``subject_areas`` are ignored; extra columns too.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import bounded_sample
from .sentences import split_sentences

PER_AREA = 512
SHARE = 0.25
_EDGE = ".,;:!?\"'()[]«»“”„।|।。，、！？：；「」（）…¿¡•*-"
NONE = -1
SILENT = -2
FUNCTIONS = ("several words", "single words", "compound", "section", "source", "address")


def words_of(sentence: str) -> list[str]:
    """Words in lower case without marks; runs of ideographs give their pairs of neighbours."""
    out: list[str] = []
    for w in sentence.lower().split():
        w = w.strip(_EDGE)
        if not w:
            continue
        if "一" <= w[0] <= "鿿" or "一" <= w[-1] <= "鿿":
            out += [w[i : i + 2] for i in range(len(w) - 1)] or [w]
        elif not w[0].isdigit():
            out.append(w)
    return out


def _pairs(words: list[str]) -> list[str]:
    return [a + " " + b for a, b in zip(words, words[1:])]


def _wilson(k: np.ndarray, n: np.ndarray, z: float = 1.96) -> np.ndarray:
    p = k / n
    return (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


class Subjects:
    """Lexicons and the latent model of the labelling functions."""

    def __init__(self, areas: list[str]):
        self.areas = areas
        self.lexicon: dict[str, tuple[int, float]] = {}
        self.compounds: dict[str, tuple[int, float]] = {}
        self.source: dict[str, int] = {}
        self.address: dict[str, int] = {}
        n, k = len(FUNCTIONS), len(areas)
        self.speaks = np.full(n, 0.5)  # how often a function votes on a sentence of an area,
        self.strays = np.full(n, 0.5)  # and on one of none
        self.right = np.full(n, 0.5)  # how often its vote on a sentence of an area is right
        self.prior = np.full(k + 1, 1 / (k + 1))  # the last class: no area

    def vote(self, words: list[str]) -> tuple[int, int, bool]:
        """(lexicon, compound) votes, NONE and SILENT without one, and whether several words carry the first."""
        s: dict[int, float] = {}
        n: dict[int, int] = {}
        get = self.lexicon.get
        for w in words:
            if v := get(w):
                s[v[0]] = s.get(v[0], 0.0) + v[1]
                n[v[0]] = n.get(v[0], 0) + 1
        if not s:
            return NONE, SILENT, False
        t: dict[int, float] = {}
        get = self.compounds.get
        prev = ""
        for w in words:
            if v := get(prev + " " + w):
                t[v[0]] = t.get(v[0], 0.0) + v[1]
            prev = w
        first = min(s, key=lambda a: (-s[a], a))
        rest = max((x for a, x in s.items() if a != first), default=0.0)
        return first, (min(t, key=lambda a: (-t[a], a)) if t else SILENT), n[first] > 1 and s[first] >= 2 * rest

    def votes(self, text: str, source: str | None, address: str | None, spans: list[tuple[int, int]] | None = None) -> list[tuple[int, ...]]:
        """Votes of all functions on each sentence."""
        spans = split_sentences(text) if spans is None else spans
        lex = [self.vote(words_of(text[a:b])) for a, b in spans]
        by_src, by_addr = self.source.get(source or "", SILENT), self.address.get(address or "", SILENT)
        out: list[tuple[int, ...]] = []
        i = 0
        while i < len(spans):
            j = i + 1
            while j < len(spans) and "\n" not in text[spans[j - 1][1] : spans[j][0]]:
                j += 1
            seen = Counter(v for v, _, _ in lex[i:j] if v >= 0)
            for own, compound, several in lex[i:j]:
                rest = [(n - (a == own), -a) for a, n in seen.items()]
                top = max(rest, default=(0, 0))
                one, many = (SILENT, own) if several else (own if own >= 0 else SILENT, SILENT)
                out.append((many, one, compound, -top[1] if top[0] > 0 else SILENT, by_src, by_addr))
            i = j
        return out

    def posteriors(self, votes: np.ndarray) -> np.ndarray:
        """(sentence, class) probabilities; *votes* has a row a sentence and a column a function."""
        k = len(self.areas)
        s = np.tile(np.log(self.prior), (len(votes), 1))
        for f in range(votes.shape[1]):
            v = votes[:, f]
            silent = v < 0
            s[silent, :k] += math.log(1 - self.speaks[f])
            s[silent, k] += math.log(1 - self.strays[f])
            i = np.flatnonzero(~silent)
            s[i, :k] += math.log(self.speaks[f] * (1 - self.right[f]) / max(1, k - 1))
            s[i, v[i]] += math.log(self.right[f]) - math.log((1 - self.right[f]) / max(1, k - 1))
            s[i, k] += math.log(self.strays[f] / k)
        s -= s.max(axis=1, keepdims=True)
        p = np.exp(s)
        return p / p.sum(axis=1, keepdims=True)

    def document_areas(self, text: str, source: str | None, address: str | None, cache: dict) -> list[str]:
        """Areas that at least the share SHARE of the sentences treat with a chance of one half (the expected number of
        these sentences reaches the least whole number that will do, less one half)."""
        votes = self.votes(text, source, address)
        if not votes:
            return []
        new = list({v for v in votes if v not in cache})
        if new:
            if len(cache) > 200_000:
                cache.clear()
                new = list(set(votes))
            cache.update(zip(new, self.posteriors(np.array(new))))
        expected = np.sum([cache[v] for v in votes], axis=0)
        least = math.ceil(SHARE * len(votes) - 1e-9)
        return [self.areas[a] for a in np.flatnonzero(expected[: len(self.areas)] >= least - 0.5).tolist()]


class _Terms:
    """Terms of all sentences as numbers: occurrences, and distinct terms of each sentence."""

    def __init__(self, sentences: list[list[str]]):
        number: dict[str, int] = {}
        self.term = np.array([number.setdefault(t, len(number)) for ts in sentences for t in ts], dtype=np.int64)
        self.sentence = np.repeat(np.arange(len(sentences)), [len(ts) for ts in sentences])
        self.names = list(number)
        once = np.unique(self.sentence * max(1, len(number)) + self.term) if len(number) else np.empty(0, np.int64)
        self.once_sentence, self.once_term = once // max(1, len(number)), once % max(1, len(number))

    def learned(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(area or -1, weight) of each term, from the (sentence, area) weights."""
        c = np.stack([np.bincount(self.once_term, weights=weights[self.once_sentence, a], minlength=len(self.names)) for a in range(weights.shape[1])], axis=1)
        n, top = c.sum(axis=1), c.max(axis=1)
        p = top / np.maximum(n, 1e-9)
        # not scaled by the size of areas: in a language with few labelled documents that would make
        # general words belong to an area known there by a wrong label only
        sure = (n >= 4) & (p >= 0.7) & (_wilson(top, np.maximum(n, 1e-9)) >= 0.5)
        return np.where(sure, c.argmax(axis=1), -1), np.log(p / np.maximum(1e-3, 1 - p) + 1)

    def scores(self, area: np.ndarray, weight: np.ndarray, sentences: int, k: int) -> np.ndarray:
        """(sentence, area) sums of the weights of the terms found."""
        i = np.flatnonzero(area[self.term] >= 0)
        t = self.term[i]
        return np.bincount(self.sentence[i] * k + area[t], weights=weight[t], minlength=sentences * k).reshape(sentences, k)


def _learn(model: Subjects, docs: list[tuple[list[list[str]], list[int]]], rounds: int = 4) -> list[list[int]]:
    """Fills the lexicons; returns the area of each sentence of the sample."""
    k = len(model.areas)
    flat = [ws for sents, _ in docs for ws in sents]
    words, pairs = _Terms(flat), _Terms([_pairs(ws) for ws in flat])
    size = np.array([len(sents) for sents, _ in docs])
    doc = np.repeat(np.arange(len(docs)), size)
    has = np.zeros((len(docs), k), bool)
    for d, (_, labels) in enumerate(docs):
        has[d, labels] = True
    given = np.full(len(flat), SILENT)
    tables: list[tuple[_Terms, np.ndarray, np.ndarray]] = []
    for r in range(rounds):
        met = np.zeros((len(docs), k))
        np.add.at(met, (doc[given >= 0], given[given >= 0]), 1)
        # labels that no area words account for yet: only for them can the other sentences stand
        rest = has & (met < 0.8 * SHARE * size[:, None])
        w = np.where((given == SILENT)[:, None], has[doc], np.where((given == NONE)[:, None], rest[doc], np.arange(k) == given[:, None])).astype(float)
        w /= np.maximum(1, w.sum(axis=1, keepdims=True))
        tables = [(t, *t.learned(w)) for t in (words, pairs)]
        s, u = (t.scores(area, weight, len(flat), k) for t, area, weight in tables)
        some = s.max(axis=1) > 0
        first, compound = s.argmax(axis=1), np.where(some & (u.max(axis=1) > 0), u.argmax(axis=1), 0)
        by_pair = some & (u.max(axis=1) > 0) & has[doc, compound]
        only = has[doc].sum(axis=1) == 1
        given = np.where(by_pair, compound, np.where(only, has[doc].argmax(axis=1), first))
        given = np.where(some & (has[doc, first] | (r == rounds - 1)), first, given)
        given = np.where(some, given, NONE)
    for (terms, area, weight), table in zip(tables, (model.lexicon, model.compounds)):
        table.update({terms.names[i]: (int(area[i]), float(weight[i])) for i in np.flatnonzero(area >= 0).tolist()})
    return [part.tolist() for part in np.split(given, np.cumsum(size)[:-1])]


def _latent(model: Subjects, votes: np.ndarray, rounds: int = 25) -> None:
    """Learns, from the votes alone, how often each function speaks, strays and is right, and the share of each class
    (expectation maximisation from the votes of the words)."""
    k, n = len(model.areas), len(votes)
    if not n:
        return
    votes, times = np.unique(votes, axis=0, return_counts=True)
    model.speaks = np.array([0.6, 0.3, 0.5, 0.8, 0.8, 0.8])
    model.strays = np.array([0.02, 0.1, 0.02, 0.8, 0.8, 0.8])
    model.right = np.array([0.97, 0.8, 0.95, 0.6, 0.4, 0.3])
    for _ in range(rounds):
        post = model.posteriors(votes) * times[:, None]
        area = post[:, :k].sum(axis=1)
        model.prior = (post.sum(axis=0) + 1) / (n + k + 1)
        for f in range(votes.shape[1]):
            i = np.flatnonzero(votes[:, f] >= 0)
            right = post[i, votes[i, f]].sum()
            model.speaks[f] = np.clip((area[i].sum() + 1) / (area.sum() + 2), 0.001, 0.999)
            model.strays[f] = np.clip((post[i, k].sum() + 1) / (post[:, k].sum() + 2), 0.001, 0.999)
            model.right[f] = np.clip((right + 1) / (area[i].sum() + k), 0.5 / k, 0.995)


def fit(areas: list[str], rows: list[tuple[str, str | None, str | None, list[str]]]) -> Subjects:
    """A model from (text, source, collection, labels) rows."""
    model = Subjects(areas)
    docs, kept = [], []
    for text, source, address, labels in rows:
        ids = sorted({areas.index(x) for x in labels if x in areas})
        spans = split_sentences(text or "")
        if ids and spans:
            docs.append(([words_of(text[a:b]) for a, b in spans], ids))
            kept.append((text, source, address, spans))
    if not docs:
        return model
    assigned = _learn(model, docs)
    for table, part in ((model.source, 1), (model.address, 2)):
        by: dict[str, Counter] = defaultdict(Counter)
        for row, given in zip(kept, assigned):
            by[row[part] or ""].update(a for a in given if a >= 0)
        table.update({s: min(c, key=lambda a: (-c[a], a)) for s, c in by.items() if c})
    _latent(model, np.array([v for t, s, a, spans in kept for v in model.votes(t, s, a, spans)]))
    return model


def document_subjects(docs: DataFrame, areas: DataFrame, labels: DataFrame, per_area: int = PER_AREA) -> DataFrame:
    """Columns doc_id, subject_area: the areas that at least a quarter of a document's sentences treat."""
    spark = docs.sparkSession
    names = sorted({r[0] for r in areas.select("subject_area").collect() if r[0]})  # a fixed table of areas
    known = labels.where(F.col("subject_area").isin(names)).select("doc_id", "subject_area")
    sample = bounded_sample(known, "doc_id", "subject_area", ["doc_id"], per_area)
    ids = sorted({r["doc_id"] for r in sample})
    if not ids:
        return spark.createDataFrame([], "doc_id long, subject_area string")
    chosen = F.broadcast(spark.createDataFrame([(i,) for i in ids], "doc_id long"))  # at most per_area x areas ids
    of: dict[int, list[str]] = defaultdict(list)
    for r in known.join(chosen, "doc_id", "left_semi").distinct().collect():
        of[r[0]].append(r[1])
    rows = docs.select("doc_id", "text", "source", "collection").join(chosen, "doc_id", "left_semi").where("text is not null").dropDuplicates(["doc_id"]).collect()
    model = fit(names, [(r["text"], r["source"], r["collection"], of[r["doc_id"]]) for r in sorted(rows, key=lambda r: r["doc_id"])])
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches):
        import pyarrow as pa

        m, cache = shared.value, {}
        for b in batches:
            out_ids, out = [], []
            for did, text, source, address in zip(*(b.column(i).to_pylist() for i in range(4))):
                if did is None or not text:
                    continue
                for a in m.document_areas(text, source, address, cache):
                    out_ids.append(did)
                    out.append(a)
            yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "subject_area"])

    return docs.select("doc_id", "text", "source", "collection").mapInArrow(run, "doc_id long, subject_area string").dropDuplicates(["doc_id", "subject_area"])
