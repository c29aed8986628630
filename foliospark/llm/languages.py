"""Languages of texts and of their segments (problem 3).

One *interpolated Kneser-Ney character model* of order 4 per language is fitted on a bounded sample of
labelled texts.  N-grams of all languages share *sorted hash arrays*, one for each order, with a row of log
probabilities (a column a language); a text is scored by binary search of its hashed windows.  The lowest
length-normalised cross-entropy wins; a sentence whose margin is small, or whose entropy is above what held-out
sentences of that language show, is rejected and takes the language of its neighbours.  Labels of the sample are
partly wrong, so the models are fitted twice: the second time on the sentences that the first models confirm.  The
first models do without a fifth of the sentences, which calibrate the rejection and the confidence: a confidence
is how often sentences and pieces of them with that lead were named rightly.

Defined results for odd input: null and blank texts give no rows; texts without a letter, and texts of which
all sentences are rejected by their entropy (languages without labels, noise), give none; repeated rows of one id count once; an empty table, or one without
a usable label, gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookalikes import plain
from .sentences import content_offset, split_sentences

ORDER = 4
PER_LABEL = 512
BLOCK = 120_000
SWITCH = 7.0
LEAST_MARGIN = 0.08
HELD_OUT = 5
# Labels that stand for none.
PLACEHOLDERS = ("", "-", "--", "n/a", "na", "none", "null", "und", "unknown", "unk", "?", "other", "mul", "zxx", "xx")
_WRAP = re.compile(r"(?<=[^\n.!?।|。！？\"”»)])\n(?=[^\n\-*•\d(])|(?<=[^\n])\n(?=[a-zß-ÿ][^A-Z])")
_M = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Code of each character below U+10000 after folding: lower case, plain look, digits as 0, space as blank."""
    table = np.arange(65536, dtype=np.uint32)
    for c in range(65536):
        if 0xD800 <= c < 0xE000:
            table[c] = 1
            continue
        ch = chr(c)
        if ch.isspace():
            table[c] = 32
        elif ch.isdigit():
            table[c] = 48
        elif c < 128:
            table[c] = ord(ch.lower())
        elif 0x0530 < c < 0x2000 or 0x3100 < c < 0xF900:
            table[c] = ord(low) if len(low := ch.lower()) == 1 else c
        else:
            p = plain(ch).lower()
            table[c] = ord(p) if len(p) == 1 else 32 if not p else ord(p[0])
    return table


def folded(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _folded()[np.minimum(c, 65535)]


def hashed(codes: np.ndarray) -> list[np.ndarray]:
    """Hashes of the windows that *end* at each character, for orders 1 to ORDER (blanks stand before the text)."""
    with np.errstate(over="ignore"):
        c = np.concatenate([np.full(ORDER - 1, 32, np.uint32), codes]).astype(np.uint64) + np.uint64(1)
        n = len(codes)
        out = []
        for k in range(1, ORDER + 1):
            h = np.zeros(n, np.uint64)
            for j in range(k):
                a = ORDER - k + j
                h = (h + c[a : a + n]) * _M
                h ^= h >> np.uint64(29)
            out.append(h)
        return out


def _lookup(sorted_keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash in the array, or -1."""
    if not len(sorted_keys):
        return np.full(len(h), -1)
    k = np.searchsorted(sorted_keys, h)
    k[k == len(sorted_keys)] = 0
    return np.where(sorted_keys[k] == h, k, -1)


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, blanks between them, and the places of their characters."""
    gap = np.full(ORDER, 32, np.uint32)
    parts, places, at = [], [], 0
    for t in texts:
        parts += [gap, t]
        places.append(np.arange(at + ORDER, at + ORDER + len(t)))
        at += ORDER + len(t)
    return np.concatenate(parts), np.concatenate(places)


class _OneLanguage:
    """Kneser-Ney estimates of one language, by hash."""

    def __init__(self, texts: list[np.ndarray]):
        self.keys: list[np.ndarray] = [np.empty(0, np.uint64)] * ORDER
        self.suffix: list[np.ndarray] = [np.empty(0, np.uint64)] * ORDER
        self.ctx: list[np.ndarray] = [np.empty(0, np.uint64)] * ORDER
        self.p: list[np.ndarray] = [np.empty(0)] * ORDER
        self.ctx_keys: list[np.ndarray] = [np.empty(0, np.uint64)] * ORDER
        self.back: list[np.ndarray] = [np.empty(0)] * ORDER
        counts: list[np.ndarray] = [np.empty(0)] * ORDER
        self.floor = 1e-7
        if not texts:
            return
        codes, inside = joined(texts)
        hs = hashed(codes)
        cat = [h[inside] for h in hs]
        # the window before a character is one shorter and ends one character earlier
        ctx = [np.empty(0, np.uint64)] + [hs[k - 1][inside - 1] for k in range(1, ORDER)]
        for k in range(ORDER):
            u, first, n = np.unique(cat[k], return_index=True, return_counts=True)
            self.keys[k], counts[k] = u, n.astype(float)
            if k:
                self.suffix[k], self.ctx[k] = cat[k - 1][first], ctx[k][first]
        for k in range(ORDER - 1):  # continuation counts: distinct longer windows that end in this one
            at = _lookup(self.keys[k], self.suffix[k + 1])
            counts[k] = np.maximum(np.bincount(at[at >= 0], minlength=len(self.keys[k])).astype(float), 1.0)
        for k in range(ORDER):
            n1, n2 = (counts[k] == 1).sum(), (counts[k] == 2).sum()
            d = min(0.95, max(0.3, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.75
            if k == 0:
                total = counts[0].sum()
                self.floor = d * len(counts[0]) / total / 65536
                self.p[0] = np.maximum(counts[0] - d, 0) / total + self.floor
                continue
            self.ctx_keys[k], inv = np.unique(self.ctx[k], return_inverse=True)
            total = np.bincount(inv, weights=counts[k])
            kinds = np.bincount(inv)
            self.back[k] = d * kinds / total
            self.p[k] = np.maximum(counts[k] - d, 0) / total[inv] + self.back[k][inv] * self.prob(k - 1, self.suffix[k])

    def prob(self, k: int, h: np.ndarray) -> np.ndarray:
        at = _lookup(self.keys[k], h)
        return np.where(at >= 0, self.p[k][at] if len(self.p[k]) else 0.0, self.floor)


def evidence(scores: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Lead of the best score of each row over the second, by the root of the length (characters depend on each other)."""
    if scores.shape[1] < 2:
        return np.full(len(scores), 1e3)
    two = np.partition(scores, -2, axis=1)[:, -2:]
    return (two[:, 1] - two[:, 0]) / np.sqrt(np.maximum(1.0, chars))


class Models:
    """Shared sorted hash arrays of all languages."""

    def __init__(self, samples: dict[str, list[np.ndarray]]):
        self.names = sorted(samples)
        ones = [_OneLanguage(samples[n]) for n in self.names]
        self.keys, self.rows, self.ctx_keys, self.backs = [], [], [], []
        self.floor = np.log(np.array([o.floor for o in ones], np.float64)).astype(np.float32)
        for k in range(ORDER):
            keys = np.unique(np.concatenate([o.keys[k] for o in ones])) if ones else np.empty(0, np.uint64)
            suffix, ctx = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
            for o in ones:
                at = _lookup(keys, o.keys[k])
                if k:
                    suffix[at], ctx[at] = o.suffix[k], o.ctx[k]
            ctx_keys = np.unique(ctx) if k else np.empty(0, np.uint64)
            backs = np.zeros((len(ctx_keys), len(ones)), np.float32)
            rows = np.empty((len(keys), len(ones)), np.float32)
            lower = _lookup(self.keys[k - 1], suffix) if k else None
            for j, o in enumerate(ones):
                if k:
                    at = _lookup(o.ctx_keys[k], ctx_keys)
                    backs[:, j] = np.where(at >= 0, np.log(o.back[k][at]) if len(o.back[k]) else 0.0, 0.0)
                seen = _lookup(o.keys[k], keys)
                if k:
                    below = np.where(lower >= 0, self.rows[k - 1][lower, j], self.floor[j]) + backs[_lookup(ctx_keys, ctx), j]
                else:
                    below = np.full(len(keys), self.floor[j], np.float32)
                rows[:, j] = np.where(seen >= 0, np.log(o.p[k][seen]) if len(o.p[k]) else 0.0, below)
            self.keys.append(keys)
            self.rows.append(rows)
            self.ctx_keys.append(ctx_keys)
            self.backs.append(backs)
        self.typical: dict[str, tuple[float, int]] = {}  # highest entropy of own sentences, and of how many
        self.steps, self.rates = np.array([0.0]), np.array([0.5])  # confidence by evidence

    def calibrate(self, first: Models, held: list[tuple[str, np.ndarray]]) -> None:
        """Confidence by evidence: how often *first*, which has not seen the held-out sentences, names their language, by
        the lead of the best score over the second.  Short pieces of them are counted too, as long ones say little
        about doubt."""
        leads, right = [], []
        for n in (8, 16, 32, 10_000):
            texts = [(name, c[:n]) for name, c in held if len(c) >= min(n, 32)]
            if not texts:
                continue
            codes, _ = joined([c for _, c in texts])
            length = np.array([len(c) for _, c in texts])
            at = np.cumsum(length + ORDER) - length
            s = first.sentence_scores(codes, np.stack([at, at + length], axis=1))
            leads.append(evidence(s, length))
            right.append(np.array([self.names[k] == name for k, (name, _) in zip(s.argmax(axis=1), texts)]))
        if not leads:
            return
        lead, hit = np.concatenate(leads), np.concatenate(right)
        order = np.argsort(lead, kind="stable")
        parts = [p for p in np.array_split(order, max(1, min(64, len(order) // 50))) if len(p)]
        self.steps = np.array([lead[p].mean() for p in parts])
        self.rates = np.maximum.accumulate(np.array([(hit[p].sum() + 1) / (len(p) + 2) for p in parts]))

    def score(self, codes: np.ndarray) -> np.ndarray:
        """(character, language) log probabilities."""
        hs = hashed(codes)
        n = len(codes)
        out = np.tile(self.floor, (n, 1))
        todo = np.arange(n)
        extra = None
        for k in range(ORDER - 1, -1, -1):
            at = _lookup(self.keys[k], hs[k][todo])
            hit = at >= 0
            got = self.rows[k][at[hit]]
            out[todo[hit]] = got if extra is None else got + extra[hit]
            miss = ~hit
            todo = todo[miss]
            if not len(todo):
                break
            if k:  # the windows before end one character earlier
                c = np.where(todo > 0, hs[k - 1][todo - 1], np.uint64(0))
                b = _lookup(self.ctx_keys[k], c)
                w = np.where((b >= 0)[:, None], self.backs[k][b], np.float32(0)) if len(self.backs[k]) else 0
                extra = w if extra is None else extra[miss] + w
        return out

    def sentence_scores(self, codes: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """(sentence, language) sums; *spans* are sorted, disjoint (start, end) rows of *codes*."""
        out = np.empty((len(spans), len(self.names)), np.float64)
        i = 0
        while i < len(spans):
            base = spans[i, 0]
            j = max(i + 1, int(np.searchsorted(spans[:, 1], base + BLOCK)))
            s = self.score(codes[base : spans[j - 1, 1]])
            cuts = (spans[i:j] - base).ravel()
            padded = np.concatenate([s, np.zeros((1, s.shape[1]), np.float32)])
            out[i:j] = np.add.reduceat(padded, cuts, axis=0, dtype=np.float64)[::2]
            i = j
        return out


def _letters(text: str) -> int:
    return sum(map(str.isalpha, text))


def sentences_of(body: str) -> list[tuple[int, int]]:
    """Sentences; single line ends within a sentence (scanned or wrapped text) do not part it."""
    return split_sentences(_WRAP.sub(" ", body))


def fit(rows: list[tuple[str, str, str | None]]) -> Models | None:
    """Models from (language, text, source) rows; fitted twice, see the module."""
    sents: list[tuple[str, np.ndarray]] = []
    for name, text, source in rows:
        body = text[content_offset(text, source) :]
        sents += [(name, folded(body[s:e])) for s, e in sentences_of(body) if e - s > (15 if body[s:e].isascii() else 7)]
    names = sorted({n for n, _ in sents})
    if not names:
        return None
    codes, _ = joined([c for _, c in sents])
    lengths = np.array([len(c) for _, c in sents])
    starts = np.cumsum(lengths + ORDER) - lengths
    spans = np.stack([starts, starts + lengths], axis=1)
    label = np.array([names.index(n) for n, _ in sents])
    # first by frequencies of whole windows: a stray sentence under a wrong label is rare there, whereas a
    # conditional model would learn it as well as the rest
    h = hashed(codes)[-1]
    where = np.repeat(np.arange(len(sents)), lengths)
    inside = np.concatenate([np.arange(a, b) for a, b in spans])
    keys, inv = np.unique(h[inside], return_inverse=True)
    seen = np.zeros((len(keys), len(names)))
    np.add.at(seen, (inv, label[where]), 1.0)
    freq = np.log((seen + 0.01) / (seen.sum(axis=0) + 1.0)).astype(np.float32)
    best = np.empty(len(sents), int)
    ends = np.cumsum(lengths)
    for k in range(0, len(sents), 2000):
        a, b = ends[k] - lengths[k], ends[min(k + 2000, len(sents)) - 1]
        best[k : k + 2000] = np.add.reduceat(freq[inv[a:b]], (ends[k : k + 2000] - lengths[k : k + 2000] - a), axis=0).argmax(axis=1)
    kept = best == label
    held = np.arange(len(sents)) % HELD_OUT == 0  # the first models do without these, which calibrate them
    models, first = None, None
    for fitted in (kept & ~held, None):
        use = kept if fitted is None else fitted
        chosen = {n: [sents[i][1] for i in np.flatnonzero(use & (label == j))] for j, n in enumerate(names)}
        models = Models({n: v or [sents[i][1] for i in np.flatnonzero(label == j)] for j, (n, v) in enumerate(chosen.items())})
        if first is None:
            first = models
            rate = models.sentence_scores(codes, spans) / lengths[:, None]
            kept &= rate.argmax(axis=1) == label
            e = -rate[np.arange(len(sents)), label]
            for j, n in enumerate(names):  # how high the entropy of a language's own held-out sentences goes
                own = e[held & kept & (label == j)]
                models.typical[n] = (float(np.quantile(own, 0.999) + max(3 * own.std(), 0.5)), len(own)) if len(own) else (math.inf, 0)
    models.typical = first.typical
    models.calibrate(first, [sents[i] for i in np.flatnonzero(held & (best == label))])
    return models


class Segmenter:
    """Language of a chunk and of its segments from sentence scores."""

    def __init__(self, models: Models):
        self.m = models
        self.high = np.array([models.typical[n][0] for n in models.names])

    def segments(self, text: str, spans: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, str, float]]:
        """(first sentence, language, confidence) of each run; empty if all is rejected."""
        length = np.array([e - s for s, e in spans], float)
        rate = scores / length[:, None]  # per character
        best = rate.argmax(axis=1)
        top = rate[np.arange(len(spans)), best]
        second = np.partition(rate, -2, axis=1)[:, -2] if rate.shape[1] > 1 else top - 1
        unknown = -top > self.high[best]
        rejected = unknown | (top - second < LEAST_MARGIN)
        if _letters(text) == 0 or unknown.all():
            return []
        if len(set(best[~rejected].tolist())) > 1:  # figures are no evidence for a change of language
            words = [text[a:b] for a, b in spans]
            rejected |= np.array([2 * _letters(w) < len(w) - w.count(" ") for w in words])
            scores = np.where(rejected[:, None], 0.05 * scores, scores)
        if len(set(best[~rejected].tolist())) <= 1:
            sure = ~rejected if (~rejected).any() else ~unknown
            return [(0, *self._named(scores[sure].sum(axis=0), length[sure].sum()))]
        e = np.where(rejected[:, None], 0.25, 1.0) * scores
        e = e - e.max(axis=1, keepdims=True)
        path = self._path(e)
        runs = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
        out = []
        for a, b in zip(runs.tolist(), [*runs[1:].tolist(), len(path)]):
            out.append((a, *self._named(scores[a:b].sum(axis=0), length[a:b].sum(), int(path[a]))))
        return out

    def _path(self, e: np.ndarray) -> np.ndarray:
        n, k = e.shape
        back = np.empty((n, k), int)
        v = e[0]
        for i in range(1, n):
            stay, jump = v, v.max() - SWITCH
            back[i] = np.where(stay >= jump, np.arange(k), int(v.argmax()))
            v = np.maximum(stay, jump) + e[i]
        path = np.empty(n, int)
        path[-1] = int(v.argmax())
        for i in range(n - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        return path

    def _named(self, total: np.ndarray, chars: float, j: int | None = None) -> tuple[str, float]:
        j = int(total.argmax()) if j is None else j
        lead = total[j] - np.delete(total, j).max() if len(total) > 1 else 1e3
        return self.m.names[j], float(np.interp(lead / max(1.0, chars) ** 0.5, self.m.steps, self.m.rates))


def label_column(languages_rows, column: str = "language") -> F.Column:
    """Canonical name of a label, or null for a missing, placeholder or unknown one."""
    key = F.lower(F.trim(F.regexp_replace(F.col(column), "[\\s\\u00a0]+", " ")))
    pairs: dict[str, str] = {}
    for r in languages_rows:
        for v in (r["language"], r["iso_code"], r["native_name"]):
            if v and v.strip().lower() not in PLACEHOLDERS:
                pairs.setdefault(v.strip().lower(), r["language"])
    table = F.create_map(*[F.lit(x) for kv in sorted(pairs.items()) for x in kv]) if pairs else None
    return F.element_at(table, key) if table is not None else F.lit(None).cast("string")


def language_segments(chunks: DataFrame, languages: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """Columns chunk_id, seg_start, language, confidence.

    One row for a chunk in one language whose label is missing or names another; one row for each longest
    run of sentences in one language for a chunk in several.
    """
    from .samples import bounded_sample

    spark = chunks.sparkSession
    known = languages.collect()  # a fixed table of the languages in use
    label = label_column(known)
    rows = chunks.where("page_content is not null").select("chunk_id", "page_content", F.when(F.col("type") == "text", F.col("source")).alias("source"), label.alias("label"))
    schema = "chunk_id long, seg_start int, language string, confidence double"
    sample = bounded_sample(rows, "chunk_id", "label", ["page_content", "source"], per_label)
    models = fit([(r["group"], r["page_content"], r["source"]) for r in sample])
    if models is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(models)  # bounded by the sample

    def run(batches):
        import pyarrow as pa

        seg = Segmenter(shared.value)
        for b in batches:
            out: list[tuple[int, int, str, float]] = []
            cols = [b.column(i).to_pylist() for i in range(4)]
            for p in range(0, b.num_rows, 512):
                parts, spans, plan, at = [], [], [], 0
                for cid, text, source, have in zip(*(c[p : p + 512] for c in cols)):
                    off = content_offset(text, source)
                    body = text[off:]
                    sents = sentences_of(body)
                    if not sents:
                        continue
                    codes = folded(body)
                    parts.append(codes)
                    plan.append((cid, off, have, body, sents, len(spans)))
                    spans += [(at + s, at + e) for s, e in sents]
                    at += len(codes)
                if not plan:
                    continue
                scores = seg.m.sentence_scores(np.concatenate(parts), np.array(spans))
                for cid, off, have, body, sents, k in plan:
                    got = seg.segments(body, sents, scores[k : k + len(sents)])
                    if len(got) > 1 or (got and got[0][1] != have):
                        out += [(cid, off + sents[a][0] if n else 0, name, conf) for n, (a, name, conf) in enumerate(got)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.string()), pa.array([r[3] for r in out], pa.float64())], names=["chunk_id", "seg_start", "language", "confidence"])

    return rows.select("chunk_id", "page_content", "source", "label").mapInArrow(run, schema).dropDuplicates(["chunk_id", "seg_start"])
