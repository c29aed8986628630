"""Texts that look the same but differ in their characters (problem 7).

A letter of another script can look like several plain ones (a Cyrillic palochka like I, l or 1), or like one that no
table lists.  Words with such letters are read through *vocabulary tries*: a *weighted edit automaton* follows the
edges of all letters a character looks like, and skips ignorable characters, at cost 0; one unlisted letter among Latin
ones may follow any edge at cost 1.  The cheapest word reached, and of these the most frequent one, is the canonical
spelling.  All other words, and those no trie holds, are normalized by the table of look-alikes and ignorables.

The vocabulary are the plain words of all texts.  A word to be read and the vocabulary meet in shards, named by
the half of the word without unlisted letters, with one trie a shard; texts that hold such words are then spelled anew.

Defined results for odd input: null texts take no part; an empty text looks like any other empty or
wholly invisible text; repeated rows of one id count once; equal texts are no pair (they do not differ);
a word that several vocabulary words fit takes the most frequent, ties the least in code points; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

# Letters of other scripts and the Latin letter each looks like.
HOMOGLYPHS = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y",
    "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ρ": "p", "α": "a", "ι": "i", "υ": "u", "ϲ": "c", "ϳ": "j", "Ϲ": "C",
    "ɡ": "g", "ɑ": "a", "ı": "i", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "‐": "-", "‑": "-", "−": "-",
}
# Radical signs without a compatibility form and the ideograph each looks like.
RADICALS = {
    "⺁": "厂", "⺄": "乙", "⺆": "冂", "⺇": "几", "⺈": "刀", "⺊": "卜", "⺍": "小", "⺎": "兀", "⺏": "尢", "⺝": "月", "⺩": "王",
    "⺫": "目", "⺬": "示", "⺮": "竹", "⺰": "纟", "⺼": "月", "⻄": "西", "⻅": "见", "⻆": "角", "⻉": "贝", "⻋": "车", "⻌": "辶",
    "⻑": "長", "⻓": "长", "⻔": "门", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻢": "马", "⻣": "骨",
    "⻥": "鱼", "⻦": "鸟", "⻨": "麦", "⻩": "黄", "⻬": "齐", "⻮": "齿", "⻰": "龙", "⻳": "龟",
}
# Sequences that are drawn like one character.
SEQUENCES = {"เเ": "แ", "अा": "आ", "अो": "ओ", "अौ": "औ", "एे": "ऐ", "आॅ": "ऑ"}

# Letters of other scripts that look like several plain characters; the first is the table's.
SEVERAL = {
    "Ӏ": "Il1", "ӏ": "lI1", "І": "Il1", "Ι": "Il1", "ı": "il", "О": "O0", "Ο": "O0", "о": "o0", "ο": "o0", "օ": "o0", "υ": "uv", "ν": "vu", "З": "З3", "з": "з3", "б": "б6",
    "Ь": "Ьb", "ѵ": "ѵv", "ʋ": "ʋv", "ɩ": "ɩil", "ǀ": "ǀlI1",
}
EDGE = ".,;:!?\"'()[]{}«»“”„‘’¿¡…"

_IGNORED = dict.fromkeys([0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x3164, 0xFEFF, 0xFFA0, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10)], "")
_TABLE = {ord(k): v for k, v in (HOMOGLYPHS | RADICALS).items()} | _IGNORED | {ord(c): " " for c in "               　"}
_SEQ = re.compile("|".join(SEQUENCES))


def plain(token: str) -> str:
    """The prototype of a token: compatibility forms, ignorables and look-alikes replaced, accents composed."""
    if token.isascii():
        return token
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKD", token).translate(_TABLE))
    return _SEQ.sub(lambda m: SEQUENCES[m.group()], t)


@lru_cache(maxsize=4096)
def _foreign(ch: str) -> bool:
    """A letter of another alphabet that could be drawn like a Latin one."""
    if ch.isascii() or not ch.isalpha() or ch in SEVERAL:
        return False
    return unicodedata.name(ch, "").split(" ")[0] in ("CYRILLIC", "GREEK", "ARMENIAN", "COPTIC", "CHEROKEE", "LISU", "GEORGIAN", "DESERET", "OLD")


_OPEN_TABLE = {k: v for k, v in _TABLE.items() if chr(k) not in SEVERAL}


def pattern(word: str) -> str | None:
    """*word* with listed look-alikes and ignorables gone, if letters remain that a vocabulary has to read: letters with
    several looks, or one unlisted letter among at least three plain ones."""
    if word.isascii():
        return None
    p = unicodedata.normalize("NFKC", unicodedata.normalize("NFKD", word).translate(_OPEN_TABLE))
    several = unlisted = latin = 0
    for ch in p:
        if ch in SEVERAL:
            several += 1
        elif ch.isascii():
            latin += ch.isalnum()
        elif _foreign(ch):
            unlisted += 1
    if unlisted > 1 or (not several and not unlisted) or (unlisted and latin < 3):
        return None
    return p


def _fold(text: str) -> str:
    return text.translate(_SKELETON)


# what letters with several looks can look like falls together in the names of shards
_SKELETON = {ord(c): "l" for c in "Il1iӀӏІΙıɩǀ"} | {ord(c): "o" for c in "Oo0ОΟоοօ"} | {ord(c): "v" for c in "uvυνѵʋ"} | {ord(c): "3" for c in "Зз3"} | {ord(c): "b" for c in "Ььбb6"}


def shard_of(pattern: str) -> str:
    """Name of the shard a pattern is read in: its length and the half that holds no unlisted letter."""
    h = len(pattern) // 2
    head = not any(map(_foreign, pattern[:h]))
    return f"{len(pattern)}:{int(not head)}:{_fold(pattern[:h] if head else pattern[h:])}"


def shards_of(word: str) -> tuple[str, str]:
    """Names of the shards a vocabulary word belongs to."""
    h = len(word) // 2
    return f"{len(word)}:0:{_fold(word[:h])}", f"{len(word)}:1:{_fold(word[h:])}"


class Trie:
    """Vocabulary words and their counts, read by a weighted edit automaton."""

    def __init__(self, words: dict[str, int]):
        self.root: dict = {}
        for word, n in words.items():
            node = self.root
            for ch in word:
                node = node.setdefault(ch, {})
            node[""] = n

    def read(self, pattern: str) -> str | None:
        """The cheapest and most frequent word that *pattern* looks like."""
        states = [(0, "", self.root)]
        for ch in pattern:
            nxt = []
            for cost, done, node in states:
                if ch in SEVERAL:
                    nxt += [(cost, done + c, node[c]) for c in SEVERAL[ch] if c in node]
                elif ch in node:
                    nxt.append((cost, done + ch, node[ch]))
                if cost == 0 and _foreign(ch):
                    nxt += [(1, done + c, m) for c, m in node.items() if c.isalpha() and c.isascii()]
            states = nxt
            if not states:
                return None
        found = [(cost, -node[""], done) for cost, done, node in states if "" in node and (cost == 0 or node[""] > 1)]
        return min(found)[2] if found else None


def _core(token: str) -> tuple[str, str, str]:
    """A token without the marks around it, and these."""
    left = token.lstrip(EDGE)
    core = left.rstrip(EDGE)
    return token[: len(token) - len(left)], core, left[len(core) :]


def canonical(text: str, spelled: dict[str, str] | None = None, asked: set[str] | None = None, cache: dict[str, str] | None = None) -> str:
    """The form that all texts of the same look share; *spelled* are readings of words by the vocabulary.  Words that a
    vocabulary has to read are noted in *asked*."""
    if text.isascii():
        return text
    out = []
    for part in re.split(r"(\s+)", text):
        if part.isascii():
            out.append(part)
            continue
        got = cache.get(part) if cache is not None else None
        if got is None:
            got = plain(part)
            if not part.isspace() and (spelled is not None or asked is not None):
                head, core, tail = _core(part)
                if (spelled is not None and core in spelled) or (asked is not None and pattern(core) is not None):
                    if asked is not None:
                        asked.add(core)
                    if spelled is not None and core in spelled:
                        got = plain(head) + spelled[core] + plain(tail)
                    out.append(got)
                    continue
            if cache is not None:
                if len(cache) >= 100_000:
                    cache.clear()
                cache[part] = got
        out.append(got)
    return "".join(out)


def content_column() -> F.Column:
    """Content of a chunk: its text without the breadcrumb line."""
    src = F.coalesce(F.col("source"), F.lit(""))
    head = F.concat(src, F.lit("\n"))
    return F.when((src != "") & F.col("page_content").startswith(head), F.expr("substring(page_content, length(source) + 2)")).otherwise(F.col("page_content"))


def _looks(batches):
    """(id, looks, raw, asked): hashes by the table alone, and the words that a vocabulary has to read."""
    import pyarrow as pa
    import xxhash

    digest = xxhash.xxh3_128_digest
    cache: dict[str, str] = {}
    for b in batches:
        ids, looks, raw, ask = [], [], [], []
        for cid, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if cid is None or t is None:
                continue
            h = digest(t.encode("utf-8", "surrogatepass"))
            words: set[str] = set()
            ids.append(cid)
            raw.append(h)
            looks.append(h if t.isascii() else digest(canonical(t, None, words, cache).encode("utf-8", "surrogatepass")))
            ask.append(sorted(words))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(looks, pa.binary()), pa.array(raw, pa.binary()), pa.array(ask, pa.list_(pa.string()))], names=["id", "looks", "raw", "asked"])


def _spelled_looks(batches):
    """(id, looks): hashes of texts by the readings that travel with them."""
    import pyarrow as pa
    import xxhash

    for b in batches:
        ids, looks = [], []
        for cid, t, words, readings in zip(*(b.column(k).to_pylist() for k in range(4))):
            ids.append(cid)
            looks.append(xxhash.xxh3_128_digest(canonical(t, dict(zip(words, readings))).encode("utf-8", "surrogatepass")))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(looks, pa.binary())], names=["id", "looks"])


def _asked_shards(batches):
    import pyarrow as pa

    for b in batches:
        got = [(w, p, shard_of(p)) for w in b.column(0).to_pylist() if (p := pattern(w)) is not None]
        yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.string()) for k in range(3)], names=["word", "pattern", "shard"])


def _vocabulary_shards(batches):
    """(shard, word, n): plain words of texts with their numbers, in both of their shards."""
    import pyarrow as pa

    def rows():
        words: Counter = Counter()
        for t, n in tokens.items():
            if w := _core(t)[1]:
                words[w] += n
        got = [(k, w, n) for w, n in words.items() if w.isascii() or (plain(w) == w and pattern(w) is None) for k in shards_of(w)]
        tokens.clear()
        return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.int64())], names=["shard", "word", "n"])

    tokens: Counter = Counter()
    for b in batches:
        for t in b.column(0).to_pylist():
            tokens.update(t.split())
        if len(tokens) > 200_000:
            yield rows()
    if tokens:
        yield rows()


def readings(texts: DataFrame, text_col: str, asked: DataFrame) -> DataFrame:
    """(word, reading): what the vocabulary of all texts makes of the asked words (column word, distinct)."""
    questions = cut(asked.mapInArrow(_asked_shards, "word string, pattern string, shard string"))
    names = questions.select("shard").distinct()
    words = texts.where(F.col(text_col).isNotNull()).select(text_col).mapInArrow(_vocabulary_shards, "shard string, word string, n long")
    vocabulary = words.join(names, "shard", "left_semi").groupBy("shard", "word").agg(F.sum("n").alias("n"))

    def read(q, v):
        import pandas as pd

        trie = Trie(dict(zip(v["word"], v["n"])))
        got = [(w, r) for w, p in zip(q["word"], q["pattern"]) if (r := trie.read(p)) is not None]
        return pd.DataFrame(got, columns=["word", "reading"])

    return questions.groupBy("shard").cogroup(vocabulary.groupBy("shard")).applyInPandas(read, "word string, reading string")


def canonical_keys(texts: DataFrame, id_col: str, text_col: str, tries: bool = True) -> DataFrame:
    """(id, looks, raw): 128-bit hashes of the canonical form and of the text itself, one row per id.  Without *tries*
    the table alone decides."""
    body = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keys = cut(body.mapInArrow(_looks, "id long, looks binary, raw binary, asked array<string>").dropDuplicates(["id"]))
    held = keys.where(F.size("asked") > 0).select("id", F.explode("asked").alias("word"))
    table_only = keys.select("id", "looks", "raw")
    if not tries or held.isEmpty():
        return table_only
    read = held.join(readings(texts, text_col, held.select("word").distinct()), "word")
    per_text = read.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("word", "reading"))).alias("_r"))  # words of one text
    bodies = body.where("id is not null and text is not null").join(per_text, "id").dropDuplicates(["id"])
    anew = bodies.select("id", "text", F.col("_r.word").alias("words"), F.col("_r.reading").alias("readings")).mapInArrow(_spelled_looks, "id long, looks binary")
    return table_only.join(anew.withColumnRenamed("looks", "_anew"), "id", "left").select("id", F.coalesce("_anew", "looks").alias("looks"), "raw")


def lookalike_pairs(texts: DataFrame, id_col: str, text_col: str, tries: bool = True) -> DataFrame:
    """Columns id_a < id_b: texts that look the same but differ in code points.

    Exact copies form classes first.  Only looks with two classes or more go on; classes are joined with
    classes and expanded to their members, so a large group of exact copies is never joined with itself.
    """
    keys = cut(canonical_keys(texts, id_col, text_col, tries))
    mixed = keys.groupBy("looks").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("looks")
    members = keys.join(mixed, "looks", "left_semi")
    first, second = members.select("looks", F.col("raw").alias("raw_a"), F.col("id").alias("a")), members.select("looks", F.col("raw").alias("raw_b"), F.col("id").alias("b"))
    both = class_pairs(members).join(first, ["looks", "raw_a"]).join(second, ["looks", "raw_b"])
    return both.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def class_pairs(members: DataFrame) -> DataFrame:
    """Columns looks, raw_a < raw_b: pairs of classes of exact copies that look the same, however many members they have."""
    classes = members.select("looks", "raw").distinct()
    left, right = classes.select("looks", F.col("raw").alias("raw_a")), classes.select("looks", F.col("raw").alias("raw_b"))
    return left.join(right, "looks").where("raw_a < raw_b")
