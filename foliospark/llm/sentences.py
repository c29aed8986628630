"""Sentence units of multilingual text (problem 2).

``split_sentences`` works on one string; ``sentence_units`` is the DataFrame operator.

Scripts with terminators get a *terminator lattice*: every mark that could end a sentence is a node
and an edge is cut when the mark belongs to an abbreviation, initial, number, ordinal date or an
embedded quotation or bracket.  Scripts without terminators (Thai) get a *word lattice*: the
runs on either side of a gap are segmented by a dictionary, whole, and the gap is classified by the
last word before it (a final particle, or a word that cannot end a clause) and the first word behind it.

Defined results for odd input: null and blank texts give no rows; repeated rows (same id) give one
set of units; ties cannot occur, since units are ordered by offset; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookalikes import plain

# Abbreviations that never end a sentence (titles, references, Latin short forms).
NEVER_FINAL = frozenset(
    """dr prof mr mrs ms st rev gen sen gov hon capt sgt col fig figs eq eqs no nos vol ch sec art pp cf
    vs incl excl approx ca viz al vgl abb nr bzw bspw sog inkl zzgl tab kap hr fr mme mlle sr sra srta dra
    pág págs ej cap núm ed eds trans resp dept univ dipl ing ph g.e i.e e.g d.h z.b u.a o.ä p.ex p.ej
    डॉ प्रो श्री श्रीमती सुश्री कि.मी से.मी मि.मी कि.ग्रा ई.पू क्र सं पृ उदा ดร นาย นาง ผศ รศ ศ พ.ศ ค.ศ""".split()
)
# Single letters that are short forms when no number stands before them.
LETTER_SHORT = frozenset("z B d h u a S s p P M n v c".split())
# German month names behind an ordinal day.
MONTHS = frozenset(
    "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jänner Feber".split()
)
# Words that carry a sentence on behind an embedded quotation, for scripts without case.
CARRY_ON = {
    "dev": frozenset("और आणि तथा एवं व कहकर बोला बोली बोले पूछा कहा म्हणून असे असा अशी म्हणाला म्हणाली म्हणाले विचारले मग फिर".split()),
    "han": frozenset("然后 并 并且 接着 随后 于是 就 便 而 但 说 问 道 他说 她说 的 地 和 与".split()),
    "thai": frozenset("จะ และ หรือ แต่ ซึ่ง โดย ว่า กับ ของ เพื่อ เพราะ จึง ก็ แล้ว แล้วก็ ที่ อีก ด้วย ได้ ไม่ ให้ ต่อ จาก จน ถึง".split()),
}
# Thai words after which a clause cannot end.
THAI_OPEN_END = frozenset("ถึง จำนวน ปี ในปี ของ ที่ และ หรือ เป็น ว่า คือ กับ โดย ใน จาก ให้ จะ ซึ่ง เมื่อ ราว ประมาณ เพียง".split())
# Thai particles that end a sentence.
THAI_FINAL = frozenset("ครับ ค่ะ คะ นะคะ นะครับ จ้ะ จ๊ะ ไหม หรือไม่ จริงหรือไม่".split())
# Thai words that open or close clauses; together with the two sets above they are the
# closed-class part of the dictionary.
THAI_OTHER = frozenset(
    """เมื่อ ถ้า หาก ใน ตาม ตามรายงาน นักเรียน อาจารย์ ครู ผู้ คน การ ความ หลัง ก่อน ระหว่าง ตลอด ทุก นี้ นั้น
    ครับ ค่ะ นะ เลย แล้ว ไหม หรือไม่ จริง จริงหรือไม่ มี ไป มา อยู่ ทำ ทำให้ เปลี่ยน ช่วย ใช้ ได้ เดือน สัปดาห์ บทเรียน ตาราง""".split()
)
# Thai words that begin or end like one of the words above.
THAI_LONGER = frozenset("ของผสม ของเหลว ของแข็ง ของเล่น ของขวัญ กับดัก เพื่อน ต่อม ต่อเนื่อง ที่ดิน ที่นั่ง ที่อยู่ แต่งงาน ถึงแม้ ไม่ว่า ให้ความ ความน่าจะเป็น น่าจะเป็น ภายใน ข้างใน จำเป็น".split())
THAI_WORDS = THAI_LONGER | THAI_FINAL | THAI_OPEN_END | THAI_OTHER | CARRY_ON["thai"]
HAN_WORDS = CARRY_ON["han"]

INVISIBLE = "­​‌‍⁠﻿"
_LIST = re.compile(r"\s*(?:[-*•–—▪◦·‣]|\d{1,3}[.)]|\([0-9A-Za-z]{1,3}\)|[A-Za-z]\))\s+\S")
_TERM = re.compile(
    r"[.!?।॥|…．]+[%s]*(?:[\"'”’»“)\]]|[\s]?»)*[%s]*(?=\s|$|[฀-๿　-ヿ一-鿿]|(?<=[^\W\d_]{2}[.!?])[A-ZÀ-Þ][\w ]|(?<=[।॥|])[ऀ-ॣ])|[。！？]+[」』”’）\")]*" % (INVISIBLE, INVISIBLE)
)
_OPENERS = "\"'«“„(「『[¿¡（" + INVISIBLE
_PAIRS = {"«": "»", "„": "“”", "“": "”", "(": ")", "[": "]", "「": "」", "『": "』", "（": "）"}
_OPEN = re.compile(r"[«„“(\[「『（\"]")
_JOINED = re.compile(r"[.!?\"”»)]")
_RUN = re.compile(r"\S*")
_LETTERS = re.compile(r"[\w%s]*" % INVISIBLE)
_THAI = re.compile(r"[฀-๿]")
_THAI_GAP = re.compile(r"(?<=\S)[%s]*[^\S\n]+[%s]*(?=\S)" % (INVISIBLE, INVISIBLE))
_LETTER = re.compile(r"[^\W\d_]")


def lattice_words(text: str, words: frozenset[str], longest: int = 16) -> list[str]:
    """Cheapest path through the word lattice of *text*: known words cost 1, an unknown character 1.6."""
    n = len(text)
    cost, back = [0.0] + [1e9] * n, [0] * (n + 1)
    for i in range(n):
        base = cost[i]
        if base + 1.6 < cost[i + 1]:
            cost[i + 1], back[i + 1] = base + 1.6, i
        for j in range(i + 1, min(n, i + longest) + 1):
            if base + 1 < cost[j] and text[i:j] in words:
                cost[j], back[j] = base + 1, i
    out, i = [], n
    while i:
        out.append(text[back[i] : i])
        i = back[i]
    return out[::-1]


def _run_before(line: str, i: int) -> str:
    """The characters before offset *i* without white space."""
    k = i
    while k and not line[k - 1].isspace():
        k -= 1
    return line[k:i]


def _script(ch: str) -> str:
    o = ord(ch)
    if 0x0900 <= o <= 0x097F:
        return "dev"
    if 0x0E00 <= o <= 0x0E7F:
        return "thai"
    if 0x3000 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF or 0x2E80 <= o <= 0x2FDF:
        return "han"
    return "latin" if ch.isalpha() else ""


def _spans(line: str) -> list[tuple[int, int]]:
    """Closed quotations and brackets of a line as (opening offset, closing offset)."""
    out, p, n = [], 0, len(line)
    while m := _OPEN.search(line, p):
        i = m.start()
        mark = line[i]
        if mark == '"':
            q = line.find('"', i + 1)
        else:
            hits = [x for c in _PAIRS[mark] if (x := line.find(c, i + 1)) >= 0]
            q = min(hits) if hits else -1
        if q < 0:
            p = i + 1
        else:
            out.append((i, q))
            p = q + 1
        if p >= n:
            break
    return out


def _thai_breaks(line: str, words: frozenset[str]) -> list[int]:
    """Offsets behind which a Thai sentence ends at a gap."""
    out = []
    for m in _THAI_GAP.finditer(line):
        i, j = m.span()
        a, b = line[i - 1], line[j]
        ta, tb = "฀" <= a <= "๿", "฀" <= b <= "๿"
        if not ta or b.isdigit() or a.isdigit() or b in "/|-)":
            continue
        if tb:
            before = lattice_words(_run_before(line, i), words)
            if before and before[-1] in THAI_OPEN_END:
                continue
            if before and before[-1] in THAI_FINAL:  # a final particle closes the sentence, whatever stands behind
                out.append(i)
                continue
            behind = lattice_words(_RUN.match(line, j).group(), words)
            if behind and behind[0] in CARRY_ON["thai"]:
                continue
            out.append(i)
        elif (s := _script(b)) in ("dev", "han"):
            out.append(i)
        elif s == "latin":  # a whole foreign sentence, not a term: it has a terminator before Thai goes on
            nxt = _THAI.search(line, j)
            rest = line[j : nxt.start() if nxt else len(line)]
            if b.isupper() and len(rest.split()) > 3 and re.search(r"[.!?]", rest):
                out.append(i)
    return out


def _ends(line: str, words: frozenset[str], has_thai: bool) -> list[int]:
    """Offsets in *line* at which sentences end (exclusive)."""
    spans = _spans(line)
    starts = [a for a, _ in spans]
    ends: list[int] = []
    n = len(line)
    for m in _TERM.finditer(line):
        i, j = m.span()
        mark = line[i]
        if mark == "|":
            k = i - 1
            while k > 0 and line[k] in "\"' ”)" + INVISIBLE:
                k -= 1
            if k < 0 or _script(line[k]) != "dev":
                continue
        if spans:
            k = bisect_right(starts, i) - 1
            if k >= 0 and starts[k] < i < spans[k][1] and spans[k][1] >= j:
                continue  # inside a quotation or bracket that closes later
        k = j
        while k < n and (line[k].isspace() or line[k] in _OPENERS):
            k += 1
        if k >= n:
            ends.append(j)
            continue
        nxt = line[k]
        if nxt.islower() and not line[k + 1 : k + 2].isupper():  # pH, mRNA open sentences
            continue
        closed = j - i > 1 and line[j - 1] in "\"'”’»“)]」』"
        script = _script(nxt)
        if closed and script in CARRY_ON:
            if script == "dev":
                if _RUN.match(line, k).group().strip(",;।|.") in CARRY_ON["dev"]:
                    continue
            elif (w := lattice_words(_LETTERS.match(line, k).group(), HAN_WORDS if script == "han" else words)) and w[0] in CARRY_ON[script]:
                continue
        if mark in ".．" and line[i : i + 2] != "..":
            tok = _run_before(line, i).lstrip(_OPENERS).strip(INVISIBLE)
            if not tok.isascii():
                tok = plain(tok)
            low = tok.lower()
            if low in NEVER_FINAL or (len(last := _JOINED.split(low)[-1]) > 1 and last in NEVER_FINAL):
                continue  # also where the sentence before is joined without a space
            if len(tok) == 1 and tok.isalpha() and script != "dev":
                before = line[: i - 1].rstrip()
                number = before[-1:].isdigit() or before[-1:] == "°"
                if not number and (tok.isupper() or tok in LETTER_SHORT):
                    continue
                if tok in "Pp" and nxt.isdigit():
                    continue
            if "." in low and low.rsplit(".", 1)[-1] in ("g", "e", "h", "b") and len(low) < 5 and not low[0].isdigit():
                continue
            if tok.isdigit() and len(tok) <= 2 and script == "latin" and plain(_LETTERS.match(line, k).group()) in MONTHS:
                continue
            if k == j and (tok.isdigit() or low != tok):
                continue  # 3.5, Node.Js
        elif mark in "….." and nxt in ",;:":
            continue
        ends.append(j)
    if has_thai:
        ends = sorted({*ends, *_thai_breaks(line, words)})
    return ends


def split_sentences(text: str, words: frozenset[str] = THAI_WORDS) -> list[tuple[int, int]]:
    """(start, end) of every sentence of *text*, in code points, end exclusive, without white space around."""
    out: list[tuple[int, int]] = []
    at = 0
    has_thai = not text.isascii() and _THAI.search(text) is not None
    carry = -1  # start of a sentence that a soft line break left open
    for line in text.split("\n"):
        if not line.strip():
            if carry >= 0 and not line:
                carry = -1
            at += len(line) + 1
            continue
        if _LIST.match(line):
            a = len(line) - len(line.lstrip())
            out.append((at + a, at + len(line.rstrip())))
            carry = -1
            at += len(line) + 1
            continue
        p, first = 0, True
        for e in [*_ends(line, words, has_thai), len(line)]:
            s = line[p:e]
            if s.strip(INVISIBLE + " "):
                a = at + p + len(s) - len(s.lstrip())
                b = at + p + len(s.rstrip())
                if b > a:
                    if first and carry >= 0 and line.lstrip()[:1].islower():
                        out[-1] = (out[-1][0], b)  # a wrapped line goes on with the sentence
                    else:
                        out.append((a, b))
                    first = False
            p = max(p, e)
        tail = line.rstrip()
        carry = 1 if tail[-1:].isalnum() or tail[-1:] in ",;-" else -1
        at += len(line) + 1
    return out


def content_offset(text: str, source: str | None) -> int:
    """Where the content of a chunk begins behind its breadcrumb line."""
    return len(source) + 1 if source and text.startswith(source + "\n") else 0


def clean_text(chunks: DataFrame) -> DataFrame:
    """Clean text chunks: type text, not scanned, with text."""
    return chunks.where((F.col("type") == "text") & (~F.coalesce(F.col("ocr"), F.lit(False))) & F.col("page_content").isNotNull())


def sentence_units(chunks: DataFrame) -> DataFrame:
    """Columns chunk_id, sent_start, sent_end: the sentences of every clean text chunk."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, starts, ends = [], [], []
            for cid, text, source in zip(*(b.column(i).to_pylist() for i in range(3))):
                off = content_offset(text, source)
                for s, e in split_sentences(text[off:] if off else text):
                    ids.append(cid)
                    starts.append(s + off)
                    ends.append(e + off)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["chunk_id", "sent_start", "sent_end"])

    out = clean_text(chunks).select("chunk_id", "page_content", "source").mapInArrow(run, "chunk_id long, sent_start int, sent_end int")
    return out.dropDuplicates(["chunk_id", "sent_start", "sent_end"])
