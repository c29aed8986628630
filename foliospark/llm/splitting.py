"""Pieces of texts that exceed a token limit (problem 4).

*Structure-tree packing*: a text is parsed into a tree (text, sections under headings, blocks between blank lines, lists
and lines, sentences) whose nodes carry their span; the leaves are sentences or list items.  Sibling subtrees are
merged from left to right as long as the span from the piece's start to the subtree's end stays within the limit, and
only a subtree that does not fit is descended into.  So a piece is the longest run of whole sentences within the
limit, found without visiting the sentences of subtrees that fit.  A sentence that alone exceeds the limit is cut
after every limit-th token.

A token is one character of U+0E00-0E7F, U+3000-30FF, U+4E00-9FFF or U+FF00-FFEF, or a longest run of
other characters except space, tab, LF and CR.

Defined results for odd input: null texts and texts within the limit give no rows; a text whose
collection has no limit gives none; repeated rows of one id count once; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentences import clean_text, content_offset, split_sentences

_SINGLE = "฀-๿　-ヿ一-鿿＀-￯"
TOKEN = re.compile(f"[{_SINGLE}]|[^ \\t\\n\\r{_SINGLE}]+")
JVM_TOKEN = "[\\u0E00-\\u0E7F\\u3000-\\u30FF\\u4E00-\\u9FFF\\uFF00-\\uFFEF]|[^ \\t\\n\\r\\u0E00-\\u0E7F\\u3000-\\u30FF\\u4E00-\\u9FFF\\uFF00-\\uFFEF]+"


_HEADING = re.compile(r"[ \t]*(?:(?P<marks>#{1,6})[ \t]+\S|<h(?P<tag>[1-6])\b|(?P<number>\d{1,2}(?:\.\d{1,2})+)\.?[ \t]+\S.{0,78}(?<![.!?;,:])$)", re.I | re.M)
_ITEM = re.compile(r"[ \t]*(?:[-*•–—▪◦·‣]|\d{1,3}[.)]|\([0-9A-Za-z]{1,3}\)|[A-Za-z]\)|<li\b)[ \t]*\S", re.I)


def _heading_level(text: str, at: int) -> int:
    """Level of the heading that the line at offset *at* is: marks, tag or a number of several parts; 0 for none."""
    m = _HEADING.match(text, at)
    if not m:
        return 0
    return len(m["marks"]) if m["marks"] else int(m["tag"]) if m["tag"] else m["number"].count(".") + 1


def structure(text: str, units: list[tuple[int, int]]) -> list:
    """The tree over *units*: [start, end, children]; a leaf has no children.

    Headings open sections that hold all behind them up to the next heading of their level or a higher one; a section
    holds blocks (parted by blank lines), a block lines and lists (list lines in a row), a line sentences.
    """
    root: list = [0, []]  # level, children
    open_sections = [root]
    block: list = []
    items: list = []
    line: list = []
    in_list = False

    def node(children: list) -> list:
        return children[0] if len(children) == 1 else [children[0][0], children[-1][1], children]

    def close_line() -> None:
        nonlocal line
        if line:
            (items if in_list else block).append(node(line))
            line = []

    def close_list() -> None:
        nonlocal items
        if items:
            block.append(node(items))
            items = []

    def close_block() -> None:
        nonlocal block
        close_line()
        close_list()
        if block:
            open_sections[-1][1].append(node(block))
            block = []

    def close_sections(level: int) -> None:
        while open_sections[-1][0] >= level and len(open_sections) > 1:
            done = open_sections.pop()[1]
            if done:
                open_sections[-1][1].append(node(done))

    last = None
    for s, e in units:
        breaks = 1 if last is None else text.count("\n", last, s)
        if breaks:
            close_line()
            begin = text.rfind("\n", 0, s) + 1
            if breaks > 1:
                close_block()
            level = _heading_level(text, begin)
            if level:
                close_block()
                close_sections(level)
                open_sections.append([level, []])
            listed = not level and _ITEM.match(text, begin) is not None
            if in_list and not listed:
                close_list()
            in_list = listed
        line.append([s, e, []])
        last = e
    close_block()
    close_sections(0)
    return node(root[1]) if root[1] else [0, 0, []]


class _Counter:
    """Tokens of a span of the text, counted over the span itself."""

    def __init__(self, text: str):
        m = [x.span() for x in TOKEN.finditer(text)]
        self.starts, self.ends = [a for a, _ in m], [b for _, b in m]

    def count(self, s: int, e: int) -> int:
        """Tokens that overlap [s, e): a run cut by the span's edge counts as one."""
        return bisect_left(self.starts, e) - bisect_left(self.ends, s + 1)


def pack(text: str, units: list[tuple[int, int]], limit: int, overlap: int = 1) -> list[tuple[int, int]]:
    """(start, end) of the pieces of *text*, whose sentences are *units*.

    A piece opens with the last *overlap* sentences of the one before (no more than that has), or as many of them as
    fit together with its next sentence.
    """
    if not units or limit < 1:
        return []
    tokens = _Counter(text)
    count = tokens.count
    pieces: list[tuple[int, int]] = []
    leaf_no = {s: k for k, (s, _) in enumerate(units)}
    state = [-1, -1]  # start and end of the open piece

    def flush() -> None:
        if state[0] >= 0:
            pieces.append((state[0], state[1]))
            state[0] = state[1] = -1

    def opening(k: int, first: int) -> int:
        """Start of the piece whose first new sentence is the k-th; the piece before starts at *first*."""
        at = k
        while at > 0 and k - at < overlap and units[at - 1][0] >= first and count(units[at - 1][0], units[k][1]) <= limit:
            at -= 1
        return units[at][0]

    def add(node: list) -> None:
        s, e, children = node
        if count(s if state[0] < 0 else state[0], e) <= limit:
            if state[0] < 0:
                state[0] = s
            state[1] = e
            return
        if children:
            for child in children:
                add(child)
            return
        first = state[0]
        flush()
        if count(s, e) > limit:  # a sentence that alone exceeds the limit
            begin = bisect_left(tokens.ends, s + 1)
            n = count(s, e)
            for k in range(0, n, limit):
                a = s if k == 0 else tokens.starts[begin + k]
                b = e if k + limit >= n else tokens.ends[begin + k + limit - 1]
                pieces.append((a, b))
            return
        k = leaf_no[s]
        state[0] = opening(k, first) if first >= 0 else s
        state[1] = e

    add(structure(text, units))
    flush()
    return pieces


def piece_rows(chunks: DataFrame, settings: DataFrame, overlap: int | None = None) -> DataFrame:
    """Columns chunk_id, piece_start, piece_end, page_numbers, repeated: pieces of clean text chunks over the
    limit of their collection; *repeated* tells whether a piece opens with sentences of the one before.

    ``overlap_sentences`` of the collection are repeated, none with 0 or null; with *overlap*, so many everywhere.
    """
    # settings is a configuration table with one row a collection
    again = F.coalesce(F.col("overlap_sentences").cast("int"), F.lit(0)) if overlap is None else F.lit(overlap)
    limits = settings.select("collection", F.col("emb_max_tokens").alias("limit"), again.alias("again")).where("limit > 0").dropDuplicates(["collection"])
    rough = F.regexp_count("page_content", F.lit(JVM_TOKEN))
    over = clean_text(chunks).select("chunk_id", "page_content", "source", "page_numbers", "collection").join(limits, "collection").where(F.length("page_content") > F.col("limit"))
    over = over.where(rough > F.col("limit")).select("chunk_id", "page_content", "source", "page_numbers", "limit", "again")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, starts, ends, pages, repeated = [], [], [], [], []
            for cid, text, source, page, limit, again in zip(*(b.column(i).to_pylist() for i in range(6))):
                off = content_offset(text, source)
                body = text[off:]
                if len(TOKEN.findall(body)) <= limit:
                    continue
                last = -1
                for s, e in pack(body, split_sentences(body), limit, again):
                    ids.append(cid)
                    starts.append(s + off)
                    ends.append(e + off)
                    pages.append(page)
                    repeated.append(s < last)
                    last = e
            arrays = [pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(pages, pa.string()), pa.array(repeated, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=["chunk_id", "piece_start", "piece_end", "page_numbers", "repeated"])

    out = over.mapInArrow(run, "chunk_id long, piece_start int, piece_end int, page_numbers string, repeated boolean")
    return out.dropDuplicates(["chunk_id", "piece_start", "piece_end"])
