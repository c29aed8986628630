"""Filling containers of fixed capacity with documents (problem 8).

Documents are spread by a hash of their id over blocks of about ``BLOCK`` documents; each block is packed by
itself, so the work is parallel and no task holds more than a block's sizes.  In a block, *Karmarkar-Karp
multiway differencing* starts with one partial partition per document and merges the two with the widest
spread of sums, putting the largest sums of one together with the smallest of the other, until one partition
with nearly equal windows is left.  With two or three documents a window some stay overfull by a few tokens: their
documents, and those of as many emptiest windows, are parted anew by best fit.  A document is split only if it alone exceeds the capacity: into full windows and a rest, which is
packed with the others.

Sizes are tokens of a public tokenizer, whose file is a parameter.

Defined results for odd input: null texts get no container; empty texts get one and take no room; repeated
rows of one id count once; equal sizes are ordered by id; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
TASKS = 4096  # most tasks; a task takes several blocks beyond
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how that vocabulary parts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str = TOKENIZER, pattern: str = PATTERN):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window (0 to k - 1) of each size, by multiway differencing into k windows."""
    n = len(sizes)
    if k <= 1 or n == 0:
        return np.zeros(n, int)
    left, right = [-1] * n, [-1] * n  # nodes below n are items; a larger node joins two
    heap = []
    for i, s in enumerate(sizes.tolist()):
        sums, nodes = np.zeros(k, np.int64), np.full(k, -1)
        sums[0], nodes[0] = s, i
        heap.append((-s, i, sums, nodes))
    heapq.heapify(heap)
    age = n
    while len(heap) > 1:
        _, _, a, na = heapq.heappop(heap)
        _, _, b, nb = heapq.heappop(heap)
        sums, other = a + b[::-1], nb[::-1]
        nodes = np.where(na < 0, other, na)
        both = np.flatnonzero((na >= 0) & (other >= 0))
        for j in both.tolist():
            nodes[j] = len(left)
            left.append(int(na[j]))
            right.append(int(other[j]))
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), age, sums, nodes))
        age += 1
    window = np.zeros(n, int)
    for w, root in enumerate(heap[0][3].tolist()):
        stack = [root] if root >= 0 else []
        while stack:
            x = stack.pop()
            if x < n:
                window[x] = w
            else:
                stack += [left[x], right[x]]
    return window


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each size: the largest first, each into the fullest window that takes it."""
    rooms: list[tuple[int, int]] = []  # (room, window), sorted
    window = np.zeros(len(sizes), int)
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        at = bisect_left(rooms, (n, -1))
        room, w = rooms.pop(at) if at < len(rooms) else (capacity, len(rooms))
        window[i] = w
        insort(rooms, (room - n, w))
    return window


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each size (none above the capacity), windows numbered from 0 and never over the capacity.

    Differencing into the least number of windows that could do makes them nearly equal, some overfull by a few
    tokens.  The documents of those and of as many emptiest windows are parted anew by best fit; the number of windows
    rises only if that needs more.
    """
    if not len(sizes):
        return np.zeros(0, int)
    k = max(1, -(-int(sizes.sum()) // capacity))
    window = differencing(sizes, k)
    load = np.bincount(window, weights=sizes, minlength=k).astype(np.int64)
    by_load = np.argsort(load, kind="stable")
    over = int((load > capacity).sum())
    if not over:
        return window
    anew = by_load[: min(k - over, over)].tolist() + by_load[k - over :].tolist()
    of = np.flatnonzero(np.isin(window, anew))
    got = best_fit(sizes[of], capacity)
    numbers = np.array(sorted(anew) + list(range(k, k + max(0, int(got.max()) + 1 - len(anew)))))
    window[of] = numbers[got]
    return np.unique(window, return_inverse=True)[1]


def assignment(ids: np.ndarray, tokens: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(window, id, part, first token, end token) of every document of a block."""
    order = np.lexsort((ids, -tokens))
    out, next_window = [], 0
    rest_of, start_of = [], []
    for i in order.tolist():
        n, at, part = int(tokens[i]), 0, 0
        while n - at > capacity:
            out.append((next_window, int(ids[i]), part, at, at + capacity))
            next_window, at, part = next_window + 1, at + capacity, part + 1
        rest_of.append(n - at)
        start_of.append((i, part, at))
    rest = np.array(rest_of, np.int64)
    by_size = np.argsort(-rest, kind="stable")
    window = pack(rest[by_size], capacity)
    for w, j in zip(window.tolist(), by_size.tolist()):
        i, part, at = start_of[j]
        out.append((next_window + w, int(ids[i]), part, at, int(tokens[i])))
    return out


def token_sizes(docs: DataFrame, path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """Columns doc_id, tokens."""

    def run(batches):
        import pyarrow as pa

        enc = encoder(path, pattern)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], names=["doc_id", "tokens"])

    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, tokens int")


def fill_containers(docs: DataFrame, containers: DataFrame, path: str = TOKENIZER, pattern: str = PATTERN, block: int = BLOCK) -> DataFrame:
    """Columns container_type, container_id, doc_id, part, token_start, token_end: for each capacity, the container
    of every document; part counts from 0 and is above 0 only for documents that exceed the capacity."""
    kinds = sorted((r[0], r[1]) for r in containers.select("container_type", "capacity_tokens").where("capacity_tokens > 0").dropDuplicates(["container_type"]).collect())
    blocks = max(1, -(-docs.count() // block))
    sizes = token_sizes(docs, path, pattern).dropDuplicates(["doc_id"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))

    def run(pdf):
        import pandas as pd

        ids, tokens, b = pdf["doc_id"].to_numpy(), pdf["tokens"].to_numpy(), int(pdf["block"].iloc[0])
        rows = [(kind, b * (1 << 24) + w, i, part, s, e) for kind, cap in kinds for w, i, part, s, e in assignment(ids, tokens, cap)]
        return pd.DataFrame(rows, columns=["container_type", "container_id", "doc_id", "part", "token_start", "token_end"])

    # sizes are a few bytes but much work: a stated number of partitions, which adaptive execution does not fold into one
    spread = sizes.repartition(max(1, min(blocks, TASKS)), "block")
    return spread.groupBy("block").applyInPandas(run, "container_type string, container_id long, doc_id long, part int, token_start int, token_end int")
