"""Model calls as vectorized functions.

A model is any picklable callable on lists; the offline stand-ins are deterministic, so that pipelines can be
tested without a server.  A failing call never loses rows: each has the default its operator defines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def hashed_embedding(texts: list[str], dim: int = 64) -> np.ndarray:
    """Stand-in embedder: signed counts of hashed words, length one."""
    out = np.zeros((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[i, h % dim] += 1.0 if (h >> 32) & 1 else -1.0
        n = np.linalg.norm(out[i])
        out[i] = out[i] / n if n else out[i]
    return out


def overlap_score(query: str, text: str) -> float:
    """Stand-in reranker: share of the query's words that the text has."""
    q = set(query.lower().split())
    return len(q & set(text.lower().split())) / len(q) if q else 0.0


def embed_udf(model: Callable[[list[str]], np.ndarray] = hashed_embedding, max_tokens: int = 512, reserve: int = 2, batch: int = 64):
    """text -> array<float>.  Texts are cut to *max_tokens* less *reserve* words; null texts give null."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            cut = [" ".join(t.split()[: max_tokens - reserve]) if isinstance(t, str) else None for t in s]
            out: list = [None] * len(cut)
            have = [i for i, t in enumerate(cut) if t is not None]
            for k in range(0, len(have), batch):
                for i, v in zip(have[k : k + batch], model([cut[i] for i in have[k : k + batch]])):
                    out[i] = [float(x) for x in v]
            yield pd.Series(out)

    return embed


def keep_udf(model: Callable[[list[str]], list[str]], batch: int = 32):
    """text -> boolean: whether the reply says yes.  Every row of a failed batch is kept."""

    @F.pandas_udf("boolean")
    def keep(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts, out = s.fillna("").tolist(), []
            for k in range(0, len(texts), batch):
                part = texts[k : k + batch]
                try:
                    replies = model(part)
                    out += ["yes" in r.strip().lower() for r in replies] if len(replies) == len(part) else [True] * len(part)
                except Exception:  # noqa: BLE001 - any failure of a model keeps the rows
                    out += [True] * len(part)
            yield pd.Series(out)

    return keep


def text_udf(model: Callable[[str], str], default: str = "No summary.", tries: int = 1):
    """text -> text, one call each, tried again on failure; then the default."""

    @F.pandas_udf("string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for t in s:
                for n in range(tries):
                    try:
                        out.append(model(t))
                        break
                    except Exception:  # noqa: BLE001
                        if n == tries - 1:
                            out.append(default)
            yield pd.Series(out)

    return call


def rerank_udf(model: Callable[[str, str], float] = overlap_score):
    """(query, text) -> score; a failed call scores 0."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in batches:
            out = []
            for a, b in zip(q, t):
                try:
                    out.append(float(model(a or "", b or "")))
                except Exception:  # noqa: BLE001
                    out.append(0.0)
            yield pd.Series(out)

    return score
