"""The calls of the search service as plain functions: what a web framework would route to them, it returns.

Every call gives a body and a status.  Streams are iterators of server-sent event lines.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .plans.search import Store
from .sources.files import Settings

# Texts that clients know.
BUSY = "Server busy. Try again shortly."
NOTHING_FOUND = "No documents found in the knowledge base for this query."
EMPTY_MESSAGES = "messages can't be empty"
NOT_INGESTED = "No data ingested"


@dataclass
class Timings:
    """Seconds of the stages of a run."""

    seconds: dict[str, float] = field(default_factory=dict)

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        begin = time.monotonic()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.monotonic() - begin


def event(text: str) -> str:
    return f"data: {json.dumps({'choices': [{'delta': {'content': text}}]})}\n\n"


def tail(lines: Iterator[str], percent: Callable[[str], int]) -> Iterator[tuple[str, int]]:
    """The log so far and its progress, after each line."""
    log = ""
    for line in lines:
        log += line
        yield log, percent(log)


@dataclass(frozen=True)
class Sampling:
    """Parameters of an answer."""

    max_tokens: int = 512
    temperature: float = 0.0
    top_k: int | None = None
    top_p: float | None = None
    repetition_penalty: float = 1.1
    stop: tuple[str, ...] = ()

    def body(self, model: str, prompt: str) -> dict:
        """The request of a completion, without parameters that are not set."""
        values = {"max_tokens": self.max_tokens, "temperature": self.temperature, "top_k": self.top_k, "top_p": self.top_p, "repetition_penalty": self.repetition_penalty, "stop": list(self.stop) or None}
        return {"model": model, "prompt": prompt, **{k: v for k, v in values.items() if v is not None}}


def budgeted_context(texts: list[str], question: str, settings: Settings) -> str:
    """Texts joined by blank lines and cut to the tokens that template and question leave."""
    tokens = "\n\n".join(texts).split(" ")
    return " ".join(tokens[: settings.prompt_tokens - (settings.template_tokens + len(question.split()))])


class Service:
    """*answer* turns a completion request into pieces of text, *models* lists the models."""

    def __init__(self, spark: SparkSession, store: Store, answer: Callable[[dict], Iterator[str]], models: Callable[[], dict], settings: Settings | None = None, slots: int = 32, template: str = "{context}\n\nQuestion: {question}\nAnswer:"):
        self.spark, self.store, self.answer, self.list_of_models = spark, store, answer, models
        self.settings, self.template = settings or Settings(), template
        self.gate = threading.BoundedSemaphore(slots)

    def reference(self, request: dict) -> tuple[dict, int]:
        """Documents of a question; 503 while nothing is ingested, other errors as a text with status 200."""
        filters = {name: request.get(name, "") for name in ("language", "subject", "class_level")}
        try:
            hits = self.store.search(
                self.spark, request.get("prompt", ""), self.settings.mode, filters, request.get("num_chunks_post_rrf", self.settings.k), request.get("num_docs_reranker", self.settings.top_r),
                request.get("use_reranker", self.settings.use_reranker), self.settings.score_threshold,
            )
            return {"documents": [r.asDict() for r in hits.collect()]}, 200  # at most as many as asked for
        except LookupError as e:
            return {"error": str(e)}, 503
        except Exception as e:  # noqa: BLE001 - clients expect the text
            return {"error": repr(e)}, 200

    def chat(self, request: dict) -> tuple[Iterator[str] | dict, int]:
        """Event lines of an answer from the documents that the request brings; only the first message counts."""
        if not request.get("messages"):
            return {"error": EMPTY_MESSAGES}, 200
        question, documents = request["messages"][0].get("content") or "", request.get("retrieved_documents", [])
        if not documents:
            return iter([event(NOTHING_FOUND)]), 200
        if not self.gate.acquire(blocking=False):
            return {"error": BUSY}, 429
        try:
            stop = request.get("stop") or ()
            sampling = Sampling(request.get("max_tokens", 512), request.get("temperature", 0.0), stop=(stop,) if isinstance(stop, str) else tuple(stop))
            context = budgeted_context([d.get("page_content", "") for d in documents], question, self.settings)
            pieces = self.answer(sampling.body(request.get("model", ""), self.template.replace("{context}", context).replace("{question}", question)))
        except Exception as e:  # noqa: BLE001
            self.gate.release()
            return {"error": repr(e)}, 500
        return self._released(pieces), 200

    def _released(self, pieces: Iterator[str]) -> Iterator[str]:
        try:
            for piece in pieces:
                yield event(piece)
            yield "data: [DONE]\n\n"
        finally:
            self.gate.release()

    def models(self) -> tuple[dict, int]:
        try:
            return self.list_of_models(), 200
        except Exception as e:  # noqa: BLE001
            return {"error": repr(e)}, 200

    def db_status(self) -> tuple[dict, int]:
        try:
            ready = not self.store.chunks(self.spark).isEmpty()
        except LookupError:
            ready = False
        except Exception as e:  # noqa: BLE001
            return {"ready": False, "message": str(e)}, 500
        return ({"ready": True} if ready else {"ready": False, "message": NOT_INGESTED}), 200

    def health(self) -> tuple[dict, int]:
        return {"status": "ok"}, 200
