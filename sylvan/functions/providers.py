"""Models as columns: embedding and language models behind small protocols, one client per task.

No model ships with this package. The hashed embedder and the mock summarizer and verifier are
deterministic, so that pipelines run and can be checked without one.
"""

from __future__ import annotations

import importlib.util
import json
import os
import time
import urllib.request
import warnings
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

from sylvan.errors import SummarizationError


@runtime_checkable
class Chunker(Protocol):
    def split_text(self, documents: DataFrame) -> DataFrame: ...


@runtime_checkable
class Clusterer(Protocol):
    def cluster_nodes(self, nodes: DataFrame) -> DataFrame: ...


@runtime_checkable
class Summarizer(Protocol):
    def summarize(self, text: Column) -> Column: ...


@runtime_checkable
class Verifier(Protocol):
    def verify(self, summary: Column, source: Column) -> Column: ...


@runtime_checkable
class Client(Protocol):
    """A language model: one prompt in, one reply out (a string, a list of parts, or else)."""

    def complete(self, prompt: str) -> object: ...


def hashed_vector(text: str, dim: int = 64) -> np.ndarray:
    """Signed counts of hashed character trigrams; a zero vector for empty text."""
    v = np.zeros(dim, np.float32)
    low = text.lower()
    for i in range(max(1, len(low) - 2) if low else 0):
        h = zlib.crc32(low[i : i + 3].encode("utf-8", "surrogatepass"))
        v[h % dim] += 1.0 if h >> 16 & 1 else -1.0
    return v


def embedder(load: Callable[[], Callable[[list[str]], list]] | None = None, batch: int = 32) -> Callable[[Column], Column]:
    """A column function from text to vectors. ``load`` makes the encoder once for each task; null
    texts get null."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load() if load else lambda texts: [hashed_vector(t) for t in texts]
        for s in batches:
            out: list = [None] * len(s)
            some = [i for i, t in enumerate(s) if t is not None]
            for a in range(0, len(some), batch):
                part = some[a : a + batch]
                vectors = list(encode([s.iloc[i] for i in part]))
                if len(vectors) != len(part):
                    raise ValueError("the encoder returned another number of vectors than texts")
                for i, v in zip(part, vectors, strict=True):
                    out[i] = np.asarray(v, np.float32).tolist()
            yield pd.Series(out)

    return embed


def sentence_encoder(model: str, batch: int = 32) -> Callable[[], Callable[[list[str]], list]]:
    """A loader for :func:`embedder`: the named sentence model, taken from the local model cache. It
    needs the sentence-transformers package on every executor and raises where that is missing."""

    def load() -> Callable[[list[str]], list]:
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError:
            raise RuntimeError(f"embedding model {model!r} needs the sentence-transformers package") from None
        encoder = SentenceTransformer(model)
        return lambda texts: list(encoder.encode(texts, batch_size=batch))

    return load


def embedder_of(model: str, batch: int = 32) -> Callable[[Column], Column]:
    """The embedder of a model name. Where no sentence model can be loaded (the package is missing, or
    the name is 'mock-model') vectors are hashed, in the former case with a warning."""
    if model == "mock-model":
        return embedder(batch=batch)
    if importlib.util.find_spec("sentence_transformers") is None:
        warnings.warn(f"{model} needs the sentence-transformers package; texts are embedded by hashing", stacklevel=2)
        return embedder(batch=batch)
    return embedder(sentence_encoder(model, batch), batch)


#: Where chat models are asked, and the variables that name the key and another address.
BASE_URL, KEY_VARIABLE, URL_VARIABLE = "https://openrouter.ai/api/v1", "OPENROUTER_API_KEY", "OPENROUTER_BASE_URL"


def api_key() -> str | None:
    """The key of the environment; blank means none. Read where a client is made, never put into a plan."""
    return os.environ.get(KEY_VARIABLE, "").strip() or None


def base_url() -> str:
    return (os.environ.get(URL_VARIABLE, "").strip() or BASE_URL).rstrip("/")


class ChatClient:
    """A model behind a chat-completion interface over HTTP."""

    def __init__(self, model: str, temperature: float = 0.0, max_tokens: int | None = None, timeout: float = 60.0):
        self.model, self.temperature, self.max_tokens, self.timeout = model, temperature, max_tokens, timeout
        self.key, self.url = api_key(), base_url()
        if self.key is None:
            raise SummarizationError(f"LLM not initialized: {KEY_VARIABLE} is not set")

    def complete(self, prompt: str) -> object:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": self.temperature}
        if self.max_tokens:
            body["max_tokens"] = self.max_tokens
        headers = {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"}
        request = urllib.request.Request(f"{self.url}/chat/completions", json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"]


def chat_model(model: str, temperature: float = 0.0, max_tokens: int | None = None, attempts: int = 3) -> Callable[[Column], Column] | None:
    """A column function from prompts to a model's replies, None for 'mock-model' (the deterministic
    one). Executors read the key from their own environment."""
    if model == "mock-model":
        return None
    return language_model(lambda: ChatClient(model, temperature, max_tokens), attempts)


def reply_text(reply: object) -> str:
    """A model's reply as text: strings as they are, lists joined by blanks, anything else spelled out."""
    if isinstance(reply, str):
        return reply
    if isinstance(reply, list):
        return " ".join(x if isinstance(x, str) else str(x.get("text", x)) if isinstance(x, dict) else str(x) for x in reply)
    return str(reply)


def with_retries(call: Callable[[], object], attempts: int, wait: Callable[[int], float] = lambda k: min(10.0, 2.0 * 2**k)) -> object:
    """``call()``, repeated with growing waits; the last error goes on."""
    for k in range(max(1, attempts)):
        try:
            return call()
        except Exception:
            if k + 1 >= max(1, attempts):
                raise
            time.sleep(wait(k))
    raise AssertionError


def language_model(client: Callable[[], Client], attempts: int = 3, wait: Callable[[int], float] | None = None) -> Callable[[Column], Column]:
    """A column function from prompts to replies. Write its result before using it twice: a task
    that is repeated repeats its calls. Equal prompts of a batch are asked once; null stays null."""

    @F.pandas_udf(StringType())
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = client()
        known: dict[str, str] = {}
        for s in batches:
            out = []
            for prompt in s:
                if prompt is not None and prompt not in known:
                    try:
                        args = {"wait": wait} if wait else {}
                        known[prompt] = reply_text(with_retries(lambda p=prompt: model.complete(p), attempts, **args))
                    except Exception as e:
                        raise SummarizationError(f"model call failed: {e}") from e
                out.append(None if prompt is None else known[prompt])
            yield pd.Series(out, dtype=object)

    return ask


