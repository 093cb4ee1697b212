"""External models as functions of Arrow batches; each client is made once per partition."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Answerer(Protocol):
    def __call__(self, system: str, prompt: str) -> dict: ...


class RateLimited(Exception):
    """Raised by a client that was told to wait."""


def hashing_embedder(dims: int = 64) -> Callable[[], Embedder]:
    """An offline stand-in: signed hashes of the words, normalised."""

    def make() -> Embedder:
        def embed(texts: list[str]) -> list[list[float]]:
            out = []
            for t in texts:
                v = np.zeros(dims)
                for w in t.lower().split():
                    h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                    v[h[0] % dims] += 1 if h[1] & 1 else -1
                n = np.linalg.norm(v)
                out.append((v / n if n else v).tolist())
            return out

        return embed

    return make


def embed(df: DataFrame, make: Callable[[], Embedder], text: str = "text", out: str = "embedding", batch: int = 100, chars: int = 32_000) -> DataFrame:
    """df with a vector per row, texts cut to what the model takes, `batch` texts a call, order kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for b in batches:
            texts = b["__text"].fillna("").tolist()
            vs = [v for i in range(0, len(texts), batch) for v in client(texts[i : i + batch])]
            yield b.drop(columns="__text").assign(**{out: vs})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` array<double>"
    return df.withColumn("__text", F.substring(F.col(text), 1, chars)).mapInPandas(run, schema)


def with_retries(call: Callable[[], dict], waits: tuple[float, ...] = (60, 120, 180), sleep: Callable[[float], None] = time.sleep) -> dict:
    """The call's result, tried again after each wait while it is rate limited; other errors pass at once."""
    for w in waits:
        try:
            return call()
        except RateLimited:
            sleep(w)
    return call()


def answer(prompts: DataFrame, make: Callable[[], Answerer], system: str, qkey: str = "query_id", waits: tuple[float, ...] = (60, 120, 180)) -> DataFrame:
    """(query, answer, model, input_tokens, output_tokens, latency_ms) of each prompt."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for b in batches:
            rows = []
            for q, p in zip(b[qkey], b["prompt"]):
                t = time.time()
                r = with_retries(lambda p=p: client(system, p), waits)
                rows.append((q, r["answer"], r.get("model"), r.get("input_tokens", 0), r.get("output_tokens", 0), (time.time() - t) * 1000))
            yield pd.DataFrame(rows, columns=[qkey, "answer", "model", "input_tokens", "output_tokens", "latency_ms"])

    kind = prompts.schema[qkey].dataType.simpleString()
    return prompts.select(qkey, "prompt").mapInPandas(run, f"`{qkey}` {kind}, answer string, model string, input_tokens long, output_tokens long, latency_ms double")


def ask(prompts: DataFrame, make: Callable[[], Callable[[str], str]], qkey: str = "query_id", out: str = "raw") -> DataFrame:
    """(query, raw) of a model that gives back plain text, such as a judge or a candidate generator."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for b in batches:
            yield pd.DataFrame({qkey: b[qkey], out: [client(p) for p in b["prompt"]]})

    kind = prompts.schema[qkey].dataType.simpleString()
    return prompts.select(qkey, "prompt").mapInPandas(run, f"`{qkey}` {kind}, `{out}` string")
