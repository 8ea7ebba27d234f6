"""Boundaries to services: encoders, rerankers, generators and OCR, with deterministic offline defaults.

A service is any object with the method of its protocol; credentials come from the environment of whoever
builds one. The defaults need no network.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def scores(self, query: str, texts: list[str]) -> list[float]: ...


class Generator(Protocol):
    def answer(self, question: str, context: str) -> str: ...


class Ocr(Protocol):
    def pages(self, data: bytes) -> list[str]: ...


class Vision(Protocol):
    def table(self, data: bytes, context: str) -> str | None: ...


class NoVision:
    """Takes no picture for a table."""

    def table(self, data: bytes, context: str) -> str | None:
        return None


class HashingEncoder:
    """Unit vectors of hashed words and character trigrams."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            low = (t or "").lower()
            for piece in [*re.findall(r"\w+", low), *(low[j : j + 3] for j in range(len(low) - 2))]:
                h = int.from_bytes(hashlib.blake2b(piece.encode(), digest_size=8).digest(), "big")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()


class OrderReranker:
    """Keeps the order it is given."""

    def scores(self, query: str, texts: list[str]) -> list[float]:
        return [-float(i) for i in range(len(texts))]


class ExtractiveGenerator:
    """The first sentences of the context that share a word with the question, else its first sentences."""

    def answer(self, question: str, context: str) -> str:
        words = set(re.findall(r"\w+", question.lower()))
        parts = [p.strip() for p in re.split(r"(?<=[.!?。！？])\s*|\n", context) if p.strip()]
        hit = [p for p in parts if words & set(re.findall(r"\w+", p.lower()))]
        return " ".join((hit or parts)[:3])


class NoOcr:
    def pages(self, data: bytes) -> list[str]:
        raise NotImplementedError("no OCR service is set up")


_FACTORIES: dict[tuple[str, str], Callable[[], object]] = {("encoder", "hashing"): HashingEncoder, ("reranker", "none"): OrderReranker, ("generator", "extractive"): ExtractiveGenerator, ("ocr", "none"): NoOcr, ("vision", "none"): NoVision}


def register(kind: str, name: str, factory: Callable[[], object]) -> None:
    _FACTORIES[kind, name] = factory


def create(kind: str, name: str):
    if (kind, name) not in _FACTORIES:
        raise ValueError(f"no {kind} named {name}")
    return _FACTORIES[kind, name]()


def encode(df: DataFrame, key: str, text: str, encoder: str = "hashing", batch: int = 32) -> DataFrame:
    """(key, vector): one encoder per task, texts in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = create("encoder", encoder)
        for pdf in batches:
            texts = pdf["t"].fillna("").tolist()
            yield pd.DataFrame({"k": pdf["k"], "vector": [v for i in range(0, len(texts), batch) for v in model.encode(texts[i : i + batch])]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, vector array<float>").withColumnRenamed("k", key)


def rerank(hits: DataFrame, reranker: str = "none", first: int = 10, k: int = 5) -> DataFrame:
    """The first hits of every query (query_id, query, rank, title, text, ...) in the reranker's order, k of them.

    At most `first` rows of a query reach the reranker, which sees the whole text.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        model = create("reranker", reranker)
        pdf = pdf.sort_values("rank")
        scores = model.scores(pdf["query"].iloc[0], (pdf["title"].fillna("") + "\n" + pdf["text"].fillna("")).tolist())
        pdf = pdf.assign(rerank_score=scores).sort_values(["rerank_score", "rank"], ascending=[False, True]).head(k)
        return pdf.assign(rank=range(1, len(pdf) + 1))

    few = hits.where(F.col("rank") <= first)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in few.schema) + ", rerank_score double"
    return few.groupBy("query_id").applyInPandas(run, schema)
