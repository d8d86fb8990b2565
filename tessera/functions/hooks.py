"""Models as functions: embedding, reranking and extraction are handed in; the defaults are deterministic and offline."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import tokens


def hash_embedding(texts: pd.Series, width: int = 64) -> pd.Series:
    """Words hashed with signs into a vector of unit length."""
    out = np.zeros((len(texts), width), dtype=np.float32)
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = xxhash.xxh64_intdigest(w)
            out[i, h % width] += 1 if h >> 63 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return pd.Series(list(out / np.where(norm == 0, 1, norm)))


def embed(text: Column, function: Callable[[pd.Series], pd.Series] = hash_embedding) -> Column:
    """Vectors of a text column by a function from batches to batches, in order."""

    @F.pandas_udf("array<float>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield function(b)

    return apply(text)


def overlap_score(query: str, text: Column) -> Column:
    """Share of the query's words that a text holds: the default reranker."""
    q = F.array_distinct(tokens(F.lit(query)))
    return F.try_divide(F.size(F.array_intersect(q, tokens(text))), F.size(q))


def extractive_summary(groups: list[list[str]], most: int = 600) -> list[str]:
    """The first sentence of each text of a group, each once, up to ``most`` words: the default summary."""
    out = []
    for texts in groups:
        said, left = [], most
        for t in texts:
            first = re.split(r"(?<=[.!?。])\s", t.strip(), maxsplit=1)[0].split()[:left]
            if first and " ".join(first) not in said:
                said.append(" ".join(first))
                left -= len(first)
            if left <= 0:
                break
        out.append(" ".join(said))
    return out
