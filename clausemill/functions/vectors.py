"""Hashed embeddings and vector arithmetic."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile("[a-z0-9]+")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Length one; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def hashed_vector(text: str, dimension: int, buckets: dict[str, tuple[int, list[int]]]) -> np.ndarray:
    """Counts of words (1) and their letter triples (1/2) in hashed buckets, log-scaled, of length one."""
    out = np.zeros(dimension, np.float32)
    for token in _TOKEN.findall(text.lower()):
        if token not in buckets:
            place = lambda feature: int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "big") % dimension
            buckets[token] = place(f"w:{token}"), [place(f"c:{token[i : i + 3]}") for i in range(len(token) - 2)]
        word, triples = buckets[token]
        out[word] += 1.0
        for t in triples:
            out[t] += 0.5
    out = np.log1p(out)
    length = np.linalg.norm(out)
    return out / length if length else out


def hashing_encoder(dimension: int = 384, prefix: str = ""):
    """A vectorised encoder; an encoder is any function from a text Column to an array<float> Column."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets: dict[str, tuple[int, list[int]]] = {}
        for texts in batches:
            if len(buckets) > 200_000:
                buckets.clear()
            yield texts.map(lambda t: hashed_vector(t or "", dimension, buckets))

    return lambda text: run(F.concat(F.lit(prefix), text))


@functools.cache
def model_encoder(path: str, batch_size: int = 16, prefix: str = ""):
    """An encoder of a local sentence-transformers model, loaded once for each worker."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from sentence_transformers import SentenceTransformer  # an optional package

        model = SentenceTransformer(path)
        for texts in batches:
            yield pd.Series(list(model.encode(texts.fillna("").tolist(), batch_size=batch_size, normalize_embeddings=True)), index=texts.index)

    return lambda text: run(F.concat(F.lit(prefix), text))


def _encoder(settings, prefix: str):
    import importlib.util

    if settings.embedding_model_path and importlib.util.find_spec("sentence_transformers"):
        return model_encoder(settings.embedding_model_path, settings.embedding_batch_size, prefix)
    if settings.use_fake_embeddings:
        return hashing_encoder(settings.embedding_dimension, prefix)
    return None


def encoder(settings):
    """The encoder of documents that settings ask for: a model, the hashing one, or None (search is then lexical)."""
    return _encoder(settings, settings.embedding_document_prefix)


def query_encoder(settings):
    """The same encoder for queries, which have a prefix of their own."""
    return _encoder(settings, settings.embedding_query_prefix)
