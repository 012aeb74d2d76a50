"""Embedding of retrieval units behind a provider, by Arrow batches."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.vector import unit
from skein.functions.text import split_segments

BATCH = 32


class EmbeddingProvider(Protocol):
    """What a user supplies: a model name, and vectors for a batch of texts. It is pickled to the executors."""

    model: str

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Signed hashing of words, normalised: deterministic, without a model. Its scores are its own."""

    def __init__(self, dimensions: int = 256):
        self.model, self.dimensions = f"hashing-{dimensions}", dimensions

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dimensions)
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.dimensions] += 1 if h >> 63 else -1
            n = math.sqrt(float(v @ v))
            out.append((v / n if n else v).tolist())
        return out


def pool(vectors: list[list[float]]) -> list[float] | None:
    """Mean and unit length; a single vector stays as it is, none gives none."""
    if len(vectors) < 2:
        return vectors[0] if vectors else None
    mean = np.mean(np.array(vectors, dtype=float), axis=0)
    n = math.sqrt(float(mean @ mean))
    return (mean / n if n else mean).tolist()


def pooled(parts: DataFrame, key: str, vector: str) -> DataFrame:
    """``key`` and ``pooled``: as ``pool``, over the rows of each key; a key's vectors never meet in one place."""
    places = parts.select(key, F.posexplode(vector).alias("i", "x"))
    mean = places.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    whole = mean.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"), F.max("n").alias("n"))
    return whole.select(key, F.when(F.col("n") > 1, unit(F.col("v"))).otherwise(F.col("v")).alias("pooled"))


def vectorize(units: DataFrame, provider: EmbeddingProvider, limit: int | None = None) -> DataFrame:
    """unit_id, model, dimensions, content_hash and vector of (the first ``limit`` of) ``units``; texts without a segment give none."""
    rows = (units if limit is None else units.limit(limit)).select("unit_id", "content_hash", "searchable_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [(i, s) for i, t in enumerate(batch.searchable_text) for s in split_segments(t)]
            got: list[list[list[float]]] = [[] for _ in range(len(batch))]
            for at in range(0, len(parts), BATCH):
                some = parts[at : at + BATCH]
                for (i, _), v in zip(some, provider.embed_batch([s for _, s in some]), strict=True):
                    got[i].append(v)
            pooled = [pool(v) for v in got]
            keep = [i for i, v in enumerate(pooled) if v is not None]
            yield pd.DataFrame({"unit_id": batch.unit_id.iloc[keep], "model": provider.model, "dimensions": [len(pooled[i]) for i in keep], "content_hash": batch.content_hash.iloc[keep], "vector": [pooled[i] for i in keep]})

    out = rows.mapInPandas(run, "unit_id string, model string, dimensions int, content_hash string, vector array<float>")
    return out.withColumn("created_at", F.current_timestamp())
