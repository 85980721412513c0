"""Chunk vectors. The default embedder counts hashed words; a real model plugs in as an Arrow function."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 64


def hashed_embedder(dim: int = DIM):
    """Arrow function text -> vector: word counts in ``dim`` buckets (md5 of the lower-case word), scaled to length 1."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        bucket: dict[str, int] = {}
        out = []
        for text in texts:
            words = (text or "").lower().split()
            for w in words:
                if w not in bucket:
                    bucket[w] = int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % dim
            counts = np.bincount([bucket[w] for w in words], minlength=dim).astype(float) if words else np.zeros(dim)
            norm = np.linalg.norm(counts)
            out.append((counts / norm if norm else counts).astype("float32"))
        return pd.Series(out)

    return embed


def embed_chunks(chunks: DataFrame, dim: int = DIM, model: Callable[[list[str]], list[list[float]]] | None = None,
                 batch: int = 100) -> DataFrame:
    """Every chunk with ``embedding`` and ``embedding_error``.

    With a model, texts go to it in batches of ``batch``. Chunks of a batch that fails or comes back short, and chunks whose
    vector has another dimension, keep a null vector and the reason, so that they can be asked for again.
    """
    if model is None:
        return chunks.withColumn("embedding", hashed_embedder(dim)("content")).withColumn("embedding_error", F.lit(None).cast("string"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at:at + batch]
                try:
                    vectors = list(model(part["content"].tolist()))
                    errors = [None if len(v) == dim else f"dimension {len(v)}" for v in vectors]
                except Exception as e:  # the service may fail in any way; the chunk says how
                    vectors, errors = [None] * len(part), [f"{type(e).__name__}: {e}"[:200]] * len(part)
                if len(vectors) != len(part):
                    errors = [f"{len(vectors)} vectors for {len(part)} texts"] * len(part)
                    vectors = [None] * len(part)
                kept = [None if e else v for v, e in zip(vectors, errors, strict=True)]
                yield part.assign(embedding=pd.Series(kept, index=part.index, dtype=object),
                                  embedding_error=pd.Series(errors, index=part.index, dtype=object))

    schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())),
                           T.StructField("embedding_error", T.StringType())])
    return chunks.mapInPandas(run, schema)


def embedding_counts(chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """Chunks, chunks with a vector, and the share of them."""
    counts = chunks.agg(F.count("*").alias("total"))
    n = embedded.filter("embedding IS NOT NULL").agg(F.count("*").alias("with_embedding")).scalar()
    return counts.withColumn("with_embedding", n).withColumn(
        "pct", F.round(F.when(F.col("total") > 0, F.col("with_embedding") / F.col("total") * 100).otherwise(0.0), 4))
