"""Vector recall: deterministic embeddings and exact cosine neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from textloom.plans.schemas import MIN_VECTOR_SCORE, VECTOR_DIMS, VECTOR_LIMIT


ROWS_AT_ONCE = 2_048  # vectors made at once


def embed_text(text: str, prefix: str, dims: int = VECTOR_DIMS) -> list[float]:
    raw = np.frombuffer(f"{prefix}: {text}".encode(), np.uint8)
    return np.bincount(np.arange(len(raw)) % dims, weights=raw % 31 + 1.0, minlength=dims).tolist()


def embed_rows(texts: list[str], prefix: str, dims: int = VECTOR_DIMS) -> np.ndarray:
    """``embed_text`` of each text, as rows of 32-bit floats."""
    out, slots = np.zeros((len(texts), dims), np.float32), np.arange(4096) % dims
    for row, text in zip(out, texts):
        raw = np.frombuffer(f"{prefix}: {text}".encode(), np.uint8)
        slots = slots if len(raw) <= len(slots) else np.arange(2 * len(raw)) % dims
        row[:] = np.bincount(slots[: len(raw)], weights=raw % 31 + 1.0, minlength=dims)
    return out


def to_bytes(vector: Column) -> Column:
    """A vector as little-endian 32-bit floats."""

    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return pack(vector)


def from_bytes(raw: Column, dims: int = VECTOR_DIMS) -> Column:
    """The vector of such bytes; another length than ``dims`` floats is an error."""

    @F.pandas_udf("array<float>")
    def unpack(b: pd.Series) -> pd.Series:
        if (wrong := b.dropna().map(len).loc[lambda n: n != 4 * dims]).size:
            raise ValueError(f"a vector of {wrong.iloc[0]} bytes, {4 * dims} are expected")
        return b.map(lambda x: None if x is None else np.frombuffer(x, "<f4").tolist())

    return unpack(raw)


def embed(rows: DataFrame, column: str, prefix: str = "passage", dims: int = VECTOR_DIMS, embedder=embed_text) -> DataFrame:
    """rows with a ``vector`` column. ``embedder(text, prefix, dims)`` runs in Arrow batches; a model plugs in here.

    An embedder with a method ``many(texts, prefix, dims)`` gets the texts by ``textloom.embed.batchSize`` (64) at a time.
    """
    size = int(rows.sparkSession.conf.get("textloom.embed.batchSize", "64"))
    names = rows.columns
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            if embedder is embed_text:
                for i in range(0, len(texts), ROWS_AT_ONCE):
                    part = embed_rows(texts[i : i + ROWS_AT_ONCE], prefix, dims)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * dims, pa.int32()), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([*batch.slice(i, ROWS_AT_ONCE).columns, lists], [*names, "vector"])
                continue
            many = getattr(embedder, "many", None)
            vectors = [v for i in range(0, len(texts), size) for v in many(texts[i : i + size], prefix, dims)] if many else [embedder(t, prefix, dims) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], [*names, "vector"])

    return rows.mapInArrow(run, StructType([*rows.schema, StructField("vector", ArrayType(FloatType()))]))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two float arrays, in doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, key: str, query: list[float], k: int = VECTOR_LIMIT, floor: float | None = None) -> DataFrame:
    """The k rows nearest to the query by cosine: key, vector_score. Filter ``vectors`` first to pre-filter a scope."""
    score = cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query]))
    best = vectors.select(key, score.alias("vector_score")).orderBy(F.round("vector_score", 6).desc(), key).limit(k)
    return best if floor is None else best.where(F.col("vector_score") >= floor)


def nearest_arrow(vectors: DataFrame, key: str, query: list[float], k: int = VECTOR_LIMIT) -> DataFrame:
    """The same by Arrow batches: each batch keeps its own k best, so the sort that follows is small."""
    kind = vectors.schema[key].dataType.simpleString()
    q = np.asarray(query, float)
    q = q / np.linalg.norm(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, -1)
            score = m @ q / np.linalg.norm(m, axis=1)
            rounded = -score.round(6)
            near = np.flatnonzero(rounded <= np.partition(rounded, k - 1)[k - 1]) if len(rounded) > k > 0 else np.arange(len(rounded))
            keys = np.asarray(batch.column(0).take(pa.array(near)).to_pylist(), object)
            top = np.lexsort((keys, rounded[near]))[:k]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(near[top])), pa.array(score[near[top]])], [key, "vector_score"])

    best = vectors.select(key, "vector").mapInArrow(run, f"{key} {kind}, vector_score double")
    return best.orderBy(F.round("vector_score", 6).desc(), key).limit(k)


def fan_out(best: DataFrame, chunks: DataFrame, key: str = "shared_normalized_text_hash", floor: float = MIN_VECTOR_SCORE) -> DataFrame:
    """Every occurrence of the neighbours' shared texts, above the floor."""
    return chunks.join(F.broadcast(best), key).where(F.col("vector_score") >= floor)  # best: at most k rows
