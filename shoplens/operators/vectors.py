"""Text embedding, and cosines as column expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shoplens import fixed
from shoplens.functions.text import normalize_query_text

#: So many texts reach the embedder in one call.
EMBED_ROWS = 1024

Embedder = Callable[[list[str], int], np.ndarray]


def pool_size(k: int) -> int:
    """Candidates to fetch before filters and re-ranking."""
    return max(15, 3 * k)


# --- texts to vectors -------------------------------------------------------

def hashed_counts(texts: list[str], dimensions: int) -> np.ndarray:
    """Word counts by hash position, at unit length, one row per text.

    The position of a word is the first 32 bits of its MD5 modulo the dimension.
    """
    place: dict[str, int] = {}
    owners, places = [], []
    for row, text in enumerate(texts):
        words = [w for w in text.split(" ") if w]
        for word in words:
            if word not in place:
                place[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dimensions
        owners.append(np.full(len(words), row * dimensions))
        places.extend([place[w] for w in words])
    at = np.concatenate([np.zeros(0, np.int64), *owners]) + np.array(places, np.int64)
    rows = np.bincount(at, minlength=len(texts) * dimensions).reshape(len(texts), dimensions).astype(float)
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(lengths == 0, 1.0, lengths)


def embed_texts(df: DataFrame, text: str, dimensions: int = fixed.EMBED_DIMENSIONS,
                embedder: Embedder | None = None, distinct: bool = True) -> DataFrame:
    """Add `vector` for the normalized text of each row.

    `embedder(texts, dimensions)` returns one row per text and runs on Arrow
    batches; without one the hashed word counts are used. With `distinct` each
    different text is computed once and joined back on its digest, which pays
    for queries and slow models. Without it there is no shuffle.
    """
    embed = embedder or hashed_counts

    @F.arrow_udf("array<float>")
    def vector(texts: pa.Array) -> pa.Array:
        parts = []
        for start in range(0, len(texts), EMBED_ROWS):
            some = texts.slice(start, EMBED_ROWS).to_pylist()
            rows = np.asarray(embed(some, dimensions), dtype="float32")
            starts = np.arange(0, rows.size + 1, rows.shape[1], dtype="int32")
            parts.append(pa.ListArray.from_arrays(starts, rows.ravel()))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))

    normal = normalize_query_text(F.coalesce(F.col(text), F.lit("")))
    if not distinct:
        return df.withColumn("vector", vector(normal))
    texts = df.select(normal.alias("_text")).distinct()
    vectors = texts.select(F.md5("_text").alias("_digest"), vector("_text").alias("vector"))
    return df.withColumn("_digest", F.md5(normal)).join(vectors, "_digest").drop("_digest")


# --- one query --------------------------------------------------------------

def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vector columns, in doubles."""
    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)
    length = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


UNROLLED = 256      # components up to which a sum is written out, and compiled


def cosine_to(vector: Column, query: list[float]) -> Column:
    """Cosine of a vector column and one query, in doubles; the query's length is computed once."""
    own = 0.0
    for x in query:
        own += x * x
    if len(query) > UNROLLED:
        return cosine(vector, F.array(*[F.lit(x) for x in query]))
    inner = square = F.lit(0.0)
    for i, x in enumerate(query):
        component = F.get(vector, F.lit(i)).cast("double")
        inner, square = inner + component * F.lit(x), square + component * component
    length = F.sqrt(square * F.lit(own))
    # A vector of another length has no cosine.
    return F.when(F.size(vector) == len(query), F.when(length > 0, inner / length).otherwise(F.lit(0.0)))


def vector_topk(index: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """k nearest rows of one query, with their metadata.

    One vector is a constant, so scan, scoring and the ordered limit stay in the JVM.
    Vectors of another length rank last, without a score.
    """
    score = F.round(cosine_to(F.col("vector"), [float(x) for x in query]), 6)
    return (index.withColumn("score", score).orderBy(F.desc("score"), "key").limit(k)
                 .select("key", "score", "metadata"))
