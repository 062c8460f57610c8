"""Exact vector search by cosine distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cosine_similarity(vector: Column, query: list[float]) -> Column:
    """Null for a null or zero vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    length = sum(float(x) ** 2 for x in query) ** 0.5
    return F.try_divide(dot, norm * F.lit(length))


def vector_of(vectors: DataFrame, key: str, value, vector: str = "embedding") -> list[float]:
    """The vector of one row, as a query."""
    row = vectors.where(F.col(key) == value).select(vector).first()
    return list(row[0]) if row else []


def top_k(vectors: DataFrame, query: list[float], k: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows with vector_distance; ties go by key.  Filter the rows before."""
    return vectors.withColumn("vector_distance", F.round(1 - cosine_similarity(F.col(vector), query), 6)).orderBy(F.asc_nulls_last("vector_distance"), key).limit(k)


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """An embedding without a model: signed hashes of the words, scaled to length one."""
    from larkspur.functions.text import tokenize_code

    tokens = tokenize_code(text)
    slot = lambda t: F.pmod(F.xxhash64(t), F.lit(dims)).cast("int")
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(tokens, lambda t: slot(t) == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)).cast("float"))
