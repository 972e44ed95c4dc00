"""Vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty or zero vectors, an error for different lengths."""
    empty = (F.coalesce(F.size(a), F.lit(0)) <= 0) | (F.coalesce(F.size(b), F.lit(0)) <= 0)
    length = norm(a) * norm(b)
    return F.when(empty, F.lit(0.0)).when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")).when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def unit(a: Column) -> Column:
    """The vector over its norm, so that a dot product is the cosine; zero vectors stay."""
    return F.element_at(F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(a, lambda x: (x.cast("double") / n).cast("float"))).otherwise(a.cast("array<float>"))), 1)


def hash_embedding(text: Column, dim: int = 1024) -> Column:
    """A deterministic stand-in for a model: SHA-256 bytes of the text mapped to [-1, 1], repeated."""

    def spread(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(h, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0 * 2.0 - 1.0)

    return F.element_at(F.transform(F.array(F.sha2(F.coalesce(text, F.lit("")), 256)), spread), 1)


def checked_vector(vector: Column, dim: int = 1024) -> Column:
    """The vector, or an error if its length is not ``dim``."""
    return F.when(vector.isNull() | (F.size(vector) == dim), vector).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(vector).cast("string"))).cast("array<float>"))


def parsed_vector(text: Column) -> Column:
    """A vector from comma-separated text; empty where it can't be read."""
    values = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("float"))
    return F.when(text.isNull() | F.exists(values, lambda x: x.isNull()), F.array().cast("array<float>")).otherwise(values)


def with_instruction(text: Column, instruction: str) -> Column:
    """A question with the instruction that query embeddings want."""
    return F.concat(F.lit(instruction), text)
