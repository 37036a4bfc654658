"""Embeddings without a model: hashed word counts of unit length, in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.codefiles import spread


def hashed_words(rows: DataFrame, text: str, dim: int) -> DataFrame:
    """rows with `vector`: word counts of a text by hash bucket, scaled to length 1.

    All zero for a text without words or a null one.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))
    bucket = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 17, 8), 16, 10).cast("long") % dim)
    counted = spread(rows).withColumn("_b", bucket)
    counts = F.aggregate(
        "_b",
        F.array_repeat(F.lit(0.0), dim),
        lambda acc, b: F.concat(F.slice(acc, F.lit(1), b.cast("int")), F.array(F.element_at(acc, (b + 1).cast("int")) + 1.0), F.slice(acc, (b + 2).cast("int"), (F.lit(dim) - b - 1).cast("int"))),
    )
    counted = counted.withColumn("_c", counts).drop("_b")
    length = F.sqrt(F.aggregate("_c", F.lit(0.0), lambda acc, x: acc + x * x))
    # The length enters as an array, an argument evaluated once, and not within the lambda.
    unit = F.zip_with("_c", F.array_repeat(length, dim), lambda x, n: F.when(n > 0, x / n).otherwise(x))
    return counted.withColumn("vector", unit).drop("_c")


class HashingProvider:
    """The default provider: nothing to load, the same vector everywhere."""

    def __init__(self, dim: int = 64):
        self.dim, self.model, self.mode = dim, f"hash-{dim}", "local"

    def embed(self, rows: DataFrame, text: str = "content") -> DataFrame:
        """rows with a column `vector` (array<float>)."""
        return hashed_words(rows, text, self.dim).withColumn("vector", F.col("vector").cast("array<float>"))
