"""The embedding cache: key (model, content_hash), the latest entry of a key holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

KEY = ["model", "content_hash"]


def latest_entries(entries: DataFrame) -> DataFrame:
    """One row a key: that with the greatest ts (of equal ones the greatest loaded_at where there is one); keys with nulls are left out."""
    order = [c for c in ("ts", "loaded_at") if c in entries.columns]
    rest = [c for c in entries.columns if c not in KEY and c not in order]
    picked = entries.dropna(subset=KEY).groupBy(*KEY).agg(F.max_by(F.struct(*rest, *order), F.struct(*order)).alias("v"))
    return picked.select(*KEY, "v.*").select(*entries.columns)


def pruned(entries: DataFrame, as_of: Column, max_age_ms: int) -> DataFrame:
    """Entries not older than max_age_ms at `as_of`; exactly that age stays. Entries without ts are older than anything."""
    age = F.unix_millis(as_of.cast("timestamp")) - F.unix_millis(F.col("ts").cast("timestamp"))
    return entries.filter(age <= max_age_ms)


def probe(rows: DataFrame, entries: DataFrame, model: str) -> DataFrame:
    """rows with the cached vector of their content_hash in one model, null where it misses."""
    known = latest_entries(entries).filter(F.col("model") == model).select(F.col("content_hash").alias("_hash"), F.col("vector"))
    return rows.join(known, F.lower("content_hash") == F.col("_hash"), "left").drop("_hash")


def stats(entries: DataFrame) -> DataFrame:
    """One row: entries, and the bytes of their vectors."""
    return latest_entries(entries).agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(F.size("vector") * 4), F.lit(0)).alias("size_bytes"))


def embedded(rows: DataFrame, entries: DataFrame, provider) -> tuple[DataFrame, DataFrame]:
    """rows (content_hash, content, ...) with `vector`, from the cache where it has one; and the new entries.

    Only contents without an entry of the provider's model are embedded, each once.
    """
    probed = cut(probe(rows, entries, provider.model))
    missing = probed.filter("vector is null").groupBy("content_hash").agg(F.first("content", ignorenulls=True).alias("content"))
    fresh = cut(provider.embed(missing).select(F.lit(provider.model).alias("model"), F.lower("content_hash").alias("content_hash"), "vector", F.current_timestamp().alias("ts")))
    found = fresh.select(F.col("content_hash").alias("_hash"), F.col("vector").alias("_fresh"))
    filled = probed.join(found, F.lower("content_hash") == F.col("_hash"), "left").withColumn("vector", F.coalesce("vector", "_fresh")).drop("_hash", "_fresh")
    return filled, fresh
