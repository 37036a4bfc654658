"""Evaluation of retrieval over a dataset, end to end."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..embed.hashing import HashingProvider
from ..operators.cache import embedded
from ..operators.knn import top_k_blocked
from ..operators.ranking import metrics
from ..operators.store import VectorStore
from ..session import cut
from ..sources.dataset import Dataset

DEPTH = 100


def _vectors(rows: DataFrame, key: str, provider, cache: VectorStore | None) -> DataFrame:
    """key, vector of rows (key, text); with a cache only contents it doesn't have are embedded, and it keeps them."""
    if cache is None:
        return cut(provider.embed(rows, "text").select(key, "vector"))
    hashed = rows.select(key, F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), F.coalesce("text", F.lit("")).alias("content"))
    filled, fresh = embedded(hashed, cache.table("cache"), provider)
    if not fresh.isEmpty():
        cache.commit({"cache": fresh})
    return cut(filled.select(key, "vector"))


def evaluate(dataset: Dataset, provider=None, cache: VectorStore | None = None, name: str = "") -> DataFrame:
    """One row: the metrics of exact search, 100 deep, over a dataset's corpus, and how they came about.

    Before the metrics stand dataset, model, num_queries and num_corpus, after
    them the milliseconds of each part. Ties go to the earlier corpus entry.
    """
    provider = provider or HashingProvider(256)
    spark, began = dataset.corpus.sparkSession, time.time()
    if cache is not None:
        cache.ensure()
    corpus = cut(dataset.corpus.select("corpus_id", "pos", "text"))
    entries = _vectors(corpus.select("pos", "text"), "pos", provider, cache).withColumnRenamed("pos", "corpus_id")
    embedded_corpus = time.time()
    queries = cut(dataset.queries.select("query_id", "text"))
    asked = _vectors(queries, "query_id", provider, cache)
    embedded_queries = time.time()
    ranked = cut(top_k_blocked(asked, entries, DEPTH, include_self=True))
    named = ranked.withColumnRenamed("corpus_id", "pos").select("query_id", "pos", "rank").join(corpus.select("pos", "corpus_id"), "pos")
    found = metrics(named, dataset.qrels).first().asDict()  # one row
    done = time.time()
    ms = lambda a, b: int((b - a) * 1000)
    record = {"dataset": name, "model": provider.model, "num_queries": queries.count(), "num_corpus": corpus.count()} | found
    record |= {"embed_corpus_ms": ms(began, embedded_corpus), "embed_queries_ms": ms(embedded_corpus, embedded_queries), "search_ms": ms(embedded_queries, done), "total_ms": ms(began, done)}
    kinds = {str: "string", int: "long", float: "double"}
    return spark.createDataFrame([tuple(record.values())], ", ".join(f"`{k}` {kinds[type(v)]}" for k, v in record.items()))
