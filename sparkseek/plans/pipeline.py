"""Incremental indexing and search over an index folder."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..chunk.files import chunk_file, chunked
from ..config import IndexConfig
from ..embed.hashing import HashingProvider
from ..operators.cache import embedded, latest_entries
from ..operators.enrich import with_lines
from ..operators.knn import top_k_blocked
from ..operators.merkle import leaf_changes, merkle_tree
from ..operators.store import VectorStore, as_points
from ..session import cut
from ..sources.scan import scan


class Indexer:
    """Keeps an index in step with a set of files: only changed files are chunked, only unseen contents embedded."""

    def __init__(self, spark: SparkSession, config: IndexConfig, provider=None):
        self.spark, self.config = spark, config
        self.reader = chunk_file
        self.provider = provider or HashingProvider(config.dim)
        self.store = VectorStore(spark, f"{config.index_dir}/{config.collection}", self.provider.dim, self.provider.model)

    def index(self, files: DataFrame | None = None, progress: Callable[[str, dict], None] | None = None) -> dict[str, int]:
        """Bring the index up to date with `files` (path, hash, text), by default those of the configured tree; returns counts.

        A file that can't be read is counted as failed and left out of the saved
        snapshot, so that the next run tries it again; chunks of its last good
        state are removed. `progress` is told each stage with its counts.
        """
        began = time.time()
        tell = progress or (lambda stage, counts: None)
        self.store.ensure()
        now = cut(files if files is not None else scan(self.spark, self.config.root_dir, self.config.extensions, self.config.skip_dirs))
        leaves = now.select("path", "hash")
        old = self.store.table("leaves")
        changes = cut(leaf_changes(old, leaves))
        counts = {r["status"]: r["n"] for r in changes.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        stats = {"total_files": now.count(), "added": counts.get("added", 0), "modified": counts.get("modified", 0), "removed": counts.get("removed", 0), "failed_files": 0, "total_chunks": 0, "new_chunks": 0, "cached_chunks": 0}
        tell("compare", dict(stats))
        if not counts and old.limit(1).count():
            return stats | {"index_time_ms": int((time.time() - began) * 1000)}
        todo = now.join(changes.filter("status <> 'removed'").select("path"), "path", "left_semi")
        read = cut(chunked(todo.select(F.col("path").alias("file_path"), "text"), self.config.max_chunk_tokens, self.config.min_chunk_tokens, self.reader))
        chunks, failed = read.filter("error is null").drop("error"), read.filter("error is not null").select(F.col("file_path").alias("path"))
        cache = self.store.table("cache")
        with_vectors, fresh = embedded(chunks, cache, self.provider)
        seen = chunks.count()
        known_before = chunks.join(fresh.select(F.col("content_hash").alias("_h")), F.lower("content_hash") == F.col("_h"), "left_anti").count()
        stats |= {"failed_files": failed.count(), "total_chunks": seen, "cached_chunks": known_before, "new_chunks": seen - known_before}
        tell("embed", dict(stats))
        stale = changes.filter("status <> 'added'").select(F.col("path").alias("file_path"))
        placed = chunks.select("content_hash", "file_path", "start_line", "end_line", "node_type", "symbol_name")
        points = self.store.points()
        arrived = as_points(with_vectors.select("content_hash", "vector")).join(points.select("point_id"), "point_id", "left_anti")
        saved = leaves.join(failed, "path", "left_anti")
        if stale.isEmpty():  # nothing goes, so rows are only added
            self.store.commit({"points": arrived, "places": placed, "cache": fresh}, leaves=saved, nodes=merkle_tree(saved))
        else:
            places = cut(self.store.table("places").join(stale, "file_path", "left_anti").unionByName(placed))
            held = points.unionByName(arrived).join(places.select("content_hash").distinct(), "content_hash", "left_semi")
            self.store.commit({"cache": fresh}, points=held, places=places, leaves=saved, nodes=merkle_tree(saved))
        tell("done", dict(stats))
        return stats | {"index_time_ms": int((time.time() - began) * 1000)}

    def search(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """Best k contents of each query (query_id, text), with every place they stand at; queries are a stated set."""
        asked = self.provider.embed(queries.select("query_id", "text"), "text").select("query_id", "vector")
        points = self.store.points()
        hits = top_k_blocked(asked, points.select(F.col("point_id").alias("corpus_id"), "vector"), k or self.config.top_k, include_self=True)
        named = hits.withColumnRenamed("corpus_id", "point_id").join(points.select("point_id", "content_hash"), "point_id")
        return named.select("query_id", "rank", "score", "point_id", "content_hash").join(self.store.table("places"), "content_hash")

    def search_enriched(self, queries: DataFrame, files: DataFrame, k: int | None = None) -> DataFrame:
        """search() with the lines of the current files (path, text)."""
        return with_lines(self.search(queries, k), files.select(F.col("path").alias("file_path"), "text"))

    def stats(self) -> dict:
        """Points and status of the store, files of the saved snapshot, entries of the cache."""
        return self.store.info() | {"files": self.store.table("leaves").count(), "cache_entries": latest_entries(self.store.table("cache")).count()}

    def stats_frame(self) -> DataFrame:
        """stats() as one row: points, status, files, cache_entries."""
        found = self.stats()
        return self.spark.createDataFrame([tuple(found[k] for k in ("points", "status", "files", "cache_entries"))], "points long, status string, files long, cache_entries long")

    def reset(self) -> None:
        """Drop vectors, cache and snapshot."""
        self.store.drop()

    def reindex(self, files: DataFrame | None = None, progress: Callable[[str, dict], None] | None = None) -> dict[str, int]:
        self.reset()
        return self.index(files, progress)
