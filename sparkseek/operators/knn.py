"""Exact nearest neighbours of a stated set of queries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import dot
from ..session import cut

MAX_BLOCK = 4096


def top_k(queries: DataFrame, corpus: DataFrame, k: int, include_self: bool = False) -> DataFrame:
    """query_id, corpus_id, score, rank: the best k of the corpus by dot product, ties by corpus_id.

    Bit-exact form: every pair is scored by ordered double sums in the JVM. The
    queries (query_id, vector) are a stated set of at most MAX_BLOCK rows, which
    are broadcast; more raise an error, for top_k_blocked takes any number.
    """
    small = queries.select("query_id", F.col("vector").alias("q")).dropna()
    if small.limit(MAX_BLOCK + 1).count() > MAX_BLOCK:
        raise ValueError(f"more than {MAX_BLOCK} queries: use top_k_blocked")
    pairs = corpus.select("corpus_id", F.col("vector").alias("c")).dropna().join(F.broadcast(small), F.lit(True) if include_self else F.col("query_id") != F.col("corpus_id"))
    scored = pairs.select("query_id", "corpus_id", dot(F.col("q"), F.col("c")).alias("score"))
    return _best(scored, k)


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class _Held:
    """The best k of each of n queries so far: rows of (query, score, id), ties by id."""

    def __init__(self, k: int):
        self.k = k
        self.rows, self.scores, self.ids = np.empty(0, np.int64), np.empty(0), None

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        """Takes in a tile of scores (queries x rows); -inf counts as absent."""
        floor = np.partition(score, score.shape[1] - self.k, axis=1)[:, -self.k] if score.shape[1] > self.k else np.full(len(score), -np.inf)
        if len(self.rows):
            full = np.bincount(self.rows, minlength=len(score)) >= self.k
            least = np.full(len(score), np.inf)
            np.minimum.at(least, self.rows, self.scores)
            floor = np.where(full, np.maximum(floor, least), floor)
        i, j = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
        rows, scores = np.concatenate([self.rows, i]), np.concatenate([self.scores, score[i, j]])
        named = ids[j] if self.ids is None else np.concatenate([self.ids, ids[j]])
        order = np.lexsort((named, -scores, rows))
        rows = rows[order]
        keep = order[np.arange(len(rows)) - np.searchsorted(rows, rows) < self.k]
        self.rows, self.scores, self.ids = np.concatenate([self.rows, i])[keep], scores[keep], named[keep]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _tiles(held: _Held, matrix: np.ndarray, own: dict, vectors: np.ndarray, others: np.ndarray, digits: int | None) -> None:
    for a in range(0, len(others), 1024):  # a few rows at a time bound the memory by the block
        near = others[a : a + 1024]
        score = matrix @ vectors[a : a + 1024].T
        score = score if digits is None else np.round(score, digits)
        for j, name in enumerate(near.tolist() if own else ()):
            if name in own:
                score[own[name], j] = -np.inf
        held.add(score, near)


def top_k_blocked(queries: DataFrame, corpus: DataFrame, k: int, include_self: bool = False, block: int = MAX_BLOCK, rows: int = 65_536, digits: int | None = None) -> DataFrame:
    """The same by matrix products: each task keeps its part's best k, and those are ranked.

    Ids may be of any type; scores may differ from the exact form in the last
    bits. Up to `block` queries go to the tasks as they are; more are put into
    blocks, which meet blocks of about `rows` corpus rows in the tasks, so
    nothing passes the driver. With `digits`, scores are rounded before they are
    ranked. Null ids and vectors are left out.
    """
    asked, entries = queries.select("query_id", "vector").dropna(), corpus.select("corpus_id", "vector").dropna(subset=["corpus_id"])
    kinds = dict(queries.select("query_id").dtypes)["query_id"], dict(corpus.select("corpus_id").dtypes)["corpus_id"]
    schema = f"query_id {kinds[0]}, corpus_id {kinds[1]}, score double"
    first = asked.limit(block + 1).collect()
    if len(first) > block:
        return _best(_block_pairs(cut(asked), cut(entries.dropna()), k, include_self, block, rows, digits, schema), k)
    ids = [r["query_id"] for r in first]
    matrix = np.array([r["vector"] for r in first], np.float64)
    own = {} if include_self else {x: i for i, x in enumerate(ids)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(k)
        kind = None
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("vector")))  # here, as a filter in Spark would compute a derived vector twice
            if not batch.num_rows or not ids:
                continue
            kind = batch.schema.field("corpus_id").type
            _tiles(held, matrix, own, _matrix(batch.column("vector")), np.array(batch.column("corpus_id").to_pylist()), digits)
        if len(held.rows):
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in held.rows]), pa.array(held.ids.tolist(), kind), pa.array(held.scores)], names=["query_id", "corpus_id", "score"])

    return _best(entries.mapInArrow(run, schema), k)


def _block_pairs(asked: DataFrame, entries: DataFrame, k: int, include_self: bool, block: int, rows: int, digits: int | None, schema: str) -> DataFrame:
    """Blocks of queries by blocks of rows: each pair is one task's, which keeps the best k of each query."""
    high, wide = max(1, math.ceil(asked.count() / block)), max(1, math.ceil(entries.count() / rows))
    at = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    q = asked.withColumns({"i": at("query_id", high), "j": F.explode(F.sequence(F.lit(0), F.lit(wide - 1)))}).select("i", "j", F.col("query_id"), F.lit(None).cast(entries.schema["corpus_id"].dataType).alias("corpus_id"), F.col("vector").cast("array<double>").alias("vector"))
    c = entries.withColumns({"j": at("corpus_id", wide), "i": F.explode(F.sequence(F.lit(0), F.lit(high - 1)))}).select("i", "j", F.lit(None).cast(asked.schema["query_id"].dataType).alias("query_id"), "corpus_id", F.col("vector").cast("array<double>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        mine = table.filter(pc.is_valid(table.column("query_id")))
        theirs = table.filter(pc.is_valid(table.column("corpus_id")))
        if not mine.num_rows or not theirs.num_rows:
            return
        ids = mine.column("query_id").to_pylist()
        best = _Held(k)
        _tiles(best, _matrix(mine.column("vector")), {} if include_self else {x: n for n, x in enumerate(ids)}, _matrix(theirs.column("vector")), np.array(theirs.column("corpus_id").to_pylist()), digits)
        if len(best.rows):
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in best.rows], mine.schema.field("query_id").type), pa.array(best.ids.tolist(), theirs.schema.field("corpus_id").type), pa.array(best.scores)], names=["query_id", "corpus_id", "score"])

    sent = q.unionByName(c).withColumn("part", F.col("i") * wide + F.col("j"))
    return sent.repartitionById(high * wide, F.col("part")).select("query_id", "corpus_id", "vector").mapInArrow(run, schema)


def nearest(points: DataFrame, vector: list[float], k: int = 10) -> DataFrame:
    """The k points (id, vector, further columns) nearest to one vector by cosine, with score; ties by id."""
    from ..functions.scalars import cosine

    query = F.array(*[F.lit(float(x)) for x in vector])
    return points.withColumn("score", cosine(F.col("vector"), query)).orderBy(F.desc_nulls_last("score"), "id").limit(k).drop("vector")
