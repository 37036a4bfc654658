"""Continuous indexing: a stream of files feeds the incremental pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import Indexer


def index_stream(files: DataFrame, indexer: Indexer, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Index a stream of file versions (path, text; a null text removes the file).

    Every micro-batch is laid over the files known so far and indexed. Keys are
    paths and content hashes, so a batch that runs again changes nothing.
    """

    def step(batch: DataFrame, _: int) -> None:
        known = indexer.store.table("leaves").select("path", "hash", F.lit(None).cast("string").alias("text"))
        last = batch.withColumn("order", F.monotonically_increasing_id()).groupBy("path").agg(F.max_by(F.struct("text"), "order").alias("v")).select("path", "v.text")
        fresh = last.dropna(subset=["text"]).select("path", F.sha2("text", 256).alias("hash"), "text")
        indexer.index(known.join(last.select("path"), "path", "left_anti").unionByName(fresh))

    writer = files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
