"""Vector matrices and JSON lines as files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_matrix(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """file, row, vector of raw little-endian float32 matrices with `dim` columns; a file of another length raises."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, data in zip(pdf["path"], pdf["content"]):
                matrix = np.frombuffer(data, "<f4").reshape(-1, dim)
                for a in range(0, len(matrix), 10_000):
                    part = matrix[a : a + 10_000]
                    yield pd.DataFrame({"file": file, "row": np.arange(a, a + len(part)), "vector": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row long, vector array<float>")


def write_matrix(vectors: DataFrame, path: str) -> None:
    """row, vector as one raw little-endian float32 matrix a partition, in order of row; read_matrix reads them back.

    Files are named by their place, so their order is that of the rows.
    """
    folder = path.rstrip("/")
    rows = vectors.select("row", F.col("vector").cast("array<float>").alias("vector")).dropna()
    ordered = rows.repartitionByRange(max(1, rows.sparkSession.sparkContext.defaultParallelism), "row").sortWithinPartitions("row")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = [np.stack(pdf["vector"].to_numpy()).astype("<f4").tobytes() for pdf in batches if len(pdf)]
        if data:
            from pyspark import TaskContext

            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "content": [b"".join(data)]})

    parts = ordered.mapInPandas(run, "part int, content binary")
    hadoop = rows.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = hadoop.getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    for r in parts.toLocalIterator():  # one matrix at a time
        out = fs.create(rows.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/part-{r['part']:06d}.bin"), True)
        out.write(bytearray(r["content"]))
        out.close()


def file_size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder, 0 if there is none."""
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(file).getLength() if fs.exists(file) else 0


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, non-ASCII kept, null fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def dataset_metadata(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, name: str) -> DataFrame:
    """One row: dataset, corpus, queries and qrels counts, taken_at; raises if a part is empty."""
    counts = {k: df.count() for k, df in (("corpus", corpus), ("queries", queries), ("qrels", qrels))}
    empty = [k for k, n in counts.items() if n == 0]
    if empty:
        raise ValueError(f"no {', '.join(empty)}")
    return corpus.sparkSession.createDataFrame([(name, *counts.values())], "dataset string, corpus long, queries long, qrels long").withColumn("taken_at", F.current_timestamp())


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines of text files that are not blank."""
    return spark.read.text(path).filter(F.length(F.trim("value")) > 0).count()


def bytes_by_folder(spark: SparkSession, path: str) -> DataFrame:
    """folder, files, size_bytes below a path, without reading contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("size_bytes"))
