"""Chunk records of files, as a function and as Spark operators."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..operators.codefiles import spread
from .segments import FileSegments
from .split import Budget, fitted, joined

CHUNK_SCHEMA = "chunk_id string, file_path string, start_line int, end_line int, content string, content_hash string, node_type string, symbol_name string"
COLUMNS = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]


def chunk_file(path: str, text: str, most: int = 512, least: int = 64) -> list[tuple]:
    """Chunk rows of one file, in order; an empty file or one of comments only has none."""
    lines = text.split("\n")
    budget = Budget(lines, most, least)
    pieces = [p for s in FileSegments(path, text).segments() for p in fitted(s, budget)]
    rows = []
    for p in joined(pieces, budget):
        content = "\n".join(lines[p.first : p.last + 1])
        digest = hashlib.sha256(content.encode("utf-8", "surrogatepass")).hexdigest()
        rows.append((digest, path, p.first + 1, p.last + 1, content, digest, p.kind, p.symbol))
    return rows


def chunk_files(files: DataFrame, most: int = 512, least: int = 64) -> DataFrame:
    """Chunks of files (file_path, text). Null paths are left out, a null text is empty; a file that can't be read raises."""
    return chunked(files, most, least).select(*COLUMNS, F.when(F.col("error").isNotNull(), F.raise_error(F.concat("file_path", F.lit(": "), "error"))).alias("error")).filter("error is null").drop("error")


def chunked(files: DataFrame, most: int = 512, least: int = 64, read: Callable[[str, str, int, int], list[tuple]] = chunk_file) -> DataFrame:
    """chunk_files with a column `error`: a file that can't be read has one row, of its path and the error alone; `read` makes a file's rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(1_000_000)
        for pdf in batches:
            rows: list[tuple] = []
            for path, text in zip(pdf["file_path"], pdf["text"]):
                try:
                    rows += [(*r, None) for r in read(path, text, most, least)]
                except Exception as e:  # noqa: BLE001 - one file must not stop the others
                    rows.append((None, path, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[*COLUMNS, "error"]).astype({"start_line": "Int32", "end_line": "Int32"})

    ready = files.dropna(subset=["file_path"]).select("file_path", F.coalesce("text", F.lit("")).alias("text"))
    return spread(ready).mapInPandas(run, CHUNK_SCHEMA + ", error string")


def register_chunk_table(spark: SparkSession) -> None:
    """Registers the table function chunk_file(path, text)."""

    class ChunkFile:
        def eval(self, path: str, text: str):
            yield from chunk_file(path or "", text or "")

    spark.udtf.register("chunk_file", udtf(ChunkFile, returnType=CHUNK_SCHEMA))
