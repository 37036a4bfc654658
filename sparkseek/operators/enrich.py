"""Search hits with the source lines they point to, and their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import line_range


def with_lines(hits: DataFrame, files: DataFrame) -> DataFrame:
    """hits (file_path, start_line, end_line, ...) with `content`: those lines of the file (file_path, text), or a note that it is missing."""
    known = files.select(F.col("file_path").alias("_path"), F.col("text").alias("_text"))
    joined = hits.join(known, F.col("file_path") == F.col("_path"), "left")
    missing = F.concat(F.lit("[File not found: "), F.coalesce("file_path", F.lit("")), F.lit("]"))
    return joined.withColumn("content", F.when(F.col("_path").isNull(), missing).otherwise(line_range(F.coalesce("_text", F.lit("")), F.col("start_line"), F.col("end_line")))).drop("_path", "_text")


def hit_text(rank: Column, path: Column, start: Column, end: Column, score: Column, symbol: Column, content: Column) -> Column:
    """One hit as text: a heading line with place, score and symbol, then the content."""
    label = F.when(symbol.isNull(), F.lit("")).otherwise(F.concat(F.lit("["), symbol, F.lit("] ")))
    return F.concat(F.lit("--- #"), rank.cast("string"), F.lit(" "), path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(" (score: "), F.format_string("%.3f", score), F.lit(") "), label, F.lit("---\n"), content)


NOTHING_FOUND = "No relevant code found."


def formatted(hits: DataFrame, group: list[str], asked: DataFrame | None = None) -> DataFrame:
    """All hits of a group in one text, in order of rank, blank lines between; hits of a group are few (its k).

    With `asked`, the groups there should be, those without a hit say so.
    """
    one = hit_text(*[F.col(c) for c in ("rank", "file_path", "start_line", "end_line", "score", "symbol_name", "content")])
    ordered = F.array_sort(F.collect_list(F.struct("rank", one.alias("text"))))
    texts = hits.groupBy(*group).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"))
    return texts if asked is None else asked.select(*group).distinct().join(texts, group, "left").fillna(NOTHING_FOUND, ["text"])
