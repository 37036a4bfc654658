"""Chunk records to chunk rows counted once and to whole files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = ["repo", "root_dir", "file_path"]


def task_count(spark: SparkSession, per_core: int = 4) -> int:
    """Partitions for CPU-heavy Python stages: the session's shuffle partitions, at least a few per core.

    Handed to repartition(), whose number adaptive execution keeps; partitions
    sized by bytes alone would leave most cores idle in parsing stages.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), per_core * spark.sparkContext.defaultParallelism)


_STAYS = frozenset(["Project", "Filter", "Relation", "LogicalRDD", "LocalRelation"])


def spread(df: DataFrame) -> DataFrame:
    """`df` in enough partitions for a CPU-heavy stage: as scanned if the scan gives enough, else shuffled once.

    Only a plan without a shuffle is asked for its number of partitions, as
    others would have to run for it.
    """
    context = df.sparkSession.sparkContext
    nodes = re.findall(r"^[\s:+-]*(\w+)", df._jdf.queryExecution().optimizedPlan().toString(), re.M)
    if _STAYS.issuperset(nodes) and df.rdd.getNumPartitions() >= 2 * context.defaultParallelism:
        return df
    return df.repartition(task_count(df.sparkSession))


def extension(path: Column) -> Column:
    """The extension with its dot in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.[^./\\]*$", 0))


def whole_files(chunks: DataFrame) -> DataFrame:
    """Files with their text: repo, root_dir, file_path, text.

    Chunks' lines stand at their line numbers, lines in no chunk are blank,
    joined by a line feed. Records delivered again (same row_id) count once.
    A null content is empty, a null start line means the first line; chunks
    that overlap follow each other in order of (start_line, row_id).
    """
    piece = F.struct(F.coalesce("start_line", F.lit(1)).alias("start"), "row_id", F.coalesce("content", F.lit("")).alias("content"))
    keyed = chunks.select(*FILE, piece.alias("piece")).repartition(task_count(chunks.sparkSession), *FILE)
    grouped = keyed.groupBy(*FILE).agg(F.sort_array(F.collect_set("piece")).alias("pieces"))
    placed = F.transform(
        "pieces",
        lambda x, i: F.struct(
            x["content"].alias("content"),
            F.when(i == 0, x["start"] - 1)
            .otherwise(F.greatest(x["start"] - (F.col("pieces")[i - 1]["start"] + F.length(F.col("pieces")[i - 1]["content"]) - F.length(F.replace(F.col("pieces")[i - 1]["content"], F.lit("\n")))), F.lit(1)))
            .alias("gap"),
        ),
    )
    text = F.array_join(F.transform(placed, lambda x: F.concat(F.repeat(F.lit("\n"), F.greatest(x["gap"], F.lit(0))), x["content"])), "")
    return grouped.select(*FILE, text.alias("text"))
