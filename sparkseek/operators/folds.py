"""Sequential folds over bounded arrays, as higher-order aggregates in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack_lines(lines: Column, max_chars: int) -> Column:
    """Greedy packing of lines into parts of at most max_chars (line feeds counted): array of (start, end), 1-based.

    A part begins before the line that would exceed the budget, unless it is
    the part's first. An empty array gives none.
    """
    zero = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("done"), F.lit(0).alias("i"), F.lit(1).alias("first"), F.lit(0).cast("long").alias("used"))

    def step(acc: Column, line: Column) -> Column:
        i = acc["i"] + 1
        size = (F.length(line) + 1).cast("long")
        cut = (acc["used"] + size > max_chars) & (i > acc["first"])
        part = F.struct(acc["first"].alias("start"), (i - 1).alias("end"))
        return F.struct(
            F.when(cut, F.concat(acc["done"], F.array(part))).otherwise(acc["done"]).alias("done"), i.alias("i"), F.when(cut, i).otherwise(acc["first"]).alias("first"), F.when(cut, size).otherwise(acc["used"] + size).alias("used")
        )

    return F.aggregate(lines, zero, step, lambda a: F.when(a["i"] == 0, a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(a["first"].alias("start"), a["i"].alias("end"))))))


def merge_small(sizes: Column, least: int) -> Column:
    """Left fold that joins neighbours while either is below `least`: array of (start, end, size), 1-based; sizes add up."""
    kind = "array<struct<start:int,end:int,size:bigint>>"
    zero = F.struct(F.array().cast(kind).alias("done"), F.lit(0).alias("i"), F.lit(0).alias("first"), F.lit(0).cast("long").alias("size"))

    def step(acc: Column, size: Column) -> Column:
        i = acc["i"] + 1
        fresh = acc["i"] == 0
        joins = ~fresh & ((acc["size"] < least) | (size < least))
        part = F.struct(acc["first"].alias("start"), acc["i"].alias("end"), acc["size"].alias("size"))
        return F.struct(
            F.when(fresh | joins, acc["done"]).otherwise(F.concat(acc["done"], F.array(part))).alias("done"), i.alias("i"), F.when(joins, acc["first"]).otherwise(i).alias("first"), F.when(joins, acc["size"] + size).otherwise(size.cast("long")).alias("size")
        )

    return F.aggregate(sizes, zero, step, lambda a: F.when(a["i"] == 0, a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(a["first"].alias("start"), a["i"].alias("end"), a["size"].alias("size"))))))


def token_batches(rows: DataFrame, group: list[str], order: str, size: str, most_tokens: int = 6000, most_inputs: int = 2048) -> DataFrame:
    """Rows with a batch number per group: a batch ends before the row that would exceed the tokens or inputs.

    A row larger than the budget makes a batch alone. Groups must be bounded
    (a run, a file, a block of rows), as each is folded in one task.
    """
    zero = F.struct(F.array().cast("array<struct<o:bigint,s:bigint,batch:int>>").alias("done"), F.lit(0).alias("batch"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        cut = (acc["n"] > 0) & ((acc["used"] + x["s"] > most_tokens) | (acc["n"] >= most_inputs))
        batch = F.when(cut, acc["batch"] + 1).otherwise(acc["batch"])
        return F.struct(
            F.concat(acc["done"], F.array(F.struct(x["o"].alias("o"), x["s"].alias("s"), batch.alias("batch")))).alias("done"), batch.alias("batch"), F.when(cut, x["s"]).otherwise(acc["used"] + x["s"]).alias("used"), F.when(cut, F.lit(1)).otherwise(acc["n"] + 1).alias("n")
        )

    items = F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), F.col(size).cast("long").alias("s"))))
    folded = rows.groupBy(*group).agg(F.aggregate(items, zero, step, lambda a: a["done"]).alias("done"))
    return folded.select(*group, F.inline("done")).select(*group, F.col("o").alias(order), F.col("s").alias(size), F.col("batch").alias("batch_no"))
