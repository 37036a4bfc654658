"""Merkle tree of a set of files: every folder's hash is that of its children's sorted hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import parent_path
from ..session import cut


def merkle_tree(leaves: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, path, hash, is_file, children for files (keys, path, hash) and all their folders up to `.`.

    A folder's hash is sha256 over its children's hex hashes, sorted and
    concatenated; children are sorted paths. One aggregation a level, deepest
    first, over the nodes of that level alone, written before the next one
    reads it; a folder's children meet in one row, as its hash needs them all.
    Null paths and hashes are left out, of several hashes of a path the greatest
    holds; no files give no nodes.
    """
    keys = keys or []
    depth = F.when(F.col("path") == ".", F.lit(0)).otherwise(F.size(F.split("path", "/")))
    files = cut(leaves.select(*keys, "path", "hash").dropna(subset=["path", "hash"]).groupBy(*keys, "path").agg(F.max("hash").alias("hash")).withColumn("depth", depth))
    deepest = files.agg(F.max("depth")).first()[0] or 0
    nodes = files.select(*keys, "path", "hash", F.lit(True).alias("is_file"), F.array().cast("array<string>").alias("children"))
    levels = [nodes]
    below = None
    for level in range(deepest, 0, -1):
        here = files.filter(F.col("depth") == level).select(*keys, "path", "hash")
        here = here if below is None else here.unionByName(below.select(*keys, "path", "hash"))
        below = here.groupBy(*keys, parent_path(F.col("path")).alias("path")).agg(
            F.sha2(F.array_join(F.array_sort(F.collect_list("hash")), ""), 256).alias("hash"), F.lit(False).alias("is_file"), F.array_sort(F.collect_set("path")).alias("children")
        ).select(*keys, "path", "hash", "is_file", "children")
        below = cut(below) if level > 1 else below
        levels.append(below)
    return reduce(DataFrame.unionByName, levels)


def root_hash(nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The hash of the node with the shortest path, per keys."""
    keys = keys or []
    least = F.min(F.struct(F.length("path").alias("n"), "path", "hash"))
    return nodes.groupBy(*keys).agg(least.alias("v")).select(*keys, F.col("v.hash").alias("root_hash"))


def leaf_changes(old: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, path, status (added, removed, modified) between two leaf tables (keys, path, hash); equal leaves are left out."""
    keys = [*(keys or []), "path"]
    pair = old.select(*keys, F.col("hash").alias("old_hash")).join(new.select(*keys, F.col("hash").alias("new_hash")), keys, "full")
    status = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "modified")
    return pair.withColumn("status", status).dropna(subset=["status"]).select(*keys, "status")
