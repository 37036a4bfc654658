"""Differences between consecutive full snapshots, by bucketed Merkle digests.

Each snapshot of a root is a tree of digests over hash ranges of the key:

    whole snapshot  ->  2**fan_bits ranges  ->  2**leaf_bits leaf ranges  ->  rows

A leaf range's digest is the multiset sum of two independent 64-bit hashes of
its rows (an exclusive-or and a count), which combines map-side, so no group is
ever gathered. The comparison walks down: pairs of snapshots whose top digests
agree are finished, then ranges, then leaf ranges; only rows of leaf ranges
that differ are compared row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROOT = ["repo", "root_dir"]
CHANGE_COLUMNS = ["repo", "root_dir", "snapshot_no", "path", "status"]


def canonical_path(path: Column) -> Column:
    """`/` as separator, no leading `./`, no doubled or trailing separator; `.` for the root itself."""
    slashed = F.regexp_replace(F.translate(path, "\\", "/"), "/{2,}", "/")
    bare = F.regexp_replace(F.regexp_replace(slashed, r"^(\./)+", ""), r"(/\.?)+$", "")
    return F.when(bare == "", F.lit(".")).otherwise(bare)


def snapshot_nodes(nodes: DataFrame) -> DataFrame:
    """One row per node of a snapshot: canonical path, lower-case hash, the row loaded last.

    Rows without repo, root, snapshot number or path name no node and are
    dropped; of rows loaded at the same time the one with the greatest
    (hash, is_file) holds, so the result does not depend on arrival order.
    A null load time counts as the earliest.
    """
    keyed = nodes.select(
        "repo",
        "root_dir",
        "snapshot_no",
        canonical_path(F.col("path")).alias("path"),
        F.struct("loaded_at", F.lower("hash").alias("hash"), F.coalesce("is_file", F.lit(False)).alias("is_file")).alias("v"),
    ).dropna(subset=["repo", "root_dir", "snapshot_no", "path"])
    return keyed.groupBy(*ROOT, "snapshot_no", "path").agg(F.max("v").alias("v")).select(*ROOT, "snapshot_no", "path", "v.hash", "v.is_file")


def snapshot_steps(nodes: DataFrame) -> DataFrame:
    """Which comparisons a snapshot takes part in: repo, root_dir, no, snapshot_no (the newer one), side.

    Each delivered snapshot is compared with the one delivered before it in
    order of number (holes are skipped): as the newer one (side 1) in its own
    comparison, as the older one (side -1) in that of its successor.
    """
    delivered = nodes.select(*ROOT, F.col("snapshot_no").alias("no")).dropna().distinct()
    by = Window.partitionBy(*ROOT).orderBy("no")
    around = delivered.withColumns({"before": F.lag("no").over(by), "after": F.lead("no").over(by)})
    own = F.when(F.col("before").isNotNull(), F.struct(F.col("no").alias("snapshot_no"), F.lit(1).alias("side")))
    next_ = F.when(F.col("after").isNotNull(), F.struct(F.col("after").alias("snapshot_no"), F.lit(-1).alias("side")))
    return around.select(*ROOT, "no", F.inline(F.array_compact(F.array(own, next_))))


def changed_ranges(leaves: DataFrame, steps: DataFrame, leaf_bits: int, fan_bits: int) -> DataFrame:
    """repo, root_dir, snapshot_no, leaf_range of every leaf range that differs between the two sides of a comparison.

    A node's difference digest is the exclusive-or of both sides' digests and
    the balance of their counts: zero exactly where the sides agree. The tree is
    built upwards with its children kept in arrays of at most 2**fan_bits and
    2**(leaf_bits - fan_bits), then walked downwards through differing nodes.
    """
    digests = leaves.groupBy(*ROOT, F.col("snapshot_no").alias("no"), "leaf_range").agg(
        F.bit_xor(F.xxhash64("path", "hash")).alias("h1"), F.bit_xor(F.xxhash64("hash", F.lit(7), "path")).alias("h2"), F.count(F.lit(1)).alias("n")
    )
    keys = [*ROOT, "snapshot_no"]
    sides = digests.join(steps, [*ROOT, "no"]).repartition(*keys)  # digests only; the groupings below need no further shuffle
    xor = [F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2")]
    leaf = sides.groupBy(*keys, "leaf_range").agg(*xor, F.sum(F.col("n") * F.col("side")).alias("n")).withColumn("fan", F.shiftright("leaf_range", leaf_bits - fan_bits))
    total = [*xor, F.sum(F.abs("n")).alias("n")]
    fan = leaf.groupBy(*keys, "fan").agg(*total, F.collect_list(F.struct("leaf_range", "h1", "h2", "n")).alias("below"))
    top = fan.groupBy(*keys).agg(*total, F.collect_list(F.struct("h1", "h2", "n", "below")).alias("below"))
    differs = "h1 <> 0 OR h2 <> 0 OR n <> 0"
    return top.filter(differs).select(*keys, F.inline("below")).filter(differs).select(*keys, F.inline("below")).filter(differs).select(*keys, "leaf_range")


def snapshot_changes(nodes: DataFrame, leaf_bits: int = 12, fan_bits: int = 6) -> DataFrame:
    """Files added, removed or modified between consecutive snapshots of each root.

    nodes: repo, root_dir, snapshot_no, path, hash, is_file, loaded_at; further
    columns are ignored. Result: repo, root_dir, snapshot_no (the newer one),
    path, status. Only files count, so a file that became a directory is
    removed. The first snapshot has no rows. A null hash is a value of its own:
    null against null is no change. An empty table gives an empty result.
    """
    held = snapshot_nodes(nodes)
    leaves = held.filter("is_file").select(*ROOT, "snapshot_no", "path", F.coalesce("hash", F.lit("")).alias("hash"), F.shiftrightunsigned(F.xxhash64("path"), 64 - leaf_bits).cast("int").alias("leaf_range"))
    steps = snapshot_steps(nodes)
    wanted = changed_ranges(leaves, steps, leaf_bits, fan_bits).join(steps, [*ROOT, "snapshot_no"])
    rows = leaves.withColumnRenamed("snapshot_no", "no").join(wanted, [*ROOT, "no", "leaf_range"])
    side = lambda n: F.max(F.when(F.col("side") == n, F.col("hash")))
    compared = rows.groupBy(*ROOT, "snapshot_no", "path").agg(side(1).alias("new_hash"), side(-1).alias("old_hash"))
    status = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "modified")
    return compared.withColumn("status", status).dropna(subset=["status"]).select(*CHANGE_COLUMNS)
