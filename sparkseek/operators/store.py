"""A versioned table of vectors: keyed upsert, deletion, export.

A table is a list of parquet folders (parts); a manifest names the parts of every
table and is replaced last, so readers see the old version or the new one, never
a mixture. A commit writes only what it is given: a table replaced is a new part,
rows appended are one more, and all else is carried over by name.
Vectors are kept once a content (point_id); places where the content occurs are
kept apart, so removing one file leaves the vector to the others.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import sha256_uuid

POINTS = "point_id string, content_hash string, vector array<float>"
PLACES = "content_hash string, file_path string, start_line int, end_line int, node_type string, symbol_name string"
LEAVES = "path string, hash string"
NODES = "path string, hash string, is_file boolean, children array<string>"
CACHE = "model string, content_hash string, vector array<float>, ts timestamp"
TABLES = {"points": POINTS, "places": PLACES, "leaves": LEAVES, "nodes": NODES, "cache": CACHE}
MAX_PARTS = 64  # of a table, before a commit that appends to it puts them together


def upserted(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """existing with the rows of `new` put in by key; of several new rows of a key the last by `order` holds."""
    columns = existing.columns
    last = new.groupBy(key).agg(F.max_by(F.struct(*[c for c in columns if c != key]), order).alias("v")).select(key, "v.*").select(*columns)
    return existing.join(last.select(key), key, "left_anti").unionByName(last)


def without(existing: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """existing without the rows whose key is in `gone`; an empty `gone` changes nothing."""
    return existing.join(gone.select(key).dropna().distinct(), key, "left_anti")


def scrolled(points: DataFrame, limit: int = 100) -> DataFrame:
    """A page of points without their vectors, in order of id."""
    return points.drop("vector").orderBy("point_id").limit(limit)


class VectorStore:
    """The index folder of one collection."""

    def __init__(self, spark: SparkSession, folder: str, dim: int, model: str):
        self.spark, self.folder, self.dim, self.model = spark, folder.rstrip("/"), dim, model

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict | None:
        """The current manifest: the one with the highest number. Null if there is no index; a broken one raises."""
        path, fs = self._path("manifests")
        if not fs.exists(path):
            return None
        names = sorted(str(s.getPath().getName()) for s in fs.listStatus(path))
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return None
        text = "\n".join(r["value"] for r in self.spark.read.text(f"{self.folder}/manifests/{names[-1]}").collect())  # one small file
        found = json.loads(text) | {"number": int(names[-1].split(".")[0])}
        if found["dim"] != self.dim or found["model"] != self.model:
            raise ValueError(f"index holds {found['model']} vectors of {found['dim']} dimensions, not {self.model} of {self.dim}")
        return found

    def ensure(self) -> None:
        """Create the collection if it is absent; check its model and dimension if not."""
        if self.manifest() is None:
            self._swap({"parts": {}})

    def _swap(self, entry: dict) -> None:
        """Put the next manifest in place by one rename; it fails if another writer was first."""
        now = self.manifest()
        text = json.dumps({"dim": self.dim, "model": self.model, "metric": "cosine", **entry})
        fresh, fs = self._path(f"manifests/{uuid.uuid4().hex}.tmp")
        out = fs.create(fresh, True)
        out.write(bytearray(text.encode()))
        out.close()
        path, _ = self._path(f"manifests/{(now['number'] if now else 0) + 1:012d}.json")
        if fs.exists(path) or not fs.rename(fresh, path):
            raise OSError("another writer put its manifest in place first")

    def table(self, name: str) -> DataFrame:
        """A table of the current version, empty if there is none."""
        found = self.manifest()
        parts = found["parts"].get(name, []) if found else []
        if not parts:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.folder}/{part}" for part in parts])

    def commit(self, append: dict[str, DataFrame] | None = None, **tables: DataFrame) -> str:
        """Write a new version from tables replaced and rows appended to others; the manifest comes last."""
        version, found = f"v-{uuid.uuid4().hex[:12]}", self.manifest()
        parts = dict(found["parts"]) if found else {}
        for name, rows in (append or {}).items():
            old = parts.get(name, [])
            whole = len(old) >= MAX_PARTS
            (self.table(name).unionByName(rows) if whole else rows).write.mode("overwrite").parquet(f"{self.folder}/{version}/{name}")
            parts[name] = [*([] if whole else old), f"{version}/{name}"]
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.folder}/{version}/{name}")
            parts[name] = [f"{version}/{name}"]
        self._swap({"parts": parts})
        return version

    def clear(self, name: str) -> None:
        """Empty one table, such as the cache; the others stay."""
        found = self.manifest()
        if found and found["parts"].get(name):
            self._swap({"parts": {k: v for k, v in found["parts"].items() if k != name}})

    def prune_cache(self, as_of, max_age_ms: int) -> int:
        """Take cache entries older than max_age_ms at `as_of` out; returns how many keys went."""
        from .cache import latest_entries, pruned

        held = latest_entries(self.table("cache"))
        kept = pruned(held, as_of, max_age_ms)
        gone = held.count() - kept.count()
        if gone:
            self.commit(cache=kept)
        return gone

    def points(self) -> DataFrame:
        return self.table("points")

    def info(self) -> dict:
        found = self.manifest()
        return {"points": 0, "status": "not_found"} if found is None else {"points": self.points().count(), "status": "green"}

    def drop(self) -> None:
        """Remove the collection; missing is fine."""
        path, fs = self._path("")
        fs.delete(path, True)


def as_points(chunks: DataFrame) -> DataFrame:
    """Points of embedded chunks (content_hash, vector): one a content."""
    return chunks.groupBy("content_hash").agg(F.first("vector", ignorenulls=True).alias("vector")).select(sha256_uuid(F.col("content_hash")).alias("point_id"), "content_hash", "vector")
