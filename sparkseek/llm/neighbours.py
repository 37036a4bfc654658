"""The k most similar vectors of every vector, along shifted space-filling curves.

Each of several orderings projects the unit vectors onto a few directions, shifts
them, maps every coordinate to a fine grid by the normal distribution function
and takes the Hilbert index. Directions are random combinations of a model's
principal axes, weighted by their spread; axes, and the places at which the
curves are cut into ranges, are fitted on a bounded sample, while every vector is
indexed. Spark partitions all orderings at once by (model, ordering, range). A
range also holds the rows that lie within a window behind either of its ends, so
neighbouring windows meet across the cut. In each sorted range a window slides
over the rows; the best k of every row are computed exactly, and the lists of all
orderings are merged and ranked again.

Equal vectors are one place on every curve. They are put together before the
search, and their lists are written out after it: the work doesn't grow with the
number of copies, and ties between copies are decided over all of them. Nearly
equal vectors are told apart by the low bits of the grid.

Work and shuffle are in proportion to the rows (orderings * window products and
`orderings` copies of a vector). Windows don't grow with the table: close
neighbours stay together on the curves at any size, while far ones, which are
hardly more similar than the rest, are lost the more often the larger the table.
recall_report measures that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.codefiles import task_count
from ..session import cut

# Dimensions of the models.
MODEL_DIMENSIONS = {"codemini-64": 64, "codewide-96": 96}


@dataclass(frozen=True)
class Curves:
    """`orderings` curves over `directions` coordinates of `bits` bits each; `window` neighbours to either side.

    `sample` bounds the rows of a model that axes and cuts are fitted on; a
    curve is cut into ranges of about `rows` rows. `block` rows share one product.
    """

    k: int = 5
    orderings: int = 20
    directions: int = 12
    bits: int = 16
    window: int = 256
    block: int = 512
    rows: int = 32_768
    sample: int = 16_384
    min_score: float = -1.0
    seed: int = 20240607


def _dimension(dimensions: dict[str, int] | None) -> Column:
    """A model's dimension: as stated, else the number its name ends in, else null."""
    dims = MODEL_DIMENSIONS if dimensions is None else dimensions
    number = F.regexp_extract("model", r"(\d{1,6})$", 1)
    named = F.when(number != "", number.cast("int"))
    return F.coalesce(F.create_map(*[F.lit(x) for pair in dims.items() for x in pair])[F.col("model")], named) if dims else named


def _held(entries: DataFrame) -> DataFrame:
    order = F.struct(F.coalesce("ts", F.lit("0001-01-01").cast("timestamp")).alias("a"), F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp")).alias("b"))
    return entries.dropna(subset=["model", "content_hash"]).groupBy("model", "content_hash").agg(F.max_by(F.struct("vector"), order).alias("v")).select("model", "content_hash", "v.vector")


def _fault(dimensions: dict[str, int] | None) -> Column:
    """Why a held entry is not valid; null if it is."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(3.4028235e38)))
    size = _dimension(dimensions)
    return (
        F.when(size.isNull(), "model of unknown dimension").when(F.col("vector").isNull(), "null").when(F.size("vector") != size, "wrong dimension").when(~finite, "not finite").when(~F.exists("vector", lambda x: x != 0), "all zero")
    )


def valid_entries(entries: DataFrame, dimensions: dict[str, int] | None = None) -> DataFrame:
    """model, content_hash, vector of the valid entries.

    Of several rows of a key the one with the latest ts holds (a null ts is the
    earliest; of equal ones the latest loaded), and it is valid if its vector is
    not null, has the model's dimension, is finite and not all zero. Keys with a
    null part have no valid entry. A model's dimension is the stated one, else
    the number its name ends in; left_out_entries reports what has none.
    """
    return _held(entries).filter(_fault(dimensions).isNull())


def left_out_entries(entries: DataFrame, dimensions: dict[str, int] | None = None) -> DataFrame:
    """model, reason, entries: the keys without a valid entry, counted."""
    return _held(entries).withColumn("reason", _fault(dimensions)).dropna(subset=["reason"]).groupBy("model", "reason").agg(F.count(F.lit(1)).alias("entries"))


def hilbert_key(grid: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert indices of grid points (n x m, each below 2**bits) as rows of big-endian bytes.

    The transposed form of the index is built in place bit plane by bit plane
    and then interleaved.
    """
    x = np.ascontiguousarray(grid.T.astype(np.uint32))
    m, n = x.shape
    for b in range(bits - 1, 0, -1):
        level, low = np.uint32(1 << b), np.uint32((1 << b) - 1)
        for i in range(m):
            high = (x[i] & level) != 0
            swap = np.where(high, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, m):
        x[i] ^= x[i - 1]
    turn = np.zeros(n, np.uint32)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[m - 1] & np.uint32(1 << b)) != 0, np.uint32((1 << b) - 1), np.uint32(0))
    x ^= turn
    planes = np.stack([(x >> np.uint32(b)).astype(np.uint8) & np.uint8(1) for b in range(bits - 1, -1, -1)])
    return np.packbits(planes.reshape(bits * m, n).T, axis=1)


def _strings(keys: np.ndarray) -> np.ndarray:
    """Byte rows as one sortable array."""
    return np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").ravel()


def _unit(raw: np.ndarray) -> np.ndarray:
    rows = raw.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


class _Fit:
    """A model's orderings: directions, centre and shift of each, and the key ranges its curve is cut into."""

    def __init__(self, unit: np.ndarray, rows: int, curves: Curves, first: int):
        dim = unit.shape[1]
        self.curves, self.first = curves, first
        centre = unit.mean(axis=0)
        spread, axes = np.linalg.eigh(np.cov(unit.T, bias=True).reshape(dim, dim) + 1e-12 * np.eye(dim))
        self.frames = []
        for ordering in range(curves.orderings):
            rng = np.random.default_rng([curves.seed, dim, ordering])
            basis = np.linalg.qr(axes @ (np.sqrt(np.maximum(spread, 0))[:, None] * rng.normal(size=(dim, min(curves.directions, dim)))))[0]
            scale = np.maximum(((unit - centre) @ basis).std(axis=0), 1e-9)
            self.frames.append((centre, basis / scale, rng.normal(size=basis.shape[1]) * 0.5))
        self.ranges = max(1, math.ceil(rows / curves.rows))
        behind = math.ceil(1.5 * curves.window * len(unit) / rows) + 1  # a window in rows of the sample
        self.low, self.high = [], []  # of each ordering: the least and greatest key a range takes rows up to
        for ordering in range(curves.orderings):
            keys = np.sort(_strings(self.keys(unit, ordering)))
            cuts = [len(keys) * r // self.ranges for r in range(1, self.ranges)]
            self.low.append(keys[[max(0, c - behind) for c in cuts]])
            self.high.append(keys[[min(len(keys) - 1, c + behind) for c in cuts]])

    def keys(self, unit: np.ndarray, ordering: int) -> np.ndarray:
        centre, basis, shift = self.frames[ordering]
        with np.errstate(over="ignore"):
            cell = 1.0 / (1.0 + np.exp(-1.702 * ((unit - centre) @ basis + shift)))  # close to the normal distribution function
        top = (1 << self.curves.bits) - 1
        return hilbert_key(np.minimum(cell * (top + 1), top).astype(np.uint32), self.curves.bits)

    def places(self, keys: np.ndarray, ordering: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and partitions: every range whose rows or windows take the key in."""
        s = _strings(keys)
        begin = np.searchsorted(self.high[ordering], s, side="left")  # ranges before end below the key
        end = np.searchsorted(self.low[ordering], s, side="right")
        count = np.maximum(end - begin, 0) + 1
        rows = np.repeat(np.arange(len(s)), count)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
        return rows, (self.first + ordering * self.ranges + begin[rows] + at).astype(np.int32)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of equal width as binary values."""
    raw = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * raw.shape[1]).astype(np.int32)), pa.py_buffer(raw)])


_KEYED = "part int, place binary, id binary, packed binary"


def _place(fits: dict[str, _Fit]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = np.array(batch.column("model").to_pylist(), dtype=object)
            for model in sorted(set(models)):
                rows = batch.filter(pa.array(models == model))
                raw = rows.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(rows.num_rows, -1)
                unit, ids, packed = _unit(raw), rows.column("id").cast(pa.binary()), _binary(raw)
                for ordering in range(fits[model].curves.orderings):
                    keys = fits[model].keys(unit, ordering)
                    at, part = fits[model].places(keys, ordering)
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(part), _binary(keys[at]), ids.take(take), packed.take(take)], names=["part", "place", "id", "packed"])

    return run


_LINKS = "model string, id binary, best array<struct<s:double,other:binary>>"


def _listed(model: str, ids: pa.Array, mine: np.ndarray, theirs: np.ndarray, scores: np.ndarray, k: int, others: pa.Array | None = None) -> pa.RecordBatch:
    """One row for each of `mine` (places in ids) with its best k: negative score and id, in order."""
    others = ids if others is None else others
    order = np.lexsort((theirs, -scores, mine))
    mine, theirs, scores = mine[order], theirs[order], scores[order]
    rank = np.arange(len(mine)) - np.searchsorted(mine, mine)
    mine, theirs, scores = mine[rank < k], theirs[rank < k], scores[rank < k]
    rows, counts = np.unique(mine, return_counts=True)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(-scores), others.take(pa.array(theirs))], names=["s", "other"])
    return pa.RecordBatch.from_arrays([pa.array([model] * len(rows), pa.string()), ids.take(pa.array(rows)), pa.ListArray.from_arrays(pa.array(offsets), pairs)], names=["model", "id", "best"])


_SPARE = 3  # further candidates taken by single precision before the exact products rank them
_SLACK = 1e-5  # more than the error of a product of unit vectors in single precision


def _windows(models: list[str], curves: Curves):
    """Along a sorted range, every vector's best k within its window."""

    def best(model: str, ids: pa.Array, unit: np.ndarray, first: int, last: int) -> pa.RecordBatch | None:
        narrow = unit.astype(np.float32)
        mine, theirs, scores = [], [], []
        for a in range(first, last, curves.block):
            b = min(last, a + curves.block)
            lo, hi = max(0, a - curves.window), min(len(unit), b + curves.window)
            near = narrow[a:b] @ narrow[lo:hi].T
            near[np.arange(b - a), np.arange(a - lo, b - lo)] = -np.inf
            k = min(curves.k + _SPARE, hi - lo - 1)
            if k < 1:
                continue
            found = np.flatnonzero(near >= np.float32(curves.min_score - _SLACK)) if curves.min_score > -1 else None
            if found is not None and len(found) <= k * (b - a):
                rows, cols = found // near.shape[1] + a, found % near.shape[1] + lo
            else:
                top = np.argpartition(near, near.shape[1] - k, axis=1)[:, -k:]
                rows, cols = np.repeat(np.arange(a, b), k), top.ravel() + lo
            exact = np.round((unit[rows] * unit[cols]).sum(axis=1), 9)
            keep = exact >= curves.min_score
            mine.append(rows[keep])
            theirs.append(cols[keep])
            scores.append(exact[keep])
        rows = np.concatenate(mine) if mine else np.empty(0, np.int64)
        return _listed(model, ids, rows, np.concatenate(theirs), np.concatenate(scores), curves.k) if len(rows) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ""
        ids: pa.Array | None = None
        unit: np.ndarray = np.empty((0, 0))
        done = 0  # rows of the buffer that only serve as neighbours of later ones

        def flush(final: bool):
            nonlocal ids, unit, done
            last = len(unit) if final else len(unit) - curves.window
            if ids is None or last <= done:
                return None
            out = best(model, ids, unit, done, last)
            keep = max(0, last - curves.window)
            ids, unit, done = ids.slice(keep), unit[keep:], last - keep
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            model = models[batch.column("part")[0].as_py()]
            rows = _unit(np.frombuffer(b"".join(batch.column("packed").to_pylist()), np.float32).reshape(batch.num_rows, -1))
            here = batch.column("id").cast(pa.binary())
            ids = here if ids is None else pa.concat_arrays([ids, here])
            unit = np.concatenate([unit, rows]) if len(unit) else rows
            if len(unit) >= 8 * curves.block + 2 * curves.window and (out := flush(False)) is not None:
                yield out
        if (out := flush(True)) is not None:
            yield out

    return run


def _curve_links(places: DataFrame, curves: Curves) -> DataFrame:
    """Lists of the best k of every distinct vector within its windows, one a range and ordering it lies in."""
    spark = places.sparkSession
    fits, models, parts = {}, [], 0
    for row in places.groupBy("model").count().orderBy("model").collect():  # one row a model
        model, n = row["model"], row["count"]
        share = F.lit(min(1.0, curves.sample / n) * float(1 << 30))
        drawn = places.filter((F.col("model") == model) & (F.pmod(F.xxhash64(F.lit(29), "id"), F.lit(1 << 30)) <= share)).select("id", "vector").limit(2 * curves.sample).collect()
        fits[model] = _Fit(_unit(np.array([r["vector"] for r in sorted(drawn, key=lambda r: r["id"])], np.float64)), n, curves, parts)
        models += [model] * (curves.orderings * fits[model].ranges)
        parts = len(models)
    if not fits:
        return spark.createDataFrame([], _LINKS)
    keyed = places.select("model", "id", "vector").repartition(task_count(spark, 2), "id").mapInArrow(_place(fits), _KEYED)
    return keyed.repartitionById(parts, F.col("part")).sortWithinPartitions("place", "id").mapInArrow(_windows(models, curves), _LINKS)


# Ids are the hashes' bytes; a hash in lower-case hex takes half its length.
def _id(name: str) -> Column:
    return F.when(F.col(name).rlike("^(?:[0-9a-f]{2})+$"), F.concat(F.lit(b"\x00"), F.unhex(name))).otherwise(F.concat(F.lit(b"\x01"), F.encode(name, "utf-8")))


def _hash(column: Column) -> Column:
    rest = F.substring(column, 2, 2_000_000_000)
    return F.when(F.hex(F.substring(column, 1, 1)) == "00", F.lower(F.hex(rest))).otherwise(F.decode(rest, "utf-8"))


class _Distinct:
    """Distinct vectors (`places`: model, id of the first copy, vector) and what is known of their copies.

    Vectors are equal if two 64-bit digests of them are. `lead` has of each
    vector with copies the first id, the number n and the first k + 1 ids,
    ranked with a limit in each task before the shuffle, so a large group of
    copies meets nowhere; `later` has the other ids with their first. Both are
    null if no vector has a copy.
    """

    def __init__(self, valid: DataFrame, k: int):
        digest = [F.xxhash64(F.lit(1), "vector").alias("d1"), F.xxhash64("vector", F.lit(2)).alias("d2")]
        rows = cut(valid.select("model", _id("content_hash").alias("id"), "vector", *digest))
        marked, group = rows.drop("vector"), ["model", "d1", "d2"]
        many = marked.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        rank = F.row_number().over(Window.partitionBy(*group).orderBy("id"))
        first = marked.withColumn("r", rank).filter(F.col("r") <= k + 1).groupBy(*group).agg(F.sort_array(F.collect_list("id")).alias("copies"))
        lead = cut(many.join(first, group).select("model", F.col("copies")[0].alias("least"), *group[1:], "n", "copies"))
        self.k, self.lead, self.later, self.places = k, None, None, rows.select("model", "id", "vector")
        if not lead.isEmpty():
            self.lead = lead
            self.later = cut(marked.join(lead.select(*group, "least"), group).filter("id <> least").select("model", "id", "least"))
            self.places = cut(self.places.join(self.later.select("model", "id"), ["model", "id"], "left_anti"))

    def lists(self, links: DataFrame) -> DataFrame:
        """model, id, best (negative score, id) of every entry from links of distinct vectors."""
        merged = links.groupBy("model", "id").agg(F.sort_array(F.flatten(F.collect_list("best"))).alias("best"))
        once = F.filter("best", lambda x, i: (i == 0) | (x != F.col("best")[F.greatest(i - 1, F.lit(0))]))
        distinct = merged.select("model", "id", F.slice(once, 1, self.k).alias("best"))
        if self.lead is None:
            return distinct
        copies = self.lead.select("model", "least", "n", "copies")
        pairs = distinct.select("model", "id", F.inline("best"))
        others = pairs.join(copies.select("model", F.col("least").alias("other"), F.slice("copies", 1, self.k).alias("with")), ["model", "other"], "left").select("model", "id", "s", F.explode(F.coalesce("with", F.array("other"))).alias("other"))
        few, full = copies.filter(F.col("n") <= self.k), copies.filter(F.col("n") > self.k)  # more copies than k fill their lists themselves
        mine = others.join(full.select("model", F.col("least").alias("id")), ["model", "id"], "left_anti").join(few.select("model", F.col("least").alias("id"), "copies"), ["model", "id"], "left").select("model", F.explode(F.coalesce("copies", F.array("id"))).alias("id"), "s", "other")
        members = copies.select("model", F.col("least").alias("id"), "copies").unionByName(self.later.join(copies, ["model", "least"]).select("model", "id", "copies"))
        among = members.select("model", "id", F.explode(F.slice(F.filter("copies", lambda x: x != F.col("id")), 1, self.k)).alias("other")).select("model", "id", F.lit(-1.0).alias("s"), "other")
        return mine.unionByName(among).groupBy("model", "id").agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "other"))), 1, self.k).alias("best"))


def _named(lists: DataFrame) -> DataFrame:
    return lists.select("model", "id", F.posexplode("best").alias("rank", "b")).select("model", _hash(F.col("id")).alias("content_hash"), _hash(F.col("b.other")).alias("other_hash"), (-F.col("b.s")).alias("score"), (F.col("rank") + 1).alias("rank"))


def similar_entries(valid: DataFrame, curves: Curves = Curves()) -> DataFrame:
    """model, content_hash, other_hash, score, rank: the best k of every valid entry with score (cosine) >= min_score.

    Scores are rounded to 9 decimals; ties are ranked by other_hash. Copies of
    a vector are entries like others. With a min_score the ranks stay those of
    the full lists, as entries left out score less than those kept.
    """
    distinct = _Distinct(valid, curves.k)
    return _named(distinct.lists(_curve_links(distinct.places, curves)))


def similar_pairs(entries: DataFrame, threshold: float = 0.85, curves: Curves = Curves()) -> DataFrame:
    """model, hash_a < hash_b: pairs of at least the threshold where one is among the other's best k."""
    from dataclasses import replace

    found = similar_entries(valid_entries(entries), replace(curves, min_score=threshold))
    return found.select("model", F.least("content_hash", "other_hash").alias("hash_a"), F.greatest("content_hash", "other_hash").alias("hash_b")).distinct()


def _block(models: list[str], k: int, tile_rows: int = 512, tile_cols: int = 8192):
    """A partition holds a block of queries and a block of all rows of one model: every query's exact best k of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by([("id", "ascending")])
        asked = rows.column("asked").to_numpy(zero_copy_only=False)
        if asked.all() or not asked.any():
            return
        unit = _unit(rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1))
        ids = rows.column("id").combine_chunks().cast(pa.binary())
        q, c = np.flatnonzero(asked), np.flatnonzero(~asked)
        own = {x: i for i, x in enumerate(ids.take(pa.array(c)).to_pylist())}
        self_at = np.array([own.get(x, -1) for x in ids.take(pa.array(q)).to_pylist()])
        narrow = unit.astype(np.float32)
        mine, theirs, scores = [], [], []
        for x in range(0, len(q), tile_rows):
            for y in range(0, len(c), tile_cols):
                qs, cs = q[x : x + tile_rows], c[y : y + tile_cols]
                near = narrow[qs] @ narrow[cs].T
                inside = np.flatnonzero((self_at[x : x + tile_rows] >= y) & (self_at[x : x + tile_rows] < y + len(cs)))
                near[inside, self_at[x + inside] - y] = -np.inf
                floor = np.partition(near, len(cs) - k, axis=1)[:, -k] - np.float32(2 * _SLACK) if len(cs) > k else np.full(len(qs), -2, np.float32)
                i, j = np.nonzero((near >= floor[:, None]) & (near > -2))
                crowded = np.bincount(i, minlength=len(qs)) > 64  # many nearly equal rows: all in double precision
                for r in np.flatnonzero(crowded):
                    exact = np.round((unit[cs] * unit[qs[r]]).sum(axis=1), 9)
                    exact[near[r] == -np.inf] = -np.inf
                    top = np.lexsort((cs, -exact))[:k]
                    mine.append(np.full(len(top), qs[r]))
                    theirs.append(cs[top])
                    scores.append(exact[top])
                i, j = i[~crowded[i]], j[~crowded[i]]
                mine.append(qs[i])
                theirs.append(cs[j])
                scores.append(np.round((unit[qs[i]] * unit[cs[j]]).sum(axis=1), 9))
        yield _listed(models[rows.column("part")[0].as_py()], ids, np.concatenate(mine), np.concatenate(theirs), np.concatenate(scores), k)

    return run


def _exact_links(queries: DataFrame, places: DataFrame, k: int, asked: int, rows: int) -> DataFrame:
    """Exact lists of a stated query set against all rows, blocks of queries by blocks of rows; nothing passes the driver."""
    counts = {r["model"]: r["count"] for r in places.groupBy("model").count().collect()}  # one row a model
    wide, high, first, models = {}, {}, {}, []
    for r in queries.groupBy("model").count().orderBy("model").collect():
        m = r["model"]
        high[m], wide[m], first[m] = max(1, math.ceil(r["count"] / asked)), max(1, math.ceil(counts[m] / rows)), len(models)
        models += [m] * (high[m] * wide[m])
    if not models:
        return places.sparkSession.createDataFrame([], _LINKS)
    of = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("model")]
    at = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    part = (of(first) + F.col("q") * of(wide) + F.col("c")).alias("part")
    sent = queries.withColumns({"q": at(of(high)), "c": F.explode(F.sequence(F.lit(0), of(wide) - 1)), "asked": F.lit(True)}).unionByName(
        places.filter(of(wide).isNotNull()).withColumns({"c": at(of(wide)), "q": F.explode(F.sequence(F.lit(0), of(high) - 1)), "asked": F.lit(False)})
    )
    return sent.select(part, "id", "vector", "asked").repartitionById(len(models), F.col("part")).mapInArrow(_block(models, k), _LINKS)


def recall_report(entries: DataFrame, curves: Curves = Curves(), every: int = 50, asked: int = 4096, rows: int = 65_536) -> DataFrame:
    """Per model: queries, exact links, links found, recall, and the mean loss of score.

    Queries are the valid entries whose id (xxhash64 of model and hash) is
    divisible by `every`; they are compared with all entries in blocks of
    `asked` queries by `rows` rows.
    """
    distinct = _Distinct(valid_entries(entries), curves.k)
    ident = F.pmod(F.xxhash64("model", "id"), F.lit(every)) == 0
    wanted = distinct.places.filter(ident).select("model", "id")
    if distinct.later is not None:
        wanted = wanted.unionByName(distinct.later.filter(ident).select("model", F.col("least").alias("id"))).distinct()
    queries = cut(distinct.places.join(wanted, ["model", "id"], "left_semi"))
    links = lambda x: distinct.lists(x).filter(ident).select("model", "id", F.inline("best"))
    truth, got = cut(links(_exact_links(queries, distinct.places, curves.k, asked, rows))), cut(links(_curve_links(distinct.places, curves)))
    t = truth.groupBy("model", "id").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("s")).groupBy("model").agg(F.count(F.lit(1)).alias("queries"), F.sum("n").alias("exact_links"), (-F.sum("s")).alias("exact_sum"))
    hit = truth.join(got.select("model", "id", "other"), ["model", "id", "other"]).groupBy("model").agg(F.count(F.lit(1)).alias("found_links"))
    g = got.groupBy("model").agg((-F.sum("s")).alias("found_sum"))
    return t.join(hit, "model", "left").join(g, "model", "left").select(
        "model", "queries", "exact_links", F.coalesce("found_links", F.lit(0)).alias("found_links"), F.round(F.coalesce("found_links", F.lit(0)) / F.col("exact_links"), 4).alias("recall"), F.round((F.col("exact_sum") - F.coalesce("found_sum", F.lit(0.0))) / F.col("exact_links"), 6).alias("mean_loss")
    )
