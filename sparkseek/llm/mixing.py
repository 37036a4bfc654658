"""Mixing documents of several sources to target shares of tokens.

Sizes are tokens of a public tokenizer. A softmax classifier, fitted on a bounded
sample of labelled rows, gives every document posteriors over the sources. Rates
(how often a document is used, between 0 and its source's cap) are then fitted by
least squares: token totals by stated source must match the targets, and expected
totals under the posteriors should. The fit is a projected-gradient method in its
lazy form: a document's rate is the projection of a linear function of one small
vector, so tasks hold no state. Each step is one pass that tries several step
lengths at once and returns sums, among them the curvature that preconditions the
next step. Rates become whole copies by dithering with a hash, shifted per source
until the totals fit.
"""

from __future__ import annotations

import base64
import math
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from ..operators.codefiles import spread

MAX_TARGETS = 10_000
DAMPINGS = (1e-7, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0)  # of the steps that one pass tries


@dataclass(frozen=True)
class Mix:
    """tokenizer: a .tiktoken rank file on the driver, from where it goes to the
    executors; sample_rows and sample_chars bound what the classifier is fitted
    on; it is applied to whole texts.

    total_tokens is the size of the mix; by default the largest at which no cap
    keeps a source from its share. soft_weight weighs the expected totals
    against the stated ones.
    """

    tokenizer: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    sample_rows: int = 8192
    sample_chars: int = 20_000
    features: int = 2048
    total_tokens: float | None = None
    soft_weight: float = 1e-3
    steps: int = 5
    tolerance: float = 0.01
    rounds: int = 80


# Fixed value: the split pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken
    from pyspark import SparkFiles

    with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as ranks:
        merges = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


_WORDS = re.compile(r"\w+|[#>`\-:!?.]+")


class _Places(dict):
    """The feature of a word; those of recurring ones are kept."""

    def __init__(self, size: int):
        self.size = size

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        place = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % (self.size - 8)
        return place


_PLACES = lru_cache(maxsize=4)(_Places)


def _features(text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the hashed words and layout marks of a text, log-scaled and of unit length."""
    table = _PLACES(size)
    places, counts = np.unique(np.array([table[w] for w in _WORDS.findall(text.lower())], np.int64), return_counts=True)
    first = text.split("\n", 1)[0]
    marks = [bool(re.match(r"[a-z]+(\([^)]*\))?: ", first)), first.startswith("#"), "```" in text, "\n- " in text or text.startswith("- "), "\n> " in text, len(text) > 800, len(text) < 200, "?" in text]
    values = np.concatenate([np.log1p(counts), np.array(marks, np.float64)])
    return np.concatenate([places, np.arange(size - 8, size)]), (values / max(1e-6, math.sqrt(float(values @ values)))).astype(np.float32)


def _dense(texts: list[str], size: int) -> np.ndarray:
    out = np.zeros((len(texts), size), np.float32)
    for row, text in zip(out, texts):
        places, values = _features(text, size)
        row[places] = values
    return out


class SourceClassifier:
    """Softmax regression on hashed features, fitted by full-batch gradient descent with momentum."""

    def __init__(self, labels: list[str], size: int):
        self.labels, self.size = labels, size
        self.weights, self.bias = np.zeros((size, len(labels)), np.float32), np.zeros(len(labels), np.float32)

    def fit(self, texts: list[str], labels: list[str], rounds: int = 80, rate: float = 4.0, decay: float = 1e-4) -> SourceClassifier:
        x = _dense(texts, self.size)
        index = {s: i for i, s in enumerate(self.labels)}
        y = np.zeros((len(labels), len(self.labels)), np.float32)
        y[np.arange(len(labels)), [index[s] for s in labels]] = 1
        vw, vb = np.zeros_like(self.weights), np.zeros_like(self.bias)
        for _ in range(rounds if len(labels) else 0):
            error = (self._softmax(x) - y) / len(labels)
            vw = 0.9 * vw - rate * (x.T @ error + decay * self.weights)
            vb = 0.9 * vb - rate * error.sum(axis=0)
            self.weights += vw
            self.bias += vb
        return self

    def _softmax(self, x: np.ndarray) -> np.ndarray:
        return self._normal(x @ self.weights + self.bias)

    @staticmethod
    def _normal(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def posteriors(self, texts: list[str]) -> np.ndarray:
        z = np.zeros((len(texts), len(self.labels)))
        for row, text in zip(z, texts):
            places, values = _features(text, self.size)
            row[:] = values @ self.weights[places] + self.bias
        return self._normal(z)


def normal_source(column):
    """A source trimmed and in lower case."""
    return F.lower(F.trim(column))


def targeted(documents: DataFrame, targets: DataFrame) -> tuple[DataFrame, list[dict]]:
    """Documents of sources that have a target (doc_id, source, text), and the targets with their sources' spelling evened.

    The targets are a stated table, read to the driver behind a check of its
    size; of several targets of one source that with the least (share, cap) holds. A null
    share counts as 0, a null cap as 1.
    """
    spelled = targets.select(normal_source("source").alias("source"), F.struct(F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("cap")).alias("v")).dropna(subset=["source"])
    rows = spelled.groupBy("source").agg(F.min("v").alias("v")).select("source", "v.share", "v.cap").orderBy("source").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    wanted = [r.asDict() for r in rows]
    docs = documents.select("doc_id", normal_source("source").alias("source"), "text").dropna(subset=["doc_id", "source", "text"])
    names = [r["source"] for r in wanted]
    return docs.filter(F.col("source").isin(names) if names else F.lit(False)), wanted


def labelled_sample(docs: DataFrame, mix: Mix) -> list[tuple[str, str]]:
    """At most sample_rows (text, source) pairs, those least in a hash of their id, texts cut at sample_chars.

    A bound on the hash, set by the number of documents, lets about as many
    rows through as are wanted, so no more texts than those leave the tasks.
    """
    total = docs.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    bound = min(1.0, (mix.sample_rows + 4 * math.sqrt(mix.sample_rows)) / max(1, total)) * float(1 << 40)
    near = docs.select(place.alias("place"), "doc_id", F.substring("text", 1, mix.sample_chars).alias("text"), "source").filter(F.col("place") < F.lit(bound))
    picked = near.limit(2 * mix.sample_rows).collect()
    return [(r["text"], r["source"]) for r in sorted(picked, key=lambda r: (r["place"], r["doc_id"], r["source"], r["text"]))[: mix.sample_rows]]


def sized(docs: DataFrame, labels: list[str], model: SourceClassifier, mix: Mix) -> DataFrame:
    """doc_id, source, slot (place of the source among labels), tokens, posterior, dither of every document with tokens."""
    place = {s: i for i, s in enumerate(labels)}

    path = mix.tokenizer
    if os.path.exists(path):
        docs.sparkSession.sparkContext.addFile(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(path)
        for pdf in batches:
            texts = pdf["text"].tolist()
            out = pdf[["doc_id", "source", "dither"]].copy()
            out["slot"] = [place[s] for s in pdf["source"]]
            out["tokens"] = [len(encoding.encode_ordinary(t)) for t in texts]
            out["posterior"] = [p.tobytes() for p in model.posteriors(texts)]
            yield out

    ready = docs.withColumn("dither", (F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40)))
    return spread(ready).mapInPandas(run, "doc_id long, source string, dither double, slot int, tokens long, posterior binary").filter("tokens > 0")


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """slot, tokens, posteriors (a row a document) and dither of a batch of the sized table."""
    n = batch.num_rows
    flat = b"".join(batch.column("posterior").to_pylist())
    return batch.column("slot").to_numpy(), batch.column("tokens").to_numpy().astype(np.float64), np.frombuffer(flat, np.float64).reshape(n, -1), batch.column("dither").to_numpy()


def _passes(table: DataFrame, size: int, work) -> np.ndarray:
    """The sum over all rows of a vector that `work` computes for a batch; partial sums are added in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += work(*_columns(batch))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "part"])

    rows = table.select("slot", "tokens", "posterior", "dither").coalesce(table.sparkSession.sparkContext.defaultParallelism)
    sums = rows.mapInArrow(run, "at int, part double").groupBy("at").agg(F.sum("part").alias("total")).collect()  # `size` rows
    out = np.zeros(size)
    for r in sums:
        out[r["at"]] = r["total"]
    return out


def _rates(force: np.ndarray, start: np.ndarray, caps: np.ndarray, slot: np.ndarray, posterior: np.ndarray) -> np.ndarray:
    n = len(caps)
    return np.clip(start[slot] + force[:n][slot] + posterior @ force[n:], 0.0, caps[slot])


def fit_rates(table: DataFrame, goal: np.ndarray, have: np.ndarray, caps: np.ndarray, mix: Mix) -> tuple[np.ndarray, np.ndarray]:
    """The small vector that fixes all rates, and the rates it starts from (those that fit the stated totals alone)."""
    n = len(goal)
    start = np.divide(goal, have, out=np.zeros(n), where=have > 0)
    weight = np.concatenate([np.ones(n), np.full(n, mix.soft_weight)])
    scale = max(1.0, float(goal.sum()))
    width = 2 * n + 4 * n * n
    tries, best = [np.zeros(2 * n)], (np.inf, np.zeros(2 * n))
    for _ in range(mix.steps if mix.soft_weight > 0 else 0):

        def work(slot, tokens, posterior, _dither, tries=tuple(tries)):
            out = np.zeros((len(tries), width))
            m = np.zeros((len(slot), 2 * n))
            m[np.arange(len(slot)), slot] = 1
            m[:, n:] = posterior
            for row, force in zip(out, tries):
                rate = _rates(force, start, caps, slot, posterior)
                free = (rate > 0) & (rate < caps[slot])
                row[: 2 * n] = m.T @ (tokens * rate)
                row[2 * n :] = ((m * (tokens * free)[:, None]).T @ m).ravel()
            return out.ravel()

        sums = _passes(table, len(tries) * width, work).reshape(len(tries), width)
        gaps = (sums[:, : 2 * n] - np.concatenate([goal, goal])) / scale
        losses = (weight * gaps * gaps).sum(axis=1)
        b = int(losses.argmin())
        if not losses[b] < best[0]:
            break
        better = best[0] - losses[b]
        best = (losses[b], tries[b])
        if better < mix.tolerance * losses[b]:
            break
        jacobian = np.sqrt(weight)[:, None] * sums[b, 2 * n :].reshape(2 * n, 2 * n) / scale
        bent, slope = jacobian.T @ jacobian, jacobian.T @ (np.sqrt(weight) * gaps[b])
        damp = max(1e-12, float(np.trace(bent)) / (2 * n))
        tries = [best[1] - np.linalg.solve(bent + d * damp * np.eye(2 * n), slope) for d in DAMPINGS]
    return best[1], start


def whole_copies(table: DataFrame, force: np.ndarray, start: np.ndarray, caps: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """A shift of the rates per source at which rounded copies come closest to the stated totals."""
    n, grid = len(goal), 65
    low, high = -np.ones(n), np.ones(n)
    for _ in range(3):
        shifts = low + (high - low) * np.arange(grid)[:, None] / (grid - 1)

        def work(slot, tokens, posterior, dither, shifts=shifts):
            rate = _rates(force, start, caps, slot, posterior)
            out = np.zeros((grid, n))
            for g in range(grid):
                copies = np.minimum(np.floor(np.clip(rate + shifts[g][slot], 0, None) + dither), caps[slot])
                out[g] = np.bincount(slot, weights=copies * tokens, minlength=n)
            return out.ravel()

        totals = _passes(table, grid * n, work).reshape(grid, n)
        nearest = np.abs(totals - goal).argmin(axis=0)
        width = (high - low) / (grid - 1)
        centre = shifts[nearest, np.arange(n)]
        low, high = centre - width, centre + width
    return centre


@dataclass(frozen=True)
class _Mixed:
    """A fitted mix: the targets, and what turns the sized documents into copies."""

    wanted: list[dict]
    table: DataFrame
    force: np.ndarray
    start: np.ndarray
    caps: np.ndarray
    shift: np.ndarray

    def copies(self) -> DataFrame:
        apply = _copier(self.force, self.start, self.caps, self.shift)
        return self.table.mapInArrow(apply, "doc_id long, source string, tokens long, rate double, copies int")

    def expected(self) -> np.ndarray:
        """The tokens used of each domain, by the documents' posteriors."""
        force, start, caps, shift = self.force, self.start, self.caps, self.shift

        def work(slot, tokens, posterior, dither):
            rate = _rates(force, start, caps, slot, posterior)
            used = tokens * np.minimum(np.floor(np.clip(rate + shift[slot], 0, None) + dither), caps[slot])
            return used @ posterior

        return _passes(self.table, len(self.wanted), work)


def _copier(force: np.ndarray, start: np.ndarray, caps: np.ndarray, shift: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            slot, _, posterior, dither = _columns(batch)
            rate = _rates(force, start, caps, slot, posterior)
            copies = np.minimum(np.floor(np.clip(rate + shift[slot], 0, None) + dither), caps[slot])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("tokens"), pa.array(rate), pa.array(copies.astype(np.int32))], names=["doc_id", "source", "tokens", "rate", "copies"])

    return run


def _plan(documents: DataFrame, targets: DataFrame, mix: Mix) -> tuple[list[dict], _Mixed | None]:
    docs, wanted = targeted(documents, targets)
    labels = [r["source"] for r in wanted]
    if not labels:
        return wanted, None
    sample = labelled_sample(docs, mix)
    model = SourceClassifier(labels, mix.features).fit([t for t, _ in sample], [s for _, s in sample], mix.rounds)
    table = cut(sized(docs, labels, model, mix))
    n = len(labels)
    have = np.zeros(n)
    for r in table.groupBy("slot").agg(F.sum("tokens").alias("tokens")).collect():  # a row a target
        have[r["slot"]] = r["tokens"]
    caps = np.array([max(0, r["cap"]) for r in wanted], np.float64)
    share = np.array([max(0.0, r["share"]) for r in wanted]) * (have > 0) * (caps > 0)
    share = share / share.sum() if share.sum() > 0 else share
    limits = [caps[i] * have[i] / share[i] for i in range(n) if share[i] > 0]
    size = mix.total_tokens if mix.total_tokens is not None else min(limits, default=0.0)
    goal = share * size
    force, start = fit_rates(table, goal, have, caps, mix)
    return wanted, _Mixed(wanted, table, force, start, caps, whole_copies(table, force, start, caps, goal))


def mixed_documents(documents: DataFrame, targets: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The documents of the mix: doc_id, source, tokens, rate, copies (at least 1, at most the source's cap).

    Sources without a target are left out, as are documents without tokens.
    With no targets or no documents the mix is empty.
    """
    _, mixed = _plan(documents, targets, mix)
    if mixed is None:
        return documents.sparkSession.createDataFrame([], "doc_id long, source string, tokens long, rate double, copies int")
    return mixed.copies().filter("copies > 0")


def reached_shares(documents: DataFrame, targets: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row a target: source, target_share, aim (the share among sources that have documents), documents, tokens, used_tokens, share, most_copies, max_repeats, expected_share.

    expected_share is the share of the used tokens that the posteriors give to the domain.
    """
    spark = documents.sparkSession
    wanted, mixed = _plan(documents, targets, mix)
    expected = mixed.expected() if mixed else np.zeros(len(wanted))
    expected = np.round(expected / max(1.0, expected.sum()), 6).tolist()
    schema = "source string, target_share double, max_repeats int, expected_share double"
    stated = spark.createDataFrame([(r["source"], float(r["share"]), int(r["cap"]), e) for r, e in zip(wanted, expected)], schema)
    plan = mixed.copies() if mixed else spark.createDataFrame([], "doc_id long, source string, tokens long, rate double, copies int")
    used = plan.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    joined = stated.join(used, "source", "left").fillna(0, ["documents", "tokens", "used_tokens", "most_copies"])
    every = Window.partitionBy(F.lit(0))  # the table of targets is one bounded group
    summed = joined.withColumns({"all_used": F.sum("used_tokens").over(every), "all_aims": F.sum(F.when(F.col("tokens") > 0, F.col("target_share")).otherwise(0.0)).over(every)})
    return summed.select(
        "source", "target_share", F.round(F.when((F.col("tokens") > 0) & (F.col("all_aims") > 0), F.col("target_share") / F.col("all_aims")).otherwise(0.0), 6).alias("aim"), "documents", "tokens", "used_tokens",
        F.round(F.when(F.col("all_used") > 0, F.col("used_tokens") / F.col("all_used")).otherwise(0.0), 6).alias("share"), "most_copies", "max_repeats", "expected_share",
    )


def classifier_report(documents: DataFrame, targets: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Held-out accuracy of the classifier: it is fitted on four fifths of the bounded sample and judged on the rest."""
    docs, wanted = targeted(documents, targets)
    sample = labelled_sample(docs, mix)
    held, seen = [p for i, p in enumerate(sample) if i % 5 == 0], [p for i, p in enumerate(sample) if i % 5]
    labels = [r["source"] for r in wanted]
    rows = []
    if seen and held:
        model = SourceClassifier(labels, mix.features).fit([t for t, _ in seen], [s for _, s in seen], mix.rounds)
        posterior = model.posteriors([t for t, _ in held])
        truth = np.array([labels.index(s) for _, s in held])
        majority = np.bincount([labels.index(s) for _, s in seen]).argmax()
        loss = float(-np.log(np.maximum(posterior[np.arange(len(truth)), truth], 1e-12)).mean())
        rows.append((len(seen), len(held), round(float((posterior.argmax(axis=1) == truth).mean()), 4), round(float((truth == majority).mean()), 4), round(loss, 4)))
    return documents.sparkSession.createDataFrame(rows, "fitted int, held_out int, accuracy double, majority double, log_loss double")
