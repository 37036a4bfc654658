"""Evaluation texts inside documents, by the q-gram lemma and banded alignment.

Both sides are reduced to their letters and digits in lower case (words joined
by one blank; items in Chinese or Japanese script without blanks). A document
that holds a stretch of `length` characters of an item with at most `edits`
edits shares at least length - q + 1 - q * edits of its q-grams, all within a
band of 2 * edits + 1 diagonals. Q-gram hits are counted in overlapping bands of
diagonals; bands that meet the bound are aligned within the band, and the
aligned region is judged.

The items are a stated, bounded query set: they are indexed on the driver in
blocks of at most `block_chars` characters and sent to the tasks; documents are
only scanned, never shuffled.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.codefiles import spread

_WORD = re.compile(r"[^\W_]+")
_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ]")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 22
_CHARS, _HITS = 1 << 20, 1 << 22


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case."""
    return _WORD.findall(text.lower()) if text else []


@dataclass(frozen=True)
class Settings:
    """min_words consecutive words (min_chars letters for Chinese and Japanese) make a leak."""

    min_words: int = 12
    min_chars: int = 20
    q_spaced: int = 10
    q_dense: int = 6
    edits: int = 2
    block_chars: int = 4_000_000


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, dtype=np.uint64)
        for k in range(q):
            out = out * _BASE + codes[k : k + n].astype(np.uint64) + np.uint64(1)
        return out ^ (out >> np.uint64(29))


class _Index:
    """Q-grams of the items of one form (spaced or dense) with their postings."""

    def __init__(self, items: list[tuple[int, list[str]]], dense: bool, s: Settings):
        self.dense, self.q = dense, s.q_dense if dense else s.q_spaced
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        self.texts = [("" if dense else " ").join(w) for _, w in items]
        self.edits, self.need, self.runs, self.length = [], [], [], []
        for text, words in zip(self.texts, self.words):
            if dense:
                length = s.min_chars
                runs = {text[k : k + length] for k in range(len(text) - length + 1)}
            else:
                windows = [" ".join(words[k : k + s.min_words]) for k in range(len(words) - s.min_words + 1)]
                length = min(map(len, windows), default=0)
                runs = set(windows)
            edits = max(0, min(s.edits, (length - self.q) // (2 * self.q)))
            self.edits.append(edits)
            self.need.append(max(1, length - self.q + 1 - self.q * edits) if runs else 1 << 30)
            self.runs.append(runs)
            self.length.append(length)
        self.codes = [_codes(t) for t in self.texts]
        hashes = [_gram_hashes(c, self.q) for c in self.codes]
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        item = np.concatenate([np.full(len(h), k, np.int32) for k, h in enumerate(hashes)]) if hashes else np.empty(0, np.int32)
        place = np.concatenate([np.arange(len(h), dtype=np.int32) for h in hashes]) if hashes else np.empty(0, np.int32)
        order = np.argsort(flat, kind="stable")
        self.item, self.place = item[order], place[order]
        self.grams, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.table[(self.grams >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        self.least, self.needs = min(self.need, default=1 << 30), np.array(self.need, np.int64)
        self.longest = max(map(len, self.texts), default=0)


class _Band(NamedTuple):
    """A stretch of a document to be aligned with an item on diagonals low..high (item place less document place)."""

    doc: np.ndarray
    item: np.ndarray
    low: int
    high: int
    start: int
    stop: int


_CELLS = 1 << 14  # of one step of a batch of alignments
_EDIT_BITS = 24
_NO_DOC, _NO_ITEM = np.uint32(0xFFFFFFFF), np.uint32(0xFFFFFFFE)


def _align(bands: list[_Band], penalty: int) -> np.ndarray:
    """Best local alignment of each band: rows of score, document start and end, edits.

    A match counts 1, an edit -penalty; of equal ones the first holds. Bands of
    like size are worked off together, one document character a step.
    """
    out = np.zeros((len(bands), 4), np.int64)
    order = sorted(range(len(bands)), key=lambda i: (bands[i].high - bands[i].low, bands[i].stop - bands[i].start))
    at = 0
    while at < len(order):
        n = max(1, _CELLS // (bands[order[at]].high - bands[order[at]].low + 1))
        part = order[at : at + n]
        out[part] = _align_together([bands[i] for i in part], penalty)
        at += n
    return out


def _align_together(bands: list[_Band], penalty: int) -> np.ndarray:
    """_align of one batch; its bands are columns, the longest first, so that those which have ended can be left out."""
    n = len(bands)
    lengths = np.array([b.stop - b.start for b in bands])
    turn = np.argsort(-lengths, kind="stable")
    bands, lengths = [bands[i] for i in turn], lengths[turn]
    width, length = max(b.high - b.low + 1 for b in bands), int(lengths[0])
    doc, item = np.full((length, n), _NO_DOC, np.uint32), np.full((length + width, n), _NO_ITEM, np.uint32)
    for i, b in enumerate(bands):
        doc[: b.stop - b.start, i] = b.doc[b.start : b.stop]
        first = b.start + b.low  # the item's place on the lowest diagonal
        lo, hi = max(0, first), min(len(b.item), b.stop + b.high)
        if hi > lo:
            item[lo - first : hi - first, i] = b.item[lo:hi]
    outside = np.arange(width)[:, None] > np.array([b.high - b.low for b in bands])[None, :]
    score = np.zeros((width + 1, n), np.int32)  # a last row without diagonal stays 0
    trace = np.zeros((width + 1, n), np.int64)  # where the alignment begins, and its edits in the low bits
    best, columns = np.zeros((n, 4), np.int64), np.arange(n)
    for t, m in enumerate(np.searchsorted(-lengths, -np.arange(length), side="left").tolist()):
        there, s, old = item[t : t + width, :m], score[:, :m], trace[:, :m]
        same = there == doc[t, :m]
        now = s[:width] + np.where(same, 1, -penalty)
        p = old[:width] + ~same
        np.copyto(p, t << _EDIT_BITS, where=same & (s[:width] == 0))
        up = s[1:] - penalty  # a document character without partner
        better = up > now
        np.copyto(now, up, where=better)
        np.copyto(p, old[1:] + 1, where=better)
        never = (there == _NO_ITEM) | outside[:, :m]
        now[never] = 0
        for k in range(1, width):  # an item character without partner
            left = now[k - 1] - penalty
            better = (left > now[k]) & (left > 0) & ~never[k]
            if better.any():
                np.copyto(now[k], left, where=better)
                np.copyto(p[k], p[k - 1] + 1, where=better)
        np.maximum(now, 0, out=now)
        s[:width], old[:width] = now, p
        top = now.argmax(axis=0)
        reached = now[top, columns[:m]]
        more = np.flatnonzero(reached > best[:m, 0])
        if len(more):
            which = p[top[more], more]
            best[more] = np.stack([reached[more], which >> _EDIT_BITS, np.full(len(more), t + 1), which & ((1 << _EDIT_BITS) - 1)], axis=1)
    best[:, 1:3] += np.array([b.start for b in bands])[:, None]
    out = np.empty_like(best)
    out[turn] = best
    return out


def _scan(texts: list[str], index: _Index, s: Settings) -> list[tuple[int, int, int, int, int, bool]]:
    """(document, item, start, end, edits, exact) of the aligned regions; start and end in the reduced text."""
    sep = "\x00" * index.q
    starts = np.cumsum([0] + [len(t) + index.q for t in texts])
    hashes = _gram_hashes(_codes(sep.join(texts) + sep), index.q)
    if not len(hashes) or not len(index.grams):
        return []
    maybe = np.flatnonzero(index.table[(hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
    slot = np.searchsorted(index.grams, hashes[maybe])
    slot[slot == len(index.grams)] = 0
    hit = index.grams[slot] == hashes[maybe]
    maybe, slot = maybe[hit], slot[hit]
    if not len(maybe):
        return []
    doc_of = np.searchsorted(starts, maybe, side="right") - 1
    enough = (np.bincount(doc_of, minlength=len(texts)) >= index.least)[doc_of]
    maybe, slot, doc_of = maybe[enough], slot[enough], doc_of[enough]
    codes, out = _codes(sep.join(texts)), []
    load = np.cumsum(index.count[slot]) // _HITS  # documents are worked off together, up to so many places in items
    cuts = np.searchsorted(doc_of, doc_of[np.flatnonzero(np.diff(load)) + 1]) if len(load) else []
    for a, b in itertools.pairwise([0, *sorted(set(cuts) - {0}), len(slot)]):
        if a < b:
            out += _judge(texts, codes, starts, maybe[a:b], slot[a:b], doc_of[a:b], index, s)
    return out


def _judge(texts: list[str], codes: np.ndarray, starts: np.ndarray, found: np.ndarray, slot: np.ndarray, doc_of: np.ndarray, index: _Index, s: Settings) -> list[tuple[int, int, int, int, int, bool]]:
    """The aligned regions of documents from the places of their q-grams in the items."""
    counts = index.count[slot]
    base = np.repeat(index.first[slot] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
    pair = np.repeat(doc_of, counts) * len(index.ids) + index.item[base]  # of document and item
    order = np.argsort(pair, kind="stable")
    pair, at = pair[order], np.repeat(found - starts[doc_of], counts)[order]
    diagonal = index.place[base][order].astype(np.int64) - at
    step = max(1, s.edits)
    shift = max(map(len, texts)) // step + 2  # makes the numbers of bands positive
    span = shift + index.longest // step + 2
    uniq, n = np.unique(pair * span + diagonal // step + shift, return_counts=True)  # bands [k, k + 2) of steps overlap by half
    both = n + np.append(np.where(uniq[1:] == uniq[:-1] + 1, n[1:], 0), 0)
    kept = uniq[both >= index.needs[uniq // span % len(index.ids)]]
    regions: list[tuple[int, int, int, int]] = []  # document, item and stretch of each group of diagonals that meets the bound
    runs: dict[int, tuple[int, int, int]] = {}
    bands: list[_Band | None] = []
    groups = np.split(kept, np.flatnonzero(np.diff(kept) > 1) + 1) if len(kept) else []  # overlapping bands are aligned as one
    begins, ends = (np.searchsorted(pair, [int(g[0]) // span + i for g in groups]) for i in (0, 1))
    for group, a, b in zip(groups, begins, ends):
        d, k = divmod(int(group[0]) // span, len(index.ids))
        low = (int(group[0]) % span - shift) * step - index.edits[k]
        high = (int(group[-1]) % span - shift + 2) * step - 1 + index.edits[k]
        inside = (diagonal[a:b] >= low) & (diagonal[a:b] <= high)
        hits, on, least = np.unique(at[a:b][inside]), diagonal[a:b][inside], index.need[k]
        if len(hits) < least or (hits[least - 1 :] - hits[: len(hits) - least + 1]).min() > index.length[k] - index.q + index.edits[k]:
            continue  # the bound must be met within one stretch of the passage's length
        near, far, first, last = (int(v) for v in (on.min(), on.max(), hits[0], hits[-1]))
        lo, hi = max(0, first - index.q), min(len(texts[d]), last + 2 * index.q)
        if near == far and last - first + 1 == len(hits):  # one unbroken run: an edit costs more than the q - 1 characters next to it can give
            runs[len(regions)] = (first, last + index.q, 0)
            bands.append(None)
        else:
            bands.append(_Band(codes[starts[d] : starts[d] + len(texts[d])], index.codes[k], near - index.edits[k], far + index.edits[k], lo, hi))
        regions.append((d, k, lo, hi))
    for i, (_, x, y, edits) in zip([i for i, b in enumerate(bands) if b], _align([b for b in bands if b], index.q).tolist()):
        runs[i] = (x, y, edits)
    out = []
    for i, (d, k, lo, hi) in enumerate(regions):
        x, y, edits = runs[i]
        if y - x >= index.length[k] - index.edits[k]:
            out.append((d, k, x, y, edits, _exact(texts[d], x, y, index, k, s) or _exact(texts[d], lo, hi, index, k, s)))
    return out


def _exact(text: str, x: int, y: int, index: _Index, k: int, s: Settings) -> bool:
    """Whether the region, to whole words, holds enough consecutive words (letters) of the item."""
    runs = index.runs[k]
    if index.dense:
        x, y = max(0, x - s.min_chars), min(len(text), y + s.min_chars)
        return any(text[i : i + s.min_chars] in runs for i in range(x, y - s.min_chars + 1))
    x = text.rfind(" ", 0, max(0, x - 1)) + 1
    y = text.find(" ", y + 1)
    words = text[x : y if y >= 0 else len(text)].split(" ")
    return any(" ".join(words[i : i + s.min_words]) in runs for i in range(len(words) - s.min_words + 1))


LEAK_SCHEMA = "doc_id long, item_id long, matched_chars int, edits int, exact boolean"


@lru_cache(maxsize=2)
def _indexes(items: tuple[tuple[int, str], ...], s: Settings) -> list[_Index]:
    """Indexes of the items with and without blanks; kept by a worker for its next task."""
    spaced, dense = [], []
    for item_id, text in items:
        words = words_of(text)
        cjk = len(_CJK.findall(text))
        (dense if cjk > sum(map(len, words)) / 4 else spaced).append((item_id, words))
    return [_Index(spaced, False, s), _Index(dense, True, s)]


def _scanner(items: list[tuple[int, str]], s: Settings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        indexes = _indexes(tuple(items), s)
        for pdf in batches:
            found: dict[tuple[int, int], tuple[int, int, bool]] = {}
            sizes = np.cumsum(pdf["text"].str.len().to_numpy()) // _CHARS  # rows are scanned together, about so many characters at a time
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(pdf)]
            for a, b in zip(cuts, cuts[1:]):
                ids = pdf["doc_id"].iloc[a:b].tolist()
                words = [words_of(t) for t in pdf["text"].iloc[a:b]]
                for index in indexes:
                    texts = ["".join(w) for w in words] if index.dense else [" ".join(w) for w in words]
                    for d, k, x, y, edits, exact in _scan(texts, index, s):
                        key, now = (ids[d], index.ids[k]), (y - x, edits, exact)
                        old = found.get(key)
                        if old is None or (now[2], now[0], -now[1]) > (old[2], old[0], -old[1]):
                            found[key] = now
            yield pd.DataFrame([(*k, *v) for k, v in found.items()], columns=["doc_id", "item_id", "matched_chars", "edits", "exact"])

    return run


def leaked_items(documents: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Document and item pairs that share a passage: doc_id, item_id, matched_chars, edits, exact.

    matched_chars and edits describe the best aligned region in the reduced
    text; exact tells whether it, or another place on its diagonals, holds the
    full number of consecutive words (letters) unchanged. Null or empty texts on either side share nothing; an
    item too short for a passage can't leak; repeated document rows with one
    doc_id give one row per pair.
    """
    stated = items.select("item_id", "text").dropna().distinct()
    size = stated.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / settings.block_chars))
    ready = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").dropna())
    found = None
    for b in range(blocks):
        rows = stated.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # one bounded block of the query set
        part = ready.mapInPandas(_scanner(sorted((r["item_id"], r["text"]) for r in rows), settings), LEAK_SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("exact", "matched_chars", "edits")).alias("v")).select("doc_id", "item_id", "v.matched_chars", "v.edits", "v.exact")
