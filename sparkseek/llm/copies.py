"""Records that are equal up to formatting: Merkle-style hashing of nested records.

A content is a tree: object literals, interface bodies and JSON objects are
nodes whose members may stand in any order, everything else is ordered. Leaves
are reduced to their letters and digits in lower case. A member's digest is
taken over its parts in order, an unordered node's over its members' digests
sorted, the root's over the whole. Records are grouped by root digest and, for
the full comparison, by the canonical text written out in the same order.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..operators.codefiles import task_count
from ..syntax.lexers import Tokens, lex_js

_ALNUM = re.compile(r"[^\W_]+")
# What stands before a brace that opens an object literal or an object type.
_BEFORE_OBJECT = frozenset("= ( , [ : ? && || ?? ... return default yield await => |".split()) | {"&", "as", "satisfies"}
_MEMBER_START = frozenset(["STR", "NUM", "[", "...", "PRIVATE"])
_AFTER_NAME = frozenset([":", ",", "}", "(", "?", "=", "<"])
_LINE_GOES_ON = frozenset(": | & => < , ( [ { = ? .".split())
HOT_COPIES = 100_000  # groups of so many records are told to the tasks, so that their rows need not meet in one
_CODE = (".ts", ".tsx", ".js", ".cjs", ".json")


def plain_form(text: str) -> str:
    """Letters and digits only, in lower case."""
    return "".join(_ALNUM.findall(text.lower()))


def _is_object(t: Tokens, i: int) -> bool:
    """Whether the brace at token i, which stands after an operator, holds members and not statements."""
    kind = t.kind
    close = t.match[i]
    if close <= i + 1:
        return close == i + 1
    first = kind[i + 1]
    if first in _MEMBER_START:
        return True
    if not (first == "NAME" or first.isalpha()):
        return False
    second = kind[i + 2]
    if second in _AFTER_NAME:
        return second != "=" or False
    return second == "NAME" or second.isalpha() and first in ("get", "set", "async", "readonly", "static")


def _unordered(t: Tokens) -> set[int]:
    """Token places of the braces whose members may stand in any order."""
    out: set[int] = set()
    kind = t.kind
    for i, k in enumerate(kind):
        if k == "{" and t.match[i] > i:
            before = kind[i - 1] if i else ""
            if (not before or before in _BEFORE_OBJECT) and _is_object(t, i):
                if before == "=>":  # a block, unless it only looks like members of a type
                    continue
                out.add(i)
        elif k == "interface" and kind[i + 1] not in ("=", ".", ":", ")", ",", ";"):
            j = i + 1
            while kind[j] not in ("{", "EOF", ";", "}"):
                j += 1
            if kind[j] == "{" and t.match[j] > j:
                out.add(j)
    return out


class _Form:
    """Canonical text and digest of a token range."""

    def __init__(self, tokens: Tokens):
        self.t, self.free = tokens, _unordered(tokens)

    def ordered(self, a: int, b: int) -> tuple[str, bytes]:
        """Tokens a..b (exclusive) in order, with the gaps (comments) before each of them."""
        t, parts, digest = self.t, [], hashlib.blake2b(digest_size=16)
        i = a
        begin = t.end[a - 1] if a else 0
        plain_from = begin
        while i < b:
            if i in self.free:
                leaf = plain_form(t.text[plain_from : t.start[i]])
                text, child = self.members(i)
                if leaf:
                    parts.append(leaf)
                    digest.update(leaf.encode("utf-8", "surrogatepass"))
                parts.append(text)
                digest.update(b"\x00" + child)
                i = t.match[i]
                plain_from = t.end[i]
            i += 1
        leaf = plain_form(t.text[plain_from : t.end[b - 1] if b > a else begin])
        if leaf:
            parts.append(leaf)
            digest.update(leaf.encode("utf-8", "surrogatepass"))
        return "".join(parts), digest.digest()

    def members(self, i: int) -> tuple[str, bytes]:
        """The members of the unordered node that opens at token i, sorted by their digests."""
        t, close = self.t, self.t.match[i]
        children: list[tuple[bytes, str]] = []
        begin = k = i + 1
        while k <= close:
            kind = t.kind[k]
            ends = k == close or kind in (",", ";")
            fresh = not ends and k > begin and t.newline[k] and t.kind[k - 1] not in _LINE_GOES_ON and kind not in ("|", "&", "=>", ":", "?", ".", ",", ")", "]", "}", "(")
            if ends or fresh:
                if k > begin:
                    text, child = self.ordered(begin, k)
                    if text:
                        children.append((child, text))
                begin = k if fresh else k + 1
            if kind in ("(", "[", "{", "THEAD") and k < t.match[k] <= close and k != close:
                k = t.match[k]
            k += 1
        tail = plain_form(t.text[t.end[close - 1] : t.start[close]])  # a comment after the last member
        if tail:
            children.append((hashlib.blake2b(tail.encode("utf-8", "surrogatepass"), digest_size=16).digest(), tail))
        children.sort()
        digest = hashlib.blake2b(digest_size=16)
        for child, _ in children:
            digest.update(child)
        return "".join(text for _, text in children), digest.digest()


def canonical(path: str | None, content: str) -> tuple[str, str]:
    """(root digest in hex, canonical text) of a content; the language follows the path's extension."""
    name = (path or "").lower()
    if name.endswith(_CODE) and "{" in content:
        tokens = lex_js(content, name.endswith(".tsx"))
        form = _Form(tokens)
        if form.free:
            text, root = form.ordered(0, len(tokens.kind))
            return root.hex(), text
    text = plain_form(content)
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest(), text


CANONICAL_SCHEMA = "row_id long, digest string, canonical string"


def _canonical_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sys.setrecursionlimit(1_000_000)
    for pdf in batches:
        forms = [canonical(p, c) for p, c in zip(pdf["file_path"], pdf["content"])]
        yield pd.DataFrame({"row_id": pdf["row_id"], "digest": [f[0] for f in forms], "canonical": [f[1] for f in forms]})


def canonical_rows(chunks: DataFrame) -> DataFrame:
    """Each record once with its root digest and canonical text. Rows without row_id or content are left out."""
    ready = chunks.select("row_id", "file_path", "content").dropna(subset=["row_id", "content"])
    once = ready.repartition(task_count(chunks.sparkSession), "row_id").dropDuplicates(["row_id"])
    return once.mapInPandas(_canonical_batches, CANONICAL_SCHEMA)


def copy_groups(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of equal records: (group, first_row, copies), and the canonical rows they were formed from.

    A group's key is its digest and the full canonical text; equal keys combine
    before the shuffle, so a text with very many copies costs a row a task.
    """
    rows = cut(canonical_rows(chunks))
    return rows.groupBy("digest", "canonical").agg(F.min("row_id").alias("first_row"), F.count(F.lit(1)).alias("copies")), rows


def equal_records(chunks: DataFrame) -> DataFrame:
    """first_row, copy_row: the smallest row_id of each group and each other one; a record alone gives no row."""
    groups, rows = copy_groups(chunks)
    several = cut(groups.filter("copies > 1"))
    by_digest = several.groupBy("digest").agg(F.min("first_row").alias("first_row"), F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("copies"))
    # One text a digest, but for a collision: then the text itself decides.
    single, places = by_digest.filter("texts = 1"), rows.select("row_id", "digest")
    hot = F.broadcast(single.filter(F.col("copies") >= HOT_COPIES).select("digest", "first_row"))  # at most a row for each HOT_COPIES records
    cold = places.join(hot, "digest", "left_anti").join(single.filter(F.col("copies") < HOT_COPIES).select("digest", "first_row"), "digest")
    clear = places.join(hot, "digest").unionByName(cold).select("first_row", F.col("row_id").alias("copy_row"))
    collided = by_digest.filter("texts > 1").select("digest")
    unclear = rows.join(collided, "digest", "left_semi").join(several.select("digest", "canonical", "first_row"), ["digest", "canonical"]).select("first_row", F.col("row_id").alias("copy_row"))
    return clear.unionByName(unclear).filter("copy_row <> first_row")


def collapsed_records(chunks: DataFrame) -> DataFrame:
    """One row for each distinct record: first_row, copies, digest, canonical_chars."""
    groups, _ = copy_groups(chunks)
    return groups.select("first_row", "copies", "digest", F.length("canonical").alias("canonical_chars"))
